"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and gives
the reread table to the next stage.  All stages but the last return the columns of documents.  A stage first deletes the
helper tables of the stage before: its docs are that one's written result, so nothing reads them any more.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names: as the operators' docstrings
say.  In short: texts without words fail the quality rules, so later stages meet none; null sources, languages and ids are
values like others; of repeated rows one stays; other columns are carried along under any name.
"""

from __future__ import annotations

import threading
from functools import wraps

from threadloom.llm import decontaminate, mixing, near_duplicates, quality, token_ids
from threadloom.llm.common import handed_out, release, saved, table
from threadloom.llm.queries import tokenizer_path


#: Per thread, so that two runs at once keep apart.
_left = threading.local()


def stage(f):
    @wraps(f)
    def run_stage(spark, docs, sf_dir):
        release(spark, getattr(_left, "paths", []))
        before = set(handed_out())
        found = f(spark, docs, sf_dir)
        _left.paths = [path for path in handed_out() if path not in before]
        return found

    return run_stage


@stage
def quality_rules(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality.kept(docs)


@stage
def near_duplicate_join(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest id stays."""
    return near_duplicates.distinct(docs)


@stage
def benchmark_decontamination(spark, docs, sf_dir):
    """Documents with a benchmark passage of 13 words go, however long they are; short items condemn those that are a twentieth them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def target_mix(spark, docs, sf_dir):
    """Documents are taken, and repeated, up to each source's budget."""
    return mixing.mixed(docs)


@stage
def token_id_files(spark, docs, sf_dir):
    """Texts become shards of token ids, which stay when helper tables go; rows tell what the files hold."""
    return token_ids.decode(token_ids.encode(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", target_mix),
    ("token ids", token_id_files),
]

#: SQL has no tokenizer, so the last stage can't be expressed; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        before = set(handed_out())
        docs = saved(function(spark, docs, sf_dir), name.replace(" ", "-"))
        made = [path for path in handed_out() if path not in before]
        # the table that saved() made last is the stage's result; the rest, and what the stage has read, are done with
        release(spark, [*spent, *made[:-1]])
        spent = made[-1:]
    return docs
