"""The pipeline's rows against the operators' brute-force versions, stage by stage."""

import zlib

import duckdb
import numpy as np
import pandas as pd
from conftest import SF
from test_llm_brute import near_brute

import corpus_pipeline
from threadloom.llm import decontaminate, mixing, quality, queries
from threadloom.llm.common import table


def run_sql(docs, sql, **tables):
    con = duckdb.connect()
    con.register("documents", docs)
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchdf()


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents").toPandas()
    benchmark = pd.read_parquet(f"{SF}/benchmark.parquet")
    verdict = run_sql(docs, quality.sql()).set_index("doc_id")["kept"]
    docs = docs[docs["doc_id"].map(verdict)]
    near = near_brute(list(zip(docs["doc_id"], docs["text"])))
    docs = docs[[near[i][2] == i if i in near else True for i in docs["doc_id"]]]
    hit = run_sql(docs, decontaminate.SQL, benchmark=benchmark).set_index("doc_id")
    bad = hit["contaminated"] | (hit["n_hit"] >= 13)
    docs = docs[~docs["doc_id"].map(bad)]
    taken = run_sql(docs, mixing.SQL).set_index("doc_id")
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in zip(docs["doc_id"], docs["text"]):
        left, size = int(taken.loc[i, "taken"]), int(taken.loc[i, "size"])
        while left > 0:
            own = t if left >= size else " ".join(t.split()[:left])
            ids = np.array([*whole.encode(own, add_special_tokens=False).ids, 0], "<u4")
            want.append((i, len(ids), zlib.crc32(ids.tobytes())))
            left -= min(left, size)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(got["doc_id"], got["n_tokens"], got["ids_crc32"])) == sorted(want)
    assert sorted(got["start"]) == [0, *np.cumsum(got.sort_values("start")["n_tokens"])[:-1]]


def test_long_documents_with_one_passage_go(spark):
    item = " ".join(f"q{k}" for k in range(15))
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, f"{long} {item} {long}"), (2, long), (3, " ".join(item.split()[:12]) + " " + long), (4, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (8, item), (9, "w1 w2")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()) == [2, 3]
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"], found[1]["contaminated"]) == (19, 3, False) and found[4]["n_items"] == 2


AWKWARD = ["doc_id", "text", "lang", "source", "n_chars", "_k", "_row", "_take", "_size", "key", "row", "size", "number", "grp", "w"]


def test_stages_take_awkward_rows(spark):
    words = " ".join(f"word{k}" for k in range(80))
    plain = [(1, words, "en", "a"), (1, words, "en", "a"), (None, None, None, None), (None, "", "en", None), (2, words + " end", "en", "a"), (3, "x " * 60000, "en", "b"), (None, words.replace("word", "other"), None, None), (None, words.replace("word", "third"), None, None)]
    rows = [(*r, len(r[1] or ""), *[f"{c}{k}" for c in AWKWARD[5:]]) for k, r in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in AWKWARD[5:]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == AWKWARD and all(r["_k"][2:] == r["_take"][5:] == r["w"][1:] for r in docs.collect()), name
    texts = [r["text"] for r in docs.collect()]
    assert {words.replace("word", "other"), words.replace("word", "third")} <= set(texts) and "x " * 60000 not in texts
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(got) == len(texts) and sorted(r["start"] for r in got)[0] == 0


def test_shards_stay_and_helpers_go(spark):
    from threadloom.llm import common, token_ids

    docs = table(spark, SF, "documents").limit(20)
    before = set(common.handed_out())
    manifest = token_ids.encode(docs, queries.tokenizer_path())
    files = [r["path"] for r in manifest.collect()]
    common.release(spark, [p for p in common.handed_out() if p not in before])
    assert files and all(token_ids.read_shard(common.get_file(f))[0] for f in files)


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
