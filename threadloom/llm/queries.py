"""The operators of this subpackage bound to the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm import chat, decontaminate, language, mixing, near_duplicates, quality, suffix_dedup, token_ids, toxicity, warc
from threadloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark, sf_dir):
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    found = suffix_dedup.cleaned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*quality.RESULT)


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(*decontaminate.RESULT)


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_token_ids(spark, sf_dir):
    return token_ids.decode(token_ids.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark, sf_dir):
    return near_duplicates.join(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_quality": op2_quality, "op3_decontaminate": op3_decontaminate, "op4_mixing": op4_mixing, "op5_chat": op5_chat, "op6_language": op6_language, "op7_token_ids": op7_token_ids, "op8_toxicity": op8_toxicity, "op9_near_duplicates": op9_near_duplicates, "op10_warc": op10_warc}

ORACLE_SQL = {"op2_quality": quality.sql(), "op3_decontaminate": decontaminate.SQL, "op4_mixing": mixing.SQL, "op5_chat": chat.SQL}
