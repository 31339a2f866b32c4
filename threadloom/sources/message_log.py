"""The message log: an append-only table of operations, and views that fold it to a state.

One row per operation, partitioned by namespace; a session is one conversation.  The table is the only state: edits, removals,
time travel and branches are views over it, so readers need no index and writers only append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B

OPS = f"ns string, branch string, session string, seq long, op string, msg_id string, to_msg_id string, participant string, content {B.CONTENT}, metadata_json string, ts timestamp, caused_by array<string>"
STATE = ["session", "msg_id", "seq", "pos", "participant", "content", "metadata_json", "ts", "caused_by"]
MAIN = "main"


def empty_ops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OPS)


def adds(messages: DataFrame, ns: str = "default", branch: str = MAIN) -> DataFrame:
    """Add operations from (session, seq, msg_id, participant, content, ...)."""
    have = set(messages.columns)
    kinds = dict(x.strip().split(" ", 1) for x in OPS.replace(B.CONTENT, "@").split(", "))
    fixed = {"ns": F.lit(ns), "branch": F.lit(branch), "op": F.lit("add")}
    return messages.select(*((fixed.get(c) if c in fixed else F.col(c) if c in have else F.lit(None)).cast(B.CONTENT if kind == "@" else kind).alias(c) for c, kind in kinds.items()))


def fold(ops: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """Messages after the operations up to ``as_of``: STATE columns, pos dense from 0 in each session.

    An edit replaces content alone.  A range removal takes every message that was added between its two ends, which
    are resolved when it was logged; later messages are not touched.
    """
    if as_of is not None:
        ops = ops.filter(F.col("seq") <= as_of)
    single = ops.filter("op <> 'remove_range'").groupBy("session", "msg_id").agg(
        F.max_by(F.struct("seq", "participant", "content", "metadata_json", "ts", "caused_by"), F.when(F.col("op") == "add", F.col("seq"))).alias("added"),
        F.max_by("content", F.when(F.col("op") == "edit", F.col("seq"))).alias("edited"),
        F.max(F.when(F.col("op") == "edit", F.col("seq"))).alias("edit_seq"),
        F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("removed"),
    )
    live = single.filter(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("removed") < F.col("added.seq"))))
    live = live.select("session", "msg_id", F.col("added.seq").alias("seq"), "added.participant", F.when(F.col("edit_seq") > F.col("added.seq"), F.col("edited")).otherwise(F.col("added.content")).alias("content"), "added.metadata_json", "added.ts", "added.caused_by")
    ends = ops.filter("op = 'add'").select("session", "msg_id", F.col("seq").alias("at"))
    ranges = ops.filter("op = 'remove_range'").select("session", "seq", "msg_id", "to_msg_id")
    ranges = ranges.join(ends.withColumnRenamed("at", "low"), ["session", "msg_id"]).join(ends.select("session", F.col("msg_id").alias("to_msg_id"), F.col("at").alias("high")), ["session", "to_msg_id"])
    ranges = ranges.select(F.col("session").alias("_s"), "low", "high")
    live = live.join(ranges, (F.col("session") == F.col("_s")) & F.col("seq").between(F.col("low"), F.col("high")), "left_anti")
    return live.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).select(*STATE)


def edits(state: DataFrame, changes: DataFrame, ns: str = "default", branch: str = MAIN) -> DataFrame:
    """Edit operations from (session, msg_id, content, seq); an unknown message stops the job."""
    known = state.select("session", "msg_id", F.lit(True).alias("_known"))
    checked = changes.join(known, ["session", "msg_id"], "left")
    sure = F.when(F.col("_known"), F.col("msg_id")).otherwise(F.raise_error(F.concat(F.lit("Message not found: "), F.col("msg_id"))))
    return adds(checked.withColumn("msg_id", sure), ns, branch).withColumn("op", F.lit("edit"))


def removals(state: DataFrame, gone: DataFrame, ns: str = "default", branch: str = MAIN) -> DataFrame:
    """Remove operations from (session, msg_id, seq); an unknown message stops the job."""
    return edits(state, gone.withColumn("content", F.lit(None).cast(B.CONTENT)), ns, branch).withColumn("op", F.lit("remove"))


def range_removals(state: DataFrame, gone: DataFrame, ns: str = "default", branch: str = MAIN) -> DataFrame:
    """Range removals from (session, msg_id, to_msg_id, seq), both ends included; unknown ends stop the job."""
    first = edits(state, gone.withColumn("content", F.lit(None).cast(B.CONTENT)), ns, branch)
    last = edits(state, gone.select("session", F.col("to_msg_id").alias("msg_id"), "seq", F.lit(None).cast(B.CONTENT).alias("content")), ns, branch)
    both = first.join(last.select("session", "seq", F.col("msg_id").alias("_to")), ["session", "seq"]).withColumn("to_msg_id", F.col("_to")).drop("_to")
    return both.withColumn("op", F.lit("remove_range")).select(*first.columns)


def lookup(state: DataFrame, msg_id: str) -> DataFrame:
    return state.filter(F.col("msg_id") == msg_id)


def lookup_at(ops: DataFrame, msg_id: str, as_of: int) -> DataFrame:
    """A message as the log had it at a sequence number.

    Its position counts all messages before it, so adds, removals and ranges of all are folded; edits of others are not read.
    """
    return fold(ops.filter((F.col("msg_id") == msg_id) | (F.col("op") != "edit")), as_of).filter(F.col("msg_id") == msg_id)


def from_offset(state: DataFrame, index: int) -> DataFrame:
    """Rows from a position on; a negative one counts from the end of each session."""
    if index >= 0:
        return state.filter(F.col("pos") >= index)
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    return state.withColumn("_n", n).filter(F.col("pos") >= F.col("_n") + index).drop("_n")


def tail(state: DataFrame, count: int) -> DataFrame:
    """The last rows of each session."""
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))
    return state.withColumn("_back", back).filter(F.col("_back") <= count).drop("_back")


def length(state: DataFrame) -> DataFrame:
    return state.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


# Branches: (id, name, head, parent_id, branch_point, created)

BRANCHES = "id string, name string, head long, parent_id string, branch_point long, created timestamp"


def branch_at(state: DataFrame, msg_id: str, name: str, parent: str = MAIN) -> DataFrame:
    """Row of a new branch whose point is the sequence number of the message's add operation."""
    one = lookup(state, msg_id).select("seq")
    return one.select(F.lit(name).alias("id"), F.lit(name).alias("name"), F.col("seq").alias("head"), F.lit(parent).alias("parent_id"), F.col("seq").alias("branch_point"), F.current_timestamp().alias("created"))


def branch_ops(ops: DataFrame, branches: list[dict], branch: str) -> DataFrame:
    """Operations that a branch sees: its own, and its ancestors' up to each branch point (``branches``: rows by id, a short list)."""
    by_id = {b["id"]: b for b in branches}
    seen = F.col("branch") == branch
    limit, at = None, branch
    while at in by_id and by_id[at]["parent_id"]:
        point = by_id[at]["branch_point"]
        limit = point if limit is None else min(limit, point)
        at = by_id[at]["parent_id"]
        seen = seen | ((F.col("branch") == at) & (F.col("seq") <= limit))
    return ops.filter(seen)


# Media: stored once by the hash of their bytes


def blobs(messages: DataFrame) -> DataFrame:
    """(hash, media_type, data) of all inline media, each content once."""
    found = messages.select(F.explode(F.expr(f"filter(content, b -> coalesce({B.storable()}, false) and b.data is not null)")).alias("b"))
    found = found.select(F.unbase64("b.data").alias("data"), "b.media_type")
    return found.withColumn("hash", F.sha2("data", 256)).groupBy("hash").agg(F.min("media_type").alias("media_type"), F.any_value("data").alias("data"))


def extract_blobs(messages: DataFrame) -> DataFrame:
    """Content with inline media replaced by references to their hashes."""
    reference = B._changed("b", type="'blob_ref'", source_type="cast(null as string)", data="cast(null as string)", blob_hash="sha2(unbase64(b.data), 256)", original_type="b.type", token_estimate="cast(null as int)")
    return messages.withColumn("content", F.expr(f"transform(content, b -> case when coalesce({B.storable()}, false) and b.data is not null then {reference} else b end)"))


def resolve_blobs(messages: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Inverse of extract_blobs; a hash that is not stored stops the job.  Own token estimates are not kept."""
    parts = messages.select(*key, F.posexplode_outer("content").alias("_i", "_b"))
    data = F.when(F.col("_b.blob_hash").isNull(), F.col("_b.data")).when(F.col("data").isNotNull(), F.base64("data")).otherwise(F.raise_error(F.concat(F.lit("Blob not found: "), F.col("_b.blob_hash"))))
    parts = parts.join(stored.select(F.col("hash").alias("_h"), "data"), F.col("_b.blob_hash") == F.col("_h"), "left").withColumn("_data", data)
    back = B._changed("_b", type="_b.original_type", source_type="'base64'", data="_data", blob_hash="cast(null as string)", original_type="cast(null as string)")
    whole = parts.withColumn("_b", F.expr(f"case when _b.blob_hash is null then _b else {back} end")).filter("_i is not null")
    whole = whole.groupBy(*key).agg(F.expr("transform(array_sort(collect_list(struct(_i, _b))), x -> x._b)").alias("_content"))
    return messages.join(whole, key, "left").withColumn("content", F.coalesce("_content", "content")).drop("_content")
