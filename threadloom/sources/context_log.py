"""The context log: the working set derived from messages.

Entries are ordered by seq; their index is computed on reading and never stored, so it cannot go stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B

ENTRIES = f"session string, entry_id string, seq long, source_msg_id string, source_relation string, participant string, content {B.CONTENT}, cache_marker boolean"
RELATIONS = ("copy", "derived", "referenced")


def indexed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("index", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)


def by_source(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """Entries of the given (session, msg_id), with their index and relation."""
    return indexed(entries).join(messages.select("session", F.col("msg_id").alias("source_msg_id")), ["session", "source_msg_id"])


def source_relations(entries: DataFrame) -> DataFrame:
    """(session, source_msg_id, relations): of each source a map from entry index to relation."""
    at = indexed(entries).filter("source_msg_id is not null and source_relation is not null")
    return at.groupBy("session", "source_msg_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("index", "source_relation")))).alias("relations"))


def edit(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the content of (session, entry_id, content)."""
    new = changes.select("session", "entry_id", F.col("content").alias("_new"))
    return entries.join(new, ["session", "entry_id"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new").select(*entries.columns)


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("session", "entry_id"), ["session", "entry_id"], "left_anti")


def remove_range(entries: DataFrame, start: int, end: int) -> DataFrame:
    """Without the indexes from start to before end."""
    return indexed(entries).filter(~((F.col("index") >= start) & (F.col("index") < end))).drop("index")


def replace_all(entries: DataFrame, sessions: DataFrame, new: DataFrame) -> DataFrame:
    """All entries of these sessions give way to the new ones."""
    return entries.join(sessions.select("session").distinct(), "session", "left_anti").unionByName(new.select(*entries.columns))


def propagate_edits(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Edited messages (session, msg_id, content) reach copies, and entries without a relation; others keep what they have."""
    new = changes.select("session", F.col("msg_id").alias("source_msg_id"), F.col("content").alias("_new"))
    follows = F.coalesce("source_relation", F.lit("copy")) == "copy"
    out = entries.join(new, ["session", "source_msg_id"], "left")
    return out.withColumn("content", F.when(follows, F.coalesce("_new", "content")).otherwise(F.col("content"))).select(*entries.columns)


def propagate_removals(entries: DataFrame, gone: DataFrame, ranges: bool = False) -> DataFrame:
    """Removed messages (session, msg_id) take their copies along; derived and referenced entries stay.

    Range removals do not reach entries unless ``ranges`` asks for it: their rows carry ``op`` = 'remove_range'.
    """
    if "op" in gone.columns and not ranges:
        gone = gone.filter("op <> 'remove_range'")
    gone = gone.select("session", F.col("msg_id").alias("_gone"), F.lit(True).alias("_copy")).withColumnRenamed("session", "_s")
    follows = F.coalesce(entries["source_relation"], F.lit("copy")) == "copy"
    return entries.join(gone, (entries["session"] == gone["_s"]) & (entries["source_msg_id"] == gone["_gone"]) & follows, "left_anti")
