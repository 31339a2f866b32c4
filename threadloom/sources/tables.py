"""Message logs made from the tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.sources import message_log

#: Tool that each kind of event stands for; an error is a tool's result (fixed values).
EVENT_TOOLS = {"click": "mcpl:click", "view": "zulip:view", "purchase": "lessons:create", "signup": "subagent:spawn"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; a temporary one on a single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts a plan that later steps would repeat, at a table that outlives executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, msg_id, pos, participant, content): one text block a turn."""
    c = table(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select(F.col("conv_id").cast("string").alias("session"), F.concat_ws("-", "conv_id", "turn").alias("msg_id"), pos.alias("pos"), F.col("role").alias("participant"), B.text_content(F.col("text")).alias("content"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, msg_id, pos, participant, content, metadata_json): tool calls of users, and errors as results."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    tool = F.create_map(*(F.lit(x) for pair in EVENT_TOOLS.items() for x in pair))[F.col("event_type")]
    compact = F.replace(F.replace("props", F.lit(": "), F.lit(":")), F.lit(", "), F.lit(","))
    use = B.block(type="tool_use", name=tool, input_json=compact, tool_id=F.col("event_id").cast("string"))
    result = B.block(type="tool_result", result_text=F.col("props"), tool_use_id=F.col("event_id").cast("string"))
    content = F.when(tool.isNull(), F.array(result)).otherwise(F.array(use))
    return e.select(F.col("user_id").cast("string").alias("session"), F.concat(F.lit("ev-"), "event_id").alias("msg_id"), pos.alias("pos"), F.when(tool.isNull(), "user").otherwise("assistant").alias("participant"), content.alias("content"), F.col("props").alias("metadata_json"))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations over conversations: adds at 10 * turn, edits of every third turn at 1000 + turn, removals of every fifth at
    2000 + turn, and the first two turns of every fourth conversation removed as a range at 3000."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("msg_id"), F.col("role").alias("participant"), "text")
    add = message_log.adds(c.withColumn("seq", 10 * F.col("turn")).withColumn("content", B.text_content(F.col("text"))))
    edit = message_log.adds(c.filter("turn % 3 = 1").withColumn("seq", 1000 + F.col("turn")).withColumn("content", B.text_content(F.concat(F.lit("edited: "), "text")))).withColumn("op", F.lit("edit"))
    gone = message_log.adds(c.filter("turn % 5 = 4").withColumn("seq", 2000 + F.col("turn")).drop("text")).withColumn("op", F.lit("remove"))
    span = c.filter("turn = 0 and conv_id % 4 = 0").withColumn("seq", F.lit(3000)).withColumn("to_msg_id", F.concat_ws("-", "conv_id", F.lit(1)))
    return add.unionByName(edit).unionByName(gone).unionByName(message_log.adds(span.drop("text")).withColumn("op", F.lit("remove_range")))


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded pyramid for each source of documents: levels by id, each higher summary naming its two predecessors."""
    d = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    level = F.when(F.col("doc_id") % 10 == 9, 3).when(F.col("doc_id") % 10 >= 7, 2).otherwise(1)
    phase = F.element_at(F.array(*(F.lit(x) for x in ("research", "synthesis", "lesson", "subagent", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    s = d.withColumn("ord", F.row_number().over(order).cast("long") - 1).withColumn("level", level)
    kids = F.filter(F.array(F.lag("doc_id", 2).over(order), F.lag("doc_id", 1).over(order)), lambda x: x.isNotNull())
    merged = F.when(F.col("doc_id") % 7 == 0, F.lit("gone"))
    return s.select(F.col("source").alias("session"), "ord", F.col("doc_id").cast("string").alias("id"), "level", F.col("text").alias("content"), F.floor(F.col("n_chars") / 40).cast("long").alias("tokens"), (F.col("level") - 1).alias("source_level"), F.transform(kids, lambda x: x.cast("string")).alias("source_ids"), F.lit(None).cast("string").alias("source_first"), F.lit(None).cast("string").alias("source_last"), merged.alias("merged_into"), F.lit(None).cast("timestamp").alias("created"), phase.alias("phase"))
