"""Window boundaries of a conversation: head, compressible middle, recent.

All of them are windows over one partitioning by session.  Token counts must not be negative, which is what makes a
loop that stops at the first overflow equal to a filter on a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from threadloom.functions import blocks as B


def session() -> WindowSpec:
    return Window.partitionBy("session")


def forward() -> WindowSpec:
    """A session's rows up to the current one."""
    return session().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def backward() -> WindowSpec:
    """A session's rows from the last down to the current one."""
    return session().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)


def measured(messages: DataFrame, estimator: Column | None = None, utf16: bool = False) -> DataFrame:
    """Add tokens, text_tokens, has_use and has_result; ``estimator`` replaces the full estimate and must not be negative."""
    full = B.full_tokens("content", utf16) if estimator is None else F.when(estimator >= 0, estimator.cast("long")).otherwise(F.raise_error(F.lit("a token estimate is negative")))
    return messages.withColumns({"tokens": full, "text_tokens": B.text_only_tokens("content", utf16), "has_use": B.has_tool_use(), "has_result": B.has_tool_result()})


def last_marker(messages: DataFrame) -> DataFrame:
    """(session, anchor_id): the last topic marker of each session that has one."""
    return messages.filter(B.is_transition()).groupBy("session").agg(F.max_by("msg_id", "pos").alias("anchor_id"))


def anchored(messages: DataFrame, anchors: DataFrame | None) -> DataFrame:
    if anchors is None:
        return messages if "anchor_id" in messages.columns else messages.withColumn("anchor_id", F.lit(None).cast("string"))
    return messages.drop("anchor_id").join(anchors.select("session", "anchor_id"), "session", "left")


def zoned(messages: DataFrame, head_tokens: int, recent_tokens: int, anchors: DataFrame | None = None) -> DataFrame:
    """Add n, head_start, head_end, recent_start and zone (head, middle, recent) to measured messages.

    The head starts at the anchor, or at 0 if there is none or it is gone, and ends before the first row whose prefix sum
    exceeds its tokens; one row earlier if that would part a tool use from what follows.  The recent window starts after the
    last row whose suffix sum exceeds its tokens; one row earlier if it would start with a tool result.
    """
    m = anchored(messages, anchors)
    at = F.when(F.col("msg_id") == F.col("anchor_id"), F.col("pos"))
    m = m.withColumn("n", F.count(F.lit(1)).over(session())).withColumn("head_start", F.coalesce(F.max(at).over(session()), F.lit(0)))
    in_head = F.col("pos") >= F.col("head_start")
    m = m.withColumn("_prefix", F.sum(F.when(in_head, F.col("tokens")).otherwise(0)).over(forward())).withColumn("_suffix", F.sum("tokens").over(backward()))
    m = m.withColumn("_end", F.coalesce(F.min(F.when(in_head & (F.col("_prefix") > head_tokens), F.col("pos"))).over(session()), F.col("n")))
    m = m.withColumn("_start", F.coalesce(F.max(F.when(F.col("_suffix") > recent_tokens, F.col("pos"))).over(session()) + 1, F.lit(0)))
    parted = F.max((F.col("pos") == F.col("_end") - 1) & F.col("has_use")).over(session()) & (F.col("_end") < F.col("n")) & (F.col("_end") > F.col("head_start"))
    orphan = F.max((F.col("pos") == F.col("_start")) & F.col("has_result")).over(session()) & (F.col("_start") > 0)
    m = m.withColumn("head_end", (F.col("_end") - parted.cast("int")) if head_tokens > 0 else F.lit(0))
    m = m.withColumn("recent_start", F.col("_start") - orphan.cast("int"))
    zone = F.when(F.col("pos") >= F.greatest("recent_start", "head_end"), "recent").when(in_head & (F.col("pos") < F.col("head_end")), "head").otherwise("middle")
    return m.withColumn("zone", zone).drop("_prefix", "_suffix", "_end", "_start").withColumns({c: F.col(c).cast("long") for c in ("head_start", "head_end", "recent_start")})


def compressible(zoned_messages: DataFrame) -> DataFrame:
    """Rows before the recent window and outside the head, renumbered from 0 as ``idx``."""
    rows = zoned_messages.filter((F.col("pos") < F.col("recent_start")) & ~((F.col("pos") >= F.col("head_start")) & (F.col("pos") < F.col("head_end"))))
    return rows.withColumn("idx", F.row_number().over(session().orderBy("pos")) - 1)
