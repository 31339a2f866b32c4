"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

Logs often hold a conversation again at each turn.  Every turn is hashed with its place, and the running
exclusive or of these hashes (two of 64 bits) names each prefix.  A conversation whose whole is a proper prefix of another is
dropped by an anti-join, and of equal ones that with the smallest conv_id stays.  Only hashes are compared; texts are
shuffled once, for the conversations that remain.  All of it is DataFrame operations.

Nulls and edge cases: turns are ordered by turn (null first), then by a hash of their content, so ties and repeated
rows have one order; null roles and texts differ from empty ones and render as empty; a null conv_id is a
conversation like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _content(salt: int) -> F.Column:
    return F.xxhash64(F.lit(salt), F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit("")))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations of (conv_id, turn, role, text) that no other one extends.

    n_copies: other conversations equal to this one.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    till = order.rowsBetween(Window.unboundedPreceding, 0)
    t = turns.select("conv_id", "turn", _content(1).alias("a"), _content(2).alias("b"))
    t = t.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead("n").over(order).isNull())
    t = t.select("conv_id", "n", "last", *(F.bit_xor(F.xxhash64("n", c)).over(till).alias(c) for c in "ab"))
    t = saved(t, "prefixes")
    whole = t.filter("last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = t.filter("not last").select("n", "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), (F.col("copies") - 1).alias("n_copies"))


def render(turns: DataFrame, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    chosen = saved(maximal(turns), "maximal").withColumnRenamed("conv_id", "_c")
    rows = turns.select("conv_id", F.struct("turn", _content(1).alias("a"), _content(2).alias("b"), "role", "text").alias("t"))
    rows = rows.join(chosen.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")))
    whole = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lines = F.transform("t", lambda x: F.concat(F.lit(opening), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(closing)))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(lines, "\n").alias("rendered"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
           md5(concat(role IS NULL, coalesce(role, ''), chr(31), text IS NULL, coalesce(text, ''))) AS h FROM conversations),
p AS (SELECT conv_id, pos, n, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM t),
f AS (SELECT min(conv_id) AS conv_id, count(*) - 1 AS n_copies, any_value(n) AS n_turns, k FROM p WHERE pos = n GROUP BY k),
m AS (SELECT * FROM f WHERE k NOT IN (SELECT k FROM p WHERE pos < n))
SELECT m.conv_id, n_turns, n_copies, string_agg(concat('{OPEN}', role, chr(10), text, '{CLOSE}'), chr(10) ORDER BY turn) AS rendered
FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
"""
