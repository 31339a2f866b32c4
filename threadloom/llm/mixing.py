"""Mixing sources to target weights.

Every document gets a hash-random key.  Each source is range-partitioned on that key (a uniform key is split
by its leading bits, so ranges are even and need no sampling), sums of the ranges are added up, and a running
sum inside each range completes the prefix sum.  The mix cuts each source where the prefix sum reaches its
budget; budgets above a source's size repeat the whole source first.

Nulls and edge cases: a null source is a source of its own, ordered last; a null text has size 0; rows without
an id get their key from the text; repeated rows are rows like others; an empty table gives no rows; other columns of
the input are left out of the plan's shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import WORD, positions, saved

#: Rows per range of a source, about.
RANGE_ROWS = 4096
#: Ranges whose sums meet in one task: two to this power.
LEVEL_BITS = 12


def words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target of each source from (source, source_size, ...).

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size and the excess is shared again.  Only two sums per
    step come to the driver, however many sources there are.
    """
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("position") % len(weights)).cast("int") + 1)
    ranked = saved(positions(sizes, [F.col("source").asc_nulls_last()], "sources").withColumn("weight", turn).drop("position"), "weights")
    cap = F.lit(most) * F.col("source_size")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    rest, weight = total, None
    while True:
        free = F.lit(True) if weight is None else F.col("weight") * F.lit(rest) / F.lit(weight) <= cap
        capped, left = ranked.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        now = (total - (capped or 0), left)
        if now == (rest, weight) or not left:
            break
        rest, weight = now
    level = F.col("weight") * F.lit(float(rest)) / F.lit(weight) if weight else F.lit(0.0)
    return ranked.withColumn("target", F.least(level, cap.cast("double"))).drop("weight")


def _starts(ranges: DataFrame) -> DataFrame:
    """(s, r, start): the sum of n over all ranges of a source before this one, from (source, above, range, n).

    In two levels: ranges of one ``above`` are summed up in one task, and so are the sums of these.
    """
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranges.groupBy("source", "above").agg(F.sum("n").alias("n"))
    tops = tops.select(F.col("source").alias("_s"), F.col("above").alias("_a"), F.coalesce(F.sum("n").over(before("source", "above")), F.lit(0)).alias("_top"))
    own = ranges.withColumn("_own", F.coalesce(F.sum("n").over(before("source", "above", "range")), F.lit(0)))
    own = own.join(tops, own["source"].eqNullSafe(tops["_s"]) & (own["above"] == tops["_a"]))
    return own.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("_top") + F.col("_own")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken) of every row of (doc_id, source, text), and the
    columns named in ``carry``.

    ``epochs``: how often the whole document is taken; ``part``: leading words of one more copy, less than
    ``size`` only for the document in which the budget ends.  taken = epochs * size + part.
    """
    # rows without an id are told apart by their text, so that they don't share one key
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))))
    rows = saved(docs.select("doc_id", "source", *carry, words(F.col("text")).alias("size"), key.alias("key")), "sizes")
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, share, most)
    aim = saved(aim.withColumn("bits", F.least(F.lit(31), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / RANGE_ROWS)))).cast("int")), "targets")
    same = rows["source"].eqNullSafe(aim["source"])
    # the leading bits of the key: of 32, so many that a range holds about RANGE_ROWS rows
    dealt = rows.join(aim, same).drop(aim["source"]).withColumn("range", F.expr("shiftright(bigint(conv(substring(key, 1, 8), 16, 10)), 32 - bits)"))
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("n"))
    starts = _starts(ranges.withColumn("above", F.expr(f"shiftright(range, {LEVEL_BITS})")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    out = dealt.join(starts, dealt["source"].eqNullSafe(starts["s"]) & (dealt["range"] == starts["r"]))
    out = out.withColumn("before", before).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    out = out.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))))
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of the mix: whole documents once per epoch, and the last one of each source up to its budget.

    A cut text keeps its leading words, one space between them, and n_chars follows it.  The other columns travel as one
    struct, so that none of their names can clash.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    rows = saved(docs.select("doc_id", "source", "text", whole, F.monotonically_increasing_id().alias("number")), "rows")
    plan = mix(rows, carry=("number",), **options).filter("taken > 0").select("number", "size", "epochs", "part")
    copies = F.expr("transform(sequence(1, int(epochs + if(part > 0, 1, 0))), i -> if(i <= epochs, size, part))")
    rows = rows.join(plan.hint("merge"), "number").withColumn("take", F.explode(copies))
    cut = F.col("take") < F.col("size")
    lead = F.expr(r"array_join(slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), 1, int(take)), ' ')")
    rows = rows.withColumn("text", F.when(cut, lead).otherwise(F.col("text")))
    changed = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*((changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
               md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
w AS (SELECT source, source_size, CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, (SELECT sum(source_size) * 1.5 FROM s)::DOUBLE AS total FROM s),
c AS (SELECT *, total - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
      sum(weight) OVER (ORDER BY 2.0 * source_size / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS left_w FROM w),
l AS (SELECT rest, left_w FROM c WHERE weight * rest / left_w <= 2 * source_size ORDER BY left_w DESC LIMIT 1),
t AS (SELECT w.source, source_size, least(weight * l.rest / l.left_w, CAST(2 * source_size AS DOUBLE)) AS target FROM w, l),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      CAST(floor(target + 0.5) AS BIGINT) AS budget FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM p
"""
