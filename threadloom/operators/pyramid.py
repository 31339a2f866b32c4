"""The summary pyramid: chunks become first-level summaries, groups of them second-level ones, groups of those third-level ones.

Each level is one batch over all sessions.  Summaries: (session, ord, id, level, content, tokens, source_level, source_ids,
source_first, source_last, merged_into, created, phase); ord is their order of creation.  A summariser is a function from a
DataFrame with (prompt, transcript, target_tokens) to a Column of text; the default needs no service and always gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B

Summariser = Callable[[DataFrame], Column]
COLUMNS = ["session", "ord", "id", "level", "content", "tokens", "source_level", "source_ids", "source_first", "source_last", "merged_into", "created", "phase"]
SCHEMA = "session string, ord long, id string, level int, content string, tokens long, source_level int, source_ids array<string>, source_first string, source_last string, merged_into string, created timestamp, phase string"
MERGE_THRESHOLD, TARGET_TOKENS = 6, 2000
PRIOR_ROWS, PRIOR_TOKENS = 50, 15000

#: Prompts are configuration; these neutral ones only state the facts of what is to be summarised.
CHUNK_PROMPT = "Summarise {rows} messages ({phase}) in at most {target} tokens."
TRANSITION_PROMPT = "Summarise what precedes this change of topic in at most {target} tokens."
MERGE_PROMPT = "Summarise {rows} summaries of level {level} ({phase}) in at most {target} tokens."


def extractive(rows: DataFrame) -> Column:
    """The beginning of each paragraph of the transcript, up to the target length."""
    return F.expr("left(array_join(transform(filter(split(transcript, '\\n'), x -> trim(x) <> '' and not startswith(x, '<')), x -> left(x, 80)), ' '), int(4 * target_tokens))")


def filled(template: str, **values: Column | int | str) -> Column:
    """A prompt: the template's {names} replaced by values, which may differ from row to row."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("any phase")) if isinstance(value, Column) else F.lit(str(value)))
    return out


def instruction(phase: Column, target: int, rows: Column | int = 1, template: str = CHUNK_PROMPT) -> Column:
    """What a summariser is asked to write about a chunk."""
    return filled(template, phase=phase, target=target, rows=rows)


def phase_histogram(sources: DataFrame, by: list[str]) -> DataFrame:
    """(by..., phases): "3 research, 1 lesson", in the order of first appearance; no phase counts as unknown."""
    counts = sources.withColumn("_p", F.coalesce("phase", F.lit("unknown"))).groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("ord").alias("_o"))
    ordered = F.array_sort(F.collect_list(F.struct("_o", "_c", "_p")))
    return counts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["_c"].cast("string"), F.lit(" "), x["_p"])), ", ").alias("phases"))


def merge_instruction(level: int, target: int, phases: Column | None = None, rows: Column | int = 1, template: str = MERGE_PROMPT) -> Column:
    """What a summariser is asked to write about summaries of the level below."""
    return filled(template, level=level - 1, target=target, rows=rows, phase=F.lit("any phase") if phases is None else phases)


def compress(pending: DataFrame, summaries: DataFrame, target: int = TARGET_TOKENS, summarise: Summariser = extractive) -> DataFrame:
    """First-level summaries of pending chunks (session, chunk_no, msg_ids, transcript, phase).

    A chunk whose messages already have a summary, in the same order, gets none.
    """
    made = summaries.filter("level = 1").select("session", F.col("source_ids").alias("msg_ids")).distinct()
    fresh = pending.join(made, ["session", "msg_ids"], "left_anti")
    start = summaries.groupBy("session").agg((F.max("ord") + 1).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy("chunk_no")) - 1
    fresh = fresh.join(start, "session", "left").withColumn("ord", (F.coalesce("_start", F.lit(0)) + rank).cast("long"))
    fresh = fresh.withColumn("target_tokens", F.lit(target)).withColumn("prompt", instruction(F.col("phase"), target, F.size("msg_ids")))
    return _rows(fresh.withColumn("content", summarise(fresh)), 1, F.col("msg_ids"), F.element_at("msg_ids", 1), F.element_at("msg_ids", -1), F.col("phase"))


def _rows(df: DataFrame, level: int, ids: Column, first: Column, last: Column, phase: Column) -> DataFrame:
    return df.select("session", "ord", F.concat(F.lit(f"L{level}-"), F.col("ord").cast("string")).alias("id"), F.lit(level).alias("level"), "content", B.estimate_text("content").alias("tokens"), F.lit(level - 1).alias("source_level"), ids.alias("source_ids"), first.alias("source_first"), last.alias("source_last"), F.lit(None).cast("string").alias("merged_into"), F.current_timestamp().alias("created"), phase.alias("phase"))


def due_merges(summaries: DataFrame, level: int, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """Full groups of the oldest unmerged summaries of a level: (session, group_no, id, ord, ...)."""
    alive = summaries.filter((F.col("level") == level) & F.col("merged_into").isNull())
    group = F.floor((F.row_number().over(Window.partitionBy("session").orderBy("ord")) - 1) / threshold)
    alive = alive.withColumn("group_no", group)
    return alive.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("session", "group_no"))).filter(F.col("_c") == threshold).drop("_c")


def merge(summaries: DataFrame, level: int, threshold: int = MERGE_THRESHOLD, target: int = TARGET_TOKENS, summarise: Summariser = extractive, phases: bool = False) -> DataFrame:
    """All summaries after merging full groups of level - 1: sources point to their merger, which has no phase."""
    due = due_merges(summaries, level - 1, threshold)
    parts = F.array_sort(F.collect_list(F.struct("ord", "id", "content", "source_first", "source_last")))
    groups = due.groupBy("session", "group_no").agg(parts.alias("p"))
    if phases:
        groups = groups.join(phase_histogram(due, ["session", "group_no"]), ["session", "group_no"])
    start = summaries.groupBy("session").agg((F.max("ord") + 1).alias("_start"))
    groups = groups.join(start, "session").withColumn("ord", (F.col("_start") + F.row_number().over(Window.partitionBy("session").orderBy("group_no")) - 1).cast("long"))
    groups = groups.withColumn("target_tokens", F.lit(target)).withColumn("prompt", merge_instruction(level, target, F.col("phases") if phases else None, F.size("p"))).withColumn("transcript", F.array_join(F.transform("p", lambda x: x["content"]), "\n"))
    made = _rows(groups.withColumn("content", summarise(groups)), level, F.transform("p", lambda x: x["id"]), F.col("p")[0]["source_first"], F.element_at("p", -1)["source_last"], F.lit(None).cast("string"))
    links = made.select("session", F.explode("source_ids").alias("id"), F.col("id").alias("_into")).select("session", "id", "_into")
    marked = summaries.join(links, ["session", "id"], "left").withColumn("merged_into", F.coalesce("merged_into", "_into")).select(*COLUMNS)
    return marked.unionByName(made.select(*COLUMNS))


def resolve(summaries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session, group_no, ord, ...) of the summaries that (session, group_no, source_ids) name, in that order; groups with a
    missing one are left out whole."""
    ids = wanted.select("session", "group_no", F.size("source_ids").alias("_n"), F.posexplode("source_ids").alias("place", "id"))
    found = ids.join(summaries, ["session", "id"])
    return found.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("session", "group_no"))).filter("_c = _n").drop("_c", "_n")


def stats(summaries: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Per session: summaries of each level, those not merged, and chunks (all, compressed)."""
    s = summaries.groupBy("session").agg(*(F.count_if(F.col("level") == k).alias(f"l{k}") for k in (1, 2, 3)), *(F.count_if((F.col("level") == k) & F.col("merged_into").isNull()).alias(f"l{k}_unmerged") for k in (1, 2, 3)))
    if chunks is None:
        return s
    c = chunks.groupBy("session").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("compressed").alias("compressed_chunks"))
    return s.join(c, "session", "full_outer").na.fill(0)


def readiness(summaries: DataFrame, chunks: DataFrame, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """(session, pending_chunks, pending_merges, ready)."""
    waiting = chunks.groupBy("session").agg(F.count_if(~F.col("compressed")).alias("pending_chunks"))
    merges = due_merges(summaries, 1, threshold).unionByName(due_merges(summaries, 2, threshold)).select("session", "level", "group_no").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("pending_merges"))
    out = waiting.join(merges, "session", "full_outer").na.fill(0)
    return out.withColumn("ready", (F.col("pending_chunks") == 0) & (F.col("pending_merges") == 0))


def prior_rows(measured: DataFrame, starts: DataFrame) -> DataFrame:
    """Raw rows in front of a chunk: at most PRIOR_ROWS, newest first, until PRIOR_TOKENS are reached by those after.

    ``starts``: (session, chunk_no, start_pos).  Adds chunk_no and back (1: the nearest).
    """
    wanted = starts.filter("start_pos > 0").select("session", "chunk_no", F.explode(F.expr(f"sequence(greatest(0, int(start_pos) - {PRIOR_ROWS}), int(start_pos) - 1)")).alias("pos"))
    rows = measured.join(wanted, ["session", "pos"])
    order = Window.partitionBy("session", "chunk_no").orderBy(F.desc("pos"))
    rows = rows.withColumn("back", F.row_number().over(order)).withColumn("_t", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.filter(F.col("_t") < PRIOR_TOKENS).drop("_t")


def transition_text(zoned: DataFrame, summaries: DataFrame | None = None, limit: int = 8000) -> DataFrame:
    """(session, head_text, top_text): head rows as "participant: text" while they fit, and the last three higher summaries."""
    rows = zoned.filter("pos >= head_start and pos < head_end").withColumn("_e", F.concat("participant", F.lit(": "), B.extract_text()))
    order = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # characters so far, with the blank line before every entry but the first
    size = F.sum(F.length("_e") + 2).over(order) - 2
    rows = rows.withColumn("_sum", size).withColumn("_before", F.col("_sum") - F.length("_e") - F.when(F.row_number().over(Window.partitionBy("session").orderBy("pos")) == 1, 0).otherwise(2))
    rows = rows.withColumn("_fits", F.col("_before") + F.length("_e") <= limit)
    stop = F.min(F.when(~F.col("_fits"), F.col("pos"))).over(Window.partitionBy("session"))
    rows = rows.withColumn("_stop", stop)
    kept = F.filter(F.array_sort(F.collect_list(F.when(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")), F.struct("pos", "_e")))), lambda x: x.isNotNull())
    head = rows.groupBy("session").agg(F.concat(F.array_join(F.transform(kept, lambda x: x["_e"]), "\n\n"), F.when(F.max("_stop").isNotNull(), F.lit("\n\n[...truncated...]")).otherwise("")).alias("head_text"))
    if summaries is None:
        return head.withColumn("top_text", F.lit(""))
    high = summaries.filter("level >= 2").withColumn("_k", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ord")))).filter("_k <= 3")
    high = high.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), B.SEPARATOR).alias("top_text"))
    return head.join(high, "session", "full_outer").na.fill("")
