"""Chunks of the compressible rows, by size or by phase.

A chunk closes on a sum that starts again with each chunk, which no window expresses: sessions, sorted, stream through a task
that carries the open chunk.  Phases are windows, known before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B

# Tools that tell phases, and how far each phase's chunks may exceed the target.
LESSON_TOOLS = ("lessons:create", "lessons:update")
RESEARCH_PREFIXES = ("mcpl:", "zulip:")
SUBAGENT_PREFIXES = ("subagent:",)
PHASE_FACTORS = {"research": 2.0, "subagent": 2.0, "synthesis": 1.5, "lesson": 1.0}
MIN_ROWS, MIN_PHASE_ROWS = 4, 2


def tool_phase(content: str = "content", lessons: tuple = LESSON_TOOLS, subagents: tuple = SUBAGENT_PREFIXES, research: tuple = RESEARCH_PREFIXES) -> Column:
    """Phase by tool names: lesson, else subagent, else research, else synthesis; null without tools."""
    names = B.tool_names(content)

    def starts(prefixes: tuple) -> Column:
        def any_of(name: Column) -> Column:
            found = F.lit(False)
            for prefix in prefixes:
                found = found | name.startswith(prefix)
            return found

        return F.exists(names, any_of)

    return F.when(F.size(names) == 0, None).when(F.exists(names, lambda x: x.isin(*lessons)), "lesson").when(starts(subagents), "subagent").when(starts(research), "research").otherwise("synthesis")


def phased(rows: DataFrame, **tools) -> DataFrame:
    """Add ``phase`` to compressible rows: of a row's tools, else (for a tool result) of the last tools before, else synthesis."""
    rows = rows.withColumn("_tool", tool_phase(**tools))
    before = Window.partitionBy("session").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(F.col("has_result"), F.last("_tool", ignorenulls=True).over(before))
    return rows.withColumn("phase", F.coalesce("_tool", carried, F.lit("synthesis"))).drop("_tool")


def phase_limits(target: int, overrides: dict[str, int] | None = None) -> dict[str, int]:
    return {phase: (overrides or {}).get(phase, int(factor * target + 0.5)) for phase, factor in PHASE_FACTORS.items()}


def _numbered(rows: DataFrame, before: Callable[[int, int, str | None, str | None], bool], after: Callable[[int, int], bool], least: int, tokens: str) -> DataFrame:
    """Rows with chunk_no, start_idx and end_idx; null for rows in no chunk.

    A session's rows stream through one task in order, numbers only, and only the open chunk is held.  It closes before a row if
    ``before`` says so of its rows, tokens and last phase and the row's, after one if ``after`` does; what remains is a chunk if it
    has ``least`` rows.  Numbers come back to the rows by an equal join on (session, idx).
    """
    phase = F.col("phase") if "phase" in rows.columns else F.lit(None).cast("string")
    thin = rows.select("session", F.col("idx").cast("long").alias("idx"), F.col(tokens).cast("long").alias("t"), phase.alias("phase"))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, no, held, total, last = None, 0, [], 0, None

        def closed(whole: bool) -> None:
            out.extend((at, i, no, held[0], held[-1] + 1) if whole else (at, i, None, None, None) for i in held)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_s", "_i", "chunk_no", "start_idx", "end_idx"])

        for batch in batches:
            for session, idx, t, p in zip(*(batch.column(c).to_pylist() for c in ("session", "idx", "t", "phase"))):
                if held and session != at:
                    closed(len(held) >= least)
                    held, total = [], 0
                if session != at:
                    at, no = session, 0
                if held and before(len(held), total, last, p):
                    closed(True)
                    no, held, total = no + 1, [], 0
                held.append(idx)
                total, last = total + t, p
                if after(len(held), total):
                    closed(True)
                    no, held, total = no + 1, [], 0
            if out:
                yield flushed()
        if held:
            closed(len(held) >= least)
        yield flushed()

    found = thin.repartition("session").sortWithinPartitions("session", "idx").mapInArrow(number, "_s string, _i long, chunk_no int, start_idx int, end_idx int")
    return rows.join(found, (F.col("session") == F.col("_s")) & (F.col("idx") == F.col("_i")), "left").drop("_s", "_i")


def by_size(rows: DataFrame, target: int, min_rows: int = MIN_ROWS, tokens: str = "text_tokens") -> DataFrame:
    """Add chunk_no, start_idx, end_idx: a chunk closes with the row that brings it to the target, of ``min_rows`` at least.

    What remains is a chunk if it has that many rows; else chunk_no is null.
    """
    return _numbered(rows, lambda n, t, last, phase: False, lambda n, t: t >= target and n >= min_rows, min_rows, tokens)


def by_phase(rows: DataFrame, target: int, limits: dict[str, int] | None = None, min_rows: int = MIN_PHASE_ROWS, tokens: str = "text_tokens") -> DataFrame:
    """As by_size, for rows with a phase: before a row, a chunk of ``min_rows`` closes if the phase changes or its own limit is reached.

    What remains is a chunk.  chunk_phase: of a chunk's last row.
    """
    most = phase_limits(target, limits)
    out = _numbered(rows, lambda n, t, last, phase: n >= min_rows and (phase != last or t >= most.get(last, target)), lambda n, t: False, 1, tokens)
    return out.withColumn("chunk_phase", F.max_by("phase", "idx").over(Window.partitionBy("session", "chunk_no")))


def chunks(chunked: DataFrame, tokens: str = "text_tokens", old_enough: Column | None = None) -> DataFrame:
    """One row per chunk: bounds, message ids in order, key, tokens, phase (null without) and transcript."""
    phase = F.col("chunk_phase") if "chunk_phase" in chunked.columns else F.lit(None).cast("string")
    rows = chunked.filter("chunk_no is not null").withColumn("_lines", B.transcript_lines())
    ordered = F.array_sort(F.collect_list(F.struct("idx", "msg_id", "_lines")))
    out = rows.groupBy("session", "chunk_no", "start_idx", "end_idx").agg(ordered.alias("_r"), F.sum(tokens).alias("tokens"), F.first(phase).alias("phase"))
    lines = F.concat(F.array(F.lit(B.TRANSCRIPT_OPEN)), F.flatten(F.transform("_r", lambda x: x["_lines"])), F.array(F.lit(B.TRANSCRIPT_CLOSE)))
    out = out.withColumn("msg_ids", F.transform("_r", lambda x: x["msg_id"])).withColumn("transcript", F.array_join(lines, "\n"))
    out = out.withColumn("chunk_key", key("msg_ids")).drop("_r")
    return out if old_enough is None else out.filter(old_enough)


def key(ids: str) -> Column:
    """Key of a chunk: its message ids joined by colons, those in the ids marked so that different lists differ."""
    return F.array_join(F.transform(ids, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))), ":")


def with_existing(found: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks with the summary that an earlier pass made of the same messages: (session, chunk_key, summary_id, diary), else pending."""
    out = found.join(done.select("session", "chunk_key", "summary_id", "diary"), ["session", "chunk_key"], "left")
    return out.withColumn("compressed", F.col("summary_id").isNotNull() | F.col("diary").isNotNull())


def collapsed(messages: DataFrame) -> DataFrame:
    """Runs of one participant merged: (session, run_no, participant, content), a separator block between messages."""
    order = Window.partitionBy("session").orderBy("pos")
    changed = ~F.col("participant").eqNullSafe(F.lag("participant").over(order)) | (F.row_number().over(order) == 1)
    runs = messages.withColumn("run_no", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    out = runs.groupBy("session", "run_no", "participant").agg(parts.alias("_p"))
    line = B.text_content(F.lit(B.SEPARATOR))
    content = F.flatten(F.transform("_p", lambda x, i: F.when(i == 0, x["content"]).otherwise(F.concat(line, x["content"]))))
    return out.withColumn("content", content).drop("_p")
