"""Strategies: what a compiled context holds.  A strategy takes and returns DataFrames, for any number of sessions at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import chunking, pyramid, selection, zones
from threadloom.sources.tables import kept


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 100_000
    reserve: int = 4_000


@dataclass(frozen=True)
class Config:
    """Defaults that decide results (fixed values)."""

    target_chunk_tokens: int = 3000
    recent_window_tokens: int = 30000
    head_window_tokens: int = 0
    attachments_ignore_size: bool = True
    auto_tick: bool = False
    max_message_tokens: int = 0
    label: str = selection.SUMMARY_LABEL
    participant: str = selection.SUMMARY_PARTICIPANT
    hierarchical: bool = True
    merge_threshold: int = pyramid.MERGE_THRESHOLD
    summary_target_tokens: int = pyramid.TARGET_TOKENS
    l3_budget: int = 30000
    l2_budget: int = 30000
    l1_budget: int = 30000
    utf16: bool = False


@runtime_checkable
class Strategy(Protocol):
    name: str

    def select(self, messages: DataFrame, state: State, budget: Budget) -> DataFrame: ...

    def tick(self, messages: DataFrame, state: State) -> State: ...

    def readiness(self, messages: DataFrame, state: State) -> DataFrame | None: ...


@runtime_checkable
class Resettable(Protocol):
    def reset_head(self, state: State, anchors: DataFrame | None) -> State: ...

    def transition_summary(self, messages: DataFrame, state: State) -> DataFrame: ...


@dataclass(frozen=True)
class State:
    """What strategies keep between passes: summaries, diaries (session, chunk_key, chunk_no, diary) and anchors; all tables."""

    summaries: DataFrame | None = None
    diaries: DataFrame | None = None
    anchors: DataFrame | None = None


class Passthrough:
    """The newest messages that fit."""

    name = "passthrough"

    def __init__(self, utf16: bool = False, estimator: Column | None = None):
        self.utf16, self.estimator = utf16, estimator

    def select(self, messages: DataFrame, state: State, budget: Budget) -> DataFrame:
        kept = selection.passthrough(zones.measured(messages, self.estimator, self.utf16), budget.max_tokens, budget.reserve)
        return kept.select("session", F.lit(0).alias("part"), F.col("pos").cast("long").alias("ord"), F.col("msg_id").alias("source_msg_id"), F.lit("copy").alias("source_relation"), "participant", "content", F.lit(False).alias("cache_marker"), F.col("out_pos").cast("long").alias("out_pos"))

    def tick(self, messages: DataFrame, state: State) -> State:
        return state

    def readiness(self, messages: DataFrame, state: State) -> None:
        return None


@dataclass
class Autobiographical:
    """Head, a pyramid of summaries, recent messages; or single-level diaries if not hierarchical."""

    config: Config = field(default_factory=Config)
    summarise: pyramid.Summariser = pyramid.extractive
    estimator: Column | None = None
    name: str = "autobiographical"

    def zoned(self, messages: DataFrame, state: State) -> DataFrame:
        measured = zones.measured(messages, self.estimator, self.config.utf16)
        anchors = zones.last_marker(messages) if state.anchors is None else state.anchors
        return zones.zoned(measured, self.config.head_window_tokens, self.config.recent_window_tokens, anchors)

    @property
    def size(self) -> str:
        return "text_tokens" if self.config.attachments_ignore_size else "tokens"

    def old_enough(self) -> Column | None:
        """A condition that chunks must meet; none here."""
        return None

    def chunked(self, messages: DataFrame, state: State) -> DataFrame:
        return chunking.by_size(zones.compressible(self.zoned(messages, state)), self.config.target_chunk_tokens, tokens=self.size)

    def chunks(self, messages: DataFrame, state: State) -> DataFrame:
        found = chunking.chunks(self.chunked(messages, state), self.size, self.old_enough())
        done = self._done(found, state)
        return chunking.with_existing(found, done)

    def _done(self, found: DataFrame, state: State) -> DataFrame:
        empty = found.limit(0).select("session", F.lit(None).cast("string").alias("chunk_key"), F.lit(None).cast("string").alias("summary_id"), F.lit(None).cast("string").alias("diary"))
        if state.summaries is not None:
            own = state.summaries.filter("level = 1").groupBy("session", chunking.key("source_ids").alias("chunk_key")).agg(F.min_by("id", "ord").alias("summary_id"))
            empty = empty.unionByName(own.withColumn("diary", F.lit(None).cast("string")))
        if state.diaries is not None:
            empty = empty.unionByName(state.diaries.select("session", "chunk_key", F.lit(None).cast("string").alias("summary_id"), "diary"))
        return empty.groupBy("session", "chunk_key").agg(F.max("summary_id").alias("summary_id"), F.max("diary").alias("diary"))

    def levels(self) -> dict:
        return {"l3": self.config.l3_budget, "l2": self.config.l2_budget, "l1": self.config.l1_budget}

    def select(self, messages: DataFrame, state: State, budget: Budget) -> DataFrame:
        c = self.config
        if c.hierarchical:
            z = self.zoned(messages, state)
            z = z if state.summaries is None else kept(z, "zones")
            return selection.hierarchical(z, state.summaries, budget.max_tokens, budget.reserve, c.max_message_tokens, c.label, c.participant, **self.levels())
        z = kept(self.zoned(messages, state), "zones")
        rows = kept(self.chunked(messages, state), "chunked")
        found = chunking.with_existing(chunking.chunks(rows, self.size, self.old_enough()), self._done(rows, state))
        return selection.single_level(z, rows, found.select("session", "chunk_no", "diary"), budget.max_tokens, budget.reserve, c.max_message_tokens, c.label, c.participant)

    def tick(self, messages: DataFrame, state: State) -> State:
        """One batch: all pending chunks, then all full groups of each level."""
        c = self.config
        pending = kept(self.chunks(messages, state).filter("not compressed"), "pending-chunks")
        if not c.hierarchical:
            pending = pending.withColumn("target_tokens", F.lit(c.summary_target_tokens)).withColumn("prompt", pyramid.instruction(F.col("phase"), c.summary_target_tokens, F.size("msg_ids")))
            made = pending.withColumn("diary", self.summarise(pending)).select("session", "chunk_key", "diary")
            return replace(state, diaries=made if state.diaries is None else state.diaries.select("session", "chunk_key", "diary").unionByName(made))
        before = state.summaries if state.summaries is not None else messages.sparkSession.createDataFrame([], pyramid.SCHEMA)
        after = kept(before.select(*pyramid.COLUMNS).unionByName(pyramid.compress(pending, before, c.summary_target_tokens, self.summarise)), "summaries")
        for level in (2, 3):
            after = kept(pyramid.merge(after, level, c.merge_threshold, c.summary_target_tokens, self.summarise, self.phases), "summaries")
        return replace(state, summaries=after)

    phases = False

    def readiness(self, messages: DataFrame, state: State) -> DataFrame:
        before = state.summaries if state.summaries is not None else messages.sparkSession.createDataFrame([], pyramid.SCHEMA)
        return pyramid.readiness(before, self.chunks(messages, state), self.config.merge_threshold)

    def stats(self, messages: DataFrame, state: State) -> DataFrame:
        before = state.summaries if state.summaries is not None else messages.sparkSession.createDataFrame([], pyramid.SCHEMA)
        return pyramid.stats(before, self.chunks(messages, state))

    def reset_head(self, state: State, anchors: DataFrame | None) -> State:
        return replace(state, anchors=anchors)

    def transition_summary(self, messages: DataFrame, state: State) -> DataFrame:
        """(session, text): a summary of the head and of the last higher-level summaries."""
        parts = pyramid.transition_text(self.zoned(messages, state), state.summaries)
        parts = parts.withColumn("transcript", F.concat_ws("\n", "head_text", "top_text")).withColumn("target_tokens", F.lit(1500)).withColumn("prompt", pyramid.filled(pyramid.TRANSITION_PROMPT, target=1500))
        return parts.select("session", self.summarise(parts).alias("text"))


@dataclass
class Knowledge(Autobiographical):
    """Chunks by phase, and first-level summaries chosen by phase."""

    name: str = "knowledge"
    tools: dict = field(default_factory=dict)
    limits: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)
    phases = True

    def __post_init__(self):
        self.config = replace(self.config, hierarchical=True)

    def chunked(self, messages: DataFrame, state: State) -> DataFrame:
        rows = chunking.phased(zones.compressible(self.zoned(messages, state)), **self.tools)
        return chunking.by_phase(rows, self.config.target_chunk_tokens, self.limits, tokens=self.size)

    def levels(self) -> dict:
        return super().levels() | {"shares": self.shares}


def compiled(messages: DataFrame, strategy: Strategy, state: State | None = None, budget: Budget | None = None, injections: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of all sessions: entries (with cache_marker) and system blocks."""
    entries = strategy.select(messages, state or State(), budget or Budget())
    return (entries, None) if injections is None else selection.injected(entries, injections)
