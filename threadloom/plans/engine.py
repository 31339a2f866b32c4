"""A context engine over one folder: operations, context entries, summaries, branches and media as Parquet tables.

The tables are the whole state, so an engine that is opened again goes on where another left off, and several engines can
share a folder by namespace.  Calls that answer for every session take and return DataFrames.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.operators import filters, pyramid
from threadloom.plans.strategies import Budget, Passthrough, Resettable, State, Strategy, compiled
from threadloom.sources import context_log, message_log
from threadloom.sources.tables import shared_folder

SESSION = "main"


@dataclass(frozen=True)
class View:
    """What hooks get: the messages and entries of a namespace, read only."""

    spark: SparkSession
    messages: DataFrame
    entries: DataFrame
    state: State


class ContextEngine:
    """One namespace of a folder: ``path``, or a new one in the shared folder.  ``isolate`` needs a namespace."""

    def __init__(self, spark: SparkSession, path: str | None = None, namespace: str | None = None, isolate: bool = False, strategy: Strategy | None = None, session: str = SESSION):
        if isolate and not namespace:
            raise ValueError("isolate needs a namespace")
        self.spark, self.session = spark, session
        self.path = path or shared_folder(spark, "engine")
        self.messages_ns = namespace if namespace and isolate else "default"
        self.entries_ns = namespace or "default"
        self.branch, self.state = message_log.MAIN, State()
        self.strategy: Strategy = strategy or Passthrough()
        self.listeners: list[Callable[[dict], None]] = []
        self.closed = False

    # tables

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        if self.closed:
            raise RuntimeError("the engine is closed")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _replace(self, name: str, rows: DataFrame, schema: str) -> None:
        """Write anew beside the old table, then swap: rows may come from the table itself."""
        fresh = f"{self.path}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(fresh)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        old, new = hadoop.Path(f"{self.path}/{name}"), hadoop.Path(fresh)
        store = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        store.delete(old, True)
        store.rename(new, old)

    def ops(self) -> DataFrame:
        every = self._read("message_ops", message_log.OPS).filter(F.col("ns") == self.messages_ns)
        return message_log.branch_ops(every, self._branches(), self.branch)

    def messages(self) -> DataFrame:
        return message_log.fold(self.ops())

    def entries(self) -> DataFrame:
        return self._read(f"context_entries/{self.entries_ns}", context_log.ENTRIES)

    def _branches(self) -> list[dict]:
        return [r.asDict() for r in self._read("branches", message_log.BRANCHES).collect()]

    def _next(self) -> int:
        last = self._read("message_ops", message_log.OPS).agg(F.max("seq")).first()[0]
        return 1 + (last if last is not None else 0)

    def _log(self, op: str, event: dict, **values) -> int:
        seq = self._next()
        row = {"ns": self.messages_ns, "branch": self.branch, "session": self.session, "seq": seq, "op": op} | values
        names = [x.name for x in self.spark.createDataFrame([], message_log.OPS).schema]
        self._append("message_ops", self.spark.createDataFrame([[row.get(n) for n in names]], message_log.OPS))
        for listener in list(self.listeners):
            listener({"type": op} | event)
        return seq

    def _known(self, msg_id: str) -> Row:
        found = self.get_message(msg_id)
        if found is None:
            raise KeyError(f"Message not found: {msg_id}")
        return found

    # messages

    def add_message(self, participant: str, content: list[dict] | str, metadata: dict | None = None, caused_by: list[str] | None = None, msg_id: str | None = None) -> str:
        """Log a message; inline media are stored once by their hash.  Returns its id."""
        msg_id = msg_id or f"msg-{uuid.uuid4().hex}"
        rows = content_rows(content)
        from datetime import datetime, timezone

        self._store_media(rows)
        self._log("add", {"id": msg_id, "content": rows}, msg_id=msg_id, participant=participant, content=[_referenced(r) for r in rows], metadata_json=None if metadata is None else json.dumps(metadata, separators=(",", ":")), ts=datetime.now(timezone.utc), caused_by=caused_by)
        if getattr(getattr(self.strategy, "config", None), "auto_tick", False):
            self.tick()
        return msg_id

    def _store_media(self, rows: list[dict]) -> None:
        held = self.spark.createDataFrame([(rows,)], f"content {B.CONTENT}")
        if any(r.get("data") for r in rows):
            fresh = message_log.blobs(held).join(self.blobs().select("hash"), "hash", "left_anti")
            self._append("blobs", fresh.select("hash", "media_type", "data"))

    def blobs(self) -> DataFrame:
        return self._read("blobs", "hash string, media_type string, data binary")

    def edit_message(self, msg_id: str, content: list[dict] | str) -> None:
        before = self._known(msg_id)
        rows = content_rows(content)
        self._store_media(rows)
        stored = [_referenced(r) for r in rows]
        self._log("edit", {"id": msg_id, "old": before["content"], "content": rows}, msg_id=msg_id, content=stored)
        change = self.spark.createDataFrame([(self.session, msg_id, stored)], f"session string, msg_id string, content {B.CONTENT}")
        self._keep_entries(context_log.propagate_edits(self.entries(), change))

    def remove_message(self, msg_id: str) -> None:
        self._known(msg_id)
        self._log("remove", {"id": msg_id}, msg_id=msg_id)
        gone = self.spark.createDataFrame([(self.session, msg_id)], "session string, msg_id string")
        self._keep_entries(context_log.propagate_removals(self.entries(), gone))

    def remove_messages(self, first: str, last: str) -> None:
        """Remove a range, both ends included; entries that were copied from it stay."""
        self._known(first), self._known(last)
        self._log("remove_range", {"id": first, "to": last}, msg_id=first, to_msg_id=last)

    def get_message(self, msg_id: str) -> Row | None:
        return self._resolved(message_log.lookup(self.messages(), msg_id)).first()

    def get_message_at(self, msg_id: str, seq: int) -> Row | None:
        return self._resolved(message_log.lookup_at(self.ops(), msg_id, seq)).first()

    def get_all_messages(self) -> DataFrame:
        return self._resolved(self.messages()).orderBy("session", "pos")

    def _resolved(self, messages: DataFrame) -> DataFrame:
        return message_log.resolve_blobs(messages, self.blobs(), ["session", "msg_id"])

    def query_messages(self, **conditions) -> DataFrame:
        return filters.query(self._resolved(self.messages()), **conditions)

    def find_message_by_external_id(self, source: str, external_id: str) -> Row | None:
        return filters.find_by_external_id(self._resolved(self.messages()), source, external_id).first()

    def add_listener(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Call ``listener`` at each operation; returns what takes it off again."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener) if listener in self.listeners else None

    # context entries

    def append_entry(self, participant: str, content: list[dict] | str, source: str | None = None, relation: str | None = None, cache_marker: bool | None = None) -> str:
        if relation is not None and relation not in context_log.RELATIONS:
            raise ValueError(f"unknown relation: {relation}")
        entry = f"ctx-{uuid.uuid4().hex}"
        seq = self.entries().agg(F.max("seq")).first()[0]
        row = (self.session, entry, (seq or 0) + 1, source, relation, participant, content_rows(content), cache_marker)
        self._append(f"context_entries/{self.entries_ns}", self.spark.createDataFrame([row], context_log.ENTRIES))
        return entry

    def _keep_entries(self, rows: DataFrame) -> None:
        if self.entries().limit(1).count():
            self._replace(f"context_entries/{self.entries_ns}", rows, context_log.ENTRIES)

    def replace_entries(self, rows: DataFrame) -> None:
        self._replace(f"context_entries/{self.entries_ns}", rows, context_log.ENTRIES)

    # branches

    def branch_at(self, msg_id: str, name: str | None = None) -> str:
        self._known(msg_id)
        name = name or f"branch-{int(time.time() * 1000)}"
        self._append("branches", message_log.branch_at(self.messages(), msg_id, name, self.branch))
        return name

    def switch_branch(self, name: str) -> None:
        if name != message_log.MAIN and name not in {b["id"] for b in self._branches()}:
            raise KeyError(f"Branch not found: {name}")
        self.branch = name

    def current_branch(self) -> dict:
        own = {"id": self.branch, "name": self.branch, "head": None, "parent_id": None, "branch_point": None, "created": None}
        return next((b for b in self._branches() if b["id"] == self.branch), own)

    def list_branches(self) -> DataFrame:
        main = self.spark.createDataFrame([(message_log.MAIN, message_log.MAIN, None, None, None, None)], message_log.BRANCHES)
        return main.unionByName(self._read("branches", message_log.BRANCHES))

    # strategy

    def set_strategy(self, strategy: Strategy) -> None:
        self.strategy, self.state = strategy, State(summaries=self._saved_summaries())

    def get_strategy(self) -> Strategy:
        return self.strategy

    def _saved_summaries(self) -> DataFrame | None:
        own = self._read(f"summaries/{self.messages_ns}", pyramid.SCHEMA)
        return own if own.limit(1).count() else None

    def compile(self, budget: Budget | None = None, injections: list[dict] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Entries of the context in order (cache_marker where a cache may end) and system blocks."""
        if self.state.summaries is None:
            self.state = State(self._saved_summaries(), self.state.diaries, self.state.anchors)
        given = None
        if injections:
            rows = [(None, k, i["namespace"], i["position"], content_rows(i["content"])) for k, i in enumerate(injections)]
            given = self.spark.createDataFrame(rows, f"session string, ord long, namespace string, position string, content {B.CONTENT}")
        entries, system = compiled(self._resolved(self.messages()), self.strategy, self.state, budget, given)
        return entries.orderBy("session", "out_pos"), system

    def tick(self) -> None:
        """Summarise what is pending and keep the result."""
        self.state = self.strategy.tick(self.messages(), self.state)
        if self.state.summaries is not None:
            self._replace(f"summaries/{self.messages_ns}", self.state.summaries.select(*pyramid.COLUMNS), pyramid.SCHEMA)
            self.state = State(self._read(f"summaries/{self.messages_ns}", pyramid.SCHEMA), self.state.diaries, self.state.anchors)

    def get_pending_work(self) -> DataFrame | None:
        return self.strategy.readiness(self.messages(), self.state)

    def is_ready(self) -> bool:
        work = self.get_pending_work()
        return work is None or not work.filter("not ready").limit(1).count()

    def reset_head_window(self, text: str | None = None) -> str:
        """Start a new topic: a marker message becomes the head's first row.  Without text the strategy sums up."""
        if not isinstance(self.strategy, Resettable):
            raise TypeError("the strategy has no head window")
        if text is None:
            row = self.strategy.transition_summary(self.messages(), self.state).first()
            text = row["text"] if row else ""
        marker = self.add_message(B.TRANSITION_PARTICIPANT, f"{B.TRANSITION_PREFIX}\n\n{text}")
        anchor = self.spark.createDataFrame([(self.session, marker)], "session string, anchor_id string")
        self.state = self.strategy.reset_head(self.state, anchor)
        return text

    # the rest

    def view(self) -> View:
        return View(self.spark, self._resolved(self.messages()), context_log.indexed(self.entries()), self.state)

    def create_view(self, name: str = "messages") -> None:
        self._resolved(self.messages()).createOrReplaceTempView(name)

    def stats(self) -> dict:
        return {"messages": self.messages().count(), "context_entries": self.entries().count(), "branches": self.list_branches().count()}

    def log_compiled(self, entries: DataFrame, out=sys.stderr) -> None:
        """One line of JSON with participants and block texts."""
        shown = entries.orderBy("session", "out_pos").select("participant", F.transform("content", lambda b: F.coalesce(b["text"], F.concat(F.lit("["), b["type"], F.lit("]")))).alias("blocks"))
        line = shown.agg(F.to_json(F.collect_list(F.struct("participant", "blocks"))).alias("j")).first()["j"]
        print(line, file=out)

    def get_store(self) -> SparkSession:
        return self.spark

    def sync(self) -> None:
        """Nothing to do: every call that writes returns after its table is complete."""

    def close(self) -> None:
        self.closed = True

    def is_closed(self) -> bool:
        return self.closed


def content_rows(content: list[dict] | str) -> list[dict]:
    """Blocks with every field, from text or from partial blocks; tool input becomes compact JSON."""
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    out = []
    for b in content:
        b = dict(b)
        if "input" in b:
            b["input_json"] = json.dumps(b.pop("input"), separators=(",", ":"), ensure_ascii=False)
        unknown = set(b) - set(B.FIELDS)
        if unknown:
            raise ValueError(f"unknown block fields: {sorted(unknown)}")
        out.append({name: b.get(name) for name in B.FIELDS})
    return out


def _referenced(b: dict) -> dict:
    """The stored form of a block: media by hash."""
    import base64
    import hashlib

    media = (b["type"] == "image" and b["source_type"] == "base64") or b["type"] in ("document", "audio", "video")
    if not media or not b["data"]:
        return b
    digest = hashlib.sha256(base64.b64decode(b["data"])).hexdigest()
    return b | {"type": "blob_ref", "source_type": None, "data": None, "blob_hash": digest, "original_type": b["type"], "token_estimate": None}
