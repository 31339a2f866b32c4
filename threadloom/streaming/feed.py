"""The message log as a stream: incremental chunking with state, and derived tables kept by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.sources import context_log, message_log


def operations(spark: SparkSession, path: str) -> DataFrame:
    """The change feed: every operation appended under ``path``, in arrival order per micro-batch."""
    return spark.readStream.schema(message_log.OPS).parquet(path)


def dispatch(on_add: Callable | None = None, on_edit: Callable | None = None, on_remove: Callable | None = None, on_range: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each kind of operation to its handler."""
    handlers = {"add": on_add, "edit": on_edit, "remove": on_remove, "remove_range": on_range}

    def batch(ops: DataFrame, number: int) -> None:
        ops.persist()
        try:
            for kind, handler in handlers.items():
                if handler is not None:
                    handler(ops.filter(F.col("op") == kind), number)
        finally:
            ops.unpersist()

    return batch


def propagation(read_entries: Callable[[], DataFrame], write_entries: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps context entries in step with edits and removals (not range removals)."""

    def batch(ops: DataFrame, number: int) -> None:
        last = ops.filter("op = 'edit'").groupBy("session", "msg_id").agg(F.max_by("content", "seq").alias("content"))
        entries = context_log.propagate_edits(read_entries(), last)
        write_entries(context_log.propagate_removals(entries, ops.filter("op = 'remove'").select("session", "msg_id")))

    return batch


class SizeChunker(StatefulProcessor):
    """Closes a chunk with the message that brings it to the target, of ``min_rows`` messages at least, as messages arrive.

    State: messages and tokens of the open chunk and the number of closed ones.  Only closed chunks come out, so a chunk, once
    out, never changes.
    """

    def __init__(self, target: int, min_rows: int = 4):
        self.target, self.min_rows = target, min_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "number long, ids string, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, ids, tokens = 0, [], 0
        if self.open.exists():
            number, joined, tokens = self.open.get()
            ids = joined.split("\x1f") if joined else []
        arrived = pd.concat(list(rows)).sort_values("seq")
        out = []
        for msg_id, n in zip(arrived["msg_id"], arrived["tokens"]):
            ids, tokens = [*ids, msg_id], tokens + int(n)
            if tokens >= self.target and len(ids) >= self.min_rows:
                out.append((key[0], number, ids, tokens))
                number, ids, tokens = number + 1, [], 0
        self.open.update((number, "\x1f".join(ids), tokens))
        yield pd.DataFrame(out, columns=["session", "chunk_no", "msg_ids", "tokens"])

    def close(self) -> None:
        pass


CHUNK = "session string, chunk_no long, msg_ids array<string>, tokens long"


def chunk_stream(adds: DataFrame, target: int, min_rows: int = 4) -> DataFrame:
    """Closed chunks of a stream of (session, seq, msg_id, tokens).  Needs a state store that holds column families (RocksDB)."""
    return adds.groupBy("session").transformWithStateInPandas(statefulProcessor=SizeChunker(target, min_rows), outputStructType=CHUNK, outputMode="Append", timeMode="None")


#: Setting of the state store, and the store that holds column families.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def finished(writer: DataStreamWriter) -> None:
    """Run a query over all that has arrived, with the state store that chunk_stream needs, and wait for its end."""
    spark = writer._spark
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
