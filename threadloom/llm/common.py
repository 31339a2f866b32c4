"""What the operators of this subpackage share: the shared folder, saved tables, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set for the session if all of it runs on this machine; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Per thread, paths of helper tables that were handed out and not deleted since; so two runs at once keep apart.
_own = threading.local()


def _handed() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, for a helper table that ``release`` may delete."""
    _handed().append(product(spark, name))
    return _handed()[-1]


def product(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, for files that stay."""
    return f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"


def handed_out() -> list[str]:
    """Paths of this thread's helper tables so far; a later list less an earlier one is what was made in between."""
    return list(_handed())


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that outlives executors, and fixes whatever a second run of the same plan
    might deal out otherwise (partition numbers, the order of ties).
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these helper tables, or all of this thread; DataFrames that read them can't be used any more.

    Results are lazy, so only who has written or collected one can tell that its helper tables are no longer needed.
    """
    for name in handed_out() if paths is None else list(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _handed():
            _handed().remove(name)


def positions(df: DataFrame, order: list, name: str, value: str | None = None) -> DataFrame:
    """Add ``position``: the 0-based place of each row in ``order`` (or the sum of ``value`` over the rows before).

    Range-partitions, saves, sums each partition and adds up the sums: only one row per partition ever
    meets in one task.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), name)
    amount = F.col(value) if value else F.lit(1).cast("long")
    ends = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_pid").agg(F.sum(amount).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(ends), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "_pid").withColumn("position", F.col("_start") + F.coalesce(F.sum(amount).over(before), F.lit(0))).drop("_pid", "_start")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column as one array, and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system: workers are kept, and idle ones should not hold what other stages need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, max_bytes: int, column: str = "text"):
    """Record batches cut into pieces of about ``max_bytes`` of text (at least a row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    give_back()


def _store(path: str):
    """Arrow's file system of a path, and the path in it; the names that Hadoop's S3 client goes by are S3 to Arrow."""
    from pyarrow import fs

    scheme, found, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else path)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name of its own, then move it: a lost or repeated task leaves no half-written file."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(part := f"{root}/.{name}.{uuid.uuid4().hex}", compression=None) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def get_file(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at, compression=None) as source:
        return source.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
