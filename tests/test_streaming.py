from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.operators import chunking, zones
from threadloom.sources import context_log, message_log
from threadloom.streaming import feed


def ops(spark, start, count):
    rows = [("s", k, f"m{k}", "User", "x" * (20 + 7 * k % 60)) for k in range(start, start + count)]
    m = spark.createDataFrame(rows, "session string, seq long, msg_id string, participant string, text string")
    return message_log.adds(m.withColumn("content", B.text_content(F.col("text"))))


def drain(query):
    try:
        query.awaitTermination(120)
        assert query.exception() is None
    finally:
        query.stop()


def test_stream_closes_the_same_chunks_as_a_batch(spark, tmp_path):
    path, out = str(tmp_path / "ops"), str(tmp_path / "chunks")
    for k in range(3):
        ops(spark, 10 * k, 10).coalesce(1).write.mode("append").parquet(path)
        adds = feed.operations(spark, path).filter("op = 'add'").select("session", "seq", "msg_id", B.full_tokens().alias("tokens"))
        drain(feed.chunk_stream(adds, 40, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start())
    streamed = [(r["chunk_no"], r["msg_ids"]) for r in spark.read.parquet(out).orderBy("chunk_no").collect()]
    rows = zones.compressible(zones.zoned(zones.measured(message_log.fold(spark.read.schema(message_log.OPS).parquet(path))), 0, -1))
    batch = [(r["chunk_no"], r["msg_ids"]) for r in chunking.chunks(chunking.by_size(rows, 40, 2)).orderBy("chunk_no").collect()]
    assert streamed and streamed == batch[: len(streamed)] and len(batch) - len(streamed) <= 1


def test_feed_keeps_entries_in_step(spark, tmp_path):
    path = str(tmp_path / "ops")
    first = ops(spark, 0, 3)
    edit = first.filter("seq = 1").withColumn("op", F.lit("edit")).withColumn("seq", F.lit(10).cast("long")).withColumn("content", B.text_content(F.lit("new")))
    gone = first.filter("seq = 2").withColumn("op", F.lit("remove")).withColumn("seq", F.lit(11).cast("long"))
    first.unionByName(edit).unionByName(gone).coalesce(1).write.parquet(path)
    held = {"entries": spark.createDataFrame([("s", f"c{k}", k, f"m{k}", "copy", "User", [], None) for k in range(3)], context_log.ENTRIES)}

    def write(entries):
        rows = entries.collect()
        held["entries"] = spark.createDataFrame(rows, context_log.ENTRIES)

    seen = []
    step = feed.propagation(lambda: held["entries"], write)
    hand = feed.dispatch(on_add=lambda df, n: seen.append(df.count()))
    drain(feed.operations(spark, path).writeStream.foreachBatch(lambda df, n: (step(df, n), hand(df, n))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    got = {r["entry_id"]: [b["text"] for b in r["content"]] for r in held["entries"].collect()}
    assert got == {"c0": [], "c1": ["new"]} and sum(seen) == 3
