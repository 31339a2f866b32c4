"""WARC archives with segmented records.

Writing: pages with equal payloads are found by their SHA-1 (counted with partial sums, and joined without the payloads,
as a third of all pages may share one); the smallest page_id is written as a response, the others as revisits of it.  A
response body is sent in chunks, and a record block longer than ``segment_bytes`` is cut: the first segment is the
response, the others are continuation records that name its record id, in archives of their own.

Reading: every task parses whole archives.  Segments are grouped by origin id, ordered by segment number and joined;
the numbers must be complete and the sum of lengths must be the stated total.  Then the chunked transfer framing is
decoded and the payload's digest is compared with the stated one.  A broken record stops the job with its id.

Nulls and edge cases: a null html is an empty payload; a null url gives a record without target; rows without a
page_id are responses; repeated rows give repeated records, each of them a response; an empty table writes no
archive and gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import get_file, product, put_file, saved

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 16 << 20
FEW_ARCHIVES = 10_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}/{sha1}'.encode()).hexdigest())}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%X\r\n%s\r\n" % (len(part), part) for part in (payload[a : a + size] for a in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; sizes may have extensions, and trailers may follow the last chunk."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as archives; returns (path, records) of each.

    Payloads of less than ``revisit_bytes`` are all written in full.  ``folder``: one that all machines share.
    """
    folder = folder or product(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    heads = rows.filter(F.length("payload") >= revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    # only ids and hashes meet by hash, which many pages may share; payloads are joined by page
    again = rows.select("page_id", "sha1").join(saved(heads, "copied-payloads"), "sha1").filter("page_id <> first").distinct()
    rows = rows.join(saved(again, "revisits"), ["page_id", "sha1"], "left")
    # a revisit needs no payload
    rows = rows.select("page_id", "url", "sha1", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: dict[str, list[bytes]] = {"main": [], "rest": []}
        size, part = {"main": 0, "rest": 0}, {"main": 0, "rest": 0}

        def flush(kind: str) -> pa.RecordBatch:
            path = put_file(folder, f"pages-{kind}-{pid:06d}-{part[kind]:04d}.warc.gz", b"".join(held[kind]))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held[kind])], pa.int64())})
            held[kind], size[kind], part[kind] = [], 0, part[kind] + 1
            return out

        def add(kind: str, data: bytes) -> None:
            held[kind].append(gzip.compress(data, 5, mtime=0))
            size[kind] += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                own = record_id(row["page_id"], row["sha1"])
                url = row["url"].replace("\r", "%0D").replace("\n", "%0A") if row["url"] is not None else None
                sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                fields = [("WARC-Type", "response" if row["first"] is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Page-ID", row["page_id"]), ("Content-Type", "application/http; msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if row["first"] is not None:
                    add("main", record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["first"], row["sha1"]))], head))
                else:
                    block = head + chunked(row["payload"], chunk_bytes)
                    segments = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
                    if len(segments) > 1:
                        fields.append(("WARC-Segment-Number", 1))
                    add("main", record(fields, segments[0]))
                    for k, segment in enumerate(segments[1:], 2):
                        total = len(block) if k == len(segments) else None
                        more = uuid.uuid5(uuid.UUID(own[10:-1]), str(k))
                        add("rest", record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{more}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], segment))
                for kind in held:
                    if size[kind] >= ARCHIVE_BYTES:
                        yield flush(kind)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    return saved(rows.mapInArrow(archive, "path string, records long"), "archives")


PARSED = "page_id long, url string, record_type string, id string, refers string, stated string, payload_bytes long, payload binary, segment int, total long, block binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every response and revisit.

    ``archives``: a path in each row.  For a revisit the length is that of the response it refers to, and refers_to that
    response's page; its payload is null, as is every payload without ``payloads``.
    """

    def checked(payload: bytes, stated: str, own: str) -> bytes:
        if digest(payload) != stated:
            raise ValueError(f"{own}: the payload's digest differs")
        return payload

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for fields, block in records(gzip.GzipFile(fileobj=io.BytesIO(get_file(path))).read()):
                    kind, own = fields["warc-type"], fields["warc-record-id"]
                    row = dict.fromkeys(names) | {"record_type": kind, "id": fields.get("warc-segment-origin-id", own), "url": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to")}
                    row["stated"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
                    if "warc-segment-number" in fields:
                        row |= {"segment": int(fields["warc-segment-number"]), "block": block}
                        row["total"] = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None
                    elif kind == "response":
                        payload = checked(http_payload(block), row["stated"], own)
                        row |= {"payload_bytes": len(payload), "payload": payload if payloads else None}
                    rows.append(row)
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    # an archive a task while there are few, four a task where there are very many
    files = archives.count()
    tasks = max(1, files if files <= FEW_ARCHIVES else FEW_ARCHIVES + (files - FEW_ARCHIVES) // 4)
    parsed = saved(archives.select("path").repartition(tasks).mapInArrow(parse, PARSED), "records")
    whole = parsed.filter("segment is null")
    # segments of one origin: equal ones (of repeated rows) once, in order, without gaps
    pieces = parsed.filter("segment is not null").groupBy("id", "segment").agg(F.any_value("block").alias("block"), F.max("total").alias("total"))
    joined = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"))
    # joined where they are decoded: a fold here would copy what it has so far for every segment
    block = F.transform("s", lambda x: x["block"])
    sound = (F.col("s")[0]["segment"] == 1) & (F.element_at("s", -1)["segment"] == F.size("s")) & F.coalesce(F.expr("aggregate(s, 0L, (a, x) -> a + length(x.block))") == F.col("total"), F.lit(False))
    joined = joined.select("id", F.when(sound, block).otherwise(F.raise_error(F.concat("id", F.lit(": segments are missing or don't sum up to the total length")))).alias("block"))
    heads = parsed.filter("segment = 1").select("page_id", "url", "record_type", "id", "refers", "stated")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [checked(http_payload(b"".join(b)), s, i) for b, s, i in zip(batch.column("block").to_pylist(), batch.column("stated").to_pylist(), batch.column("id").to_pylist())]
            batch = batch.drop_columns(["block"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(p) for p in done], pa.int64()), pa.array(done if payloads else [None] * len(done), pa.binary())], names=[*batch.schema.names, "payload_bytes", "payload"])

    shape = ", ".join(PARSED.split(", ")[:8])
    segmented = heads.join(joined, "id").select("page_id", "url", "record_type", "id", "refers", "stated", "block").mapInArrow(decode, shape)
    full = whole.select(*segmented.columns).unionByName(segmented)
    if not payloads:
        full = saved(full, "payload-lengths")
    targets = full.filter("record_type = 'response'").groupBy(F.col("id").alias("refers")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("n"))
    revisits = full.filter("record_type = 'revisit'").join(targets, "refers", "left").withColumn("payload_bytes", F.col("n")).drop("n")
    responses = full.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(revisits).select("page_id", "url", "record_type", "refers_to", "payload_bytes", F.col("stated").alias("payload_digest"), "payload")
