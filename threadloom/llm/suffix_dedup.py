"""Exact substring deduplication by prefix-free parsing and suffix arrays.

Every string of ``span`` bytes that starts at two places marks all its copies.  Rolling hashes of GRAM bytes trigger the
parse: the strings of a text that share their smallest hash and follow one another make a phrase.  Neighbouring
phrases overlap by span - 1 bytes, so each string lies in exactly one phrase, and equal strings have equal triggers
wherever they are.  That makes the two parts of the method:

- the parse: a phrase that occurs twice is repeated as a whole, which counts per phrase settle;
- the dictionary: phrases of equal trigger and different content are sorted by suffix, to the depth of span bytes.  A
  string of that length lies inside one dictionary phrase, so ranks in the parse never have to break a tie: order in the
  dictionary, with the number of occurrences from the parse, is corpus order to the depth that matters.

Phrases whose trigger occurs once, in the corpus and in the phrase, need neither: that is all text without copies.  The rest is dealt by trigger in
groups; a trigger of more than HOT different phrases (or HOT_BYTES of them) is not brought together but compared string by string, by 128-bit
hashes and partial counts.  Content is sent once for each different phrase, so thousands of copies cost what one does.

Nulls and edge cases: texts are UTF-8 bytes and a null text is empty; texts shorter than the span keep all bytes;
repeated rows are copies of each other; null and repeated ids are told apart by a hash of the text; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import saved, slices, text_bytes

SPAN = 200
GRAM = 32
#: Strings of a phrase, at most; longer runs of one trigger are cut.
MAX_WINDOWS = 4095
#: A phrase's place: its start, then a bit for a recurring trigger and 12 bits for the number of its strings.
PLACE_BITS = 13
#: Different phrases of one trigger, and their bytes, that are compared in one task.
HOT, HOT_BYTES = 4096, 2 << 20
#: Bytes of text that are parsed at once, about; longer texts are parsed in parts.
PIECE = 1 << 20
#: Bytes of dictionary that are sorted together, about.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _power:
        _power.clear()
        one = np.ones(1, np.uint64)
        _power[size] = tuple(np.cumprod(np.concatenate((one, np.full(size, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _power[size]


def _least(x: np.ndarray, width: int, n: int) -> np.ndarray:
    """Smallest of ``width`` values from each of the first n places."""
    p = 1
    while 2 * p <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return x[:n] if p == width else np.minimum(x[:n], x[width - p : width - p + n])


def parse(data: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, start, windows, whether the trigger recurs, trigger and content hash of every phrase."""
    n = len(data) - span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none, none
    power, back = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    del sums
    h *= back[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    # smallest hash of each window twice: with the first and with the last of the places (modulo 4096) that have it
    low = np.uint64(0xFFF)
    place = np.arange(len(h), dtype=np.uint64) & low
    h &= ~low
    left = _least(h | place, span - gram + 1, n)
    place ^= low
    h |= place
    del place
    right = _least(h, span - gram + 1, n)
    del h
    sizes = np.diff(at)
    counts = np.maximum(sizes - span + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(doc)) - begin[doc]
    if not len(doc):
        return none, none, none, none, none, none
    window = at[:-1][doc] + place
    left, right = left[window], right[window]
    del window
    key = left & ~low
    new = np.ones(len(doc), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    new |= run % MAX_WINDOWS == 0
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(doc)))
    d, start = doc[first], place[first]
    # does the trigger occur more than once in the phrase?  If not, none of the phrase's strings repeats in it
    least, most = np.minimum.reduceat(left & low, first), np.maximum.reduceat(low ^ (right & low), first)
    raw = memoryview(data)
    a = at[:-1][d] + start
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[x:y]) for x, y in zip(a.tolist(), (a + windows + span - 1).tolist())), np.uint64, len(a))
    return d, start, windows, least != most, key[first].view(np.int64), content.view(np.int64)


def segments(data: np.ndarray, at: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in parts of about PIECE bytes: (text number and offset of each part, bytes, offsets of the parts).

    Parts of a long text overlap by span - 1 bytes, so each of its strings starts in exactly one part.
    """
    sizes = np.diff(at)
    if len(data) <= 2 * PIECE:
        yield np.arange(len(sizes)), np.zeros(len(sizes), np.int64), data, at
        return
    parts = [(k, a, min(a + PIECE + span - 1, n)) for k, n in enumerate(sizes.tolist()) for a in range(0, max(n, 1), PIECE)]
    held, size = [], 0
    for part in [*parts, None]:
        if held and (part is None or size >= PIECE):
            owner, begin, end = (np.array(x, np.int64) for x in zip(*held))
            raw = np.concatenate([data[at[k] + a : at[k] + b] for k, a, b in held])
            yield owner, begin, raw, np.concatenate(([0], np.cumsum(end - begin)))
            held, size = [], 0
        if part is not None:
            held.append(part)
            size += part[2] - part[1]


def ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes; equal ranks mean equal bytes.  (Near the end, zeros follow.)

    Ranks to a depth are sorted m at a time to give ranks to m times the depth, with m as large as a 63-bit key takes.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    first = min(7, depth)
    for k in range(first):
        key = (key << np.uint64(8)) | padded[k : k + n]
    done = first
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if done >= depth:
            return rank
        bits = max(1, int(rank.max()).bit_length())
        parts = min(63 // bits, -(-depth // done))
        offsets = [min(k * done, depth - done) for k in range(parts)]
        padded = np.concatenate((rank, np.zeros(depth, np.int64)))
        key = np.zeros(n, np.int64)
        for offset in offsets:
            key = (key << bits) | padded[offset : offset + n]
        done += offsets[-1]


def repeated_windows(phrases: list[bytes], span: int) -> np.ndarray:
    """Of the strings of ``span`` bytes of all phrases, in order: which occur more than once in them."""
    sizes = np.array([len(p) for p in phrases])
    counts = sizes - span + 1
    begin = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    rank = ranks(np.frombuffer(b"".join(phrases), np.uint8), span)[at]
    return np.bincount(rank, minlength=1)[rank] > 1


def spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, packed, spans): of every document the compressed text and its removed byte ranges (begin, end), in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    unsure = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text") if unsure else F.col("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, PIECE):
            for owner, offset, data, at in segments(*text_bytes(piece.column("text")), span):
                doc, start, windows, again, trigger, form = parse(data, at, span, gram)
                start = start + offset[doc]
                yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(owner[doc])), pa.array((start << PLACE_BITS) | (again.astype(np.int64) << (PLACE_BITS - 1)) | windows), pa.array(trigger), pa.array(form)], names=["key", "place", "trigger", "form"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for piece in slices(batches, PIECE):
            data, at = text_bytes(piece.column("text"))
            raw = memoryview(data)
            packed = pa.array([press(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), packed], names=["doc_id", "_key", "packed"])

    packed = rows.mapInArrow(pack, "doc_id long, _key long, packed binary")
    again = F.max(F.col("place").bitwiseAND(1 << (PLACE_BITS - 1))) > 0
    phrases = saved(rows.select("key", "text").mapInArrow(cut, "key long, place long, trigger long, form long"), "phrases")
    live = saved(phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), again.alias("again")).filter("n > 1 or again").select("trigger"), "live-triggers")
    parsed = saved(phrases.join(live.hint("merge"), "trigger"), "parse")
    dictionary = saved(parsed.groupBy("trigger", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at")), "dictionary")
    copied = dictionary.filter("n > 1").select("trigger", "form")
    start, windows = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND((1 << (PLACE_BITS - 1)) - 1)
    whole = parsed.join(copied.hint("merge"), ["trigger", "form"]).select("key", start.alias("begin"), (start + windows + (span - 1)).alias("end"))
    again = F.max(F.col("at.place").bitwiseAND(1 << (PLACE_BITS - 1))) > 0
    held = F.sum(F.col("at.place").bitwiseAND((1 << (PLACE_BITS - 1)) - 1) + (span - 1))
    forms = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("forms"), held.alias("held"), again.alias("again")).filter("forms > 1 or again")
    unlike = dictionary.join(forms.hint("merge"), "trigger").select("at.key", F.struct("at.place", "trigger", (F.col("n") == 1).alias("single"), ((F.col("forms") > hot) | (F.col("held") > HOT_BYTES)).alias("hot")).alias("p"))
    wanted = unlike.groupBy("key").agg(F.collect_list("p").alias("p"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("trigger", "key", "start", "single", "hot", "content")}
            held = 0
            for key, text, places in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), batch.column("p").to_pylist()):
                text = unpress(text)
                for p in places:
                    a, n = p["place"] >> PLACE_BITS, p["place"] & ((1 << (PLACE_BITS - 1)) - 1)
                    for name, value in (("trigger", p["trigger"]), ("key", key), ("start", a), ("single", p["single"]), ("hot", p["hot"]), ("content", text[a : a + n + span - 1])):
                        out[name].append(value)
                    held += n + span
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=content_schema)
                    out, held = {c: [] for c in out}, 0
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=content_schema)

    content_schema = pa.schema([("trigger", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("content", pa.binary())])
    texts = wanted.hint("merge").join(packed.drop("doc_id"), F.col("key") == F.col("_key")).select("key", "packed", "p")
    contents = saved(texts.mapInArrow(fetch, "trigger long, key long, start long, single boolean, hot boolean, content binary"), "contents")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list) -> pa.RecordBatch:
            hit = repeated_windows([r[4] for r in rows], span)
            counts = np.array([len(r[4]) - span + 1 for r in rows])
            owner = np.repeat(np.arange(len(rows)), counts)
            hit &= np.array([r[3] for r in rows])[owner]
            at = np.flatnonzero(hit)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1 if len(at) else first
            o = owner[at[first]]
            offset = np.array([r[2] for r in rows])[o] - (np.cumsum(counts) - counts)[o]
            return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows])[o]), pa.array(at[first] + offset), pa.array(at[last] + offset + span)], names=["key", "begin", "end"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "key", "start", "single", "content"))):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield found(held)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for key, start, single, content in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "single", "content"))):
                n = len(content) - span + 1
                both = np.frombuffer(b"".join(digest(content[k : k + span]) for k in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.arange(start, start + n)), pa.array([single] * n), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "at", "single", "h1", "h2"])

    dealt = contents.filter("not hot").repartition("trigger").sortWithinPartitions("trigger")
    parts = [whole, dealt.mapInArrow(compare, "key long, begin long, end long")]
    if contents.filter("hot").limit(1).count():
        strings = saved(contents.filter("hot").mapInArrow(hashes, "key long, at long, single boolean, h1 long, h2 long"), "strings")
        twice = strings.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
        parts.append(strings.filter("single").join(twice, ["h1", "h2"]).select("key", F.col("at").alias("begin"), (F.col("at") + span).alias("end")))
    ranges = parts[0]
    for part in parts[1:]:
        ranges = ranges.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("begin", "end")))
    merged = saved(ranges.groupBy("key").agg(ordered.alias("spans")), "ranges")
    return packed.join(merged.hint("merge"), F.col("_key") == F.col("key"), "left").select("doc_id", "packed", F.coalesce("spans", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")).alias("spans"))


def cleaned(docs: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """(doc_id, kept, spans) of every document: remaining bytes, and maximal removed runs as (begin, end)."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, runs, held = [], [], 0
            first = 0
            for k, (packed, ranges) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist())):
                text, merged = unpress(packed), []
                for r in ranges:
                    if merged and r["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                    else:
                        merged.append(r)
                edges = [0, *(x for r in merged for x in (r["begin"], r["end"])), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                runs.append(merged)
                held += len(text)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, k + 1 - first), pa.array(kept, pa.binary()), pa.array(runs, run_type)], names=["doc_id", "kept", "spans"])
                    kept, runs, held, first = [], [], 0, k + 1
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first), pa.array(kept, pa.binary()), pa.array(runs, run_type)], names=["doc_id", "kept", "spans"])

    run_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return spans(docs, span, **options).mapInArrow(drop, "doc_id long, kept binary, spans array<struct<begin:long,end:long>>")
