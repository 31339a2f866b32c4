"""Token ids in Simple-8b files.

Documents are range-partitioned by doc_id; each task encodes its range with a tokenizer of the tokenizers
library and writes shard files.  A shard packs ids into 64-bit words: the top 4 bits select how many values of
how many bits follow.  Blocks of BLOCK ids start at a word of their own and the header holds their offsets,
so any block is decoded alone, with a few array operations per selector.  A value over 60 bits is an escape:
its word holds the place of the raw value in the exceptions that end the file.

Shard layout, little endian: magic (8 bytes), block length, documents, ids, blocks, words, exceptions (u64 each),
doc ids (i64), doc flags (u8: 1 for a null id, padded to 8), ids per document (u64), first word of each block
and the end (u64), words (u64), exceptions (u64).

Edge cases: null and empty texts hold just the end id; a null doc_id sorts first; repeated ids are kept,
side by side, in an order that their texts decide; an empty table writes no file and gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import get_file, positions, product, put_file, saved, slices

ID = attrgetter("id")
MAGIC = b"TLS8ID01"
BLOCK = 1024
SHARD_IDS = 1 << 20
#: Selectors of Simple-8b (fixed values): values per word and bits per value. Selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PAD = int(COUNTS.max())
_WIDTH = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Words seen twice that a worker caches, and as many words seen once.
CACHE = 400_000


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offset of each block's first word (and the end), exceptions."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    small = ids.max() < 1 << 16
    values = np.zeros((blocks, block + PAD), np.uint16 if small else np.uint64)
    whole = np.zeros(blocks * block, values.dtype)
    whole[:n] = ids
    values[:, :block] = whole.reshape(blocks, block)
    if small:
        width = _WIDTH[values]
    else:
        width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # rounding up at 2^53 and beyond only wastes a bit
    widest = {1: width}

    def window(c: int) -> np.ndarray:
        """Widest of the next c values: of a power of two, from halves; else of two that overlap."""
        p = 1 << (c.bit_length() - 1)
        if p not in widest:
            half = window_of(p // 2)
            widest[p] = np.maximum(half, np.pad(half[:, p // 2 :], ((0, 0), (0, p // 2))))
        m = widest[p]
        return m[:, :block] if p == c else np.maximum(m[:, :block], m[:, c - p : c - p + block])

    def window_of(p: int) -> np.ndarray:
        window(p)
        return widest[p]

    # what fits fewer bits and more values fits the next selector too, so counting selectors that fit finds the best one
    fitting = np.zeros((blocks, block), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = window(int(COUNTS[s])) <= np.uint8(BITS[s])
        if not fits.any():
            break
        fitting += fits.view(np.uint8)
    choice = (len(COUNTS) - fitting) * (fitting > 0)
    # all blocks step from word to word together
    flat, size = choice.reshape(-1), np.minimum(block, n - np.arange(blocks) * block)
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        first = live * block + at
        steps.append(first)
        at = at + COUNTS[flat[first]]
        on = at < size[live]
        at, live = at[on], live[on]
    begins = np.zeros(blocks * block, bool)
    begins[np.concatenate(steps)] = True
    starts = np.flatnonzero(begins)
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * block).astype(np.uint64)
    selectors = flat[starts].astype(np.int64)
    places = starts + starts // block * PAD
    padded = values.reshape(-1)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selectors):
        own = np.flatnonzero(selectors == s)
        if s == 0:
            exceptions = padded[places[own]].astype(np.uint64)
            words[own] |= np.arange(len(own), dtype=np.uint64)
        elif BITS[s]:
            place, word = places[own], words[own]
            for k in range(int(COUNTS[s])):
                word |= padded[place + k].astype(np.uint64) << np.uint64(k * BITS[s])
            words[own] = word
    return words, offsets, exceptions if (selectors == 0).any() else np.zeros(0, np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of the blocks whose words these are (offsets: of each block's first word, and the end)."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    offsets = offsets.astype(np.int64)
    block_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = before - before[offsets[:-1]][block_of] + block_of * (block + PAD) if len(words) else before
    blocks = len(offsets) - 1
    ids = np.zeros(blocks * (block + PAD), np.uint64)  # a block's last word may say more values than the block has
    for s in np.unique(selectors):
        own = np.flatnonzero(selectors == s)
        if s == 0:
            ids[at[own]] = exceptions[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            mask, packed, place = np.uint64((1 << int(BITS[s])) - 1), words[own], at[own]
            for k in range(int(COUNTS[s])):
                ids[place + k] = (packed >> np.uint64(k * BITS[s])) & mask
    return ids.reshape(blocks, block + PAD)[:, :block].reshape(-1)[:n]


def shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, exceptions = pack(ids)
    head = np.array([BLOCK, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(exceptions)], "<u8")
    flags = bytes(d is None for d in doc_ids)
    return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), flags, bytes(-len(flags) % 8), np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()])


def read_shard(data: bytes, first: int = 0, last: int | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ids) of a shard; first and last: only the ids of these blocks."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    block, docs, n, blocks, n_words, n_exceptions = np.frombuffer(data, "<u8", 6, 8).astype(int).tolist()
    at = 56
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    flags = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at := at + docs + -docs % 8).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at := at + 8 * (blocks + 1))
    exceptions = np.frombuffer(data, "<u8", n_exceptions, at + 8 * n_words)
    last = blocks if last is None else min(last, blocks)
    part = offsets[first : last + 1]
    ids = unpack(words[part[0] : part[-1]], part - part[0], exceptions, max(0, min(n, last * block) - first * block), block)
    return [None if f else int(d) for d, f in zip(doc_ids, flags)], lengths, ids


def splits_before_blanks(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that Words relies on: byte-level BPE with the usual split rule and no more."""
    split, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    plain = not any(settings.get(part) for part in ("normalizer", "post_processor", "truncation", "padding"))
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    bare = model.get("type") == "BPE" and not any(model.get(part) for part in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    # an added token must not hold a blank, nor take those around it, nor be found inside a word of letters
    added = all(" " not in t["content"] and not t["content"].isalpha() and not (t["lstrip"] or t["rstrip"]) for t in settings.get("added_tokens", []))
    return bool(plain and usual and bare and added)


class Words(dict):
    """Ids, as bytes, of a word with the blank before it; filled on demand by the tokenizer itself.

    A byte-level BPE splits text before every blank that precedes something else, so the ids of a text are those
    of its words one after the other, unless a blank meets other white space; such texts are encoded whole, and so are all
    texts if the tokenizer's settings are not those of such a BPE.
    A word of Latin letters is one pretoken and goes to the BPE model directly, signs after it are another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_before_blanks(json.loads(self.tokenizer.to_str()))
        self.once: dict[str, bytes] = {}  # words seen once wait here
        self.letters = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def mark(self, signs: str) -> bytes:
        ids = self.marks.get(signs)
        if ids is None:
            ids = self.whole(signs)
            if len(self.marks) < 10_000:
                self.marks[signs] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.once.pop(word, None)
        if ids is not None:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        else:
            letters = word if word.isalpha() else word.rstrip(punctuation)
            if letters.isalpha() and (letters.isascii() or max(letters) < LATIN_END):
                if letters is not word:
                    ids = self[letters] + self.mark(word[len(letters) :])
                else:
                    spelt = word if word.isascii() else word.translate(SPELT)
                    ids = array("I", map(ID, self.letters(BLANK_LETTER + spelt))).tobytes()
            else:
                ids = self.whole(" " + word)
            if len(word) <= 32:
                if len(self.once) >= CACHE:
                    self.once.clear()
                self.once[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words or text[-1] == " " or BLANKS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.__getitem__, rest))


#: Byte-level BPE spells bytes as letters: printable ones as they are, the others from U+0100 on (fixed rule).
BLANK_LETTER = "\u0120"
_plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _plain)}
#: Letters below are letters to every version of Unicode.
LATIN_END = "\u0250"
SPELT = {c: chr(c).encode().decode("latin-1").translate(BYTE_LETTERS) for c in range(128, ord(LATIN_END))}
BLANKS = re.compile(r" \s")
_words: dict[str, Words] = {}


def encode(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Write all (doc_id, text) as shards in ascending doc_id order; returns the shards' manifest.

    Manifest: pid, part (order of the shards), path, n_docs, n_ids, start (ids of all shards before).
    ``tokenizer``: a file for the tokenizers library; ``folder``: one that all machines share, by default a new one in
    ``spark.checkpoint.dir`` that nothing deletes.
    """
    folder = folder or product(docs.sparkSession, "token-ids")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(tokenizer) or _words.setdefault(tokenizer, Words(tokenizer))
        pid, part, doc_ids, lengths, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            path = put_file(folder, f"ids-{pid:07d}-{part:05d}.s8b", shard(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4")))
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for piece in slices(batches, 4 << 20):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                ids = words.encode(text or "") + end
                if doc_ids and n + len(ids) // 4 > SHARD_IDS:
                    yield flush()
                    part, doc_ids, lengths, held, n = part + 1, [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
        if doc_ids:
            yield flush()

    # rows of one id are ordered and parted by their texts, so that neither null nor repeated ids meet in one task
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    shards = saved(ordered.mapInArrow(write, "pid int, part int, path string, n_docs long, n_ids long"), "shards")
    return saved(positions(shards, ["pid", "part"], "shard-starts", "n_ids").withColumnRenamed("position", "start"), "manifest")


def decode(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                doc_ids, lengths, ids = read_shard(get_file(path))
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - lengths + start, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    files, ids = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    tasks = max(1, min(files, ids // (4 * SHARD_IDS) + 1))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
