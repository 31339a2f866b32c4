"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled texts, per language and hash bucket, with partial sums in every task; the
log-probability matrix is broadcast.  Its size is bounded: with more languages there are fewer buckets, so that it
never exceeds MATRIX_BYTES.  A batch is scored as one sparse product: bucket numbers of all its n-grams gather rows
of the matrix, which are summed text by text.

At most TRAIN_ROWS labelled texts of each language are learnt from, chosen by a hash of id and text; all texts are scored.
Labels beyond the MAX_LANGS most frequent (ties: in code-point order) are not learnt.

Nulls and edge cases: null texts and texts without a letter are "und" with score 0; without any labelled text all
are; null languages aren't learnt; equal scores go to the first language in code-point order; repeated rows are
rows like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slices

ORDERS = (1, 2, 3)
BITS = 15
MATRIX_BYTES = 64 << 20
MAX_LANGS = 1024
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def ngrams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the text that each belongs to."""
    joined = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    lengths = pc.utf8_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    shift = np.uint64(64 - bits)
    buckets, owners, h = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # h: of the n characters from each place
        last = chars[n - 1 :]
        h = h[: len(last)] * np.uint64(0x100000001B3) + last + np.uint64(1)
        if n in ORDERS:
            inside = doc[: len(last)] == doc[n - 1 :]
            mixed = (h + np.uint64(n)) * _MULTIPLY
            buckets.append((((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLY) >> shift).astype(np.int32)[inside])
            owners.append(doc[: len(last)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, int]:
    """Languages, log-probabilities (buckets x languages) with the priors in the last row, and bits of the buckets."""
    labelled = labelled.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # at most MAX_LANGS rows reach the driver
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(counts, key=lambda x: x.encode())
    bits = BITS
    while len(langs) * (4 << bits) > MATRIX_BYTES:
        bits -= 1
    if not langs:
        return [], np.zeros((1, 0), np.float32), bits
    code = {lang: k for k, lang in enumerate(langs)}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))))
    labelled = labelled.filter(F.col("lang").isin(langs)) if len(langs) == MAX_LANGS else labelled
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1_000_003)) < F.lit(1_000_003) * share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << bits, np.int64)
        for piece in slices(batches, 2 << 20):
            own = np.array([code[x] for x in piece.column("lang").to_pylist()])
            buckets, owner = ngrams(piece.column("text"), bits)
            total += np.bincount((own[owner] << bits) + buckets, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["cell", "n"])

    cells = chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(langs) << bits)
    total[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    total = total.reshape(len(langs), -1).T + SMOOTHING
    weight = np.array([counts[x] for x in langs], float)
    return langs, np.vstack([np.log(total / total.sum(0)), np.log(weight / weight.sum())]).astype(np.float32), bits


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, bits: int) -> DataFrame:
    """Add lang_pred and score (posterior probability) to (doc_id, text, and what else ``docs`` has but no text)."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kept = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for piece in slices(batches, max(64 << 10, (2 << 20) // max(1, len(langs) // 4))):
            text = piece.column("text")
            n = len(text)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            sums = np.zeros((n, len(langs)))
            if len(langs):
                buckets, owner = ngrams(text, bits)
                for k in range(len(langs)):
                    sums[:, k] = np.bincount(owner, table[:-1, k][buckets], minlength=n)
                sums += table[-1]
                best = sums.argmax(1)
                chance = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            else:
                letters, best, chance = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
            names = np.array([*langs, "und"], object)[np.where(letters, best, len(langs))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, np.clip(chance, 0, 1), 0.0))], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(score, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows whose crc32 of the id, modulo 4, is not 2."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    langs, matrix, bits = train(docs.filter(~fold))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), langs, matrix, bits)
