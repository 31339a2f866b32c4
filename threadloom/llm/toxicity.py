"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of any kind the unlabelled.  With prior p, the risk of a scorer g under
the sigmoid loss l is estimated as p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]): what unlabelled texts suggest for
the negative class, less what positives would have added to it, never below zero.  Where that term falls below zero, its
gradient is taken back.  The scorer is linear in the presence of hashed words and word
stems, those that positives have clearly more or less often than other texts.  Training is numpy on the driver over bounded samples
(MAX_POSITIVE, MAX_UNLABELLED, chosen by hashes of ids and texts); every text is scored, in its whole length.  The unlabelled sample
is a deviation: the unlabelled term of the risk is not estimated on all texts, however large the corpus is.  The prior is
the share of toxic ones among the labels learnt from.

Nulls and edge cases: null and empty texts have no words and get the score of the bias alone; without a confirmed toxic
text every score is 0; null labels are unlabelled; rows without an id can't be labelled; ids with several labels
count as toxic if any is; repeated rows are rows like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slices, text_bytes

BITS = 20
#: Leading bytes of a word that are features besides the word: stems that toxic words share.
PREFIXES = (4, 5, 7)
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 18_000
#: Features of the scorer, at most, and how many standard errors apart their rates must be.
MAX_FEATURES, CLEAR = 4096, 3.5
STEPS, RATE, DECAY = 300, 0.03, 1e-5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Letters, digits and all bytes beyond ASCII make words; A-Z count as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _power:
        _power.clear()
        one = np.ones(1, np.uint64)
        _power[size] = tuple(np.cumprod(np.concatenate((one, np.full(size, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _power[size]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of words and prefixes of each text in order, and the n + 1 offsets of the texts."""
    data, at = text_bytes(column)
    data = _FOLD[data]
    inside = _INSIDE[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(at[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    power, back = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)))
    doc = np.searchsorted(at[1:], starts, side="right") << BITS
    both = []
    for size in (*PREFIXES, 0):  # prefixes of longer words, and whole words
        long = ends - starts > size
        a, salt = starts[long], np.uint64(size + 1)
        b = a + size if size else ends
        h = ((sums[b] - sums[a]) * back[a] + salt) * np.uint64(_BASE)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
        both.append(doc[long] | (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(both))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(at)))


def _chosen(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About ``most`` of n rows, by a hash of them."""
    share = min(1.0, most / n) if n else 1.0
    return rows.filter(F.pmod(F.xxhash64(*rows.columns, F.lit(salt)), F.lit(1_000_003)) < share * 1_000_003)


def _collected(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts of a bounded sample (doc_id, text)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2 << 20):
            words, at = features(piece.column("text"))
            raw = words.astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())], names=["doc_id", "words"])

    found = chosen.mapInArrow(extract, "doc_id long, words binary").toArrow().sort_by("doc_id").column("words").to_pylist()
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    return np.frombuffer(b"".join(found), np.int32), np.concatenate(([0], np.cumsum(sizes)))


def _take(words: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = at[rows + 1] - at[rows]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[rows], sizes)
    return words[place], np.repeat(np.arange(len(rows)), sizes)


def learn(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """Weights of the buckets and, last, the bias."""
    n_p, n_u = len(positive[1]) - 1, len(unlabelled[1]) - 1
    in_p, in_u = np.bincount(positive[0], minlength=1 << BITS), np.bincount(unlabelled[0], minlength=1 << BITS)
    # features that positives have clearly more or less often than texts of any kind
    rate = (in_p + in_u) / (n_p + n_u)
    apart = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_p + 1 / n_u))
    apart[in_p + in_u < 3] = 0
    strong = np.argsort(-np.abs(apart), kind="stable")[:MAX_FEATURES]
    strong = np.sort(strong[np.abs(apart[strong]) > CLEAR])
    place = np.full(1 << BITS, -1)
    place[strong] = np.arange(len(strong))

    def reduced(texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        f = place[texts[0]]
        owner = np.repeat(np.arange(len(texts[1]) - 1), np.diff(texts[1]))
        return f[f >= 0], owner[f >= 0]

    (fp, dp), (fu, du) = reduced(positive), reduced(unlabelled)
    odds = np.log((in_p[strong] + 0.5) / (n_p + 1)) - np.log((in_u[strong] + 0.5) / (n_u + 1))
    x = np.append(np.clip(odds, -2, 2), -2.0)  # weights and bias: naive Bayes to start from
    first, second = np.zeros_like(x), np.zeros_like(x)
    loss = lambda g: 1 / (1 + np.exp(np.clip(g, -30, 30)))
    for step in range(1, STEPS + 1):
        gu = np.bincount(du, x[fu], n_u) + x[-1]
        gp = np.bincount(dp, x[fp], n_p) + x[-1]
        slope_u, slope_p = loss(gu) * loss(-gu) / n_u, loss(gp) * loss(-gp) * prior / n_p
        # derivatives by each text's g of the positive part and of the negative one, or of the latter taken back
        below = loss(-gu).mean() - prior * loss(-gp).mean() < 0
        cu, cp = (-slope_u, slope_p) if below else (slope_u, -2 * slope_p)
        grad = np.append(np.bincount(fu, cu[du], len(strong)) + np.bincount(fp, cp[dp], len(strong)), cu.sum() + cp.sum())
        grad[:-1] += DECAY * x[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        x -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((1 << BITS) + 1)
    weights[strong], weights[-1] = x[:-1], x[-1]
    return weights


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Add score to the columns of ``docs`` other than text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != "text"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for piece in slices(batches, 2 << 20):
            if w is None:
                g = np.full(piece.num_rows, -np.inf)
            else:
                words, at = features(piece.column("text"))
                g = np.bincount(np.repeat(np.arange(piece.num_rows), np.diff(at)), w[words], piece.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(1 / (1 + np.exp(np.clip(-g, -700, 700))) * (g > -np.inf))], names=[*kept, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(rate, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns labels only from rows whose crc32 of the id, modulo 5, is not 0."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.filter("doc_id is not null and toxic is not null").filter(~fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share, n = known.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    weights = None
    if n and share:
        texts = docs.filter(~fold).select("doc_id", "text")
        # ids are sampled before they meet texts, so MAX_POSITIVE bounds what is broadcast
        toxic = _chosen(known.filter("toxic = 1"), round(share * n), MAX_POSITIVE, "positive").select("doc_id")
        positive = _collected(texts.join(F.broadcast(toxic), "doc_id", "left_semi"))
        unlabelled = _collected(_chosen(texts, texts.count(), MAX_UNLABELLED, "unlabelled"))
        if len(positive[1]) > 1:
            weights = learn(positive, unlabelled, float(share))
    scored = score(docs.select("doc_id", fold.alias("held_out"), "text"), weights)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
