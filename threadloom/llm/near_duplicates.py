"""N-gram Jaccard join: a MinHash LSH forest and exact verification.

A text is the set of its runs of five words (of all its words, if fewer).  Texts with equal sets form a class, and
classes are joined: each gets TREES labels of MAX_DEPTH minimum hashes.  Sorting the labels of each tree lays out its
prefix trie: a node of depth d is a run of labels with d common hashes, and neighbours' common prefixes tell all runs of all
depths in one pass.  Two sets of similarity s share a node of depth d in some tree with probability 1 - (1 - s^d)^TREES.

Matching starts from whole labels.  Classes that share a node are verified exactly, and from the similarities of the pairs
found so far follows how many others share no node: each pair stands for one over its probability, and DOUBT pairs at
the threshold are taken to be missing besides.  Until the share of pairs found reaches the target recall, the matched prefix
is shortened by STEP hashes and the pairs that meet anew are verified; it never becomes shorter than what gives that
recall even if all pairs are at the threshold.

What is a candidate depends on shared nodes alone.  How candidates travel depends on numbers: nodes are linked by stars, so
they cost a row per label, not per pair.  Connected candidates meet once, and exact similarities come from products of
blocks of their set-membership matrix.  Components of more than UNIT classes are cut instead: every node is a unit of its
own, large nodes are split into pairs of blocks, and a pair counts only in the first tree that it shares.  So nothing
unbounded meets in one task, and no pair is dropped or written out: what leaves a unit is a link count and a star for each
class.  (All pairs of a node of n classes are compared, so its sets are copied to about n / 512 units.)

Rows are told apart by a key of id and text, classes by numbers of their own; ids come back in the result only.

Nulls and edge cases: texts without words match nothing, not even each other; join() does not compare rows without an id
and keeps their null ids, distinct() compares them like others and prefers rows with ids; repeated rows are copies of
each other, and rows of one id with different texts are rows like others; an empty table gives no rows; other columns
are not read, and distinct() carries them along under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import give_back, saved, slices, text_bytes

SHINGLE = 5
TREES, MAX_DEPTH, STEP = 16, 8, 4
#: Classes that are compared in one unit, shingles of all its sets, and rows of one block of the matrix product.
UNIT = 1024
UNIT_SHINGLES = 4 << 20
BLOCK = 512
#: Bins of similarity from the threshold to 1 that verified pairs are counted in, and pairs taken to be missing on top.
BINS, DOUBT = 20, 3
#: Edges of a graph that one task unites; with more, tasks take turns.
EDGES = 1 << 17
KEY = "struct<none: boolean, id: long, text: long>"
#: Odd multipliers and offsets of the hash functions come from one seeded generator.
_random = np.random.default_rng(20240601)
_MULTIPLY = _random.integers(1, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def chance(similarity: float, d: int) -> float:
    """Probability that two sets share a node of depth d in some tree."""
    return 1 - (1 - similarity**d) ** TREES


def depth(similarity: float, recall: float, longest: int = MAX_DEPTH) -> int:
    """The longest prefix that reaches the target recall for pairs at the threshold, shortening from whole labels."""
    d = longest
    while d > 1 and chance(similarity, d) < recall:
        d -= 1
    return d


def recall_reached(tally: np.ndarray, similarity: float, d: int, recall: float) -> bool:
    """Whether pairs verified at depth d, counted by similarity, are at least that share of all pairs, as far as they tell."""
    at = [similarity + (1 - similarity) * k / len(tally) for k in range(len(tally))]
    missed = sum(n * (1 / chance(s, d) - 1) for n, s in zip(tally.tolist(), at)) + DOUBT * (1 / chance(similarity, d) - 1)
    found = int(tally.sum())
    return found > 0 and found >= recall * (found + missed)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the n + 1 offsets of the texts."""
    data, at = text_bytes(column)
    rows = len(at) - 1
    inside = ~_SPACES[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word can't cross texts: cut where a text begins inside a run
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    # hash of a word: a polynomial of its bytes, from prefix sums
    power = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:-1], dtype=np.uint64)))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), _inverse, np.uint64))), dtype=np.uint64)
    word = _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(rows), n)
    where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    left = np.repeat(first[1:], n) - where
    h = np.zeros(len(where), np.uint64)
    padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    for k in range(SHINGLE):
        h = _mixed(h * _BASE + np.where(left > k, padded[where + k], np.uint64(k + 1)))
    till = np.cumsum(n).tolist()
    for a, b in zip([0, *till], till):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(rows + 1))


def labels(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Labels of the non-empty sets: for each tree MAX_DEPTH minimum hashes of 16 bits, packed into two integers that sort like them."""
    out = np.zeros((len(at) - 1, TREES, 2), np.uint64)
    for h in range(TREES * MAX_DEPTH):
        least = np.minimum.reduceat((sets * _MULTIPLY[h] + _ADD[h]) >> np.uint64(32), at[:-1]) & np.uint64(0xFFFF)
        tree, k = divmod(h, MAX_DEPTH)
        out[:, tree, k // 4] |= least << np.uint64(48 - 16 * (k % 4))
    # flipping the sign bit makes the order of signed integers that of the unsigned ones
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def row_key() -> Column:
    """Id and text of a row, in the order of ids, null last; equal for repeated rows only."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))


def _id(key: str) -> Column:
    return F.when(~F.col(f"{key}.none"), F.col(f"{key}.id"))


def signatures(docs: DataFrame) -> DataFrame:
    """(key, h1, h2, n, labels): hash and size of the set, and its label in each tree; no row without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1 << 20):
            sets, at = shingle_sets(piece.column("text"))
            own = np.flatnonzero(np.diff(at))
            if not len(own):
                continue
            at = np.append(at[own], at[-1])
            raw = memoryview(sets.tobytes())
            whole = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            both = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            label = pa.FixedSizeListArray.from_arrays(pa.array(labels(sets, at).reshape(-1)), 2 * TREES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(own)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.diff(at)), label], names=["key", "h1", "h2", "n", "labels"])

    return docs.select(row_key().alias("key"), "text").mapInArrow(sign, f"key {KEY}, h1 long, h2 long, n long, labels array<long>")


def _common(tree: tuple, hi: tuple, lo: tuple) -> np.ndarray:
    """Number of hashes that labels share from the start, of (before, after) pairs of arrays; 0 in different trees."""

    def leading(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 4)
        for k in range(4):
            out[x >= np.uint64(1) << np.uint64(16 * k)] = 3 - k
        return out

    high, low = ((a ^ b).view(np.uint64) for a, b in (hi, lo))
    return np.where(tree[0] != tree[1], 0, np.where(high != 0, leading(high), 4 + leading(low)))


def trie(classes: DataFrame, depths: list[int]) -> DataFrame:
    """(rep, n, tree, nodes): number of the node at each of these depths, for labels that share the last depth with another.

    Labels are range-partitioned and sorted.  Each task walks its part and counts the runs of each depth; one row of each part
    (its ends and its counts) then tells which runs go on from the part before, and from which numbers to count.
    """
    least = depths[-1]
    leaves = classes.select("rep", "n", F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(t as tree, labels[2 * t] as hi, labels[2 * t + 1] as lo))")).alias("l")).select("l.*", "rep", "n")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        columns = ["tree", "hi", "lo", "rep", "n"]
        last, runs = None, np.zeros(len(depths), np.int64)

        def out(rows: dict, common: np.ndarray, following: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            keep = (common >= least) | (following >= least) | (common < 0) | (following < 0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(counts[keep].reshape(-1)), len(depths)).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), pid)), *(pa.array(rows[c][keep].astype(np.int64)) for c in columns), pa.array(common[keep].astype(np.int64)), pa.array(following[keep].astype(np.int64)), lists], names=["pid", *columns, "common", "following", "runs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns}
            before = {c: np.append(rows[c][:1] if last is None else last[0][c], rows[c][:-1]) for c in columns[:3]}
            common = _common(*((before[c], rows[c]) for c in columns[:3]))
            if last is None:
                common[0] = -1
            counts = runs + np.cumsum(common[:, None] < np.array(depths), axis=0)
            runs = counts[-1]
            # a row goes out when its successor is known
            if last is None:
                yield out({c: rows[c][:-1] for c in columns}, common[:-1], common[1:], counts[:-1])
            else:
                yield out({c: np.append(last[0][c], rows[c][:-1]) for c in columns}, np.append(last[1], common[:-1]), common, np.vstack([last[2], counts[:-1]]))
            last = ({c: rows[c][-1:] for c in columns}, common[-1:], counts[-1:])
        if last is not None:
            yield out(last[0], last[1], np.array([-1]), last[2])

    order = ["tree", "hi", "lo", "rep"]
    shape = "pid long, tree long, hi long, lo long, rep long, n long, common long, following long, runs array<long>"
    parts = saved(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, shape), "trie-parts")
    label = F.struct("tree", "hi", "lo")
    ends = parts.filter("common < 0 or following < 0").groupBy("pid").agg(F.max(F.when(F.col("common") < 0, label)).alias("first"), F.max(F.when(F.col("following") < 0, F.struct("tree", "hi", "lo", "runs"))).alias("last"))
    along = Window.orderBy("pid")  # a row of each part
    same = [f"p.{c} = first.{c}" for c in ("tree", "hi", "lo")]
    chunks = [f"shiftrightunsigned(p.{c} ^ first.{c}, {s}) = 0" for c in ("hi", "lo") for s in (48, 32, 16, 0)]
    shared = f"case when p is null or not ({same[0]}) then 0 " + " ".join(f"when not ({x}) then {k}" for k, x in enumerate(chunks)) + f" else {MAX_DEPTH} end"
    ends = ends.withColumn("p", F.lag("last").over(along)).withColumn("joint", F.expr(shared)).withColumn("next", F.coalesce(F.lead("joint").over(along), F.lit(0)))
    for k, d in enumerate(depths):
        goes_on = (F.col("joint") >= d).cast("long")
        ends = ends.withColumn(f"b{k}", F.coalesce(F.sum(F.col("last.runs")[k] - goes_on).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - goes_on)
    ends = F.broadcast(ends.select("pid", "joint", "next", F.array(*(f"b{k}" for k in range(len(depths)))).alias("base")))
    whole = parts.join(ends, "pid").withColumn("common", F.expr("if(common < 0, joint, common)")).withColumn("following", F.expr("if(following < 0, next, following)"))
    return saved(whole.filter(f"common >= {least} or following >= {least}").select("rep", "n", "tree", F.expr("zip_with(runs, base, (r, b) -> r + b)").alias("nodes")), "trie")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task, of which there are at most EDGES."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            low, high = sorted((find(a), find(b)))
            top[high] = low
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node of each connected component, from undirected edges (a, b); isolated nodes don't appear.

    Large stars (each node's larger neighbours move to its smallest one) and small stars (so do its smaller ones) take turns
    until nothing changes; both keep the number of edges from growing.  What has at most EDGES edges is united in one task,
    with the same result.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] <= EDGES:
            return edges.repartition(1).mapInArrow(_united, "node long, component long")
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = saved(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = saved(small.filter("a <> b").distinct(), "edges")


def connected(stars: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (node, center): those with a common center, however indirectly, are of one component.

    Components are looked for among centers alone: of each node's centers (there are few) the others are linked to the smallest.
    """
    few = saved(stars.groupBy("node").agg(F.min("center").alias("low"), F.collect_set("center").alias("centers")), "centers")
    joined = components(few.select(F.explode("centers").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
    joined = joined.withColumnRenamed("node", "_n")
    return few.join(joined, F.col("low") == F.col("_n"), "left").select("node", F.coalesce("component", "low").alias("component"))


def _compare(nodes: np.ndarray, deeper: np.ndarray | None, tree: int, side: np.ndarray, copies: np.ndarray, flat: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (counting copies) of each class of a unit with the others, the smallest class that it reaches inside, and
    the pairs by similarity.

    Pairs count if they share a node of their trees (-1: no node) and none of the ``deeper`` ones, which have been compared
    before; with a ``tree``, only if their first common node is in that one.  ``side``: if both 0 and 1 occur, only pairs across.
    """
    g = len(sizes)
    owner = np.repeat(np.arange(g), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renamed = np.cumsum(count > 1) - 1
    column, owner = renamed[column[shared]], owner[shared]
    width, crossing = int((count > 1).sum()), side.min() != side.max()
    links, label, tally = np.zeros(g, np.int64), np.arange(g), np.zeros(BINS, np.int64)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, min(BLOCK, (64 << 20) // (4 * max(1, width))))
    begin = np.searchsorted(owner, np.arange(0, g + step, step))

    def matrix(k: int) -> np.ndarray:
        x = np.zeros((min(step, g - k * step), width), np.float32)
        x[owner[begin[k] : begin[k + 1]] - k * step, column[begin[k] : begin[k + 1]]] = 1
        return x

    blocks = -(-g // step)
    for i in range(blocks):
        x = matrix(i)
        a = np.arange(i * step, i * step + len(x))
        for j in range(i, blocks):
            y = x if i == j else matrix(j)
            b = np.arange(j * step, j * step + len(y))
            common = (x @ y.T).astype(np.float64)
            hit = common * (1 + threshold) >= threshold * (sizes[a][:, None] + sizes[b]) - 1e-9
            hit &= a[:, None] < b
            if crossing:
                hit &= side[a][:, None] != side[b]
            p, q = np.nonzero(hit)
            both, p, q = common[p, q], a[p], b[q]
            shared = (nodes[p] == nodes[q]) & (nodes[p] >= 0)
            own = shared.any(1) if tree < 0 else shared[:, tree] & (shared.argmax(1) == tree)
            if deeper is not None:
                own &= ~((deeper[p] == deeper[q]) & (deeper[p] >= 0)).any(1)
            both, p, q = both[own], p[own], q[own]
            alike = both / (sizes[p] + sizes[q] - both)
            tally += np.bincount(np.clip(((alike - threshold) / max(1e-9, 1 - threshold) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            near.append((p, q))
    while True:
        before = label.copy()
        for p, q in near:
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return links, label, tally


def _units(placed: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """(rep, copies, now, before, unit, side): where each class is compared, of (rep, component, n, copies, nodes, now, before).

    In its component, or in every node of a component that is too large (``fresh``: node, size, shingles).
    """
    sizes = placed.groupBy("component").agg(((F.count(F.lit(1)) <= UNIT) & (F.sum("n") <= UNIT_SHINGLES)).alias("whole"))
    placed = saved(placed.join(sizes, "component"), "placed")
    same = ["rep", "copies", "now", "before"]
    together = placed.filter("whole").select(*same, F.struct(F.col("component").alias("k"), F.lit(-1).alias("tree"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("unit"), F.lit(0).alias("side"))
    cut = placed.filter("not whole").select(*same, F.posexplode("now").alias("tree", "node")).filter("node >= 0")
    cut = cut.join(fresh, "node").withColumn("load", F.greatest(F.col("size") / UNIT, F.col("shingles") / UNIT_SHINGLES))
    cut = cut.withColumn("parts", F.when(F.col("load") <= 1, 1).otherwise(F.ceil(2 * F.col("load"))).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    apart = cut.select(*same, F.struct(F.col("node").alias("k"), "tree", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j")).alias("unit"), (F.col("part") > F.col("o")).cast("int").alias("side"))
    return together.unionByName(apart)


def _verified(full: DataFrame, similarity: float) -> DataFrame:
    """(rep, links, root) of the classes of all units; rows without rep: number of pairs (links) of a bin of similarity (root)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None

        def done(rows: list) -> pa.RecordBatch:
            reps = np.array([r["rep"] for r in rows])
            order = np.argsort(reps, kind="stable")
            rows, reps = [rows[k] for k in order], reps[order]
            raw = [np.frombuffer(r["set"], np.uint64) for r in rows]
            sides = np.array([r["side"] for r in rows])
            if len(rows) < 2 or (rows[0]["unit"]["i"] != rows[0]["unit"]["j"] and sides.min() == sides.max()):
                links, label, tally = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(BINS, np.int64)
            else:
                deeper = None if rows[0]["before"] is None else np.array([r["before"] for r in rows])
                links, label, tally = _compare(np.array([r["now"] for r in rows]), deeper, rows[0]["unit"]["tree"], sides, np.array([r["copies"] for r in rows]), np.concatenate(raw), np.array([len(x) for x in raw]), similarity)
            bins = np.flatnonzero(tally)
            return pa.RecordBatch.from_arrays([pa.array([*reps.tolist(), *[None] * len(bins)], pa.int64()), pa.array(np.concatenate([links, tally[bins]])), pa.array(np.concatenate([reps[label], bins]))], names=["rep", "links", "root"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["unit"] != last:
                    yield done(held)
                    held = []
                last = row["unit"]
                held.append(row)
        if held:
            yield done(held)
        held = []
        give_back()

    return full.repartition("unit").sortWithinPartitions("unit").mapInArrow(verify, "rep long, links long, root long")


def clusters(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """(key, first, n_links, head) of every row with words: the smallest keys of its class and of its cluster."""
    least = depth(similarity, recall)
    depths = sorted({*range(MAX_DEPTH, least, -STEP), least}, reverse=True)
    signed = saved(signatures(docs), "signatures")
    classes = signed.groupBy("h1", "h2", "n").agg(F.min("key").alias("first"), F.any_value("labels").alias("labels"), F.count(F.lit(1)).alias("copies"))
    # numbers in place of ids, as an id can have several texts and so be in several classes
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    leaves = trie(classes, depths)
    by_tree = leaves.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "nodes"))).alias("m"))
    nodes = [F.expr(f"transform(sequence(0L, {TREES - 1}L), t -> coalesce(m[t][{k}], -1L))").alias(f"n{k}") for k in range(len(depths))]
    candidates = saved(by_tree.join(classes, "rep").select("rep", "first", "n", "copies", *nodes), "candidates")
    # always by shuffle: the part of the corpus with candidates has no bound that a broadcast could rely on
    chosen = candidates.select("first", F.col("rep").alias("_r")).hint("merge")
    keyed = docs.select(row_key().alias("key"), "text")
    texts = keyed.join(chosen, keyed["key"] == chosen["first"]).select("key", "_r", "text").dropDuplicates(["key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1 << 20):
            values, at = shingle_sets(piece.column("text"))
            raw = memoryview(np.ascontiguousarray(values).tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("_r"), pa.array([raw[8 * a : 8 * b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())], names=["_r", "set"])

    members = saved(texts.select("_r", "text").mapInArrow(sets, "_r long, set binary"), "sets")
    found, tally = None, np.zeros(BINS, np.int64)
    for k, d in enumerate(depths):
        # nodes in which classes meet that did not meet below
        meets = F.count(F.lit(1)) > 1 if k == 0 else F.min(F.col("nodes")[k - 1]) < F.max(F.col("nodes")[k - 1])
        fresh = leaves.groupBy(F.col("nodes")[k].alias("node")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), meets.alias("meets"))
        fresh = saved(fresh.filter("meets").drop("meets"), "nodes")
        stars = leaves.select(F.col("rep").alias("_rep"), F.col("nodes")[k].alias("node")).join(fresh.select("node"), "node")
        groups = connected(stars.select(F.col("_rep").alias("node"), F.col("node").alias("center")))
        before = F.col(f"n{k - 1}") if k else F.lit(None).cast("array<long>")
        placed = groups.join(candidates, groups["node"] == candidates["rep"]).select("rep", "component", "n", "copies", F.col(f"n{k}").alias("now"), before.alias("before"))
        units = _units(placed, fresh, k)
        full = units.join(members, units["rep"] == members["_r"]).select("unit", "side", "rep", "copies", "now", "before", "set")
        part = saved(_verified(full, similarity), "links")
        for row in part.filter("rep is null").groupBy("root").agg(F.sum("links").alias("pairs")).collect():  # a row for each bin
            tally[row["root"]] += row["pairs"]
        found = part if found is None else found.union(part)
        if recall_reached(tally, similarity, d, recall):
            break
    found = found.filter("rep is not null")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = saved(connected(found.select(F.col("rep").alias("node"), F.col("root").alias("center"))), "joined")
    heads = joined.join(classes, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("head"))
    joined = joined.join(heads, "component").select("node", "head")
    named = classes.join(links.withColumnRenamed("rep", "_l"), F.col("rep") == F.col("_l"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = saved(named.select("h1", "h2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "first").alias("head")), "named")
    return signed.select("key", "h1", "h2").join(named, ["h1", "h2"]).select("key", "first", "n_links", "head")


def join(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """(doc_id, class_id, n_links, cluster_id) of every document.

    class_id: smallest doc_id with an equal set; n_links: other documents of at least that similarity, copies
    included; cluster_id: smallest doc_id reached over links.  A document without words stands for itself.
    """
    linked = clusters(docs.filter("doc_id is not null"), similarity, recall)
    linked = linked.select(_id("key").alias("doc_id"), _id("first").alias("class_id"), "n_links", _id("head").alias("cluster_id"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    bare = docs.filter(F.col("doc_id").isNull() | ~worded).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("cluster_id"))
    return linked.unionByName(bare)


def distinct(docs: DataFrame, **options) -> DataFrame:
    """One row of each cluster, with the smallest doc_id (any of those that repeat it and its text), and every row without words; all columns."""
    found = clusters(docs, **options).filter("n_links > 0").groupBy("key").agg(F.any_value("head").alias("head"), F.count(F.lit(1)).alias("rows"))
    found = saved(found.filter("key <> head or rows > 1").select(F.col("key").alias("_k"), (F.col("key") == F.col("head")).alias("_stays")), "dropped")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("key"))
    alone = keyed.join(found, F.col("key") == F.col("_k"), "left_anti").select("row.*")
    repeated = found.filter("_stays")
    if not repeated.limit(1).count():
        return alone
    return alone.union(keyed.join(repeated, F.col("key") == F.col("_k"), "left_semi").dropDuplicates(["key"]).select("row.*"))
