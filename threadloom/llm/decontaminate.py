"""Benchmark decontamination by winnowing.

Texts become words; every K words hash to a fingerprint, and of each WINDOW consecutive fingerprints the smallest is
kept.  With K + WINDOW - 1 = SPAN, two texts that share SPAN words in a row keep a common fingerprint, so joining
kept fingerprints loses no shared span.  A match fixes how document and item line up; comparing words along that
line extends it and settles exactly which windows occur.  Items of fewer than SPAN words are matched whole, by
the hash of all their words.  Everything is DataFrame operations.

The fingerprints of the benchmark are broadcast while there are at most BROADCAST_ROWS of them, so are the ids of
documents with matches, and the items while they have at most BROADCAST_BYTES; beyond that the same joins shuffle.

Nulls and edge cases: null and empty texts have no words; items without words match nothing; item ids count
once however many rows they have, and a null item id is the string "null"; repeated documents get equal rows;
documents with equal ids and different texts are told apart by a hash of the text; an empty benchmark marks
nothing.  Texts of fewer than 2^26 words are supported, which is beyond the 2 GB limit of a value for words of 30 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import saved

SPAN, K = 13, 6
WINDOW = SPAN - K + 1
PLACE_BITS = 26
#: What is broadcast has at most so many rows (of fixed width, or of so many bytes in all).
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(df: DataFrame) -> DataFrame:
    """Add ``w``, the words of ``text``."""
    plain = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    df = df.withColumn("_p", F.split(F.coalesce(plain, F.lit("")), GAPS))
    first, last = "int(_p[0] = '')", "int(element_at(_p, -1) = '')"
    return df.withColumn("w", F.expr(f"slice(_p, 1 + {first}, greatest(0, size(_p) - {first} - {last}))")).drop("_p")


def _grams(k: int) -> str:
    """SQL of the packed hashes of every k words: hash above, place below."""
    words = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}), i -> shiftleft(xxhash64({words}), {PLACE_BITS}) | bigint(i)))"


def _fingerprints(df: DataFrame, ids: list[str], short: list[int]) -> DataFrame:
    """(ids, kind, hash, place) of kept fingerprints (kind SPAN) and of all runs of the lengths in ``short``, in one pass.

    A row of kind 0 tells the number of a text's words as its place.
    """
    df = df.select(*ids, "w", F.expr(f"if(size(w) < {SPAN}, array(), {_grams(K)})").alias("_g"))
    kept = f"if(size(_g) < {WINDOW}, array(), array_distinct(transform(sequence(0, size(_g) - {WINDOW}), i -> array_min(slice(_g, i + 1, {WINDOW})))))"
    kinds = ["array(struct(0 as kind, bigint(size(w)) as f))", f"transform({kept}, f -> struct({SPAN} as kind, f as f))", *(f"transform({_grams(k)}, f -> struct({k} as kind, f as f))" for k in short)]
    out = df.select(*ids, F.explode(F.expr(f"concat({', '.join(kinds)})")).alias("e"))
    return out.select(*ids, "e.kind", F.expr(f"shiftright(e.f, {PLACE_BITS})").alias("hash"), F.expr(f"int(e.f & {(1 << PLACE_BITS) - 1}L)").alias("place"))


def _small(df: DataFrame, size: F.Column | None = None) -> DataFrame:
    """``df``, with a broadcast hint if it has few rows (and few bytes, where ``size`` tells those of a row)."""
    few = df.limit(BROADCAST_ROWS + 1)
    rows, held = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def _text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_words) of every row, and (doc_id, text_hash, item_ids, starts, length): windows of an item's words
    in a document, by the place of their first words, and the ids of all items with these words."""
    named = _words(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")).filter("size(w) > 0")
    # items with the same words are one, named by 128 bits of them
    items = saved(named.groupBy(F.md5(F.array_join("w", " ")).alias("item")).agg(F.any_value("w").alias("w"), F.array_sort(F.collect_set("item_id")).alias("item_ids")), "items")
    short = [r[0] for r in items.filter(F.size("w") < SPAN).select(F.size("w")).distinct().collect()]  # of 1 ... SPAN - 1
    own = _fingerprints(items, ["item"], sorted(short)).join(items.select("item", F.least(F.size("w"), F.lit(SPAN)).alias("kind")), ["item", "kind"])
    own = saved(own.withColumnRenamed("place", "item_place"), "item-fingerprints")
    texts = docs.select("doc_id", _text_hash().alias("text_hash"), "text")
    prints = _fingerprints(_words(texts), ["doc_id", "text_hash"], sorted(short))
    # one pass over the texts serves the counts of words too, so the join keeps the rows of kind 0
    marks = prints.join(_small(own), ["kind", "hash"], "left").filter("kind = 0 or item is not null")
    marks = saved(marks.select("doc_id", "text_hash", "kind", "item", "place", (F.col("place") - F.col("item_place")).alias("shift")), "marks")
    sizes = marks.filter("kind = 0").select("doc_id", "text_hash", F.col("place").cast("long").alias("n_words"))
    lines = saved(marks.filter("item is not null").select("doc_id", "text_hash", "item", "shift").distinct(), "lines")
    ids = lines.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    found = _words(texts.join(_small(ids), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("w").alias("dw"))
    named_words = _small(items.withColumnRenamed("w", "iw"), F.length(F.array_join("iw", " ")) + F.length(F.array_join("item_ids", " ")))
    both = lines.join(named_words, "item").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    both = both.select("doc_id", "text_hash", "item_ids", "shift", F.expr(f"least({SPAN}, size(iw))").alias("length"), F.expr("transform(iw, (x, j) -> coalesce(x = get(dw, shift + j), false))").alias("_m"))
    starts = "transform(filter(sequence(0, size(_m) - length), j -> forall(slice(_m, j + 1, length), x -> x)), j -> j + shift)"
    return sizes, both.withColumn("starts", F.expr(starts)).filter("size(starts) > 0").select("doc_id", "text_hash", "item_ids", "starts", "length")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    n_hit: words inside any occurring window; contaminated: they are at least a twentieth of the words.
    """
    spans = F.flatten(F.collect_list(F.expr("transform(starts, s -> struct(s as a, s + length as b))")))
    sizes, found = matches(docs, benchmark)
    hits = found.groupBy("doc_id", "text_hash").agg(F.array_sort(spans).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"))
    covered = "aggregate(s, struct(0L as n, 0 as till), (a, x) -> struct(a.n + greatest(0, x.b - greatest(a.till, x.a)) as n, greatest(a.till, x.b) as till), a -> a.n)"
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.expr(covered).alias("n"), "i")
    out = sizes.join(_small(hits, F.lit(64) + 16 * F.size("i")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    n_hit, ids = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("i", F.array().cast("array<string>"))
    out = out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, all columns.

    A document goes if SPAN of its words, in one window or more, are hit, however long it is, or if it is contaminated.  So an
    item of fewer words condemns short documents only: it may well occur in a long one by chance.
    """
    bad = contamination(docs, benchmark).filter(f"n_hit >= {SPAN} or contaminated")
    bad = saved(bad.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_t"])
    return docs.join(_small(bad), same, "left_anti")


RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[j + 1 : j + n], ' ') AS g FROM (SELECT item_id, w, least({SPAN}, len(w)) AS n, unnest(range(0, len(w) - least({SPAN}, len(w)) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, n, j, array_to_string(w[j + 1 : j + n], ' ') AS g FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS j FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT rid, item_id, j, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + n)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
