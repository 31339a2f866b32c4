"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Statistics of each text become a vector of four numbers.  For each language and source, the mean and covariance of the half
of the documents that has the smallest determinant are looked for: several starts (STARTS) are improved by concentration
steps, each of which keeps the half that is closest by Mahalanobis distance, then their determinants are compared and the
smallest decides.  A document far from that estimate is rejected.  So up to half of a group, alike or not, can be outliers.

A half of fewer than MIN_ROWS / 2 documents says little about a covariance of four numbers: groups below MIN_ROWS pool with
their language's other small groups, and if these are too few as well with those of all languages.

A step is one aggregation for all groups and starts: documents are counted and summed by (group, start, distance bin), with
partial sums before the shuffle, and running sums over a few hundred bins give the estimate of the closest documents.
Estimates are broadcast while there are at most BROADCAST_ROWS of them, else rows meet them under a salt.  So no group,
however large, meets in one task.  All of it is DataFrame operations; the statistics are computed once and
saved without their texts (or with the columns named in ``carry``).

Nulls and edge cases: a null or empty text has no words and fails the base rule; null languages and sources are
values like others; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import saved

#: Documents that a group needs for an estimate of its own.
MIN_ROWS = 100
#: Share of a group's documents that an estimate covers, and concentration steps.
COVERAGE = 0.5
STEPS = 6
#: What the concentration steps start from, in this order: distances from the medians, on the scale of the floors or of the
#: quartiles; mean and covariance of all; medians and the covariance of directions from them.
STARTS = ("floors", "quartiles", "all", "directions")
#: Estimates (of a group and start) that are broadcast; with more, rows and estimates are dealt by group and salt.
BROADCAST_ROWS, SALTS = 100_000, 32
#: Chance that a document of a normal population lies beyond the cutoff.
TAIL = 1e-5
#: Statistics are kept as whole multiples of 1 / SCALE, so that sums do not depend on their order.
SCALE = 10_000
#: Deviations below which no statistic is held to be narrow: log word length, root of symbols a word, shares.
FLOORS = (0.1, 0.08, 0.1, 0.1)
DIM = 4


def _solve(f, goal: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > goal else (low, mid)
    return high


#: Chi-square tails with 4 and 6 degrees of freedom in closed form.
_tail4 = lambda x: math.exp(-x / 2) * (1 + x / 2)
_tail6 = lambda x: math.exp(-x / 2) * (1 + x / 2 + x * x / 8)
CUTOFF = round(_solve(_tail4, TAIL), 6)
#: Makes the covariance of the closest documents consistent for a normal population.
CONSISTENCY = round(COVERAGE / (1 - _tail6(_solve(_tail4, 1 - COVERAGE))), 6)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics of every (doc_id, text, lang, source): counts, base_failed and the vector x1 ... x4."""
    # each array is a column of its own projection, so that lambdas read it instead of computing it again
    d = docs.select("doc_id", "lang", "source", *carry, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_b", F.expr("trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM _t)"))
    d = d.withColumn("_w", F.expr(r"if(_b = '', array(), split(_b, '[\\x20\\x09-\\x0D]+'))"))
    d = d.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("_shift", F.expr("length(bin(n_words))"))
    # hash of each three words, with the place of the first in the low bits
    d = d.withColumn("_h", F.expr("if(n_words < 3, array(), sort_array(transform(sequence(0, int(n_words) - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _shift) | bigint(i))))"))
    place = "int({0} & (shiftleft(1L, _shift) - 1))".format
    words = lambda x: f"get(_w, {place(x)}), get(_w, {place(x)} + 1), get(_w, {place(x)} + 2)"
    hashes, same = "shiftright({0}, _shift) = shiftright({1}, _shift)".format, lambda x, y: f"struct({words(x)}) = struct({words(y)})"
    # equal hashes lie side by side; should different words share one, the text's grams are sorted by their words instead
    near = lambda other: f"coalesce({hashes('x', other)}, false)"
    fast = f"transform(filter(_h, (x, k) -> {near('get(_h, k - 1)')} or {near('get(_h, k + 1)')}), x -> {place('x')})"
    clash = f"exists(transform(_h, (x, k) -> {near('get(_h, k - 1)')} and not ({same('x', 'get(_h, k - 1)')})), x -> x)"
    told = "sort_array(transform(sequence(0, int(n_words) - 3), i -> struct(_w[i] as a, _w[i + 1] as b, _w[i + 2] as c, i as i)))"
    equal = "coalesce(({0}.a = {1}.a and {0}.b = {1}.b and {0}.c = {1}.c), false)".format
    slow = f"transform(filter(_s, (x, k) -> {equal('x', 'get(_s, k - 1)')} or {equal('x', 'get(_s, k + 1)')}), x -> x.i)"
    d = d.withColumn("_c", F.expr(f"n_words > 2 and {clash}")).withColumn("_s", F.expr(f"if(_c, {told}, null)"))
    d = d.withColumn("_r", F.expr(f"sort_array(if(_c, {slow}, {fast}))"))
    covered = "aggregate(_r, struct(0L as n, 0 as till), (a, s) -> struct(a.n + (s + 3 - greatest(a.till, s)) as n, s + 3 as till), a -> a.n)"
    d = d.select(
        "doc_id", "lang", "source", *carry, "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr("bigint(size(_l) - size(array_distinct(_l)))").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_l").alias("_n_lines"),
    )
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    vector = ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", "sqrt(n_symbols / greatest(n_words, 1))", "n_dup_lines / greatest(_n_lines, 1)", "n_repeat_words / greatest(n_words, 1)")
    return d.select("*", *(F.expr(f"floor({SCALE} * ({x}) + 0.5D)").cast("double").alias(f"x{i + 1}") for i, x in enumerate(vector))).drop("_n_lines")


def _groups(stats: DataFrame) -> DataFrame:
    """(_l, _s, _level) of each language and source: whether it has an estimate of its own (2), pools with its language (1) or with all."""
    n = stats.filter("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < MIN_ROWS, F.col("n"))
    by_lang = n.groupBy("lang").agg(F.coalesce(F.sum(small), F.lit(0)).alias("m"))
    level = F.when(F.col("n") >= MIN_ROWS, 2).when(F.col("m") >= MIN_ROWS, 1).otherwise(0)
    n = n.join(by_lang.withColumnRenamed("lang", "_m"), F.col("lang").eqNullSafe(F.col("_m"))).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), level.alias("_level"))
    return saved(n, "groups")


def _grouped(stats: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Add ``grp``: language and source, or what a small group pools with."""
    own = F.when(F.col("_level") == 2, F.concat(F.lit("2:"), F.to_json(F.struct("lang", "source")))).when(F.col("_level") == 1, F.concat(F.lit("1:"), F.to_json(F.struct("lang"))))
    found = stats.join(F.broadcast(groups) if few else groups, stats["lang"].eqNullSafe(groups["_l"]) & stats["source"].eqNullSafe(groups["_s"]), "left")
    return found.withColumn("grp", F.coalesce(own, F.lit("0:"))).drop("_l", "_s", "_level")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, DIM + 1) for j in range(1, i + 1)]


def _estimate(n: str = "n", scale: float | None = None) -> dict[str, str]:
    """SQL of means m_i and of the Cholesky factor l_ij of the covariance, from sums n, s_i and q_ij; each may use those before."""
    out = {f"m{i}": f"s{i} / {n}" for i in range(1, DIM + 1)}
    for i, j in _pairs():
        floor = f" + {(FLOORS[i - 1] * SCALE) ** 2:.1f}" if i == j else ""
        rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        cov = f"{CONSISTENCY if scale is None else scale} * (q{i}{j} / {n} - m{i} * m{j}){floor}{rest}"
        out[f"l{i}{j}"] = f"sqrt({cov})" if i == j else f"({cov}) / l{j}{j}"
    return out


def _distance() -> dict[str, str]:
    """SQL of z_i, the standardised vector, and of its squared length d2."""
    out = {f"z{i}": f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(1, i))}) / l{i}{i}" for i in range(1, DIM + 1)}
    return out | {"d2": " + ".join(f"z{i} * z{i}" for i in range(1, DIM + 1))}


#: Bins of squared distance: 16 to an octave.
BIN = "cast(floor(16 * log2(d2 + 0.0001)) as int)"
SUMS = {"n": "count(*)"} | {f"s{i}": f"sum(x{i})" for i in range(1, DIM + 1)} | {f"q{i}{j}": f"sum(x{i} * x{j})" for i, j in _pairs()}
PARAMS = [f"m{i}" for i in range(1, DIM + 1)] + [f"l{i}{j}" for i, j in _pairs()]
X = [f"x{i}" for i in range(1, DIM + 1)]
#: Logarithm of an estimate's determinant, in whole millionths.
DETERMINANT = f"cast(floor(2000000 * ({' + '.join(f'ln(l{i}{i})' for i in range(1, DIM + 1))}) + 0.5) as bigint)"


def _spread(center: str, scales: list[str]) -> dict[str, str]:
    """SQL of a diagonal estimate: means are ``center`` followed by the number of the statistic, deviations are given."""
    return {f"m{i}": f"{center}{i}" for i in range(1, DIM + 1)} | {f"l{i}{j}": scales[i - 1] if i == j else "0.0D" for i, j in _pairs()}


def _starting() -> dict[str, dict[str, str]]:
    """SQL of each start's estimate, from a group's quartiles a_i, b_i, c_i and sums (t_ij: of products of directions)."""
    floors = [f"{f * SCALE:.1f}D" for f in FLOORS]
    # quartiles of a normal population lie 1.349 deviations apart
    quartiles = [f"greatest({f}, (c{i} - a{i}) / 1.349D)" for i, f in enumerate(floors, 1)]
    directions = {f"m{i}": f"b{i}" for i in range(1, DIM + 1)}
    for i, j in _pairs():
        rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        cov = f"{DIM}.0D * {floors[i - 1]} * {floors[j - 1]} * (t{i}{j} / n / 1000000.0D{' + 0.01D' if i == j else ''}){rest}"
        directions[f"l{i}{j}"] = f"sqrt({cov})" if i == j else f"({cov}) / l{j}{j}"
    return {"floors": _spread("b", floors), "quartiles": _spread("b", quartiles), "all": _estimate(scale=1.0), "directions": directions}


def _toward() -> dict[str, str]:
    """SQL of z_i, the place of a document seen from its group's medians b_i on the scale of the floors, r its distance, and of
    whole millionths t_ij of the products of its direction's parts."""
    out = {f"z{i}": f"(x{i} - b{i}) / {FLOORS[i - 1] * SCALE:.1f}D" for i in range(1, DIM + 1)}
    out["r"] = " + ".join(f"z{i} * z{i}" for i in range(1, DIM + 1))
    return out | {f"t{i}{j}": f"floor(1000000.0D * z{i} * z{j} / (r + 0.0001D) + 0.5D)" for i, j in _pairs()}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns, each of which may use those before."""
    return df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in columns.items()))


def _met(rows: DataFrame, params: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with the estimates of their group; the rows of a large group are never brought together for that."""
    if few:
        return rows.join(F.broadcast(params), "grp", how)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["grp", "_salt"], how).drop("_salt")


def _concentrated(distances: DataFrame) -> DataFrame:
    """Estimate of each group and start from its closest documents, given (grp, start, x1 ... x4, d2)."""
    # saved, as else one shuffle by grp would serve the sums too and bring a large group's partial sums to one task
    bins = saved(distances.withColumn("bin", F.expr(BIN)).groupBy("grp", "start", "bin").agg(*(F.expr(sql).alias(c) for c, sql in SUMS.items())), "bins")
    till = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select("grp", "start", "bin", F.sum("n").over(Window.partitionBy("grp", "start")).alias("total"), *(F.sum(c).over(till).cast("double").alias(c) for c in SUMS))
    first = Window.partitionBy("grp", "start").orderBy("bin")
    enough = sums.filter(f"n >= {COVERAGE} * total").withColumn("k", F.row_number().over(first)).filter("k = 1")
    return _with(enough, _estimate()).select("grp", "start", *PARAMS)


def _started(sound: DataFrame, few: bool) -> DataFrame:
    """(grp, start, parameters) of all starts, from (grp, x1 ... x4)."""
    # quartiles from counted values
    pairs = ", ".join(f"struct({i} as i, floor(x{i} / 100) as v)" for i in range(1, DIM + 1))
    values = saved(sound.select("grp", F.explode(F.expr(f"array({pairs})")).alias("e")).groupBy("grp", "e").count(), "values")
    till = Window.partitionBy("grp", "e.i").orderBy("e.v")
    counted = values.withColumn("c", F.sum("count").over(till.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("count").over(Window.partitionBy("grp", "e.i")))
    at = lambda i, quarter: F.expr(f"min(if(e.i = {i} and 4 * c >= {quarter} * t, e.v, null)) * 100.0D + 50.0D")
    quartiles = saved(counted.groupBy("grp").agg(*(at(i, k + 1).alias(f"{c}{i}") for k, c in enumerate("abc") for i in range(1, DIM + 1))), "quartiles")
    seen = _with(_met(sound, quartiles.select("grp", *(f"b{i}" for i in range(1, DIM + 1))), few), _toward())
    # sums by group and a share of the rows first, as all of a group's partial sums would meet in one task
    part = F.pmod(F.xxhash64(*X), F.lit(SALTS)).alias("part")
    sums = SUMS | {f"t{i}{j}": f"sum(t{i}{j})" for i, j in _pairs()}
    parts = saved(seen.groupBy("grp", part).agg(*(F.expr(sql).alias(c) for c, sql in sums.items())), "parts")
    base = saved(quartiles.join(parts.groupBy("grp").agg(*(F.sum(c).cast("double").alias(c) for c in sums)), "grp"), "starts")
    out = None
    for k, name in enumerate(STARTS):
        one = _with(base, _starting()[name]).select("grp", F.lit(k).alias("start"), *(F.col(c).cast("double").alias(c) for c in PARAMS))
        out = one if out is None else out.unionByName(one)
    return out


def verdicts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of every document, with ``distance2`` (null if the base rule fails) and ``kept``."""
    stats = saved(statistics(docs, carry), "statistics")
    groups = _groups(stats)
    few = groups.limit(BROADCAST_ROWS + 1).count() * len(STARTS) <= BROADCAST_ROWS
    stats = _grouped(stats, groups, few)
    sound = stats.filter("not base_failed").select("grp", *X)
    params = _started(sound, few)
    for _ in range(STEPS + 1):
        params = _concentrated(_with(_met(sound, params, few), _distance()))
    best = params.withColumn("det", F.expr(DETERMINANT)).groupBy("grp").agg(F.min_by(F.struct(*PARAMS), F.struct("det", "start")).alias("p"))
    out = _with(_met(stats, best.select("grp", "p.*"), few, "left"), _distance())
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select("doc_id", *carry, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance2"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return verdicts(rows, ("_row",)).filter("kept").select("_row.*")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """The same rules in DuckDB's SQL: base statistics by joins and windows over exploded words, then every step as a view."""
    w = r"'[^\x20\x09-\x0D]+'"

    def chain(columns: dict[str, str], source: str) -> str:
        for name, expression in columns.items():
            # whole and decimal literals would make decimals of DuckDB's doubles
            expression = re.sub(r"\b(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", expression)
            source = f"(SELECT *, {expression} AS {name} FROM {source})"
        return source

    parts = [
        "docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents)",
        f"w AS (SELECT *, regexp_extract_all(t, {w}) AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {w})) AS l FROM docs)",
        "g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i:i+2]})) AS u FROM w WHERE len(w) > 2)",
        "h AS (SELECT rid, u.i AS i, count(*) OVER (PARTITION BY rid, u.g) AS c FROM g)",
        "r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY rid)",
        "b AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN r USING (rid))",
        f"s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, floor({SCALE} * ln(greatest(word_chars, 1) / greatest(n_words, 1)) + 0.5) AS x1, floor({SCALE} * sqrt(n_symbols / greatest(n_words, 1)) + 0.5) AS x2, floor({SCALE} * (n_dup_lines / greatest(n_lines, 1)) + 0.5) AS x3, floor({SCALE} * (n_repeat_words / greatest(n_words, 1)) + 0.5) AS x4 FROM b)",
        "c2 AS (SELECT lang, source, count(*) AS n FROM s WHERE NOT base_failed GROUP BY ALL)",
        f"c1 AS (SELECT lang, coalesce(sum(n) FILTER (n < {MIN_ROWS}), 0) AS m FROM c2 GROUP BY lang)",
        f"x AS (SELECT s.*, CASE WHEN n >= {MIN_ROWS} THEN '2' || coalesce('=' || s.lang, '-') || chr(31) || coalesce('=' || s.source, '-') WHEN m >= {MIN_ROWS} THEN '1' || coalesce('=' || s.lang, '-') ELSE '0' END AS grp FROM s LEFT JOIN c2 ON s.lang IS NOT DISTINCT FROM c2.lang AND s.source IS NOT DISTINCT FROM c2.source LEFT JOIN c1 ON s.lang IS NOT DISTINCT FROM c1.lang)",
        "m AS (SELECT grp, " + ", ".join(f"list_sort(list(floor(x{i} / 100)))[CAST(ceil({k + 1} * count(*) / 4) AS INT)] * 100 + 50 AS {c}{i}" for k, c in enumerate("abc") for i in range(1, DIM + 1)) + " FROM x WHERE NOT base_failed GROUP BY grp)",
        f"v AS (SELECT * FROM {chain(_toward(), '(SELECT x.grp, x1, x2, x3, x4, b1, b2, b3, b4 FROM x JOIN m USING (grp) WHERE NOT base_failed)')})",
        "u AS (SELECT grp, " + ", ".join(f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in (SUMS | {f"t{i}{j}": f"sum(t{i}{j})" for i, j in _pairs()}).items()) + " FROM v GROUP BY grp)",
        "p AS (" + " UNION ALL ".join(f"SELECT grp, {k} AS start, {', '.join(PARAMS)} FROM {chain(_starting()[name], '(SELECT * FROM m JOIN u USING (grp))')}" for k, name in enumerate(STARTS)) + ")",
    ]
    for k in range(STEPS + 1):
        before = "p" if k == 0 else f"p{k - 1}"
        sums = ", ".join(f"{sql} AS {c}" for c, sql in SUMS.items())
        running = ", ".join(f"CAST(sum({c}) OVER (PARTITION BY grp, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS {c}" for c in SUMS)
        parts.append(f"d{k} AS (SELECT grp, start, x1, x2, x3, x4, d2 FROM {chain(_distance(), f'(SELECT * FROM x JOIN {before} USING (grp) WHERE NOT base_failed)')})")
        parts.append(f"e{k} AS (SELECT grp, start, bin, sum(n) OVER (PARTITION BY grp, start) AS total, {running} FROM (SELECT grp, start, {BIN} AS bin, {sums} FROM d{k} GROUP BY ALL))")
        parts.append(f"p{k} AS (SELECT grp, start, {', '.join(PARAMS)} FROM {chain(_estimate(), f'(SELECT * FROM e{k} WHERE n >= {COVERAGE} * total QUALIFY row_number() OVER (PARTITION BY grp, start ORDER BY bin) = 1)')})")
    parts.append(f"best AS (SELECT * FROM p{STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {DETERMINANT}, start) = 1)")
    parts.append(f"d AS (SELECT rid, d2 FROM {chain(_distance(), '(SELECT * FROM x JOIN best USING (grp) WHERE NOT base_failed)')})")
    return "WITH " + ",\n".join(f"{p.partition(' AS ')[0]} AS MATERIALIZED {p.partition(' AS ')[2]}" for p in parts) + f"\nSELECT {', '.join(f'x.{c}' for c in RESULT[:-1])}, NOT x.base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept FROM x LEFT JOIN d USING (rid)"
