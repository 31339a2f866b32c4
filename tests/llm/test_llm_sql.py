"""Operators that SQL can express, against DuckDB on the small tables and on awkward rows."""

import pandas as pd
import pytest
from conftest import SF, rows_of

from threadloom.llm import chat, decontaminate, mixing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.ORACLE_SQL[name]).fetchdf())


LONG = " ".join(f"w{i % 7000}" for i in range(20000))
TEXTS = [None, "", "  \n\t ", "one", "Foo bar baz\nFoo bar baz\n\nq", "# * $ | x " * 30, LONG, "a b c " * 40, "é ß ü " * 30 + "\x1c  end", "the same row " + "k " * 60, "the same row " + "k " * 60]
DOCS = [(i if i != 2 else None, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "sé"][i % 4], 0, "extra") for i, t in enumerate(TEXTS)] + [(10, TEXTS[-1], "en", "s1", 0, "again")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def duck_with(**tables):
    import duckdb

    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        frame = pd.DataFrame(rows, columns=columns)
        for c in columns:
            frame[c] = frame[c].astype("Int64") if c in ("doc_id", "item_id", "n_chars", "conv_id", "turn") else frame[c].astype("string")
        con.register(name, frame)
    return con


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.mark.parametrize("rows", [DOCS, [], DOCS[:1]])
def test_quality_on_awkward_rows(spark, rows):
    got = quality.verdicts(spark.createDataFrame(rows, SCHEMA)).select(*quality.RESULT).toPandas()
    assert rows_of(got) == rows_of(duck_with(documents=(rows, NAMES)).execute(quality.sql()).fetchdf())
    kept = quality.kept(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == NAMES and kept.count() == got["kept"].sum()


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    import random

    rng = random.Random(2)
    clean = [" ".join("abcdefghij"[: rng.randint(2, 9)] + str(rng.randint(0, 999)) for _ in range(120)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:20]]
    rows = [(i, t, "en", "s", 0, "") for i, t in enumerate(clean + junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 320))


@pytest.mark.parametrize("copies", [False, True])
def test_quality_rejects_junk_that_is_a_third_of_a_group(spark, copies):
    import random

    rng = random.Random(2)
    clean = [" ".join("abcdefghij"[: rng.randint(2, 9)] + str(rng.randint(0, 999)) for _ in range(120)) for _ in range(400)]
    varied = [" ".join(w + "###" if rng.random() < 0.9 else w for w in t.split()) for t in clean[:200]]
    rows = [(i, t, "en", "s", 0, "") for i, t in enumerate(clean + (varied[:1] * 200 if copies else varied))]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(400, 600))


@pytest.mark.parametrize("rows", [DOCS, []])
def test_mixing_on_awkward_rows(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    want = duck_with(documents=(rows, NAMES)).execute(mixing.SQL).fetchdf()
    assert rows_of(got) == rows_of(want)
    mixed = mixing.mixed(d)
    assert mixed.columns == NAMES
    words = sum(len((r["text"] or "").replace("\x1c", "").replace(" ", "x").split()) for r in mixed.collect())
    assert abs(words - got["taken"].sum()) <= 4


def test_targets_stop_at_twice_a_source(spark):
    rows = [(i, "w " * n, "en", s, 0, "") for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000), (None, 500)])]
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"] == (20.0, 20) and abs(sum(t for t, _ in got.values()) - 1.5 * 2510) < 1e-6
    assert all(abs(t - taken) <= 1 for t, taken in got.values())


ITEMS = [(1, "foo bar baz"), (2, " ".join(f"w{i}" for i in range(3, 30))), (2, "qux"), (None, "K K"), (4, None), (5, "..."), (6, "a b c " * 6), (6, "a b c " * 6)]


@pytest.mark.parametrize("rows,items", [(DOCS, ITEMS), (DOCS, []), ([], ITEMS)])
def test_decontamination_on_awkward_rows(spark, rows, items):
    d, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).select(*decontaminate.RESULT).toPandas()
    want = duck_with(documents=(rows, NAMES), benchmark=(items, ["item_id", "text"])).execute(decontaminate.SQL).fetchdf()
    assert rows_of(got) == rows_of(want)
    assert decontaminate.clean(d, b).count() == len(got) - (got["contaminated"] | (got["n_hit"] >= decontaminate.SPAN)).sum()


def test_winnowing_finds_every_shared_span(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for k in range(12)]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        item = rng.choice(items)[1].split()
        a = rng.randint(0, len(item) - 1)
        words[len(words) // 2 : len(words) // 2] = item[a : a + rng.randint(5, 20)]
        docs.append((k, " ".join(words), "en", "s", 0, ""))
    got = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).select(*decontaminate.RESULT).toPandas()
    assert rows_of(got) == rows_of(duck_with(documents=(docs, NAMES), benchmark=(items, ["item_id", "text"])).execute(decontaminate.SQL).fetchdf())
    assert got["n_hit"].sum() > 0


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "more"), (5, 0, "user", "else"), (None, 0, "user", "none"), (6, 0, "user", ""), (7, 0, None, "x"), (8, None, "user", "tie"), (9, 0, "user", None), (10, 3, "user", "gap"), (10, 7, "user", "gap2"), (11, 1, "user", "gap")]


def test_chats(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    got = chat.render(turns)
    assert sorted(r["conv_id"] or 0 for r in got.collect()) == [0, 3, 5, 6, 7, 8, 9, 10]
    assert {r["conv_id"]: r["n_copies"] for r in got.collect()}[3] == 1
    want = duck_with(conversations=(CHATS, ["conv_id", "turn", "role", "text"])).execute(chat.SQL).fetchdf()
    assert rows_of(got.toPandas()) == rows_of(want)
    assert chat.render(turns.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat.render(tied).count() >= 1
