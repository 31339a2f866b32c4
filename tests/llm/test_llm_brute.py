"""Operators that SQL can't express: brute force, exact round trips, held-out accuracy."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import language, near_duplicates, queries, suffix_dedup, token_ids, toxicity, warc
from threadloom.llm.common import table

key = lambda row: tuple((x is None, x) for x in row)
rng = random.Random(1)
BASE = "".join(rng.choice("abcd ") for _ in range(3000))
TEXTS = [(1, BASE[:700]), (2, BASE[300:1200]), (3, None), (4, ""), (5, "a" * 900), (6, "b" * 199), (7, "ab" * 300), (8, BASE[:700]), (None, BASE[1500:2000]), (9, "é" * 50 + BASE[1600:1900]), (9, "zz" + BASE[100:500] + "q" + BASE[50:400]), (9, "zz" + BASE[100:500] + "q" + BASE[50:400]), (10, "c" * 10000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")


# substring deduplication


def removed_brute(rows, span):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, t in raw:
        seen.update(t[p : p + span] for p in range(len(t) - span + 1))
    out = []
    for i, t in raw:
        marks = np.zeros(len(t) + 1, int)
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                marks[p] += 1
                marks[p + span] -= 1
        gone = np.cumsum(marks)[: len(t)] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=key)


def removed(docs, **options):
    n = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    found = suffix_dedup.cleaned(docs, **options)
    return sorted((tuple(r) for r in found.select("doc_id", (F.length("kept") + n).alias("n"), n.alias("r"), F.size("spans").cast("long"), F.sha2("kept", 256)).collect()), key=key)


@pytest.mark.parametrize("options", [{"span": 200}, {"span": 40, "gram": 8}, {"span": 40, "gram": 8, "hot": 1}])
def test_removed_spans(spark, options):
    assert removed(frame(spark, TEXTS), **options) == removed_brute(TEXTS, options["span"])


def test_removed_spans_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long + "x" + long[2500:7000]), (2, long[100:8000]), (3, "y" * 7000), (4, long[8500:])]
    docs = spark.createDataFrame([(i, t, "k", "t", 0) for i, t in rows], "doc_id long, text string, key string, trigger string, spans int")
    assert removed(docs, span=200) == removed_brute(rows, 200)


def test_removed_spans_of_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op1_suffix_dedup(spark, SF).collect()), key=key)
    assert got == removed_brute(rows, 200)
    assert removed(frame(spark, [])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 6))
def test_ranks_are_a_suffix_order(parts, depth):
    data = np.frombuffer(b"".join(parts), np.uint8)
    rank = suffix_dedup.ranks(data, depth)
    raw = bytes(data) + bytes(depth)
    words = [raw[k : k + depth] for k in range(len(data))]
    order = {w: n for n, w in enumerate(sorted(set(words)))}
    assert rank.tolist() == [order[w] for w in words]


# near duplicates


def near_brute(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w and i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    where = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    first, top, links = {}, {i: i for i in sets}, collections.Counter()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        first.setdefault(sets[i], i)
        both = collections.Counter(j for g in sets[i] for j in where[g])
        for j, n in both.items():
            if j != i and n * (1 + least) >= least * (len(sets[i]) + len(sets[j])) - 1e-9:
                links[i] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (first[s], links[i], find(i)) for i, s in sets.items()}


def near_cases():
    r = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one"), (5, "a b c d e"), (6, "a b c d f"), (7, "x " * 20000)]
    for g in range(6):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([30, 120, 400]))]
        for _ in range(r.randint(1, 30)):
            own = list(words)
            for _ in range(r.randint(0, len(own) // 60)):
                own[r.randrange(len(own))] = f"z{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(own)))
    return [*rows, (len(rows), rows[-1][1])]


@pytest.mark.parametrize("unit", [1024, 6])
def test_near_duplicates(spark, monkeypatch, unit):
    monkeypatch.setattr(near_duplicates, "UNIT", unit)
    rows = near_cases()
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["cluster_id"]) for r in near_duplicates.join(frame(spark, [*rows, (None, "a b c d e")])).collect()}
    want = near_brute(rows)
    assert {i: got[i] for i in want} == want
    assert got[0] == (0, 0, 0) and got[None] == (None, 0, None) and len(got) == len(rows) + 1
    assert near_duplicates.distinct(frame(spark, rows)).count() == sum(1 for i, _ in rows if i not in want or want[i][2] == i)


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    far = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    near = far[1] + " end"
    # a row four times, copies without id, and one id with texts of three groups
    rows = [(1, far[0])] * 4 + [(None, far[2]), (None, far[2]), (5, far[3]), (5, far[1]), (5, near), (7, near), (8, far[3]), (None, far[0]), (None, ""), (9, None), (9, None)]
    stay = [(r["doc_id"], r["text"]) for r in near_duplicates.distinct(frame(spark, rows)).collect()]
    assert sorted((r for r in stay if r[1] not in (far[1], near)), key=key) == sorted([(1, far[0]), (None, far[2]), (5, far[3]), (None, ""), (9, None), (9, None)], key=key)
    assert [i for i, t in stay if t in (far[1], near)] == [5]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["cluster_id"]) for r in near_duplicates.join(frame(spark, rows)).collect() if r["doc_id"] in (1, 5, 7, 8))
    assert got == [(1, 1, 3, 1)] * 4 + [(5, 5, 1, 5), (5, 5, 2, 5), (5, 5, 2, 5), (7, 5, 2, 5), (8, 5, 1, 5)]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.join(frame(spark, [])).count() == 0


def test_depth_shortens_to_the_recall():
    assert near_duplicates.depth(0.8, 0.99) == 6 and near_duplicates.depth(0.8, 0.9995) == 4 and near_duplicates.depth(1.0, 0.9) == near_duplicates.MAX_DEPTH
    tally = np.zeros(near_duplicates.BINS, np.int64)
    assert not near_duplicates.recall_reached(tally, 0.8, 8, 0.9995)
    tally[15] = 100_000
    assert near_duplicates.recall_reached(tally, 0.8, 8, 0.9995)
    tally[0] = 5_000
    assert not near_duplicates.recall_reached(tally, 0.8, 8, 0.9995) and near_duplicates.recall_reached(tally, 0.8, 4, 0.9995)


def edited_groups(groups, copies):
    """Groups of texts whose pairs have similarities from about 0.7 to 0.95."""
    r = random.Random(7)
    rows = []
    for _ in range(groups):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(copies):
            own = list(words)
            for _ in range(r.choice([1, 1, 2])):
                own[r.randrange(len(own))] = f"z{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_links_depend_on_no_unit_size_and_reach_the_recall(spark, monkeypatch):
    rows = edited_groups(20, 12)
    want = sum(n for _, n, _ in near_brute(rows).values())
    found = {}
    for unit in (1024, 4):
        monkeypatch.setattr(near_duplicates, "UNIT", unit)
        found[unit] = sorted((r["doc_id"], r["n_links"], r["cluster_id"]) for r in near_duplicates.join(frame(spark, rows), recall=0.9).collect())
    assert found[4] == found[1024]
    assert 0.9 * want <= sum(n for _, n, _ in found[4]) <= want


@pytest.mark.parametrize("edges", [0, 1 << 17])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(near_duplicates, "EDGES", edges)
    r = random.Random(8)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)] + [(200, k) for k in range(150, 170)]
    top = {x: x for p in pairs for x in p}
    for _ in top:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = near_duplicates.components(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: t for x, t in top.items() if any(a != b and x in (a, b) for a, b in pairs)}


def test_trie_nodes_are_runs_of_common_prefixes(spark):
    r = random.Random(3)
    rows = []
    for rep in range(300):
        label = []
        for _ in range(near_duplicates.TREES):
            h = [r.choice([0, 1, 0xFFFF]) if k > 1 else r.choice([0, 0x8000, 5]) for k in range(8)]
            for half in (h[:4], h[4:]):
                x = sum(v << (48 - 16 * k) for k, v in enumerate(half)) ^ (1 << 63)
                label.append(x - (1 << 64) if x >= 1 << 63 else x)
        rows.append((rep, 5, label))
    leaves = near_duplicates.trie(spark.createDataFrame(rows, "rep long, n long, labels array<long>").repartition(3), [8, 6, 3])
    got = {(x["rep"], x["tree"]): x["nodes"] for x in leaves.collect()}
    for k, d in enumerate((8, 6, 3)):
        prefix = {(rep, t): (t, *[(label[2 * t + j // 4] >> (48 - 16 * (j % 4))) & 0xFFFF for j in range(d)]) for rep, _, label in rows for t in range(near_duplicates.TREES)}
        runs, nodes = collections.defaultdict(set), collections.defaultdict(set)
        for leaf, p in prefix.items():
            runs[p].add(leaf)
        for leaf, own in got.items():
            nodes[own[k]].add(leaf)
        if d == 3:
            assert sorted(map(sorted, nodes.values())) == sorted(sorted(v) for v in runs.values() if len(v) > 1)
        assert all(len({prefix[x] for x in v}) == 1 for v in nodes.values()) and len(nodes) == len({prefix[x] for x in got})


# token ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60000), st.integers(0, (1 << 64) - 1)), max_size=700), st.sampled_from([16, 64, 1024]))
def test_packed_ids_come_back(ids, block):
    ids = np.array(ids, np.uint64)
    words, offsets, exceptions = token_ids.pack(ids, block)
    assert (token_ids.unpack(words, offsets, exceptions, len(ids), block) == ids).all()


def test_a_block_is_read_alone():
    ids = np.arange(5000) * 7 % 50000
    data = token_ids.shard([None, 3], [1000, 4000], ids)
    doc_ids, lengths, part = token_ids.read_shard(data, 2, 4)
    assert doc_ids == [None, 3] and lengths.tolist() == [1000, 4000] and (part == ids[2 * token_ids.BLOCK : 4 * token_ids.BLOCK]).all()
    with pytest.raises(ValueError):
        token_ids.read_shard(b"nothing here")


WORDS = ["a b", " a", "a ", "a  b", "a\n b", "a \nb", "x\n \nfoo", "<|endoftext|> x", "foo, bar. baz's 12 3,4 é,   x", "\tq w　 e", "x.y, z..", "w\n\n next", "it's a", "Ünï çà ñandú!? a###b c### ##", "ɐɑ ab"]


def test_words_make_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    own, whole = token_ids.Words(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for _ in range(3):
        for text in [*WORDS, " ".join(WORDS)]:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rows", [None, [], [*TEXTS, *((20 + k, t) for k, t in enumerate(WORDS))]])
def test_token_id_files(spark, monkeypatch, rows):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents") if rows is None else frame(spark, rows)
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for i, t in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = token_ids.decode(token_ids.encode(docs, queries.tokenizer_path())).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x or 0))


# archives

PAGES = [(1, "http://a", "x" * 100000), (2, None, "x" * 100000), (3, "u", None), (4, "u", ""), (None, "u", "x" * 100000), (5, "http://q\r\nZ", "é" * 9000), (5, "http://q", "é" * 9000), (6, "u", "abc"), (7, "u", "abc"), (7, "u", "abc"), (8, "u", "solo" * 5000), (8, "u", "other")]


def pages_brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = i is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=key)


def test_pages_come_back(spark):
    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op10_warc(spark, SF).collect()), key=key) == pages_brute(rows)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 300, "chunk_bytes": 70}])
def test_awkward_pages_come_back(spark, options):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.read(warc.write(pages, **options)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == pages_brute(PAGES)
    assert sorted(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response") == sorted(h or "" for (i, _, h), kind in zip(PAGES, [x for x in (("revisit" if i is not None and min(j for j, _, g in PAGES if j is not None and (g or "") == (h or "")) != i else "response") for i, _, h in PAGES)]) if kind == "response")
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert warc.read(warc.write(pages, revisit_bytes=1 << 30)).filter("record_type = 'revisit'").count() == 0


def test_broken_records_stop(spark, tmp_path):
    import gzip

    def archive(*parts):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.warc.gz"
        path.write_bytes(b"".join(gzip.compress(p) for p in parts))
        return spark.createDataFrame([(f"file://{path}",)], "path string")

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'abc')}"), ("Page-ID", 1)]
    more = lambda k, total: [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:a{k}>"), ("WARC-Segment-Origin-ID", "<urn:a>"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)]
    first = warc.record([*head, ("WARC-Segment-Number", 1)], block[:20])
    rest = (warc.record(more(3, len(block)), block[50:]), warc.record(more(2, None), block[20:50]))
    assert bytes(warc.read(archive(*rest, first)).first()["payload"]) == b"abc"
    assert bytes(warc.read(archive(warc.record(head, block))).first()["payload"]) == b"abc"
    for bad in ((first, rest[0]), (first, warc.record(more(2, len(block) + 1), block[20:])), (warc.record(head, block.replace(b"abc", b"abd")),)):
        with pytest.raises(Exception, match="segments are missing|digest differs"):
            warc.read(archive(*bad)).collect()


# classifiers


def test_languages_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = queries.op6_language(spark, SF).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("123 ?!", "en"), ("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the bird", None), ("é" * 50000, None)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[5]["lang_pred"] == "en" and got[0]["score"] == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    r = random.Random(9)
    words, bad = [f"w{k}" for k in range(300)], ["vile", "scorn", "filth"]
    rows, labels = [], []
    for i in range(1500):
        own = r.choices(words, k=r.randint(5, 200))
        toxic = int(r.random() < 0.15)
        for _ in range(toxic * 2):
            own[r.randrange(len(own))] = r.choice(bad)
        rows.append((i, " ".join(own)))
        if r.random() < 0.6:
            labels.append((i, toxic))
    rows += [(None, "vile"), (2000, None), (2001, "")]
    labels += [(5000, 1), (None, 1), (3, None)]
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(x["predicted"], truth[x["doc_id"]]) for x in got if x["held_out"] and truth.get(x["doc_id"]) is not None]
    assert len(got) == len(rows) and len(held) > 100
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)


def test_toxicity_prior_is_the_share_of_toxic_labels(spark, monkeypatch):
    priors = []
    monkeypatch.setattr(toxicity, "learn", lambda positive, unlabelled, prior: priors.append(prior))
    rows = [(i, int(i % 4 > 0)) for i in range(200)]
    toxicity.toxicity(frame(spark, [(i, f"word{i}") for i, _ in rows]), spark.createDataFrame(rows, "doc_id long, toxic int"))
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert priors == [pytest.approx(sum(learnt) / len(learnt))] and priors[0] > 0.7


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(frame(spark, TEXTS), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0
