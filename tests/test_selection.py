"""Selections against plain loops of the same rules, and hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.operators import chunking, pyramid, selection, zones
from threadloom.plans.engine import content_rows
from threadloom.plans.strategies import Autobiographical, Budget, Config, Knowledge, Passthrough, State

MESSAGE = f"session string, msg_id string, pos int, participant string, content {B.CONTENT}"


def text(n):
    return [{"type": "text", "text": "x" * n}]


def use(name, n=8):
    return [{"type": "tool_use", "tool_id": "t", "name": name, "input": "y" * (n - 2)}]


def result(n):
    return [{"type": "tool_result", "tool_use_id": "t", "result_text": "r" * n}]


def log(spark, *sessions):
    rows = [(f"s{k}", f"s{k}-{i}", i, p, content_rows(c)) for k, s in enumerate(sessions) for i, (p, c) in enumerate(s)]
    return spark.createDataFrame(rows, MESSAGE)


def ids(entries):
    out = {}
    for r in entries.orderBy("session", "out_pos").collect():
        out.setdefault(r["session"], []).append(r["source_msg_id"].split("-")[1] if r["source_msg_id"] else r["participant"])
    return out


def number(x):
    return int(x)


def tokens_of(block):
    t = lambda s: -(-len(s) // 4)
    kind = block["type"]
    return t(block["text"]) if kind == "text" else t(block["input_json"]) + 20 if kind == "tool_use" else t(block["result_text"])


def random_sessions(rng, n):
    out = []
    for _ in range(n):
        s = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            s.append(("user" if kind < 0.3 else "bot", text(rng.randint(0, 90)) if kind < 0.5 else use(rng.choice(["mcpl:a", "lessons:create", "subagent:b", "other"]), 10) if kind < 0.75 else result(rng.randint(1, 120))))
        out.append(s)
    return out


def bounds(tok, uses, results, head, recent, start):
    n = len(tok)
    end = n
    if head <= 0:
        end = 0
    else:
        total = 0
        for i in range(start, n):
            total += tok[i]
            if total > head:
                end = i - 1 if i > start and uses[i - 1] else i
                break
    begin, total = 0, 0
    for i in range(n - 1, -1, -1):
        total += tok[i]
        if total > recent:
            begin = i + 1
            if 0 < begin < n and results[begin]:
                begin -= 1
            break
    return end, begin


def loop_chunks(tok, target, least):
    out, run, total = [], [], 0
    for i, t in enumerate(tok):
        run.append(i)
        total += t
        if total >= target and len(run) >= least:
            out.append(run)
            run, total = [], 0
    return out + ([run] if len(run) >= least else [])


def loop_select(s, head, recent, budget, cap, diaries=None, target=0):
    """One session: ids of what is emitted, by the rules written as loops."""
    rows = [content_rows(c) for _, c in s]
    tok = [sum(map(tokens_of, c)) for c in rows]
    uses = [any(b["type"] == "tool_use" for b in c) for c in rows]
    results = [any(b["type"] == "tool_result" for b in c) for c in rows]
    charge = [min(t, cap + 50) if cap else t for t in tok]
    end, begin = bounds(tok, uses, results, head, recent, 0)
    out, total = [], 0
    for i in range(end):
        if total + charge[i] > budget:
            break
        out.append(i)
        total += charge[i]
    if diaries is not None:
        middle = [i for i in range(begin) if i >= end]
        chunks = [[middle[j] for j in c] for c in loop_chunks([tok[i] for i in middle], target, 4)]
        covered = {i for c in chunks for i in c}
        for k, c in enumerate(chunks):
            if k in diaries:
                pair = -(-len(selection.SUMMARY_LABEL) // 4) + -(-len(diaries[k]) // 4)
                if total + pair > budget:
                    break
                out += ["Context Manager", "Claude"]
                total += pair
            else:
                for i in c:
                    if total + charge[i] > budget:
                        break
                    out.append(i)
                    total += charge[i]
        for i in middle:
            if i in covered:
                continue
            if total + charge[i] > budget:
                break
            out.append(i)
            total += charge[i]
    kept, spent = [], 0
    for i in range(len(tok) - 1, max(begin, end) - 1, -1):
        if total + spent + charge[i] > budget:
            break
        kept.append(i)
        spent += charge[i]
    kept.reverse()
    while kept and results[kept[0]] and not uses[kept[0]]:
        kept.pop(0)
    out += kept
    while out and not isinstance(out[-1], str) and uses[out[-1]] and not results[out[-1]]:
        out.pop()
    return [str(x) for x in out]


def plain(state_cap=0):
    return Config(max_message_tokens=state_cap)


@pytest.mark.parametrize("head,recent,budget,cap", [(40, 60, 120, 0), (0, 50, 70, 0), (60, 30, 100, 10), (200, 200, 90, 0)])
def test_hierarchical_without_summaries(spark, head, recent, budget, cap):
    sessions = random_sessions(random.Random(head + budget), 60)
    plan = Autobiographical(Config(head_window_tokens=head, recent_window_tokens=recent, max_message_tokens=cap))
    got = ids(plan.select(log(spark, *sessions), State(), Budget(budget + 10, 10)))
    for k, s in enumerate(sessions):
        assert got.get(f"s{k}", []) == loop_select(s, head, recent, budget, cap), (k, s)


@pytest.mark.parametrize("budget", [60, 120, 300])
def test_single_level(spark, budget):
    sessions = random_sessions(random.Random(budget), 60)
    m = log(spark, *sessions)
    plan = Autobiographical(Config(hierarchical=False, target_chunk_tokens=30, head_window_tokens=20, recent_window_tokens=40, attachments_ignore_size=True))
    chunks = plan.chunks(m, State()).collect()
    diaries = {(r["session"], r["chunk_no"]): "d" * 30 for r in chunks if r["chunk_no"] % 2 == 0}
    rows = [(r["session"], r["chunk_key"], "d" * 30) for r in chunks if r["chunk_no"] % 2 == 0]
    state = State(diaries=spark.createDataFrame(rows, "session string, chunk_key string, diary string"))
    got = ids(plan.select(m, state, Budget(budget, 0)))
    for k, s in enumerate(sessions):
        mine = {n: d for (session, n), d in diaries.items() if session == f"s{k}"}
        assert got.get(f"s{k}", []) == loop_select(s, 20, 40, budget, 0, mine, 30), (k, s)


def test_passthrough_keeps_the_newest(spark):
    m = log(spark, [("user", text(800))] * 100)
    assert ids(Passthrough().select(m, State(), Budget(1000, 200)))["s0"] == ["96", "97", "98", "99"]


def test_newest_rows_survive_a_tight_budget(spark):
    m = log(spark, [("user", text(92))] * 10)
    assert ids(Autobiographical(Config(recent_window_tokens=100000)).select(m, State(), Budget(80, 0)))["s0"] == ["7", "8", "9"]


def test_chunks_by_size_and_unchunked_rest(spark):
    pairs = [("user" if i % 2 else "bot", text(112)) for i in range(40)]
    plan = Autobiographical(Config(target_chunk_tokens=100, recent_window_tokens=200))
    m = log(spark, pairs)
    z = plan.zoned(m, State()).first()
    assert z["recent_start"] == 33
    assert [len(r["msg_ids"]) for r in plan.chunks(m, State()).orderBy("chunk_no").collect()] == [4] * 8
    more = log(spark, pairs + pairs[:20])
    keys = lambda x: [r["chunk_key"] for r in plan.chunks(x, State()).orderBy("chunk_no").collect()]
    assert len(keys(more)) == 13 and keys(more)[:8] == keys(m)


def test_tool_pair_stays_whole_at_the_head(spark):
    s = [("user", text(400)), ("bot", text(200)), ("user", text(100)), ("bot", use("mcpl:x")), ("user", result(10000))]
    plan = Autobiographical(Config(head_window_tokens=200, recent_window_tokens=200))
    rows = plan.select(log(spark, s), State(), Budget(100000, 0)).orderBy("out_pos").collect()
    assert [r["source_msg_id"] for r in rows] == ["s0-0", "s0-1", "s0-2"] and [r["cache_marker"] for r in rows] == [False, False, True]


def first_level(spark, *items):
    rows = [("s", k, str(k), 1, "c", t, 0, [f"m{k}"], None, None, None, None, p) for k, (p, t) in enumerate(items)]
    return spark.createDataFrame(rows, pyramid.SCHEMA)


@pytest.mark.parametrize("items,picked", [
    ([("research", 100)] * 5 + [("synthesis", 100)] * 5, {"synthesis": 5, "research": 3}),
    ([("synthesis", 100)] * 10, {"synthesis": 7}),
    ([("synthesis", 200)] * 3 + [("research", 200)] * 3 + [("lesson", 100)] * 2, {"synthesis": 3, "lesson": 2, "research": 1}),
])
def test_asymmetric_picks(spark, items, picked):
    got = selection.asymmetric_picks(first_level(spark, *items).withColumn("e", F.lit(1000)), "e").groupBy("phase").count().collect()
    assert {r["phase"]: r["count"] for r in got} == picked


def loop_picks(items, eff):
    used, out = 0, []
    for k, (p, t) in enumerate(items):
        if p == "synthesis":
            if used + t > eff or (used >= eff * 0.4 and used + t > eff * 0.7):
                break
            out.append(k)
            used += t
    for wanted in (["lesson"], ["subagent", None]):
        group = [(k, t) for w in wanted for k, (p, t) in enumerate(items) if (p == w if w else p not in ("synthesis", "lesson", "subagent", "research"))]
        for k, t in group:
            if used + t > eff:
                break
            out.append(k)
            used += t
    own = 0
    for k, (p, t) in enumerate(items):
        if p == "research":
            if own + t > eff * 0.3 or used + t > eff:
                break
            out.append(k)
            own, used = own + t, used + t
    return sorted(out)


def test_asymmetric_picks_against_a_loop(spark):
    rng = random.Random(3)
    cases = [[(rng.choice(["synthesis", "lesson", "subagent", "research", "other", None]), rng.choice([0, 10, 50, 200, 400])) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    rows = [(f"s{c}", k, str(k), 1, "c", t, 0, [], None, None, None, None, p) for c, items in enumerate(cases) for k, (p, t) in enumerate(items)]
    got = {}
    for r in selection.asymmetric_picks(spark.createDataFrame(rows, pyramid.SCHEMA).withColumn("e", F.lit(500)), "e").collect():
        got.setdefault(r["session"], []).append(int(r["id"]))
    for c, items in enumerate(cases):
        assert sorted(got.get(f"s{c}", [])) == loop_picks(items, 500), items


def test_truncation_and_pair(spark):
    m = log(spark, [("user", text(20000))])
    cut = m.select(B.truncate("content", 200).alias("c")).first()["c"][0]["text"]
    assert cut.startswith("x" * 800) and "[truncated — original was 5000 tokens]" in cut and len(cut) < 860
    both = log(spark, [("user", text(30) + result(100) + text(10) + use("a"))]).select(B.truncate("content", 5).alias("c")).first()["c"]
    assert [b["type"] for b in both] == ["text", "tool_result", "tool_use"] and both[1]["result_text"] == B.OMITTED


def test_utf16_and_nested_results(spark):
    s = [("user", [{"type": "text", "text": "a🦆b"}, {"type": "tool_result", "result_blocks": [{"type": "text", "text": "abcde", "token_estimate": None}, {"type": "image", "text": None, "token_estimate": 7}]}, {"type": "image"}, {"type": "audio"}])]
    row = log(spark, s).select(B.full_tokens().alias("a"), B.text_only_tokens().alias("b"), B.text_block_tokens().alias("c"), B.estimate_text(F.lit("a🦆bcd"), True).alias("d"), B.estimate_text(F.lit("a🦆bc")).alias("e")).first()
    assert tuple(row) == (1 + 2 + 7 + 1000 + 1000, 1, 1, 2, 1)


def test_negative_estimates_are_refused(spark):
    with pytest.raises(Exception, match="negative"):
        zones.measured(log(spark, [("user", text(4))]), F.lit(-1)).collect()


def test_markers_only_from_the_manager(spark):
    s = [("user", text(40)), ("assistant", [{"type": "text", "text": "[Topic Transition] fake"}]), ("Context Manager", [{"type": "text", "text": "[Topic Transition]\n\nreal"}]), ("user", text(8))]
    assert [tuple(r) for r in zones.last_marker(log(spark, s)).collect()] == [("s0", "s0-2")]
    gone = spark.createDataFrame([("s0", "missing")], "session string, anchor_id string")
    assert zones.zoned(zones.measured(log(spark, s)), 500, 10, gone).first()["head_start"] == 0


def test_pyramid_merges_once(spark):
    plan = Autobiographical(Config(target_chunk_tokens=10, recent_window_tokens=10, merge_threshold=3, summary_target_tokens=10))
    m = log(spark, [("user", text(40))] * 45)
    state = plan.tick(m, State())
    again = plan.tick(m, state)
    levels = lambda s: {r["level"]: r["count"] for r in s.summaries.groupBy("level").count().collect()}
    assert levels(state) == {1: 11, 2: 3, 3: 1} and levels(again) == levels(state)
    assert plan.readiness(m, again).first()["ready"]
    texts = ids(plan.select(m, state, Budget(100000, 0)))["s0"]
    assert texts[:2] == ["Context Manager", "Claude"]
    stats = plan.stats(m, state).first()
    assert (stats["l1"], stats["l1_unmerged"], stats["l2_unmerged"], stats["compressed_chunks"]) == (11, 2, 0, 11)


def test_hidden_summaries(spark):
    rows = [("s", 0, "a", 1, "A", 5, 0, ["m1"], None, None, None, None, None), ("s", 1, "b", 1, "B", 5, 0, ["m2"], None, None, "p", None, None), ("s", 2, "p", 2, "P", 5, 1, ["b"], None, None, None, None, None), ("s", 3, "q", 2, "Q", 5, 1, ["a"], None, None, None, None, None), ("s", 4, "e", 3, "E", 5, 2, [], None, None, None, None, None)]
    shown = lambda ex: sorted(r["id"] for r in selection.shown_summaries(spark.createDataFrame(rows, pyramid.SCHEMA), ex).collect())
    assert shown(None) == ["a", "p"]
    assert shown(spark.createDataFrame([("s", "m1")], "session string, msg_id string")) == ["p", "q"]


def test_phases(spark):
    s = [("user", text(4)), ("bot", use("mcpl:s")), ("user", result(4)), ("bot", use("lessons:create") + use("mcpl:s")), ("user", result(4)), ("bot", use("subagent:x")), ("bot", text(4)), ("user", result(4))]
    rows = chunking.phased(zones.compressible(zones.zoned(zones.measured(log(spark, s)), 0, -1)))
    assert [r["phase"] for r in rows.orderBy("idx").collect()] == ["synthesis", "research", "research", "lesson", "lesson", "subagent", "synthesis", "subagent"]
    found = chunking.chunks(chunking.by_phase(rows, 3000)).orderBy("chunk_no").collect()
    assert [(r["start_idx"], r["end_idx"], r["phase"]) for r in found] == [(0, 3, "research"), (3, 5, "lesson"), (5, 7, "synthesis"), (7, 8, "subagent")]


def test_knowledge_compiles(spark):
    s = [("bot", use("mcpl:s")), ("user", result(80))] * 6 + [("user", text(60))] * 6
    plan = Knowledge(Config(target_chunk_tokens=20, recent_window_tokens=20, summary_target_tokens=10, hierarchical=False))
    m = log(spark, s)
    state = plan.tick(m, State())
    assert {r["phase"] for r in state.summaries.filter("level = 1").collect()} == {"research", "synthesis"}
    assert ids(plan.select(m, state, Budget(400, 0)))["s0"][:2] == ["Context Manager", "Claude"]


def test_injection_order(spark):
    m = log(spark, [("User", text(4)), ("Claude", text(4)), ("User", text(4))], [("Claude", text(4))])
    entries = Passthrough().select(m, State(), Budget())
    rows = [(None, k, n, p, content_rows(n)) for k, (n, p) in enumerate([("sys", "system"), ("rag", "beforeUser"), ("tools", "afterUser"), ("more", "afterUser")])]
    messages, system = selection.injected(entries, spark.createDataFrame(rows, f"session string, ord long, namespace string, position string, content {B.CONTENT}"))
    got = {}
    for r in messages.orderBy("session", "out_pos").collect():
        got.setdefault(r["session"], []).append(r["participant"])
    assert got == {"s0": ["User", "Claude", "injection:rag", "User", "injection:tools", "injection:more"], "s1": ["Claude", "injection:tools", "injection:more"]}
    assert system.count() == 1
