"""Which rows fit a token budget: raw windows, summaries and the entries of a context.

Entries: session, part, ord, out_pos, source_msg_id, source_relation, participant, content, cache_marker.  Every "stop at
the first that does not fit" is a filter on a running sum; the one selection that is not (single level, where a chunk that
overflows does not stop later chunks) is a fold over a session's token numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.operators.zones import backward, forward, session

ENTRY = ["session", "part", "ord", "source_msg_id", "source_relation", "participant", "content", "cache_marker"]
#: Label of the turn that asks for summaries; whoever answers it is configured (fixed values).
SUMMARY_LABEL, SUMMARY_PARTICIPANT = "What do you remember from earlier?", "Claude"


def available(max_tokens: int, reserve: int) -> int:
    return max_tokens - reserve


def passthrough(measured: DataFrame, max_tokens: int, reserve: int = 0) -> DataFrame:
    """The newest rows whose tokens fit, in log order; ``index`` is the row's place in the log.

    If everything fits, every suffix does, so filling from the front first would choose the same rows.
    """
    suffix = F.sum("tokens").over(backward())
    kept = measured.withColumn("_s", suffix).filter(F.col("_s") <= available(max_tokens, reserve)).drop("_s")
    return kept.withColumn("index", F.col("pos")).withColumn("out_pos", F.row_number().over(session().orderBy("pos")) - 1)


def _copies(rows: DataFrame, part: int, cap: int, marker: Column | None = None) -> DataFrame:
    return rows.select("session", F.lit(part).alias("part"), F.col("pos").cast("long").alias("ord"), F.col("msg_id").alias("source_msg_id"), F.lit("copy").alias("source_relation"), "participant", B.truncate("content", cap).alias("content"), (F.lit(False) if marker is None else marker).alias("cache_marker"))


def head(zoned: DataFrame, budget: int, cap: int = 0) -> DataFrame:
    """Add head_out (emitted from the head), head_used (its tokens) and charge (tokens of each row when emitted)."""
    charge = B.capped_tokens(F.col("tokens"), cap)
    inside = (F.col("pos") >= F.col("head_start")) & (F.col("pos") < F.col("head_end"))
    z = zoned.withColumn("charge", charge).withColumn("_h", F.when(inside, F.sum(F.when(inside, charge).otherwise(0)).over(forward())))
    z = z.withColumn("head_out", F.coalesce(F.col("_h") <= budget, F.lit(False)))
    return z.withColumn("head_used", F.coalesce(F.max(F.when(F.col("head_out"), F.col("_h"))).over(session()), F.lit(0))).drop("_h")


def head_entries(with_head: DataFrame, cap: int = 0) -> DataFrame:
    """Head rows; the last of them marks the cache boundary."""
    rows = with_head.filter("head_out")
    return _copies(rows, 0, cap, F.col("pos") == F.max("pos").over(session()))


def recent_rows(with_head: DataFrame, budget: int, used: Column) -> DataFrame:
    """Recent rows that fit beside ``used`` tokens, the oldest going first, without leading orphaned tool results."""
    rows = with_head.filter(F.col("pos") >= F.greatest("recent_start", "head_end"))
    rows = rows.withColumn("_r", F.sum("charge").over(backward())).filter(F.col("_r") + used <= budget)
    orphan = F.col("has_result") & ~F.col("has_use")
    return rows.withColumn("_first", F.min(F.when(~orphan, F.col("pos"))).over(session())).filter(F.col("pos") >= F.col("_first")).drop("_r", "_first")


def trimmed(entries: DataFrame) -> DataFrame:
    """Without tool uses at the end that have no result; numbered as out_pos."""
    order = session().orderBy("part", "ord")
    out = entries.withColumn("_k", F.row_number().over(order) - 1)
    dangling = B.has_tool_use() & ~B.has_tool_result()
    out = out.withColumn("_last", F.max(F.when(~dangling, F.col("_k"))).over(session())).filter(F.col("_k") <= F.col("_last"))
    return out.withColumn("out_pos", F.col("_k").cast("long")).drop("_k", "_last")


# Summaries: (session, ord, id, level, content, tokens, source_ids, merged_into, phase)


def shown_summaries(summaries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Summaries that repeat nothing: unmerged; first-level ones without a message of ``excluded`` (session, msg_id); higher ones
    unless all their children are shown."""
    alive = summaries.filter("merged_into is null")
    first = alive.filter("level = 1")
    if excluded is not None:
        touched = first.select("session", "id", F.explode("source_ids").alias("msg_id")).join(excluded.select("session", "msg_id").distinct(), ["session", "msg_id"], "left_semi").select("session", "id").distinct()
        first = first.join(touched, ["session", "id"], "left_anti")
    second = _uncovered(alive.filter("level = 2"), first)
    third = _uncovered(alive.filter("level = 3"), second)
    return first.unionByName(second).unionByName(third)


def _uncovered(parents: DataFrame, children: DataFrame) -> DataFrame:
    missing = parents.select("session", F.col("id").alias("_p"), F.explode("source_ids").alias("id")).join(children.select("session", "id"), ["session", "id"], "left_anti").select("session", F.col("_p").alias("id")).distinct()
    return parents.join(missing, ["session", "id"], "left_semi")


def waterfall(shown: DataFrame, used: DataFrame, budget: int, l3: int = 30000, l2: int = 30000, l1: int = 30000, shares: dict | None = None) -> DataFrame:
    """Selected summaries with ``pick`` (their order): third level, second, first, each leaving what it does not use to the next.

    ``used``: (session, head_used).  ``shares``: asymmetric_picks for the first level, by phase.
    """
    s = shown.join(used.select("session", "head_used"), "session", "left").withColumn("head_used", F.coalesce("head_used", F.lit(0)))
    s = s.withColumn("_run", F.sum("tokens").over(Window.partitionBy("session", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    room = F.lit(budget) - F.col("head_used")

    def picked(s: DataFrame, level: int, own: Column, before: Column, name: str) -> DataFrame:
        fits = (F.col("level") == level) & (F.col("_run") <= own) & (F.col("_run") + before <= room)
        s = s.withColumn(f"_ok{level}", fits)
        return s.withColumn(name, F.coalesce(F.max(F.when(fits, F.col("_run"))).over(session()), F.lit(0)))

    s = picked(s, 3, F.lit(l3), F.lit(0), "_u3")
    s = s.withColumn("_b2", F.lit(l2 + l3) - F.col("_u3"))
    s = picked(s, 2, F.col("_b2"), F.col("_u3"), "_u2")
    s = s.withColumn("_b1", F.lit(l1) + F.col("_b2") - F.col("_u2"))
    eff = F.least(F.col("_b1"), room - F.col("_u3") - F.col("_u2"))
    high = s.filter("(level = 3 and _ok3) or (level = 2 and _ok2)").withColumn("pick", F.when(F.col("level") == 3, 0).otherwise(1))
    low = s.filter("level = 1").withColumn("_eff", eff)
    low = low.filter(F.col("_run") <= F.col("_eff")).withColumn("pick", F.lit(2)) if shares is None else asymmetric_picks(low, "_eff", **shares).withColumn("pick", F.col("_rank") + 2).drop("_rank")
    out = [*shown.columns, "pick"]
    return high.select(*out).unionByName(low.select(*out))


def asymmetric_picks(first: DataFrame, effective: str, research_cap: float = 0.3, synthesis_floor: float = 0.4, synthesis_cap: float = 0.7) -> DataFrame:
    """First-level picks by phase: synthesis (to its cap, once past its floor), lessons, subagent and others, then research to its cap.

    Every stop condition only tightens along a phase, so each phase is a running-sum filter and totals are chained.  Adds _rank.
    """
    eff = F.col(effective)
    rank = F.when(F.col("phase") == "synthesis", 0).when(F.col("phase") == "lesson", 1).when(F.col("phase") == "research", 4).when(F.col("phase") == "subagent", 2).otherwise(3)
    f = first.withColumn("_rank", rank).withColumn("_group", F.when(F.col("_rank").isin(2, 3), 2).otherwise(F.col("_rank")))
    f = f.withColumn("_run", F.sum("tokens").over(Window.partitionBy("session", "_group").orderBy("_rank", "ord").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_run") - F.col("tokens")
    stop = (before >= eff * synthesis_floor) & (F.col("_run") > eff * synthesis_cap)
    total = F.lit(0)
    for group, allowed in ((0, ~stop), (1, F.lit(True)), (2, F.lit(True)), (4, F.col("_run") <= eff * research_cap)):
        mine = F.col("_group") == group
        f = f.withColumn(f"_t{group}", total).withColumn(f"_f{group}", mine & (F.col("_run") + F.col(f"_t{group}") <= eff) & allowed)
        # a phase ends at its first row that does not fit
        stopped = F.min(F.when(mine & ~F.col(f"_f{group}"), F.struct("_rank", "ord"))).over(session())
        f = f.withColumn(f"_f{group}", F.col(f"_f{group}") & (stopped.isNull() | (F.struct("_rank", "ord") < stopped)))
        f = f.withColumn(f"_t{group}", F.coalesce(F.max(F.when(F.col(f"_f{group}"), F.col("_run"))).over(session()), F.lit(0)) + F.col(f"_t{group}"))
        total = F.col(f"_t{group}")
    return f.filter("_f0 or _f1 or _f2 or _f4").drop("_group", *(f"_{x}{g}" for x in "tf" for g in (0, 1, 2, 4)))


def summary_pair(selected: DataFrame, cap: int = 0, label: str = SUMMARY_LABEL, participant: str = SUMMARY_PARTICIPANT) -> DataFrame:
    """Two entries for each session with selected summaries, and pair_tokens: question, and all contents as one answer."""
    texts = F.array_sort(F.collect_list(F.struct("pick", "ord", "content")))
    one = selected.groupBy("session").agg(F.array_join(F.transform(texts, lambda x: x["content"]), B.SEPARATOR).alias("_t"))
    one = one.withColumn("_a", B.text_content(F.col("_t"))).withColumn("_a", B.truncate("_a", cap)).withColumn("_q", B.text_content(F.lit(label)))
    one = one.withColumn("pair_tokens", B.text_block_tokens("_q") + B.text_block_tokens("_a"))
    turns = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit(B.TRANSITION_PARTICIPANT).alias("participant"), F.col("_q").alias("content")), F.struct(F.lit(1).cast("long").alias("ord"), F.lit(participant).alias("participant"), F.col("_a").alias("content")))
    return one.select("session", "pair_tokens", F.inline(turns)).select("session", "pair_tokens", F.lit(1).alias("part"), "ord", F.lit(None).cast("string").alias("source_msg_id"), F.lit("derived").alias("source_relation"), "participant", "content", F.lit(False).alias("cache_marker"))


def hierarchical(zoned: DataFrame, summaries: DataFrame | None, max_tokens: int, reserve: int = 0, cap: int = 0, label: str = SUMMARY_LABEL, participant: str = SUMMARY_PARTICIPANT, **levels) -> DataFrame:
    """Head, one pair of summaries, recent rows.  Middle rows without a summary are left out, as there is no room made for them."""
    budget = available(max_tokens, reserve)
    z = head(zoned, budget, cap)
    parts = [head_entries(z, cap)]
    used = F.col("head_used")
    if summaries is not None:
        shown = shown_summaries(summaries, zoned.filter("(pos >= head_start and pos < head_end) or pos >= recent_start"))
        pair = summary_pair(waterfall(shown, z.select("session", "head_used").distinct(), budget, **levels), cap, label, participant)
        parts.append(pair.select(*ENTRY))
        z = z.join(pair.filter("ord = 0").select("session", "pair_tokens"), "session", "left")
        used = used + F.coalesce("pair_tokens", F.lit(0))
    entries = parts[0].unionByName(_copies(recent_rows(z, budget, used), 2, cap))
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return trimmed(entries)


def single_level(zoned: DataFrame, chunked: DataFrame, done: DataFrame, max_tokens: int, reserve: int = 0, cap: int = 0, label: str = SUMMARY_LABEL, participant: str = SUMMARY_PARTICIPANT) -> DataFrame:
    """Head, chunks (a pair where a diary exists, raw rows where not), rows in no chunk, recent rows.

    ``chunked``: compressible rows with chunk_no; ``done``: (session, chunk_no, diary).  A pair that does not fit ends the chunks;
    a raw row that does not fit ends its chunk alone, so later chunks may still fit.
    """
    budget = available(max_tokens, reserve)
    z = head(zoned, budget, cap)
    question = B.text_content(F.lit(label))
    diaries = done.filter("diary is not null").select("session", "chunk_no", B.text_content(F.col("diary")).alias("_a")).withColumn("_a", B.truncate("_a", cap))
    diaries = diaries.withColumn("_q", question).withColumn("t", B.text_block_tokens("_q") + B.text_block_tokens("_a"))
    charge = B.capped_tokens(F.col("tokens"), cap)
    raw = chunked.join(diaries.select("session", "chunk_no"), ["session", "chunk_no"], "left_anti")
    kind, number = F.when(F.col("chunk_no").isNull(), 2).otherwise(1), F.coalesce("chunk_no", F.lit(1 << 30))
    units = raw.select("session", F.struct(number.alias("c"), F.col("pos").cast("long").alias("p"), kind.alias("k"), charge.alias("t")).alias("u"))
    units = units.unionByName(diaries.select("session", F.struct(F.col("chunk_no").alias("c"), F.lit(0).cast("long").alias("p"), F.lit(0).alias("k"), F.col("t")).alias("u")))
    lists = units.groupBy("session").agg(F.array_sort(F.collect_list("u")).alias("u"))
    lists = lists.join(z.groupBy("session").agg(F.max("head_used").alias("head_used")), "session")
    # state: tokens so far, ended (1: all chunks, 2: rows outside chunks), chunk that ended, accepted places
    full = f"a.n + x.t > {budget}"
    skip = "(x.k < 2 and a.e = 1) or (x.k = 1 and a.f = x.c) or (x.k = 2 and a.e = 2)"
    ends = "named_struct('n', a.n, 'e', case x.k when 0 then 1 when 2 then 2 else a.e end, 'f', if(x.k = 1, x.c, a.f), 'o', a.o)"
    takes = "named_struct('n', a.n + x.t, 'e', a.e, 'f', a.f, 'o', concat(a.o, array(named_struct('c', x.c, 'p', x.p, 'k', x.k))))"
    fold = f"aggregate(u, named_struct('n', bigint(head_used), 'e', 0, 'f', -1, 'o', cast(array() as array<struct<c:int,p:bigint,k:int>>)), (a, x) -> case when {skip} then a when {full} then {ends} else {takes} end)"
    folded = lists.select("session", F.expr(fold).alias("f"))
    taken = folded.select("session", F.inline("f.o"))
    rows = raw.join(taken.filter("k > 0").select("session", F.col("p").alias("pos"), "c"), ["session", "pos"])
    middle = _copies(rows, 1, cap).join(taken.filter("k > 0").select("session", F.col("p").alias("ord"), "c"), ["session", "ord"]).withColumn("ord", F.col("c").cast("long") * (1 << 32) + F.col("ord")).drop("c")
    pairs = diaries.join(taken.filter("k = 0").select("session", F.col("c").alias("chunk_no")), ["session", "chunk_no"])
    turns = F.array(F.struct((F.col("chunk_no").cast("long") * (1 << 32)).alias("ord"), F.lit(B.TRANSITION_PARTICIPANT).alias("participant"), F.col("_q").alias("content")), F.struct((F.col("chunk_no").cast("long") * (1 << 32) + 1).alias("ord"), F.lit(participant).alias("participant"), F.col("_a").alias("content")))
    pairs = pairs.select("session", F.inline(turns)).select("session", F.lit(1).alias("part"), "ord", F.lit(None).cast("string").alias("source_msg_id"), F.lit("derived").alias("source_relation"), "participant", "content", F.lit(False).alias("cache_marker"))
    z = z.join(folded.select("session", F.col("f.n").alias("_used")), "session", "left")
    recent = recent_rows(z, budget, F.coalesce("_used", "head_used"))
    return trimmed(head_entries(z, cap).unionByName(middle.select(*ENTRY)).unionByName(pairs.select(*ENTRY)).unionByName(_copies(recent, 2, cap)))


def injected(entries: DataFrame, injections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and system blocks of a compiled context.

    ``injections``: (session, ord, namespace, position, content) with position system, beforeUser or afterUser; a null session
    means every session.  Before and after refer to the last entry of participant "user", whatever its case; without one,
    beforeUser injections go and afterUser ones end the context.
    """
    anchor = F.max(F.when(F.lower("participant") == "user", F.col("out_pos"))).over(session())
    e = entries.withColumn("_anchor", anchor)
    sessions = e.groupBy("session").agg(F.max("_anchor").alias("_anchor"), F.max("out_pos").alias("_end")).withColumnRenamed("session", "_s")
    near = injections.filter("position <> 'system'")
    # two joins, as one with "or" can't be by key; those for every session meet them under one constant
    own = near.filter("session is not null").join(sessions, F.col("session") == F.col("_s"))
    every = sessions.join(F.broadcast(near.filter("session is null").groupBy().agg(F.collect_list(F.struct(*near.columns)).alias("_all"))))
    near = own.unionByName(every.select(F.explode("_all").alias("_x"), "_s", "_anchor", "_end").select("_x.*", "_s", "_anchor", "_end"))
    near = near.filter("position = 'afterUser' or _anchor is not null")
    slot = F.when(F.col("position") == "beforeUser", 0).otherwise(2)
    near = near.select(F.col("_s").alias("session"), F.coalesce("_anchor", F.col("_end")).alias("_at"), slot.alias("_slot"), "ord", F.lit(None).cast("string").alias("source_msg_id"), F.lit(None).cast("string").alias("source_relation"), F.concat(F.lit("injection:"), "namespace").alias("participant"), "content", F.lit(False).alias("cache_marker"))
    own = e.select("session", F.col("out_pos").alias("_at"), F.lit(1).alias("_slot"), F.lit(0).cast("long").alias("ord"), "source_msg_id", "source_relation", "participant", "content", "cache_marker")
    messages = own.unionByName(near.withColumn("ord", F.col("ord").cast("long")))
    messages = messages.withColumn("out_pos", F.row_number().over(session().orderBy("_at", "_slot", "ord")) - 1).drop("_at", "_slot", "ord")
    system = injections.filter("position = 'system'").select("session", "ord", F.posexplode("content").alias("_i", "block"))
    return messages, system.select("session", "ord", F.col("_i").alias("block_no"), "block")
