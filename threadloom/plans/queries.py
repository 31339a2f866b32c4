"""Registered queries over the tables of a data folder, with the SQL that each must match where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.operators import chunking, filters, pyramid, selection, zones
from threadloom.plans.strategies import Autobiographical, Budget, Config, Knowledge, State, compiled
from threadloom.sources import context_log, message_log
from threadloom.sources.tables import conversation_messages, event_messages, operation_log, summary_table, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Shared beginnings of the SQL

CONVERSATIONS = """m AS (SELECT CAST(conv_id AS VARCHAR) AS session, conv_id, turn, conv_id || '-' || turn AS msg_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
 role AS participant, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""
EVENTS = """e0 AS (SELECT CAST(user_id AS VARCHAR) AS session, 'ev-' || event_id AS msg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
 event_type, props, event_type = 'error' AS has_result, event_type <> 'error' AS has_use, replace(replace(props, ': ', ':'), ', ', ',') AS compact FROM events),
e AS (SELECT *, CAST(CASE WHEN has_use THEN ceil(length(compact) / 4.0) + 20 ELSE ceil(length(props) / 4.0) END AS BIGINT) AS tokens,
 CASE event_type WHEN 'click' THEN 'research' WHEN 'view' THEN 'research' WHEN 'purchase' THEN 'lesson' WHEN 'signup' THEN 'subagent' END AS tool_phase FROM e0)"""
OPS = """c AS (SELECT CAST(conv_id AS VARCHAR) AS session, conv_id, turn, conv_id || '-' || turn AS msg_id, role AS participant, text FROM conversations)"""
SUMMARIES = """s AS (SELECT source AS session, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 9 THEN 3 WHEN doc_id % 10 >= 7 THEN 2 ELSE 1 END AS level,
 text AS content, CAST(floor(n_chars / 40.0) AS BIGINT) AS tokens, CASE WHEN doc_id % 7 = 0 THEN 'gone' END AS merged_into, doc_id,
 lag(doc_id, 2) OVER (PARTITION BY source ORDER BY doc_id) AS kid2, lag(doc_id, 1) OVER (PARTITION BY source ORDER BY doc_id) AS kid1,
 list_extract(['research', 'synthesis', 'lesson', 'subagent', 'other'], CAST(doc_id % 5 + 1 AS INT)) AS phase FROM documents)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {CONVERSATIONS}, k AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS s FROM m) SELECT session, msg_id, participant, text, tokens, pos AS index, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS out_pos FROM k WHERE s <= 300")
def passthrough_budget(spark, sf_dir) -> DataFrame:
    kept = selection.passthrough(zones.measured(conversation_messages(spark, sf_dir)), 400, 100)
    return kept.select("session", "msg_id", "participant", B.extract_text().alias("text"), "tokens", F.col("index").cast("long").alias("index"), F.col("out_pos").cast("long").alias("out_pos"))


@query(f"WITH {CONVERSATIONS}, {EVENTS} SELECT session, msg_id, tokens AS full_tokens, tokens AS text_only, tokens AS text_blocks FROM m UNION ALL SELECT session, msg_id, tokens, tokens, 0 FROM e")
def token_estimates(spark, sf_dir) -> DataFrame:
    rows = conversation_messages(spark, sf_dir).unionByName(event_messages(spark, sf_dir).drop("metadata_json"))
    return rows.select("session", "msg_id", B.full_tokens().alias("full_tokens"), B.text_only_tokens().alias("text_only"), B.text_block_tokens().alias("text_blocks"))


@query(f"WITH {CONVERSATIONS} SELECT session, msg_id, CAST(pos AS BIGINT) AS pos FROM m WHERE pos >= n - 3")
def tail_n(spark, sf_dir) -> DataFrame:
    return message_log.tail(conversation_messages(spark, sf_dir), 3).select("session", "msg_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {CONVERSATIONS} SELECT session, msg_id, 'from 2' AS scan FROM m WHERE pos >= 2 UNION ALL SELECT session, msg_id, 'last 2' FROM m WHERE pos >= n - 2")
def offset_scan(spark, sf_dir) -> DataFrame:
    m = conversation_messages(spark, sf_dir)
    return message_log.from_offset(m, 2).select("session", "msg_id", F.lit("from 2").alias("scan")).union(message_log.from_offset(m, -2).select("session", "msg_id", F.lit("last 2").alias("scan")))


@query(f"WITH {CONVERSATIONS}, k AS (SELECT *, count(*) OVER (PARTITION BY session) AS total_count, row_number() OVER (PARTITION BY session ORDER BY pos DESC) - 1 AS rank FROM m WHERE participant = 'user') SELECT session, msg_id, total_count, rank FROM k WHERE rank < 2")
def query_filter(spark, sf_dir) -> DataFrame:
    found = filters.query(conversation_messages(spark, sf_dir), limit=2, reverse=True, participant="user")
    return found.select("session", "msg_id", "total_count", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {EVENTS} SELECT session, msg_id FROM e WHERE json_extract_string(props, '$.k') = '42' AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')")
def metadata_path_eq(spark, sf_dir) -> DataFrame:
    return event_messages(spark, sf_dir).filter(filters.predicate(metadata={"k": 42})).select("session", "msg_id")


@query(f"WITH {EVENTS}, x AS (SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY pos) AS r FROM e WHERE event_type = 'click') SELECT session, msg_id FROM x WHERE r = 1")
def external_id_lookup(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("ev-"), "event_id").alias("msg_id"), F.to_json(F.struct(F.struct(F.col("event_type").alias("source"), F.lit("x1").alias("id")).alias("external"))).alias("metadata_json"))
    m = event_messages(spark, sf_dir).drop("metadata_json").join(e, "msg_id")
    return filters.find_by_external_id(m, "click", "x1").select("session", "msg_id")


ZONES = """z0 AS (SELECT *, CASE WHEN CAST(session AS BIGINT) % 2 = 0 AND n > 3 THEN 3 ELSE 0 END AS head_start FROM {rows}),
z1 AS (SELECT *, sum(CASE WHEN pos >= head_start THEN tokens ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) AS prefix, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS suffix FROM z0),
z2 AS (SELECT *, coalesce(min(CASE WHEN pos >= head_start AND prefix > {head} THEN pos END) OVER (PARTITION BY session), n) AS e0, coalesce(max(CASE WHEN suffix > {recent} THEN pos END) OVER (PARTITION BY session) + 1, 0) AS r0 FROM z1),
z3 AS (SELECT *, bool_or(pos = e0 - 1 AND has_use) OVER (PARTITION BY session) AND e0 < n AND e0 > head_start AS cut, bool_or(pos = r0 AND has_result) OVER (PARTITION BY session) AND r0 > 0 AS orphan FROM z2),
z AS (SELECT * EXCLUDE (cut, orphan), CAST(e0 - CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS head_end, CAST(r0 - CASE WHEN orphan THEN 1 ELSE 0 END AS BIGINT) AS recent_start FROM z3)"""


def _anchors(m: DataFrame) -> DataFrame:
    return m.filter("pos = 3 and bigint(session) % 2 = 0").select("session", F.col("msg_id").alias("anchor_id"))


def _zoned_events(spark, sf_dir) -> DataFrame:
    m = event_messages(spark, sf_dir)
    return zones.zoned(zones.measured(m), 150, 200, _anchors(m))


@query(f"WITH {EVENTS}, {ZONES.format(rows='e', head=150, recent=200)} SELECT session, msg_id, CAST(head_start AS BIGINT) AS head_start, head_end, recent_start, CASE WHEN pos >= greatest(recent_start, head_end) THEN 'recent' WHEN pos >= head_start AND pos < head_end THEN 'head' ELSE 'middle' END AS zone FROM z")
def zone_bounds(spark, sf_dir) -> DataFrame:
    return _zoned_events(spark, sf_dir).select("session", "msg_id", "head_start", "head_end", "recent_start", "zone")


@query(f"WITH {EVENTS}, {ZONES.format(rows='e', head=150, recent=200)} SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS idx FROM z WHERE pos < recent_start AND NOT (pos >= head_start AND pos < head_end)")
def compressible_rows(spark, sf_dir) -> DataFrame:
    return zones.compressible(_zoned_events(spark, sf_dir)).select("session", "msg_id", F.col("idx").cast("long").alias("idx"))


@query(f"""WITH {EVENTS}, {ZONES.format(rows='e', head=150, recent=200)},
h AS (SELECT *, CASE WHEN pos >= head_start AND pos < head_end THEN sum(CASE WHEN pos >= head_start AND pos < head_end THEN least(tokens, 75) ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) END AS hr FROM z),
u AS (SELECT *, coalesce(max(CASE WHEN hr <= 260 THEN hr END) OVER (PARTITION BY session), 0) AS used FROM h),
r AS (SELECT *, sum(least(tokens, 75)) OVER (PARTITION BY session ORDER BY pos DESC) AS rr FROM u WHERE pos >= greatest(recent_start, head_end)),
f AS (SELECT *, min(CASE WHEN has_use THEN pos END) OVER (PARTITION BY session) AS fst FROM r WHERE rr + used <= 260),
a AS (SELECT session, 0 AS part, pos, msg_id, has_use, pos = max(pos) OVER (PARTITION BY session) AS mark FROM u WHERE hr <= 260 UNION ALL SELECT session, 2, pos, msg_id, has_use, false FROM f WHERE pos >= fst),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY part, pos) - 1 AS out_pos FROM a),
t AS (SELECT *, max(CASE WHEN NOT has_use THEN out_pos END) OVER (PARTITION BY session) AS lst FROM k)
SELECT session, out_pos, msg_id, mark AS cache_marker FROM t WHERE out_pos <= lst""")
def recent_newest_first(spark, sf_dir) -> DataFrame:
    entries = selection.hierarchical(_zoned_events(spark, sf_dir), None, 300, 40, 25)
    return entries.select("session", "out_pos", F.col("source_msg_id").alias("msg_id"), "cache_marker")


@query(f"""WITH RECURSIVE {CONVERSATIONS}, r AS (SELECT session, pos, tokens AS t, 1 AS k, 0 AS c, tokens >= 150 AND 1 >= 2 AS closed FROM m WHERE pos = 0
UNION ALL SELECT m.session, m.pos, CASE WHEN r.closed THEN m.tokens ELSE r.t + m.tokens END, CASE WHEN r.closed THEN 1 ELSE r.k + 1 END, r.c + CASE WHEN r.closed THEN 1 ELSE 0 END,
 CASE WHEN r.closed THEN false ELSE r.t + m.tokens >= 150 AND r.k + 1 >= 2 END FROM r JOIN m ON m.session = r.session AND m.pos = r.pos + 1),
x AS (SELECT session, c, count(*) AS rows, min(pos) AS a, max(pos) + 1 AS b FROM r GROUP BY ALL)
SELECT session, CAST(c AS BIGINT) AS chunk_no, CAST(a AS BIGINT) AS start_idx, CAST(b AS BIGINT) AS end_idx, string_agg(msg_id, ':' ORDER BY pos) AS chunk_key, CAST(sum(tokens) AS BIGINT) AS tokens FROM x JOIN m USING (session) WHERE rows >= 2 AND pos >= a AND pos < b GROUP BY ALL""")
def chunk_by_size(spark, sf_dir) -> DataFrame:
    rows = zones.compressible(zones.zoned(zones.measured(conversation_messages(spark, sf_dir)), 0, -1))
    found = chunking.chunks(chunking.by_size(rows, 150, 2))
    return found.select("session", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), "chunk_key", "tokens")


PHASES = f"""{EVENTS}, p AS (SELECT *, CASE WHEN has_use THEN tool_phase ELSE coalesce(last_value(tool_phase IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'synthesis') END AS phase FROM e)"""


def _phased_events(spark, sf_dir) -> DataFrame:
    return chunking.phased(zones.compressible(zones.zoned(zones.measured(event_messages(spark, sf_dir)), 0, -1)))


@query(f"WITH {PHASES} SELECT session, msg_id, phase FROM p")
def phase_classify(spark, sf_dir) -> DataFrame:
    return _phased_events(spark, sf_dir).select("session", "msg_id", "phase")


@query(f"""WITH RECURSIVE {PHASES}, r AS (SELECT session, pos, phase, tokens AS t, 1 AS k, 0 AS c FROM p WHERE pos = 0
UNION ALL SELECT q.session, q.pos, q.phase, CASE WHEN q.cut THEN q.tokens ELSE q.t + q.tokens END, CASE WHEN q.cut THEN 1 ELSE q.k + 1 END, q.c + CASE WHEN q.cut THEN 1 ELSE 0 END
 FROM (SELECT p.session, p.pos, p.phase, p.tokens, r.t, r.k, r.c, r.k >= 2 AND (p.phase <> r.phase OR r.t >= CASE r.phase WHEN 'synthesis' THEN 90 WHEN 'lesson' THEN 60 ELSE 120 END) AS cut FROM r JOIN p ON p.session = r.session AND p.pos = r.pos + 1) q)
SELECT session, CAST(c AS BIGINT) AS chunk_no, min(pos) AS start_idx, max(pos) + 1 AS end_idx, arg_max(phase, pos) AS phase FROM r GROUP BY session, c""")
def chunk_by_phase(spark, sf_dir) -> DataFrame:
    found = chunking.chunks(chunking.by_phase(_phased_events(spark, sf_dir), 60))
    return found.select("session", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), "phase")


@query(f"""WITH {CONVERSATIONS}, x AS (SELECT *, CASE WHEN lag(participant) OVER (PARTITION BY session ORDER BY pos) = participant THEN 0 ELSE 1 END AS b FROM m), y AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY pos) - 1 AS run_no FROM x)
SELECT session, CAST(run_no AS BIGINT) AS run_no, participant, string_agg(text, chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || chr(10) ORDER BY pos) AS text FROM y GROUP BY ALL""")
def collapse_runs(spark, sf_dir) -> DataFrame:
    return chunking.collapsed(conversation_messages(spark, sf_dir)).select("session", F.col("run_no").cast("long").alias("run_no"), "participant", B.extract_text().alias("text"))


@query("SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 50 THEN text ELSE left(text, 200) || chr(10) || chr(10) || '[truncated — original was ' || CAST(ceil(length(text) / 4.0) AS BIGINT) || ' tokens]' END AS text FROM documents")
def truncate_content(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", B.text_content(F.col("text")).alias("content"))
    return d.select("doc_id", B.truncate("content", 50).alias("content")).select("doc_id", B.extract_text().alias("text"))


@query(f"WITH {CONVERSATIONS} SELECT session, '<earlier_in_conversation>' || chr(10) || string_agg('# ' || upper(participant) || chr(10) || text || chr(10), chr(10) ORDER BY pos) || chr(10) || '</earlier_in_conversation>' AS transcript FROM m GROUP BY session")
def transcripts(spark, sf_dir) -> DataFrame:
    rows = zones.compressible(zones.zoned(zones.measured(conversation_messages(spark, sf_dir)), 0, -1))
    return chunking.chunks(chunking.by_size(rows, 1 << 30, 1)).select("session", "transcript")


FOLDED = f"""{OPS}, f AS (SELECT session, msg_id, turn, participant, CASE WHEN turn % 3 = 1 AND 1000 + turn <= {{till}} THEN 'edited: ' || text ELSE text END AS text FROM c WHERE 10 * turn <= {{till}} AND NOT (turn % 5 = 4 AND 2000 + turn <= {{till}}) AND NOT ({{till}} >= 3000 AND conv_id % 4 = 0 AND turn <= 1))"""


@query(f"WITH {FOLDED.format(till=9999)} SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, participant, text FROM f")
def edit_fold(spark, sf_dir) -> DataFrame:
    return message_log.fold(operation_log(spark, sf_dir)).select("session", "msg_id", F.col("pos").cast("long").alias("pos"), "participant", B.extract_text().alias("text"))


@query(f"WITH {FOLDED.format(till=1002)} SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, text FROM f")
def time_travel(spark, sf_dir) -> DataFrame:
    return message_log.fold(operation_log(spark, sf_dir), 1002).select("session", "msg_id", F.col("pos").cast("long").alias("pos"), B.extract_text().alias("text"))


@query(f"WITH {OPS} SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, text FROM (SELECT session, msg_id, turn, text FROM c WHERE 10 * turn <= 20 UNION ALL SELECT session, msg_id || '-b', 100, lower(text) FROM c WHERE turn = 0)")
def branch_view(spark, sf_dir) -> DataFrame:
    ops = operation_log(spark, sf_dir)
    own = ops.filter("op = 'add' and seq = 0").select("session", F.lit(5000).alias("seq"), F.concat("msg_id", F.lit("-b")).alias("msg_id"), "participant", F.transform("content", lambda b: B.block(type="text", text=F.lower(b["text"]))).alias("content"))
    seen = message_log.branch_ops(ops.unionByName(message_log.adds(own, branch="side")), [{"id": "side", "parent_id": "main", "branch_point": 20}], "side")
    return message_log.fold(seen).select("session", "msg_id", F.col("pos").cast("long").alias("pos"), B.extract_text().alias("text"))


@query(f"WITH {OPS}, {FOLDED.format(till=9999).split(', f AS')[0].replace(OPS, 'q AS (SELECT 1)')} SELECT session, count(*) AS n FROM (SELECT * FROM c WHERE NOT (turn % 5 = 4) AND NOT (conv_id % 4 = 0 AND turn <= 1)) GROUP BY session")
def log_length(spark, sf_dir) -> DataFrame:
    return message_log.length(message_log.fold(operation_log(spark, sf_dir)))


def _entries(spark, sf_dir) -> DataFrame:
    """A context entry for each message and relation by turn: copy, derived, referenced, none."""
    m = conversation_messages(spark, sf_dir)
    relation = F.element_at(F.array(F.lit("copy"), F.lit("derived"), F.lit("referenced"), F.lit(None)), (F.col("pos") % 4 + 1).cast("int"))
    return m.select("session", F.concat(F.lit("ctx-"), "msg_id").alias("entry_id"), F.col("pos").cast("long").alias("seq"), F.col("msg_id").alias("source_msg_id"), relation.alias("source_relation"), "participant", "content", F.lit(False).alias("cache_marker"))


@query(f"WITH {CONVERSATIONS} SELECT 'ctx-' || msg_id AS entry_id, pos AS index, CASE WHEN pos % 4 IN (0, 3) AND turn % 3 = 1 THEN 'edited: ' || text ELSE text END AS text FROM m")
def propagate_edit(spark, sf_dir) -> DataFrame:
    changed = operation_log(spark, sf_dir).filter("op = 'edit'").select("session", "msg_id", "content")
    out = context_log.indexed(context_log.propagate_edits(_entries(spark, sf_dir), changed))
    return out.select("entry_id", F.col("index").cast("long").alias("index"), B.extract_text().alias("text"))


@query(f"WITH {CONVERSATIONS}, x AS (SELECT * FROM m WHERE NOT (turn % 5 = 4 AND pos % 4 IN (0, 3))) SELECT 'ctx-' || msg_id AS entry_id, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS index FROM x")
def propagate_remove(spark, sf_dir) -> DataFrame:
    gone = operation_log(spark, sf_dir).filter("op in ('remove', 'remove_range')").select("session", "msg_id", "op")
    out = context_log.indexed(context_log.propagate_removals(_entries(spark, sf_dir), gone))
    return out.select("entry_id", F.col("index").cast("long").alias("index"))


@query(f"WITH {CONVERSATIONS} SELECT msg_id AS source_msg_id, pos AS index, CASE pos % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'derived' ELSE 'referenced' END AS relation FROM m WHERE pos % 4 < 3")
def source_relations(spark, sf_dir) -> DataFrame:
    r = context_log.source_relations(_entries(spark, sf_dir)).select("source_msg_id", F.explode("relations").alias("index", "relation"))
    return r.select("source_msg_id", F.col("index").cast("long").alias("index"), "relation")


@query("SELECT sha256(text) AS hash, count(*) AS uses, any_value(CAST(ceil(4 * ceil(strlen(text) / 3.0) * 0.75) AS BIGINT)) AS size FROM documents GROUP BY 1")
def blob_dedup(spark, sf_dir) -> DataFrame:
    media = B.block(type="document", source_type="base64", media_type="text/plain", data=F.base64(F.encode("text", "UTF-8")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("msg_id"), F.array(media).alias("content"))
    uses = message_log.extract_blobs(d).select(F.col("content")[0]["blob_hash"].alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("uses"))
    stored = message_log.blobs(d).select(F.col("hash").alias("h"), F.base64("data").alias("data"))
    joined = uses.join(stored, uses["hash"] == stored["h"])
    return joined.select("hash", "uses", B.media_size(F.struct(F.replace("data", F.lit("\r\n"), F.lit("")).alias("data"))).alias("size"))


@query(f"""WITH {CONVERSATIONS}, k AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS s FROM m), p AS (SELECT session, participant, text, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS o FROM k WHERE s <= 300),
a AS (SELECT *, max(CASE WHEN lower(participant) = 'user' THEN o END) OVER (PARTITION BY session) AS u, max(o) OVER (PARTITION BY session) AS l FROM p),
x AS (SELECT session, participant, text, o AS place, 1 AS slot FROM a UNION ALL SELECT DISTINCT session, 'injection:rag', 'facts', u, 0 FROM a WHERE u IS NOT NULL UNION ALL SELECT DISTINCT session, 'injection:tools', 'hints', coalesce(u, l), 2 FROM a)
SELECT session, participant, text, row_number() OVER (PARTITION BY session ORDER BY place, slot) - 1 AS out_pos FROM x""")
def injections(spark, sf_dir) -> DataFrame:
    kept = selection.passthrough(zones.measured(conversation_messages(spark, sf_dir)), 300)
    entries = kept.select("session", F.col("out_pos").cast("long").alias("out_pos"), F.col("msg_id").alias("source_msg_id"), F.lit("copy").alias("source_relation"), "participant", "content", F.lit(False).alias("cache_marker"))
    rows = [(None, 0, "rag", "beforeUser", "facts"), (None, 1, "tools", "afterUser", "hints"), (None, 2, "sys", "system", "rules")]
    given = spark.createDataFrame(rows, "session string, ord long, namespace string, position string, text string").withColumn("content", B.text_content(F.col("text"))).drop("text")
    messages, _ = selection.injected(entries, given)
    return messages.select("session", "participant", B.extract_text().alias("text"), F.col("out_pos").cast("long").alias("out_pos"))


SHOWN = f"""{SUMMARIES}, alive AS (SELECT * FROM s WHERE merged_into IS NULL), s1 AS (SELECT * FROM alive WHERE level = 1),
s2 AS (SELECT * FROM alive a WHERE level = 2 AND EXISTS (SELECT 1 FROM (VALUES (a.kid1), (a.kid2)) v(k) WHERE k IS NOT NULL AND k NOT IN (SELECT doc_id FROM s1 WHERE s1.session = a.session))),
s3 AS (SELECT * FROM alive a WHERE level = 3 AND EXISTS (SELECT 1 FROM (VALUES (a.kid1), (a.kid2)) v(k) WHERE k IS NOT NULL AND k NOT IN (SELECT doc_id FROM s2 WHERE s2.session = a.session))),
shown AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


@query(f"WITH {SHOWN} SELECT session, id, level FROM shown")
def anti_redundant(spark, sf_dir) -> DataFrame:
    return selection.shown_summaries(summary_table(spark, sf_dir)).select("session", "id", "level")


@query(f"""WITH {SHOWN}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY session, level ORDER BY ord) AS run FROM shown),
a AS (SELECT *, coalesce(max(CASE WHEN level = 3 AND run <= 300 AND run <= 1000 THEN run END) OVER (PARTITION BY session), 0) AS u3 FROM r),
b AS (SELECT *, coalesce(max(CASE WHEN level = 2 AND run <= 600 - u3 AND u3 + run <= 1000 THEN run END) OVER (PARTITION BY session), 0) AS u2 FROM a)
SELECT session, id, level FROM b WHERE (level = 3 AND run <= 300 AND run <= 1000) OR (level = 2 AND run <= 600 - u3 AND u3 + run <= 1000) OR (level = 1 AND run <= 900 - u3 - u2 AND run <= 1000 - u3 - u2)""")
def summary_waterfall(spark, sf_dir) -> DataFrame:
    shown = selection.shown_summaries(summary_table(spark, sf_dir))
    used = shown.select("session", F.lit(0).alias("head_used")).distinct()
    return selection.waterfall(shown, used, 1000, 300, 300, 300).select("session", "id", "level")


@query(f"""WITH {SUMMARIES}, f AS (SELECT *, CASE phase WHEN 'synthesis' THEN 0 WHEN 'lesson' THEN 1 WHEN 'research' THEN 4 ELSE 2 END AS g, CASE phase WHEN 'subagent' THEN 0 ELSE 1 END AS h FROM s WHERE level = 1),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session, g ORDER BY h, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, row_number() OVER (PARTITION BY session, g ORDER BY h, ord) AS q FROM f),
a0 AS (SELECT *, g = 0 AND run <= 1000 AND NOT (run - tokens >= 400 AND run > 700) AS k FROM r),
b0 AS (SELECT *, k AND q < coalesce(min(CASE WHEN g = 0 AND NOT k THEN q END) OVER (PARTITION BY session), 1 << 30) AS ok0 FROM a0), c0 AS (SELECT *, coalesce(max(CASE WHEN ok0 THEN run END) OVER (PARTITION BY session), 0) AS t0 FROM b0),
a1 AS (SELECT *, g = 1 AND t0 + run <= 1000 AS ok1 FROM c0), c1 AS (SELECT *, t0 + coalesce(max(CASE WHEN ok1 THEN run END) OVER (PARTITION BY session), 0) AS t1 FROM a1),
a2 AS (SELECT *, g = 2 AND t1 + run <= 1000 AS ok2 FROM c1), c2 AS (SELECT *, t1 + coalesce(max(CASE WHEN ok2 THEN run END) OVER (PARTITION BY session), 0) AS t2 FROM a2)
SELECT session, id, phase FROM c2 WHERE ok0 OR ok1 OR ok2 OR (g = 4 AND run <= 300 AND t2 + run <= 1000)""")
def l1_asymmetric(spark, sf_dir) -> DataFrame:
    first = summary_table(spark, sf_dir).filter("level = 1").withColumn("eff", F.lit(1000))
    return selection.asymmetric_picks(first, "eff").select("session", "id", "phase")


@query(f"WITH {SUMMARIES} SELECT session, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3, count(*) FILTER (level = 1 AND merged_into IS NULL) AS l1_unmerged, count(*) FILTER (level = 2 AND merged_into IS NULL) AS l2_unmerged, count(*) FILTER (level = 3 AND merged_into IS NULL) AS l3_unmerged FROM s GROUP BY session")
def summary_stats(spark, sf_dir) -> DataFrame:
    return pyramid.stats(summary_table(spark, sf_dir))


@query(f"""WITH {SUMMARIES}, a AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY ord) - 1) // 6 AS g FROM s WHERE level = 1 AND merged_into IS NULL), b AS (SELECT *, count(*) OVER (PARTITION BY session, g) AS c FROM a),
x AS (SELECT session, g, string_agg(id, ',' ORDER BY ord) AS source_ids FROM b WHERE c = 6 GROUP BY ALL), p AS (SELECT session, g, phase, count(*) AS n, min(ord) AS o FROM b WHERE c = 6 GROUP BY ALL),
h AS (SELECT session, g, string_agg(n || ' ' || phase, ', ' ORDER BY o) AS phases FROM p GROUP BY ALL) SELECT session, CAST(g AS BIGINT) AS group_no, source_ids, phases FROM x JOIN h USING (session, g)""")
def merge_groups(spark, sf_dir) -> DataFrame:
    due = pyramid.due_merges(summary_table(spark, sf_dir), 1)
    ids = due.groupBy("session", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",").alias("source_ids"))
    return ids.join(pyramid.phase_histogram(due, ["session", "group_no"]), ["session", "group_no"])


@query(f"WITH {CONVERSATIONS}, x AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m WHERE pos < 5 AND n > 5) SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS back FROM x WHERE b < 15000")
def prior_context(spark, sf_dir) -> DataFrame:
    m = zones.measured(conversation_messages(spark, sf_dir))
    starts = m.filter("pos = 5").select("session", F.lit(1).alias("chunk_no"), F.col("pos").alias("start_pos"))
    return pyramid.prior_rows(m, starts).select("session", "msg_id", F.col("back").cast("long").alias("back"))


COMPILED = """h AS (SELECT *, CASE WHEN pos >= head_start AND pos < head_end THEN sum(CASE WHEN pos >= head_start AND pos < head_end THEN tokens ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) END AS hr FROM z),
u AS (SELECT *, coalesce(max(CASE WHEN hr <= 300 THEN hr END) OVER (PARTITION BY session), 0) AS used FROM h),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS rr FROM u WHERE pos >= greatest(recent_start, head_end)),
a AS (SELECT session, 0 AS part, pos, msg_id, participant, pos = max(pos) OVER (PARTITION BY session) AS mark FROM u WHERE hr <= 300 UNION ALL SELECT session, 2, pos, msg_id, participant, false FROM r WHERE rr + used <= 300)"""


@query(f"WITH {CONVERSATIONS}, rows AS (SELECT *, false AS has_use, false AS has_result FROM m), {ZONES.format(rows='rows', head=60, recent=120).replace('CASE WHEN CAST(session AS BIGINT) % 2 = 0 AND n > 3 THEN 3 ELSE 0 END', '0')}, {COMPILED} SELECT session, msg_id, participant, mark AS cache_marker, row_number() OVER (PARTITION BY session ORDER BY part, pos) - 1 AS out_pos FROM a")
def compile_hierarchical(spark, sf_dir) -> DataFrame:
    plan = Autobiographical(Config(head_window_tokens=60, recent_window_tokens=120))
    entries, _ = compiled(conversation_messages(spark, sf_dir), plan, State(), Budget(400, 100))
    return entries.select("session", F.col("source_msg_id").alias("msg_id"), "participant", "cache_marker", "out_pos")


def _ticked(spark, sf_dir, plan):
    m = event_messages(spark, sf_dir).drop("metadata_json")
    return m, plan.tick(m, State())


@query()
def compile_pyramid(spark, sf_dir) -> DataFrame:
    """Hierarchical contexts after one pass of summaries, with merges."""
    m, state = _ticked(spark, sf_dir, plan := Autobiographical(Config(target_chunk_tokens=100, head_window_tokens=60, recent_window_tokens=150, merge_threshold=3, summary_target_tokens=20)))
    entries, _ = compiled(m, plan, state, Budget(600, 100))
    return entries.select("session", "out_pos", "source_msg_id", "source_relation", "participant", F.size("content").alias("blocks"), "cache_marker")


@query()
def compile_knowledge(spark, sf_dir) -> DataFrame:
    """The same with phases."""
    m, state = _ticked(spark, sf_dir, plan := Knowledge(Config(target_chunk_tokens=60, recent_window_tokens=150, merge_threshold=3, summary_target_tokens=20)))
    entries, _ = compiled(m, plan, state, Budget(600, 100))
    return entries.select("session", "out_pos", "source_msg_id", "source_relation", "participant", F.size("content").alias("blocks"), "cache_marker")


@query()
def compile_single_level(spark, sf_dir) -> DataFrame:
    """Single-level contexts, a diary for every second chunk."""
    plan = Autobiographical(Config(hierarchical=False, target_chunk_tokens=100, head_window_tokens=60, recent_window_tokens=150))
    m = event_messages(spark, sf_dir).drop("metadata_json")
    diaries = plan.chunks(m, State()).filter("chunk_no % 2 = 0").select("session", "chunk_key", F.concat(F.lit("diary "), F.col("chunk_no").cast("string")).alias("diary"))
    entries, _ = compiled(m, plan, State(diaries=diaries), Budget(500, 100))
    return entries.select("session", "out_pos", "source_msg_id", "source_relation", "participant", "cache_marker")


@query(f"WITH {CONVERSATIONS} SELECT count(*) AS messages, (SELECT count(*) FROM m) AS context_entries, 1 AS branches FROM m")
def log_stats(spark, sf_dir) -> DataFrame:
    m = conversation_messages(spark, sf_dir).agg(F.count(F.lit(1)).alias("messages"))
    return m.crossJoin(_entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("context_entries"))).withColumn("branches", F.lit(1))


@query(f"WITH {PHASES} SELECT session, phase, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY ROLLUP (session, phase)")
def phase_rollup(spark, sf_dir) -> DataFrame:
    return _phased_events(spark, sf_dir).rollup("session", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


# Context entries, lookups, media and the rest of the operators, each against SQL

ENTRIES = f"""{CONVERSATIONS}, c AS (SELECT session, 'ctx-' || msg_id AS entry_id, msg_id AS source_msg_id, pos, CASE pos % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'derived' WHEN 2 THEN 'referenced' END AS relation, participant, text FROM m)"""


def _shown_entries(entries: DataFrame) -> DataFrame:
    return context_log.indexed(entries).select("entry_id", F.col("index").cast("long").alias("index"), B.extract_text().alias("text"))


@query(f"WITH {ENTRIES} SELECT entry_id, pos AS index, CASE WHEN pos % 3 = 0 THEN 'new: ' || text ELSE text END AS text FROM c")
def context_edit(spark, sf_dir) -> DataFrame:
    e = _entries(spark, sf_dir)
    new = e.filter("seq % 3 = 0").select("session", "entry_id", B.text_content(F.concat(F.lit("new: "), B.extract_text())).alias("content"))
    return _shown_entries(context_log.edit(e, new))


@query(f"WITH {ENTRIES} SELECT entry_id, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS index, text FROM c WHERE pos % 3 <> 1")
def context_remove(spark, sf_dir) -> DataFrame:
    e = _entries(spark, sf_dir)
    return _shown_entries(context_log.remove(e, e.filter("seq % 3 = 1")))


@query(f"WITH {ENTRIES} SELECT entry_id, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS index, text FROM c WHERE pos < 1 OR pos >= 3")
def context_remove_range(spark, sf_dir) -> DataFrame:
    return _shown_entries(context_log.remove_range(_entries(spark, sf_dir), 1, 3))


@query(f"WITH {ENTRIES} SELECT entry_id, pos AS index, text FROM c WHERE CAST(session AS BIGINT) % 2 = 1 UNION ALL SELECT 'new-' || session, 0, 'fresh' FROM c WHERE CAST(session AS BIGINT) % 2 = 0 AND pos = 0")
def context_replace_all(spark, sf_dir) -> DataFrame:
    e = _entries(spark, sf_dir)
    even = e.filter("bigint(session) % 2 = 0 and seq = 0")
    new = even.withColumn("entry_id", F.concat(F.lit("new-"), "session")).withColumn("content", B.text_content(F.lit("fresh")))
    return _shown_entries(context_log.replace_all(e, even, new))


@query(f"WITH {ENTRIES} SELECT entry_id, pos AS index, relation FROM c WHERE participant = 'user'")
def entries_by_source(spark, sf_dir) -> DataFrame:
    m = conversation_messages(spark, sf_dir).filter("participant = 'user'")
    return context_log.by_source(_entries(spark, sf_dir), m).select("entry_id", F.col("index").cast("long").alias("index"), F.col("source_relation").alias("relation"))


@query(f"WITH {CONVERSATIONS} SELECT session, msg_id, pos, participant FROM m WHERE msg_id = (SELECT min(msg_id) FROM m)")
def point_lookup(spark, sf_dir) -> DataFrame:
    m = conversation_messages(spark, sf_dir)
    wanted = m.agg(F.min("msg_id")).first()[0]
    return message_log.lookup(m, wanted).select("session", "msg_id", F.col("pos").cast("long").alias("pos"), "participant")


@query(f"WITH {FOLDED.format(till=1002)}, g AS (SELECT session, msg_id, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, text FROM f) SELECT * FROM g WHERE msg_id = (SELECT max(msg_id) FROM g WHERE pos = 1)")
def lookup_as_of(spark, sf_dir) -> DataFrame:
    wanted = table(spark, sf_dir, "conversations").filter("turn = 1").agg(F.max(F.concat_ws("-", "conv_id", "turn"))).first()[0]
    found = message_log.lookup_at(operation_log(spark, sf_dir), wanted, 1002)
    return found.select("session", "msg_id", F.col("pos").cast("long").alias("pos"), B.extract_text().alias("text"))


@query(f"WITH {OPS} SELECT 'side' AS id, 'side' AS name, 10 * turn AS head, 'main' AS parent_id, 10 * turn AS branch_point FROM c WHERE msg_id = (SELECT max(msg_id) FROM c WHERE turn = 1)")
def branch_points(spark, sf_dir) -> DataFrame:
    wanted = table(spark, sf_dir, "conversations").filter("turn = 1").agg(F.max(F.concat_ws("-", "conv_id", "turn"))).first()[0]
    adds = operation_log(spark, sf_dir).filter("op = 'add'")
    return message_log.branch_at(message_log.fold(adds), wanted, "side").drop("created")


@query("SELECT doc_id, text, 'text/plain' AS media_type, CAST(NULL AS BIGINT) AS estimate FROM documents")
def blob_get(spark, sf_dir) -> DataFrame:
    media = B.block(type="document", source_type="base64", media_type="text/plain", data=F.base64(F.encode("text", "UTF-8")), token_estimate=F.lit(7))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), F.array(media).alias("content"))
    back = message_log.resolve_blobs(message_log.extract_blobs(d), message_log.blobs(d), ["msg_id"])
    one = F.col("content")[0]
    return back.select(F.col("msg_id").alias("doc_id"), F.decode(F.unbase64(one["data"]), "UTF-8").alias("text"), one["media_type"].alias("media_type"), one["token_estimate"].cast("long").alias("estimate"))


@query("SELECT doc_id, doc_id % 3 <> 1 AS storable, doc_id % 3 = 0 AS is_image FROM documents")
def storable_media(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 2, "audio").otherwise("image")
    block = B.block(type=kind, source_type=F.when(F.col("doc_id") % 3 == 1, "url").otherwise("base64"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(block).alias("content"))
    return d.select("doc_id", B.has_storable_media().alias("storable"), (B.has_block("image") & B.has_storable_media()).alias("is_image"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) + ceil(length(lang) / 4.0) + ceil(length(source) / 4.0) + 9 + 1000 + 1000 AS BIGINT) AS full_tokens,
CAST(ceil(length(text) / 4.0) + ceil(length(lang) / 4.0) AS BIGINT) AS text_only, CAST(ceil(length(text) / 4.0) AS BIGINT) AS text_blocks FROM documents""")
def media_estimates(spark, sf_dir) -> DataFrame:
    """Text, thinking, a result of nested blocks, an image without an estimate of its own, and audio."""
    nested = F.array(F.struct(F.lit("text").alias("type"), F.col("source").alias("text"), F.lit(None).cast("int").alias("token_estimate")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(9).alias("token_estimate")))
    content = F.array(B.block(type="text", text=F.col("text")), B.block(type="thinking", thinking=F.col("lang")), B.block(type="tool_result", result_blocks=nested), B.block(type="image"), B.block(type="audio"))
    d = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return d.select("doc_id", B.full_tokens().alias("full_tokens"), B.text_only_tokens().alias("text_only"), B.text_block_tokens().alias("text_blocks"))


@query("SELECT doc_id, CAST(ceil((length(text) + 2) / 4.0) AS BIGINT) AS tokens, CAST(ceil((length(text) + 1) / 4.0) AS BIGINT) AS points, left(text, 9) AS cut FROM documents")
def utf16_estimates(spark, sf_dir) -> DataFrame:
    """A character beyond 16 bits counts twice in UTF-16, and a slice never parts it."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat("text", F.lit("\U0001F986")))
    return d.select("doc_id", B.estimate_text("t", True).alias("tokens"), B.estimate_text("t").alias("points"), F.left("t", F.least(F.lit(9), F.length("text"))).alias("cut"))


@query(f"WITH {CONVERSATIONS} SELECT session, arg_max(msg_id, pos) AS anchor_id FROM m WHERE pos IN (1, 2) GROUP BY session")
def topic_markers(spark, sf_dir) -> DataFrame:
    """The last marker of the manager itself; the same words of others don't count."""
    m = conversation_messages(spark, sf_dir)
    marked = B.text_content(F.concat(F.lit(B.TRANSITION_PREFIX), F.lit(" next")))
    m = m.withColumn("participant", F.when(F.col("pos").isin(1, 2), F.lit(B.TRANSITION_PARTICIPANT)).otherwise(F.col("participant"))).withColumn("content", F.when(F.col("pos") >= 1, marked).otherwise(F.col("content")))
    return zones.last_marker(m)


@query(f"WITH {SUMMARIES}, alive AS (SELECT * FROM s WHERE merged_into IS NULL) SELECT session, id FROM alive WHERE level = 1 AND coalesce(kid1 % 11 <> 0, true) AND coalesce(kid2 % 11 <> 0, true)")
def summaries_without_excluded(spark, sf_dir) -> DataFrame:
    """First-level summaries that share no source with what is shown anyway."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("msg_id"), "doc_id")
    excluded = d.filter("doc_id % 22 = 0").union(d.filter("doc_id % 11 = 0")).select("session", "msg_id").distinct()
    return selection.shown_summaries(summary_table(spark, sf_dir), excluded).filter("level = 1").select("session", "id")


@query(f"WITH {SUMMARIES}, g AS (SELECT session, doc_id AS group_no, kid2, kid1 FROM s WHERE level = 2 AND kid2 IS NOT NULL AND kid1 % 7 <> 0 AND kid2 % 7 <> 0) SELECT session, group_no, 0 AS place, CAST(kid2 AS VARCHAR) AS id FROM g UNION ALL SELECT session, group_no, 1, CAST(kid1 AS VARCHAR) FROM g")
def merge_sources(spark, sf_dir) -> DataFrame:
    """Sources of a merge in their order; a group with one that is gone is left out whole."""
    s = summary_table(spark, sf_dir)
    wanted = s.filter("level = 2 and size(source_ids) = 2").select("session", F.col("id").cast("long").alias("group_no"), "source_ids")
    return pyramid.resolve(s.filter("merged_into is null"), wanted).select("session", "group_no", F.col("place").cast("long").alias("place"), "id")


@query(ORACLE_SQL["chunk_by_size"].replace("SELECT session, CAST(c AS BIGINT) AS chunk_no", "SELECT session, CAST(c AS BIGINT) AS chunk_no, c % 2 = 0 AS compressed, CASE WHEN c % 2 = 0 THEN 'diary ' || c END AS diary"))
def chunk_reuse(spark, sf_dir) -> DataFrame:
    rows = zones.compressible(zones.zoned(zones.measured(conversation_messages(spark, sf_dir)), 0, -1))
    found = chunking.chunks(chunking.by_size(rows, 150, 2))
    done = found.filter("chunk_no % 2 = 0").select("session", "chunk_key", F.lit(None).cast("string").alias("summary_id"), F.concat(F.lit("diary "), F.col("chunk_no").cast("string")).alias("diary"))
    out = chunking.with_existing(found, done)
    return out.select("session", F.col("chunk_no").cast("long").alias("chunk_no"), "compressed", "diary", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), "chunk_key", "tokens")


@query(f"""WITH {CONVERSATIONS}, e AS (SELECT *, sum(length(participant) + length(text) + 4) OVER (PARTITION BY session ORDER BY pos) - 2 AS till FROM m)
SELECT session, string_agg(participant || ': ' || text, chr(10) || chr(10) ORDER BY pos) FILTER (pos < 2) || CASE WHEN max(pos) > 1 THEN chr(10) || chr(10) || '[...truncated...]' ELSE '' END AS head_text FROM (SELECT e.*, 0 AS z FROM e) GROUP BY session""")
def transition_head(spark, sf_dir) -> DataFrame:
    """Head rows as text while they fit, here two of them: the limit is set per session by making later rows long."""
    m = conversation_messages(spark, sf_dir)
    text = F.when(F.col("pos") < 2, B.extract_text()).otherwise(F.repeat(F.lit("z"), 8000))
    z = zones.zoned(zones.measured(m.withColumn("content", B.text_content(text))), 1 << 30, 0)
    return pyramid.transition_text(z).select("session", "head_text")


@query(f"WITH {SUMMARIES}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS r FROM s WHERE level >= 2) SELECT session, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS top_text FROM k WHERE r <= 3 GROUP BY session")
def transition_top(spark, sf_dir) -> DataFrame:
    """The last three higher summaries of each session."""
    none = conversation_messages(spark, sf_dir).filter("session is null")
    text = pyramid.transition_text(zones.zoned(zones.measured(none), 0, 0), summary_table(spark, sf_dir))
    return text.select("session", "top_text")


@query(f"WITH {SUMMARIES}, u AS (SELECT session, level, count(*) AS n FROM s WHERE merged_into IS NULL AND level < 3 GROUP BY ALL), g AS (SELECT session, CAST(sum(n // 6) AS BIGINT) AS pending_merges FROM u GROUP BY session HAVING sum(n // 6) > 0) SELECT session, CAST(0 AS BIGINT) AS pending_chunks, pending_merges, false AS ready FROM g")
def readiness(spark, sf_dir) -> DataFrame:
    none = spark.createDataFrame([], "session string, compressed boolean")
    return pyramid.readiness(summary_table(spark, sf_dir), none)


@query("SELECT DISTINCT lang, source, 'Summarise 3 messages (' || lang || ') in at most 50 tokens.' AS chunk_prompt, 'Summarise 6 summaries of level 1 (' || source || ') in at most 50 tokens.' AS merge_prompt FROM documents")
def instructions(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return d.select("lang", "source", pyramid.instruction(F.col("lang"), 50, 3).alias("chunk_prompt"), pyramid.merge_instruction(2, 50, F.col("source"), 6).alias("merge_prompt"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, props AS json FROM events")
def epoch_millis(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_millis(F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))).alias("ms"), F.col("props").alias("json"))


@query("""SELECT r_name AS participant, CASE WHEN r_regionkey = 1 THEN 'edited' ELSE lower(r_name) END AS text, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos,
(SELECT count(*) - 1 FROM region) AS messages, (SELECT count(*) - 1 FROM region) AS entries, (SELECT count(*) - 1 FROM region) AS heard, 1 AS branches FROM region WHERE r_regionkey <> 2""")
def engine_store(spark, sf_dir) -> DataFrame:
    """A store in a new folder: append, copy to entries, edit, remove, listen, count, read by view."""
    from threadloom.plans.engine import ContextEngine
    from threadloom.sources.tables import shared_folder

    engine, heard = ContextEngine(spark, shared_folder(spark, "engine"), "regions", isolate=True), []
    off = engine.add_listener(heard.append)
    ids = {}
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # regions are few by definition
    for k, r in enumerate(rows):
        if k == len(rows) - 1:
            off()
        ids[r["r_regionkey"]] = engine.add_message(r["r_name"], r["r_name"].lower())
        engine.append_entry(r["r_name"], r["r_name"].lower(), ids[r["r_regionkey"]], "copy")
    engine.edit_message(ids[1], "edited")
    engine.remove_message(ids[2])
    stats = engine.stats()
    engine.sync()
    engine.create_view("engine_messages")
    out = engine.get_store().table("engine_messages").select("participant", B.extract_text().alias("text"), F.col("pos").cast("long").alias("pos"))
    engine.close()
    return out.select("*", F.lit(stats["messages"]).cast("long").alias("messages"), F.lit(stats["context_entries"]).cast("long").alias("entries"), F.lit(len(heard)).cast("long").alias("heard"), F.lit(stats["branches"]).alias("branches"))


@query(ORACLE_SQL["chunk_by_size"].replace("x AS (SELECT session, c, count(*) AS rows,", "x AS (SELECT session, c, bool_or(closed) AS closed, count(*) AS rows,").replace("WHERE rows >= 2 AND", "WHERE closed AND").replace("CAST(a AS BIGINT) AS start_idx, CAST(b AS BIGINT) AS end_idx, ", ""))
def feed_chunks(spark, sf_dir) -> DataFrame:
    """The log replayed as a stream in three batches: chunks that have closed, by a stateful operator."""
    from threadloom.sources.tables import shared_folder
    from threadloom.streaming import feed

    base = shared_folder(spark, "feed")
    rows = conversation_messages(spark, sf_dir).withColumn("seq", F.col("pos").cast("long"))
    for k in range(3):
        last = F.col("pos") >= 4 if k == 2 else F.col("pos").between(2 * k, 2 * k + 1)
        message_log.adds(rows.filter(last)).write.mode("append").parquet(f"{base}/ops")
        added = feed.operations(spark, f"{base}/ops").filter("op = 'add'").select("session", "seq", "msg_id", B.full_tokens().alias("tokens"))
        feed.finished(feed.chunk_stream(added, 150, 2).writeStream.format("parquet").option("path", f"{base}/chunks").option("checkpointLocation", f"{base}/progress").outputMode("append"))
    out = spark.read.schema(feed.CHUNK).parquet(f"{base}/chunks")
    return out.select("session", "chunk_no", F.array_join("msg_ids", ":").alias("chunk_key"), "tokens")
