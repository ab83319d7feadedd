"""Registered queries, one for each operation, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import parsing
from chatloom.operators import catalog, export, index, quality, search
from chatloom.operators.tables import materialized, shared_folder
from chatloom.plans import synth
from chatloom.plans.oracle import MESSAGE, SESSION, sql
from chatloom.sources import claude, codex, copilot, files, gemini, manifest, opencode
from chatloom.streaming import incremental
from chatloom.streaming import sessions as sessions_stream
from chatloom.streaming.sessions import keyed_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2026-01-01T00:00:00Z"


def query(name: str, oracle: str | None = None, fts: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle, fts)
        return f

    return keep


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_TABLES: dict[tuple[str, ...], DataFrame] = {}


def _stamp(spark: SparkSession, d: str) -> str:
    """Names, sizes and times of the files of ``conversations``, so that a changed folder is taken in again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{d}/conversations.parquet")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def held(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once for each application and state of a folder, as logs are taken in once and then queried."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d), name)
    if key not in _TABLES:
        _TABLES[key] = materialized(make(), name)
    return _TABLES[key]


def rendered(spark: SparkSession, d: str, older: bool = False) -> files.Raw:
    """Raw logs. ``older``: as they were before the last turns of every third conversation."""
    rows = synth.table(spark, d)
    if older:
        rows = rows.filter("conv_id % 3 <> 0 or turn < 2")
    return files.split(held(spark, d, "raw-older" if older else "raw", lambda: files.union(synth.render(rows))))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "sessions", lambda: files.all_sessions(rendered(spark, d)))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "messages", lambda: files.all_messages(rendered(spark, d), as_of()))


def session_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "provider", "session_id", "project_path", "project_name", "git_branch", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("ended_at").alias("ended"), "summary", "model",
        F.col("token_usage.input_tokens").cast("string").alias("input_tokens"), F.col("token_usage.output_tokens").cast("string").alias("output_tokens"), "message_count",
    )


def message_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "provider", "session_id", "seq", "message_id", "role", F.unix_timestamp("timestamp").alias("ts"), F.array_join(F.transform("content", lambda b: b["type"]), ",").alias("types"),
        F.md5(F.array_join(F.transform("content", lambda b: b["text"]), "|").cast("binary")).alias("body"),
    )


# ---- sources
_OWN = {
    "claude": ("claude_code", lambda r: claude.sessions(r.claude, r.history), lambda r: claude.messages(r.claude, as_of())),
    "copilot": ("copilot_cli", lambda r: copilot.sessions(r.workspaces, r.events), lambda r: copilot.messages(r.workspaces, r.events, r.checkpoints, as_of())),
    "gemini": ("gemini_cli", lambda r: gemini.sessions(r.chats, r.projects), lambda r: gemini.messages(r.chats, as_of())),
    "codex": ("codex_cli", lambda r: codex.sessions(r.rollouts), lambda r: codex.messages(r.rollouts, as_of())),
    "opencode": ("opencode", lambda r: opencode.sessions(r.oc_sessions, r.oc_messages), lambda r: opencode.messages(r.oc_messages, r.oc_parts, as_of())),
}


def _own(key: str, name: str, which: int, where: str = "true") -> None:
    provider, *made = _OWN[name]
    rows = session_rows if which == 0 else message_rows
    oracle = f"SELECT {SESSION} FROM s WHERE provider = '{provider}'" if which == 0 else f"SELECT {MESSAGE} FROM mb WHERE provider = '{provider}'"
    query(key, f"{oracle} AND {where}")(lambda spark, d: rows(made[which](rendered(spark, d))))


for _key, _name, _which in (
    ("src_claude_sessions", "claude", 0), ("src_codex_rollouts", "codex", 0), ("src_opencode_sessions", "opencode", 0),
    ("norm_claude", "claude", 1), ("norm_copilot", "copilot", 1), ("norm_gemini", "gemini", 1), ("norm_codex", "codex", 1), ("norm_opencode", "opencode", 1), ("sess_meta_times", "copilot", 0), ("sess_project_path_join", "gemini", 0),
):
    _own(_key, _name, _which)


@query("src_copilot_events", "SELECT '/p/' || sid AS folder, turn * 10 AS ord, false AS bad, CASE WHEN role IN ('user', 'assistant') THEN role END AS role, 'e-' || turn AS message_id FROM c0 WHERE kind = 1 UNION ALL SELECT '/p/' || sid, turn * 10 + 3, true, NULL, NULL FROM c0 WHERE kind = 1 AND (conv_id + turn) % 17 = 0")
def _(spark, d):
    """Every event line with what it is."""
    return copilot.annotated(rendered(spark, d).events).select("folder", F.col("ord").cast("int").alias("ord"), "bad", "role", F.when(~F.col("bad"), F.col("message_id")).alias("message_id"))


@query("src_gemini_chats", "SELECT '/g/tmp/' || any_value(project) || '/chats/session-' || sid || '.json' AS source_path, sid AS session_id, count(*)::BIGINT AS entries FROM c0 WHERE kind = 2 GROUP BY sid")
def _(spark, d):
    """Whole chat files."""
    return gemini.chats(rendered(spark, d).chats).select("source_path", F.col("r.sessionId").alias("session_id"), F.size("r.messages").cast("long").alias("entries"))


@query("src_opencode_messages", "SELECT sid AS session_id, sid || '-' || lpad(turn::VARCHAR, 4, '0') AS message_id, CASE WHEN role IN ('user', 'assistant') THEN role END AS role, epoch::BIGINT AS ts FROM c0 WHERE kind = 4")
def _(spark, d):
    """Every message file, also those of other roles."""
    r = rendered(spark, d)
    return opencode.annotated(r.oc_messages, r.oc_parts).select("session_id", "message_id", "role", F.unix_timestamp("timestamp").alias("ts"))


@query("src_claude_history", "SELECT 'session-' || conv_id AS session_id, 'talk ' || conv_id AS display, min(epoch)::BIGINT * 1000 AS millis FROM c0 WHERE kind = 0 GROUP BY conv_id")
def _(spark, d):
    return claude.history(rendered(spark, d).history).select("session_id", "display", "millis")


@query("src_copilot_workspace", "SELECT 'session-' || conv_id AS id, '/work/' || any_value(project) AS cwd, strftime(to_timestamp(min(epoch)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(to_timestamp(max(epoch)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM c0 WHERE kind = 1 GROUP BY conv_id")
def _(spark, d):
    return copilot.workspaces(rendered(spark, d).workspaces).select("id", "cwd", "created_at", "updated_at")


@query("src_copilot_checkpoint", "SELECT sid AS session_id, body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c0 WHERE kind = 1) x JOIN (SELECT conv_id AS k, '# notes' || chr(10) || first(text ORDER BY turn) AS raw, regexp_replace('# notes' || chr(10) || first(text ORDER BY turn), '\\s+$', '') AS body FROM c0 WHERE kind = 1 GROUP BY conv_id) y ON k = conv_id WHERE n = 1 AND NOT newer AND conv_id % 3 <> 0")
def _(spark, d):
    """Older conversations lose their events; every third one has headings alone and gives nothing."""
    c = synth.conversations(synth.table(spark, d)).filter("kind = 1")
    first = c.groupBy("conv_id", "sid").agg(F.min_by("said", "turn").alias("t"))
    raw = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    notes = first.join(raw, "conv_id").select(F.concat(F.lit("/p/"), "sid", F.lit("/checkpoints/index.md")).alias("source_path"), F.lit(0).cast("long").alias("ord"), F.when(F.col("conv_id") % 3 == 0, "# only\n\n| head |").otherwise(F.concat(F.lit("# notes\n"), "text")).alias("value"))
    r = rendered(spark, d)
    kept = r.events.filter(F.regexp_extract("source_path", r"session-(\d+)/", 1).cast("long") % 2 == 1)
    got = copilot.messages(r.workspaces, kept, notes, as_of()).filter("role = 'system'")
    return got.select("session_id", F.element_at("content", 1)["text"].alias("body"))


@query("src_gemini_projects", "SELECT DISTINCT project AS slug, '/work/' || project AS project_path FROM c0 WHERE conv_id % 7 < 6")
def _(spark, d):
    return gemini.projects(rendered(spark, d).projects).select("slug", "project_path")


@query("src_opencode_parts", "SELECT message_id, CASE WHEN role = 'assistant' THEN 'text,code_block,tool_use,tool_result' ELSE 'text' END AS types FROM (SELECT *, sid || '-' || lpad(turn::VARCHAR, 4, '0') AS message_id FROM c0 WHERE kind = 4 AND newer)")
def _(spark, d):
    return opencode.part_blocks(rendered(spark, d).oc_parts).select("message_id", F.array_join(F.transform("parts", lambda b: b["type"]), ",").alias("types"))


@query("src_multi_base", "SELECT session_id, count(*)::BIGINT AS copies FROM s WHERE provider = 'codex_cli' GROUP BY 1 HAVING true UNION ALL SELECT session_id || '-b', count(*)::BIGINT FROM s WHERE provider = 'codex_cli' GROUP BY 1")
def _(spark, d):
    """Two bases of one provider, and a third that is missing: a plain union."""
    r = rendered(spark, d).rollouts
    other = r.withColumn("source_path", F.regexp_replace("source_path", r"^/x/(.*)\.jsonl$", "/y/$1-b.jsonl"))
    return codex.sessions(r.unionByName(other).unionByName(r.filter("false"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))


@query("src_bad_lines", "SELECT 'session-' || conv_id AS session_id, count(*)::BIGINT + count(*) FILTER (WHERE (conv_id + turn) % 17 = 0) AS lines, count(*) FILTER (WHERE (conv_id + turn) % 17 = 0)::BIGINT AS parse_errors, count(*)::BIGINT AS kept FROM c0 WHERE kind = 0 GROUP BY conv_id")
def _(spark, d):
    rows = claude.annotated(rendered(spark, d).claude)
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("parse_errors"), F.count_if(~F.col("bad")).alias("kept"))


# ---- normalisation
_BLOCK = "provider, sid AS session_id, seq::BIGINT AS seq, pos::INT AS pos, type, btext AS text, language"


def _blocks(key: str, name: str) -> None:
    provider, _, made = _OWN[name]
    query(key, f"SELECT {_BLOCK} FROM b WHERE provider = '{provider}'")(lambda spark, d: catalog.content_blocks(made(rendered(spark, d))).select("provider", "session_id", "seq", "pos", "type", "text", "language"))


_blocks("norm_claude_blocks", "claude")
_blocks("norm_copilot_blocks", "copilot")


@query("norm_explode_blocks", f"SELECT {_BLOCK} FROM b")
def _(spark, d):
    return catalog.content_blocks(messages(spark, d)).select("provider", "session_id", "seq", "pos", "type", "text", "language")


@query("norm_tool_result_text", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text || chr(10) || role ELSE '' END AS output FROM c0")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    item = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))
    made = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("content")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.array(item(F.col("text")), image, item(F.col("role"))).alias("content")))).otherwise(F.lit("{}"))
    return rows.select("conv_id", "turn", claude.tool_result_text(F.parse_json(made)).alias("output"))


@query("norm_tool_args", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS arguments FROM events")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", parsing.canonical_json(F.try_parse_json("props")).alias("arguments"))


@query("norm_fences", "SELECT conv_id, turn, pos::INT AS pos, type, btext AS text, language FROM (SELECT conv_id, turn, pos, type, btext, language FROM b WHERE type IN ('text', 'code_block') UNION ALL SELECT conv_id, turn, 0, 'text', regexp_replace(regexp_replace(text, '^\\n+', ''), '\\s+$', ''), NULL FROM c0 WHERE role = 'system')")
def _(spark, d):
    c = synth.conversations(synth.table(spark, d))
    return c.select("conv_id", "turn", F.posexplode(parsing.fences(F.col("said"))).alias("pos", "b")).select("conv_id", "turn", "pos", "b.type", "b.text", "b.language")


@query("norm_timestamp", "SELECT event_id, epoch(ts)::BIGINT AS zoned, NULL::VARCHAR AS bare, epoch(ts)::BIGINT AS by_millis, (epoch(ts) - 7200)::BIGINT AS offset FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", parsing.utc_text(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.unix_timestamp("ts").alias("n"))
    return rows.select(
        "event_id", F.unix_timestamp(parsing.iso_time(F.concat("t", F.lit("Z")))).alias("zoned"), F.unix_timestamp(parsing.iso_time(F.col("t"))).cast("string").alias("bare"),
        F.unix_timestamp(parsing.millis(F.col("n") * 1000)).alias("by_millis"), F.unix_timestamp(parsing.iso_time(F.concat("t", F.lit("+02:00")))).alias("offset"),
    )


@query("norm_tokens", "SELECT provider, sid AS session_id, seq::BIGINT AS seq, inp::BIGINT AS input_tokens, outp::BIGINT AS output_tokens FROM m WHERE role = 'assistant' AND (kind IN (0, 2, 4) OR kind = 1 AND NOT newer)")
def _(spark, d):
    return messages(spark, d).filter("token_usage is not null").select("provider", "session_id", "seq", "token_usage.input_tokens", "token_usage.output_tokens")


@query("norm_drop_empty", "SELECT sid AS session_id, turn::BIGINT AS n, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS seq FROM m WHERE kind = 3 AND (role = 'system' OR turn % 3 <> 0)")
def _(spark, d):
    """Every third turn says nothing (errors stay), so its message goes and the others are numbered without it."""
    r = rendered(spark, d).rollouts
    empty = r.withColumn("value", F.when(F.floor(F.col("ord") / 10) % 3 == 0, F.regexp_replace("value", r'"(content|message)":"[^"\\]*+(?:\\.[^"\\]*+)*+"', '"$1":""')).otherwise(F.col("value")))
    got = codex.messages(empty, as_of())
    return got.select("session_id", ((F.unix_timestamp("timestamp") - 1735689600) % 3600 / 5).cast("long").alias("n"), "seq")


@query("norm_order", "SELECT provider, sid AS session_id, seq::BIGINT AS seq, epoch::BIGINT AS ts FROM m")
def _(spark, d):
    return messages(spark, d).select("provider", "session_id", "seq", F.unix_timestamp("timestamp").alias("ts"))


# ---- session roll-up
def _session_part(key: str, columns: str, where: str = "true") -> None:
    typed = columns.replace("input_tokens, output_tokens", "input_tokens::VARCHAR AS input_tokens, output_tokens::VARCHAR AS output_tokens")
    query(key, f"SELECT provider, session_id, {typed} FROM s WHERE {where}")(lambda spark, d: session_rows(sessions(spark, d)).filter(where).select("provider", "session_id", *[c.strip() for c in columns.split(",")]))


_session_part("sess_time_bounds", "started, ended", "provider in ('claude_code', 'codex_cli')")
_session_part("sess_message_count", "message_count")
_session_part("sess_first_meta", "git_branch, model, project_path", "provider in ('claude_code', 'gemini_cli', 'opencode')")
_session_part("sess_token_sum", "input_tokens, output_tokens", "provider in ('claude_code', 'gemini_cli')")
_session_part("sess_summary_history", "summary", "provider = 'claude_code'")
_session_part("sess_summary_first_user", "summary", "provider <> 'claude_code'")
_session_part("sess_project_name", "project_name")


@query("sess_drop_rules", "SELECT provider, sid AS session_id, CASE WHEN conv_id % 4 = 1 THEN 0 ELSE said END::BIGINT + CASE WHEN kind = 4 THEN told ELSE 0 END::BIGINT AS message_count FROM (SELECT provider, sid, kind, conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS said, count(*) FILTER (WHERE role = 'system') AS told FROM c0 GROUP BY ALL) WHERE CASE conv_id % 4 WHEN 1 THEN kind IN (1, 4) AND told > 0 WHEN 2 THEN kind = 1 OR kind = 0 AND said > 0 ELSE kind IN (1, 4) OR said > 0 END")
def _(spark, d):
    """Of every fourth conversation only the system's turns are left, and the next ones have no time: what stays a session?"""
    rows = synth.table(spark, d)
    raw = synth.render(rows.filter("conv_id % 4 <> 1 or role = 'system'"))
    untimed = F.coalesce(F.regexp_extract("source_path", r"session-([0-9]+)", 1).try_cast("long") % 4 == 2, F.lit(False))
    bare = F.regexp_replace(F.regexp_replace("value", r'"(timestamp|startTime|lastUpdated|createdAt|updatedAt)":"[^"]*"', '"$1":""'), r'"time":\{[^}]*\}', '"time":{}')
    kept = files.split(files.union(raw).withColumn("value", F.when(untimed, bare).otherwise(F.col("value"))))
    return files.all_sessions(kept).select("provider", "session_id", "message_count")


# ---- catalog
@query("cat_union", f"SELECT {SESSION} FROM s")
def _(spark, d):
    return session_rows(sessions(spark, d))


@query("cat_sort", "SELECT provider, session_id, started FROM l ORDER BY started DESC, rank, session_id")
def _(spark, d):
    return session_rows(catalog.sort(sessions(spark, d))).select("provider", "session_id", "started")


@query("cat_provider_counts", "SELECT provider, count(*)::BIGINT AS sessions FROM s GROUP BY ROLLUP (provider)")
def _(spark, d):
    return catalog.provider_counts(sessions(spark, d))


@query("cat_recent", "SELECT strftime(to_timestamp(started) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS started, label AS provider, coalesce(project_name, '(unknown)') AS project, coalesce(git_branch, '') AS branch, CASE WHEN length(summary) > 60 THEN left(summary, 57) || '...' ELSE coalesce(summary, '') END AS summary, session_id FROM (SELECT * FROM l ORDER BY started DESC, rank, session_id LIMIT 20)")
def _(spark, d):
    return catalog.recent(sessions(spark, d))


@query("cat_list_labels", "SELECT provider, session_id, coalesce(project_name, '(unknown project)') AS project, CASE WHEN length(summary) > 80 THEN left(summary, 77) || '...' ELSE coalesce(summary, '') END AS summary, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' WHEN a < 604800 THEN (a // 86400) || 'd ago' ELSE strftime(to_timestamp(started) AT TIME ZONE 'UTC', '%b %d') END AS age FROM (SELECT *, 1736121600 - started AS a FROM s)")
def _(spark, d):
    return catalog.list_labels(sessions(spark, d), F.timestamp_seconds(F.lit(1736121600)))


@query("cat_filter_provider", "SELECT provider, session_id FROM s WHERE provider IN ('codex_cli', 'opencode')")
def _(spark, d):
    return catalog.filter_provider(sessions(spark, d), ["codex_cli", "opencode"]).select("provider", "session_id")


@query("cat_filter_project", "SELECT provider, session_id FROM s WHERE project_name LIKE '%ect-3%' OR project_path LIKE '%ect-3%'")
def _(spark, d):
    return catalog.filter_project(sessions(spark, d), "ECT-3").select("provider", "session_id")


@query("cat_filter_dates", "SELECT provider, session_id FROM s WHERE (to_timestamp(started) AT TIME ZONE 'UTC')::DATE BETWEEN DATE '2025-01-02' AND DATE '2025-01-03'")
def _(spark, d):
    return catalog.filter_dates(sessions(spark, d), "2025-01-02", "2025-01-03").select("provider", "session_id")


@query("cat_filter_all", "SELECT provider, session_id FROM s WHERE provider <> 'codex_cli' AND (project_name LIKE '%-2%' OR project_path LIKE '%-2%') AND (to_timestamp(started) AT TIME ZONE 'UTC')::DATE >= DATE '2025-01-02'")
def _(spark, d):
    return catalog.filter_all(sessions(spark, d), ["claude_code", "copilot_cli", "gemini_cli", "opencode"], "-2", "2025-01-02").select("provider", "session_id")


@query("cat_enabled_providers", "SELECT provider, session_id FROM s WHERE provider IN ('claude_code', 'gemini_cli')")
def _(spark, d):
    return catalog.enabled_providers(sessions(spark, d), ["claude-code", "gemini-cli", "other"]).select("provider", "session_id")


@query("cat_lookup", "SELECT key, provider, session_id FROM (SELECT k.key, l.provider, l.session_id, row_number() OVER (PARTITION BY k.key ORDER BY rank, started DESC, session_id) AS n FROM l JOIN (VALUES ('session-1'), ('ses'), ('rollout-session-3'), ('none')) AS k(key) ON starts_with(l.session_id, k.key)) WHERE n = 1")
def _(spark, d):
    keys = spark.createDataFrame([("session-1",), ("ses",), ("rollout-session-3",), ("none",)], "key string")
    return catalog.lookup(sessions(spark, d), keys).select("key", "provider", "session_id")


@query("cat_messages_capped", "SELECT provider, session_id, seq, total FROM (SELECT provider, sid AS session_id, seq::BIGINT AS seq, count(*) OVER (PARTITION BY conv_id)::BIGINT AS total FROM m) WHERE seq < 3")
def _(spark, d):
    return catalog.capped(messages(spark, d), 3).select("provider", "session_id", "seq", "total")


@query("cat_transcript", "SELECT provider, sid AS session_id, seq::BIGINT AS seq, pos::INT AS pos, CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS speaker, type AS kind, CASE WHEN type IN ('tool_use', 'tool_result') THEN '' ELSE btext END AS body FROM b")
def _(spark, d):
    return catalog.transcript(messages(spark, d)).select("provider", "session_id", "seq", "pos", "speaker", "kind", "body")


@query("cat_token_label", "SELECT provider, session_id, CASE WHEN input_tokens + output_tokens > 0 THEN ((input_tokens + output_tokens) // 1000) || 'k tokens' END AS tokens FROM s")
def _(spark, d):
    return catalog.token_label(sessions(spark, d))


@query("cat_resume_command", "SELECT provider, session_id, CASE provider WHEN 'claude_code' THEN 'claude --resume ' WHEN 'copilot_cli' THEN 'copilot --resume=' WHEN 'gemini_cli' THEN 'gemini --resume ' WHEN 'codex_cli' THEN 'codex resume ' ELSE 'opencode --session ' END || CASE provider WHEN 'codex_cli' THEN replace(session_id, 'rollout-', '') ELSE session_id END AS command FROM s")
def _(spark, d):
    return sessions(spark, d).select("provider", "session_id", catalog.resume_command(F.col("provider"), F.col("session_id")).alias("command"))


# ---- search
QUERY_ROWS = [("a", "select that"), ("b", "project thon"), ("c", "   "), ("d", "nosuchword")]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "docs", lambda: search.documents(messages(spark, d), sessions(spark, d)))


_INDEXES: dict[tuple[str, ...], index.Index] = {}


def built(spark: SparkSession, d: str) -> index.Index:
    """The index: written once, as queries read few of its terms."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    if key not in _INDEXES:
        _INDEXES[key] = index.refresh(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", docs(spark, d))
    return _INDEXES[key]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_ROWS, "query string, text string")


def hits(spark: SparkSession, d: str) -> DataFrame:
    return index.topk(built(spark, d), asked(spark), 200, digits=9)


@query("fts_extract_text", "SELECT provider, sid AS session_id, seq::BIGINT AS seq, content AS text FROM mb")
def _(spark, d):
    return messages(spark, d).select("provider", "session_id", "seq", search.block_text(F.col("content")).alias("text")).filter("text <> ''")


@query("fts_docs", "SELECT provider, session_id, seq::BIGINT AS seq, message_id, provider_label, project, role_label, content, ts AS timestamp FROM d", True)
def _(spark, d):
    return docs(spark, d)


@query("fts_postings", "SELECT field, term, provider, session_id, seq::BIGINT AS seq, tf, dl::BIGINT AS dl FROM p", True)
def _(spark, d):
    """The stored index, taken apart again."""
    return built(spark, d).postings().select("field", "term", "provider", "session_id", "seq", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@query("fts_term_stats", "SELECT field, term, df FROM df", True)
def _(spark, d):
    return built(spark, d).term_stats()


@query("fts_search", "SELECT query, provider, session_id, seq::BIGINT AS seq, round(round(score, 9), 6) AS score FROM r", True)
def _(spark, d):
    """Every hit, so that the whole ranking is compared; ``fts_topk`` has the limit."""
    return index.scored(built(spark, d), asked(spark), digits=9).select("query", "provider", "session_id", "seq", F.round("score", 6).alias("score"))


@query("fts_topk", "SELECT query, provider, session_id, seq::BIGINT AS seq, rank::INT AS rank FROM r WHERE rank <= 200", True)
def _(spark, d):
    return hits(spark, d).select("query", "provider", "session_id", "seq", "rank")


#: Query texts, and what they mean in SQL (conditions on documents; words and phrases below).
CLAUSE_ROWS = [
    ("required", "+content:the -content:was +content:\"of the\" in"),
    ("signs", "\"Of, the.\" -WAS."),
    ("fields", "+role:Assistant +project:3 thon"),
    ("operators", "to AND the NOT was OR in"),
    ("whole", "provider:\"Gemini CLI\" +project:project-2"),
    ("excluded", "-the"),
    ("blank", "  "),
    ("cut", "the-of nosuchword"),
]


def _word(text: str, field: str = "content") -> str:
    """SQL: the words of ``text`` stand in a row in a field."""
    return rf"regexp_matches(lower({field}), '(^|[^\p{{L}}\p{{N}}]){text.replace(' ', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}([^\p{{L}}\p{{N}}]|$)')"


def _any(text: str) -> str:
    return f"({_word(text)} OR {_word(text, 'project')})"


_CLAUSES = {
    "required": f"{_word('the')} AND NOT {_word('was')} AND {_word('of the')}",
    "signs": f"{_any('of the')} AND NOT {_any('was')}",
    "fields": f"role_label = 'Assistant' AND {_word('3', 'project')}",
    "operators": f"{_any('to')} AND {_any('the')} AND NOT {_any('was')}",
    "whole": _word("project 2", "project"),
    "cut": _any("the of"),
}


@query("fts_search_clauses", " UNION ALL ".join(f"SELECT '{q}' AS query, provider, session_id, seq::BIGINT AS seq FROM d WHERE {where}" for q, where in _CLAUSES.items()), True)
def _(spark, d):
    """Query texts with required and excluded words, phrases, fields and operators, several at once."""
    asked = spark.createDataFrame(CLAUSE_ROWS, "query string, text string")
    return index.search_texts(built(spark, d), asked).select("query", "provider", "session_id", "seq")


@query("fts_snippet", r"SELECT provider, session_id, seq::BIGINT AS seq, CASE WHEN st > 0 THEN '...' ELSE '' END || trim(regexp_replace(substr(content, st + 1, least(120, length(content) - st)), '\s+', ' ', 'g')) || CASE WHEN st + 120 < length(content) THEN '...' ELSE '' END AS snippet FROM (SELECT *, greatest(instr(lower(content), 'select') - 1 - 60, 0) AS st FROM d)", True)
def _(spark, d):
    return docs(spark, d).select("provider", "session_id", "seq", search.snippet(F.col("content"), F.lit("SELECT")).alias("snippet"))


@query("fts_sessions", "SELECT query, provider, session_id, min(rank)::INT AS rank FROM r WHERE rank <= 200 GROUP BY ALL HAVING true", True)
def _(spark, d):
    return search.hit_sessions(hits(spark, d))


@query("fts_filtered_sessions", "SELECT r.query, r.provider, r.session_id, min(r.rank)::INT AS rank FROM r JOIN s USING (provider, session_id) WHERE r.rank <= 200 AND provider IN ('claude_code', 'opencode') GROUP BY ALL HAVING true", True)
def _(spark, d):
    return search.filtered_sessions(hits(spark, d), sessions(spark, d), ["claude_code", "opencode"]).select("query", "provider", "session_id", "rank")


# ---- incremental refresh: the older state lacks the last turns of every third conversation
_TOUCHED = "SELECT DISTINCT provider, sid AS session_id FROM c0 WHERE conv_id % 3 = 0 AND turn >= 2"


def _log_files(raw: files.Raw) -> DataFrame:
    """(path, document) of raw rows: each file whole, as it stands on a disk."""
    rows = files.union(raw).withColumn("path", F.substring("source_path", 2, 1 << 20))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n").alias("document"))


def _bases(root: str) -> dict[str, list[str]]:
    """Where the rendered logs of each provider stand below a folder."""
    return {p: [f"{root}/{d}"] for p, d in (("claude", "c"), ("copilot", "p"), ("gemini", "g"), ("codex", "x"), ("opencode", "o"))}


class Refreshed(NamedTuple):
    """Folders of logs in their older state, and what a refresh found once they had grown."""

    older: manifest.Change
    change: manifest.Change


_REFRESHED: dict[tuple[str, str, str], Refreshed] = {}


def refreshed(spark: SparkSession, d: str) -> Refreshed:
    """The older logs are written as files and read; then the files that differ are replaced, and the folders compared."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    if key not in _REFRESHED:
        root = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
        before, now = materialized(_log_files(rendered(spark, d, True)), "older-files"), _log_files(rendered(spark, d))
        export.write_documents(before, root)
        older = manifest.change(spark, _bases(root))
        same = before.withColumnRenamed("document", "old")
        export.write_documents(now.join(same, "path", "left").filter("old is null or old <> document").select("path", "document"), root)
        _REFRESHED[key] = Refreshed(older, manifest.change(spark, _bases(root), older.manifest))
    return _REFRESHED[key]


@query("inc_changed", _TOUCHED)
def _(spark, d):
    """Sessions of files that are new or differ in size or time; no other file is opened."""
    return refreshed(spark, d).change.touched


def _fresh(change: manifest.Change) -> DataFrame:
    """Search documents of the sessions that a refresh has read."""
    return search.documents(files.all_messages(change.raw, as_of()), files.all_sessions(change.raw))


class Stored(NamedTuple):
    #: The index of the older logs, the documents of the refresh, and the index after it.
    before: index.Index
    fresh: DataFrame
    after: index.Index


_STORED: dict[tuple[str, ...], Stored] = {}


def stored(spark: SparkSession, d: str) -> Stored:
    """An index of the older logs that is refreshed with what changed in their folders."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    if key not in _STORED:
        path, r = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", refreshed(spark, d)
        before = index.refresh(spark, path, _fresh(r.older), r.older.touched, {"units": r.older.manifest.units})
        fresh = materialized(_fresh(r.change), "fresh")
        _STORED[key] = Stored(before, fresh, index.refresh(spark, path, fresh, r.change.touched, {"units": r.change.manifest.units}))
    return _STORED[key]


@query("inc_upsert", "SELECT provider, session_id, seq::BIGINT AS seq, content FROM d", True)
def _(spark, d):
    """The index of the older logs is refreshed where files have changed; what is stored then is what a full build gives."""
    return stored(spark, d).after.docs().select("provider", "session_id", "seq", "content")


@query("inc_search", "SELECT query, provider, session_id, seq::BIGINT AS seq, round(round(score, 9), 6) AS score FROM r", True)
def _(spark, d):
    """Searching the segments of a refreshed index gives the scores of a full build."""
    return index.scored(stored(spark, d).after, asked(spark), digits=9).select("query", "provider", "session_id", "seq", F.round("score", 6).alias("score"))


@query("inc_clear", "SELECT count(DISTINCT provider || '/' || sid)::BIGINT AS sessions_indexed, (SELECT count(*) FROM d)::BIGINT AS messages_indexed FROM c0", True)
def _(spark, d):
    """After clearing, the next build takes every session."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.refresh(spark, path, docs(spark, d))
    none = index.clear(spark, path).stored("manifest", "provider string, session_id string, fingerprint string")
    raw = rendered(spark, d)
    now = incremental.fingerprints(files.union(raw).drop("kind"), files.session_files(raw))
    touched = incremental.changed(now, none)
    again = index.refresh(spark, path, docs(spark, d), touched, {"manifest": now})
    return incremental.stats(again.docs(), again.stored("manifest", "provider string, session_id string, fingerprint string"))


@query("inc_stats", f"SELECT count(DISTINCT t.provider || '/' || t.session_id)::BIGINT AS sessions_indexed, count(d.seq)::BIGINT AS messages_indexed, 0::BIGINT AS left_over FROM ({_TOUCHED}) t LEFT JOIN d USING (provider, session_id)", True)
def _(spark, d):
    """What a refresh takes, and what is left to take with the manifest it leaves."""
    change = refreshed(spark, d).change
    after = manifest.compared(change.manifest.files, change.manifest.files).agg(F.count(F.lit(1)).alias("left_over"))
    return incremental.stats(stored(spark, d).fresh, change.touched).crossJoin(after)


@query("inc_stream", "SELECT provider, sid AS session_id, seq::BIGINT AS seq, content FROM mb WHERE provider = 'codex_cli'")
def _(spark, d):
    """Log files as a stream in two runs, the lines of every session cut into two files; the index then holds whole sessions."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lines = rendered(spark, d).rollouts
    half = lines.groupBy("source_path").agg((F.max("ord") / 2).alias("half"))
    lines = lines.join(half, "source_path").withColumn("part", F.when(F.col("ord") < F.col("half"), 0).otherwise(1))
    cut = F.concat(F.lit("part-"), F.col("part").cast("string"), F.col("source_path")).alias("path")
    cut = lines.groupBy("part", cut).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n").alias("document"))
    cut = materialized(cut, "cut")
    for part in (0, 1):
        export.write_documents(cut.filter(F.col("part") == part), f"{folder}/logs")
        with keyed_state(spark):
            sessions_stream.stream_logs(spark, "codex", f"{folder}/logs", f"{folder}/index", f"{folder}/state", as_of(), lambda path: F.regexp_replace(path, "/part-[0-9]+/", "/")).awaitTermination()
    return index.Index(spark, f"{folder}/index").docs().select("provider", "session_id", "seq", "content")


# ---- sinks
_NL = "chr(10)"
_DATE = "strftime(to_timestamp(started) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')"
_STATUS = "CASE WHEN turn % 2 = 0 THEN 'Success' ELSE 'Error' END"
#: Tool arguments, indented.
_ARGS = "'{' || chr(10) || '  \"n\": ' || turn || chr(10) || '}'"


def _joined(*parts: str) -> str:
    """SQL of texts one after another; line feeds as chr(10)."""
    return " || ".join(" || chr(10) || ".join(f"'{x}'" for x in p[1:].split("\n")) if p.startswith("=") else p for p in parts)


def _html(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


_MD_HEAD = _joined("=# ", "coalesce(project_name, 'Conversation')", "=\n\n- **Provider**: ", "label", "=\n- **Date**: ", _DATE, "= UTC\n", "CASE WHEN git_branch IS NULL THEN '' ELSE '- **Branch**: ' || git_branch || chr(10) END", "CASE WHEN model IS NULL THEN '' ELSE '- **Model**: ' || model || chr(10) END", "=\n---\n\n")
_MD_BLOCK = (
    f"CASE type WHEN 'text' THEN {_joined('btext', '=' + chr(10) * 2)} WHEN 'code_block' THEN {_joined('=```sql' + chr(10), 'btext', '=' + chr(10) + '```' + chr(10) * 2)} "
    f"WHEN 'thinking' THEN {_joined('=<details>' + chr(10) + '<summary>Thinking</summary>' + chr(10) * 2, 'btext', '=' + chr(10) * 2 + '</details>' + chr(10) * 2)} "
    f"WHEN 'tool_use' THEN {_joined('=<details>' + chr(10) + '<summary>Tool: Lookup</summary>' + chr(10) * 2 + '```json' + chr(10), _ARGS, '=' + chr(10) + '```' + chr(10) * 2 + '</details>' + chr(10) * 2)} "
    f"WHEN 'tool_result' THEN {_joined('=<details>' + chr(10) + '<summary>Tool Result (', _STATUS, '=)</summary>' + chr(10) * 2 + '```' + chr(10), 'btext', '=' + chr(10) + '```' + chr(10) * 2 + '</details>' + chr(10) * 2)} "
    f"ELSE {_joined('=> **Error**: ', 'btext', '=' + chr(10) * 2)} END"
)
_HTML_HEAD = _joined(
    '=<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>', _html("coalesce(project_name, 'Conversation')"), f"=</title>\n<style>{export.STYLE}</style></head><body>\n<h1>", _html("coalesce(project_name, 'Conversation')"), "=</h1>\n<dl><dt>Provider</dt><dd>", "label",
    "=</dd><dt>Date</dt><dd>", _DATE, "= UTC</dd>", "coalesce('<dt>Branch</dt><dd>' || git_branch || '</dd>', '')", "coalesce('<dt>Model</dt><dd>' || model || '</dd>', '')", "=</dl>\n",
)
_HTML_BLOCK = (
    f"CASE type WHEN 'text' THEN {_joined('=<p class=\"text\">', _html('btext'), '=</p>' + chr(10))} WHEN 'code_block' THEN {_joined('=<pre><code class=\"language-sql\">', _html('btext'), '=</code></pre>' + chr(10))} "
    f"WHEN 'thinking' THEN {_joined('=<details><summary>Thinking</summary><pre>', _html('btext'), '=</pre></details>' + chr(10))} WHEN 'tool_use' THEN {_joined('=<details><summary>Tool: Lookup</summary><pre>', _html(_ARGS), '=</pre></details>' + chr(10))} "
    f"WHEN 'tool_result' THEN {_joined('=<details><summary>Tool Result (', _STATUS, '=)</summary><pre>', _html('btext'), '=</pre></details>' + chr(10))} ELSE {_joined('=<p class=\"error\">', _html('btext'), '=</p>' + chr(10))} END"
)


def _document(head: str, start: str, block: str, end: str, tail: str) -> str:
    """SQL of (provider, session_id, document): messages of a session in order, blocks of a message in order."""
    one = f"(SELECT conv_id, turn, string_agg({block}, '' ORDER BY pos) AS inner_text FROM b GROUP BY conv_id, turn)"
    parts = f"(SELECT provider, sid, string_agg({start} || inner_text || {end}, '' ORDER BY seq) AS parts FROM mb JOIN {one} USING (conv_id, turn) GROUP BY provider, sid)"
    return f"SELECT l.provider, session_id, {head} || coalesce(parts, '') || {tail} AS document FROM l LEFT JOIN {parts} x ON x.sid = l.session_id AND x.provider = l.provider"


_MARKDOWN = _document(_MD_HEAD, "'## ' || role_label || chr(10) || chr(10)", _MD_BLOCK, "''", "''")
_PAGE = _document(_HTML_HEAD, _joined('=<section class="message ', "role", '="><h2>', "role_label", "=</h2>\n"), _HTML_BLOCK, _joined("=</section>\n"), _joined("=</body></html>\n"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("provider", "session_id", F.md5(F.col("document").cast("binary")).alias("document"))


@query("out_markdown", f"SELECT provider, session_id, md5(document) AS document FROM ({_MARKDOWN})")
def _(spark, d):
    return _hashed(export.to_markdown(sessions(spark, d), messages(spark, d)))


@query("out_json", f"SELECT s.provider, s.session_id, count(m.seq)::BIGINT AS messages, coalesce(sum(n_blocks), 0)::BIGINT AS blocks, md5(coalesce(string_agg(m.role || ':' || t, '|' ORDER BY m.seq), '')) AS content, s.summary FROM s LEFT JOIN mb m ON m.sid = s.session_id AND m.provider = s.provider LEFT JOIN (SELECT conv_id, turn, string_agg(type || '=' || CASE type WHEN 'tool_use' THEN {_ARGS} ELSE btext END, ',' ORDER BY pos) AS t FROM b GROUP BY conv_id, turn) x ON x.conv_id = m.conv_id AND x.turn = m.turn GROUP BY s.provider, s.session_id, s.summary")
def _(spark, d):
    """The exported JSON is parsed again: every role, block type and text is read back from it."""
    shape = "session struct<id:string,provider:string,summary:string>, messages array<struct<id:string,role:string,content:array<struct<type:string,data:variant>>>>"
    j = export.to_json_document(sessions(spark, d), messages(spark, d)).select("provider", "session_id", F.from_json("document", shape).alias("j"))
    text = lambda x, path: F.try_variant_get(x["data"], path, "string")
    data = lambda x: F.when(x["type"] == "code_block", text(x, "$.code")).when(x["type"] == "tool_use", text(x, "$.arguments")).when(x["type"] == "tool_result", text(x, "$.output")).otherwise(text(x, "$"))
    said = F.transform("j.messages", lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], lambda x: F.concat(x["type"], F.lit("="), data(x))), ",")))
    blocks = F.aggregate("j.messages", F.lit(0).cast("long"), lambda a, m: a + F.size(m["content"]))
    return j.select("provider", "session_id", F.size("j.messages").cast("long").alias("messages"), blocks.alias("blocks"), F.md5(F.array_join(said, "|").cast("binary")).alias("content"), F.col("j.session.summary").alias("summary"))


@query("out_html", f"SELECT provider, session_id, md5(document) AS document FROM ({_PAGE})")
def _(spark, d):
    return _hashed(export.to_html(sessions(spark, d), messages(spark, d)))


@query("out_files", f"SELECT provider, 'conversation-' || CASE WHEN count(*) OVER (PARTITION BY provider, left(session_id, 8)) > 1 THEN session_id ELSE left(session_id, 8) END || '.md' AS file_name, md5(document) AS document FROM ({_MARKDOWN})")
def _(spark, d):
    """Written under their names, and read again."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    export.write_files(export.export(sessions(spark, d), messages(spark, d), "markdown"), path)
    return export.read_files(spark, path).select("provider", "file_name", F.md5(F.col("document").cast("binary")).alias("document"))


@query("out_tables", "SELECT s.provider, s.session_id, project_name, started, message_count, count(m.seq)::BIGINT AS messages, md5(coalesce(string_agg(m.joined, '|' ORDER BY m.seq), '')) AS body FROM s LEFT JOIN mb m ON m.provider = s.provider AND m.sid = s.session_id GROUP BY ALL HAVING true")
def _(spark, d):
    """Sessions and messages published as one version, and both read again."""
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    sessions_, messages_ = export.read_tables(spark, export.write_tables(sessions(spark, d), messages(spark, d), path))
    said = messages_.select("provider", "session_id", "seq", F.array_join(F.transform("content", lambda b: b["text"]), "|").alias("body"))
    own = said.groupBy("provider", "session_id").agg(F.count(F.lit(1)).alias("messages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "|").alias("body"))
    out = sessions_.join(own, ["provider", "session_id"], "left")
    return out.select("provider", "session_id", "project_name", F.unix_timestamp("started_at").alias("started"), "message_count", F.coalesce("messages", F.lit(0)).cast("long").alias("messages"), F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("body"))


# ---- quality
_PATH = "CASE kind WHEN 0 THEN '/c/projects/' || project || '/session-' || conv_id || '.jsonl' WHEN 1 THEN '/p/' || sid || '/events.jsonl' WHEN 2 THEN '/g/tmp/' || project || '/chats/session-' || sid || '.json' WHEN 3 THEN '/x/2025/01/01/' || sid || '.jsonl' ELSE '/o' END"


@query("dq_parse_counters", f"SELECT provider, source_path, count(*)::BIGINT + sum(broken)::BIGINT AS lines, sum(broken)::BIGINT AS parse_errors, count(*) FILTER (WHERE NOT spoken)::BIGINT AS skipped_types, 0::BIGINT AS empty_content, count(*) FILTER (WHERE spoken)::BIGINT AS messages FROM (SELECT provider, {_PATH} AS source_path, CASE WHEN kind IN (0, 1, 3) AND (conv_id + turn) % 17 = 0 THEN 1 ELSE 0 END AS broken, role IN ('user', 'assistant') OR kind = 3 AND NOT newer AS spoken FROM c0) GROUP BY provider, source_path")
def _(spark, d):
    return quality.all_counters(rendered(spark, d))


@query("dq_format_mismatch", "SELECT provider, session_id, message_count FROM s WHERE message_count > 0 AND (provider = 'codex_cli' OR NOT EXISTS (SELECT 1 FROM m WHERE m.provider = s.provider AND m.sid = s.session_id))")
def _(spark, d):
    """One provider's messages are withheld, as if its format had changed."""
    return quality.format_mismatch(sessions(spark, d), messages(spark, d).filter("provider <> 'codex_cli'"))


@query("dq_block_checks", "SELECT rule, CASE rule WHEN 'empty_text' THEN (SELECT count(*) FROM b WHERE type = 'text' AND trim(btext) = '') ELSE 0 END::BIGINT AS broken FROM (VALUES ('empty_text'), ('empty_thinking'), ('empty_code_block'), ('empty_error'), ('tool_without_name'), ('result_without_call')) AS v(rule)")
def _(spark, d):
    return quality.block_checks(messages(spark, d))


@query("dq_provider_sample", "SELECT provider, session_id, message_count, (SELECT count(*) FROM m WHERE m.provider = x.provider AND m.sid = x.session_id)::BIGINT AS loaded, coalesce((SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM m WHERE m.provider = x.provider AND m.sid = x.session_id), '') AS roles FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started DESC, session_id) AS n FROM s) x WHERE n <= 5")
def _(spark, d):
    return quality.provider_sample(sessions(spark, d), messages(spark, d))
