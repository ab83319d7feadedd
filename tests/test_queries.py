"""Registered queries against DuckDB on the small tables, and table-level behaviour."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.operators import catalog, export, search
from chatloom.plans.registry import ORACLE_SQL, QUERIES
from chatloom.streaming import incremental

DATA = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "events")


def rows(frame):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)
    return Counter(tuple(plain(v) for v in r) for r in frame)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(got)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_unknown_export_format(spark):
    with pytest.raises(ValueError):
        export.export(spark.range(1), spark.range(1), "pdf")


def test_snippet(spark):
    text = "a" * 100 + " Needle\n\n here " + "b" * 200
    got = spark.createDataFrame([(text,)], "t string").select(search.snippet(F.col("t"), F.lit("NEEDLE")), search.snippet(F.col("t"), F.lit("none"))).first()
    assert got[0].startswith("...") and "Needle here" in got[0] and got[0].endswith("...")
    assert not got[1].startswith("...") and got[1].endswith("...")


def test_blank_query_finds_nothing(spark):
    docs = spark.createDataFrame([("p", "s", 0, "some text", "proj")], "provider string, session_id string, seq bigint, content string, project string")
    asked = spark.createDataFrame([("a", " "), ("b", "text"), ("c", "zzz")], "query string, text string")
    got = search.search(docs, asked).collect()
    assert [r["query"] for r in got] == ["b"] and got[0]["score"] > 0


def test_stored_refresh_touches_only_changed_sessions(spark, tmp_path):
    shape = "provider string, session_id string, seq bigint, content string"
    first = spark.createDataFrame([("p", f"s{k}", 0, "old") for k in range(6)], shape)
    keys = first.select("provider", "session_id")
    path = str(tmp_path / "docs")
    incremental.refresh_stored(spark, first, keys, path, 4)
    fresh = spark.createDataFrame([("p", "s1", 0, "new"), ("p", "s1", 1, "more"), ("p", "s9", 0, "born")], shape)
    incremental.refresh_stored(spark, fresh, fresh.select("provider", "session_id").distinct(), path, 4)
    got = {(r.session_id, r.seq, r.content) for r in incremental.stored(spark, path).collect()}
    assert got == {(f"s{k}", 0, "old") for k in (0, 2, 3, 4, 5)} | {("s1", 0, "new"), ("s1", 1, "more"), ("s9", 0, "born")}


def test_stored_refresh_of_sessions_that_shrink(spark, tmp_path):
    """Documents that nothing replaces go, also where their bucket becomes empty."""
    shape = "provider string, session_id string, seq bigint, content string"
    first = spark.createDataFrame([("p", f"s{k}", n, "old") for k in range(4) for n in range(3)], shape)
    for buckets in (1, 64):
        path = str(tmp_path / f"docs{buckets}")
        incremental.refresh_stored(spark, first, first.select("provider", "session_id"), path, buckets)
        fresh = spark.createDataFrame([("p", "s2", 0, "new")], shape)
        incremental.refresh_stored(spark, fresh, spark.createDataFrame([("p", "s1"), ("p", "s2"), ("p", "none")], "provider string, session_id string"), path, buckets)
        got = {(r.session_id, r.seq, r.content) for r in incremental.stored(spark, path).collect()}
        assert got == {(f"s{k}", n, "old") for k in (0, 3) for n in range(3)} | {("s2", 0, "new")}


def test_export_keeps_every_message(spark, tmp_path):
    block = "struct<type:string,text:string,language:string,tool_call_id:string,tool_name:string,success:boolean>"
    sessions = spark.createDataFrame([("codex_cli", f"a1b2c3d4-{k}", f"<p{k}>", "topic & x" if k else None) for k in range(2)], "provider string, session_id string, project_name string, git_branch string")
    sessions = sessions.select("*", F.lit("2026-01-01T00:00:00Z").cast("timestamp").alias("started_at"), F.lit("m").alias("model"), *[F.lit(None).cast(t).alias(n) for n, t in (("project_path", "string"), ("ended_at", "timestamp"), ("summary", "string"), ("token_usage", "struct<input_tokens:bigint>"), ("message_count", "bigint"), ("source_path", "string"))])
    many = spark.range(6000).selectExpr("'codex_cli' as provider", "'a1b2c3d4-0' as session_id", "id as seq", "'user' as role", f"cast(array(named_struct('type', if(id = 3, 'tool_use', 'text'), 'text', if(id = 3, '{{\"b\":[1],\"a\":\"<x>\"}}', concat('m', id)), 'language', null, 'tool_call_id', 'c', 'tool_name', 'T', 'success', null)) as array<{block}>) as content")
    many = many.withColumn("message_id", F.lit("")).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("model", F.lit("m")).withColumn("token_usage", F.lit(None).cast("struct<input_tokens:bigint>"))
    made = {r.session_id: r.document for r in export.to_markdown(sessions, many).collect()}
    assert made["a1b2c3d4-0"].count("## You") == 6000 and "m5999" in made["a1b2c3d4-0"] and '```json\n{\n  "b": [\n    1\n  ],\n  "a": "<x>"\n}\n```' in made["a1b2c3d4-0"]
    few = {r.session_id: r.document for r in export.to_markdown(sessions, many, most=10).collect()}
    assert few["a1b2c3d4-0"].count("## You") == 10 and few["a1b2c3d4-0"].endswith("*Showing 10 of 6000 messages*\n") and "Showing" not in few["a1b2c3d4-1"]
    page = {r.session_id: r.document for r in export.to_html(sessions, many).collect()}
    assert "<dt>Branch</dt><dd>topic &amp; x</dd><dt>Model</dt><dd>m</dd>" in page["a1b2c3d4-1"] and "<title>&lt;p0&gt;</title>" in page["a1b2c3d4-0"] and "Branch" not in page["a1b2c3d4-0"]
    export.write_files(export.export(sessions, many, "markdown"), str(tmp_path / "out"))
    got = {r.file_name: r.document for r in export.read_files(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 2 and set(got.values()) == set(made.values()) and all(n.startswith("conversation-a1b2c3d4-") and n.endswith(".md") for n in got)


def test_sessions_of_several_files_arrive_in_several_batches(spark, tmp_path):
    logs, target = tmp_path / "logs", str(tmp_path / "docs")
    sessions = lambda lines: lines.select("source_path", F.lit("p").alias("provider"), F.regexp_extract("source_path", r"/([^/]+)/[^/]+$", 1).alias("session_id")).distinct()
    build = lambda lines: lines.join(sessions(lines), "source_path").select("provider", "session_id", F.concat_ws(":", F.regexp_extract("source_path", r"([^/]+)$", 1), "ord", "value").alias("content"))

    def put(name, *lines):
        (logs / name).parent.mkdir(parents=True, exist_ok=True)
        (logs / name).write_text("".join(x + "\n" for x in lines))

    def stored():
        return sorted((r.session_id, r.content) for r in incremental.stored(spark, target).collect())

    def stream():
        incremental.stream_lines(spark, str(logs), build, target, str(tmp_path / "state"), sessions).awaitTermination()

    put("s1/a", "one", "two")
    put("s2/a", "three")
    stream()
    put("s1/b", "four")
    stream()
    first = [("s1", "a:1:one"), ("s1", "a:2:two"), ("s1", "b:1:four"), ("s2", "a:1:three")]
    assert stored() == first
    uri = next(r.source_path for r in spark.read.parquet(f"{target}-lines").select("source_path").distinct().collect() if r.source_path.endswith("s2/a"))
    put("s2/a", "three", "five")
    incremental.refresh_lines(spark, spark.createDataFrame([(uri, 1, "three"), (uri, 2, "five")], "source_path string, ord bigint, value string"), build, target, sessions)
    assert stored() == sorted([*first, ("s2", "a:2:five")])
    put("s2/b", "six")
    stream()
    assert stored() == sorted([*first, ("s2", "a:2:five"), ("s2", "b:1:six")])


def test_files_under_their_names(spark, tmp_path):
    """Ids that share a short name, a digest's start, signs, or a length that no file name has."""
    ids = ["rollout-2026-01-01T00-00-00-000000034183", "rollout-2026-01-01T00-00-00-000000061404", "rollout-", "alone-1234", "a/b", "a b", "a%20b", "a.b", "a+b", "ä日", "x" * 400 + "1", "x" * 400 + "2", "abc", "abcdefgh", "abcdefghi"]
    rows = spark.createDataFrame([("codex_cli", i) for i in ids], "provider string, session_id string")
    named = export.file_names(rows, "markdown")
    names = {r.session_id: r.file_name for r in named.collect()}
    assert len(set(names.values())) == len(ids) and names["alone-1234"] == "conversation-alone-12.md" and names["abc"] == "conversation-abc.md"
    assert all(len(n.encode()) <= 255 and "/" not in n for n in names.values())
    out = named.select("provider", "file_name", F.concat(F.lit("of "), "session_id").alias("document"))
    for form in ("", "file:", "file://"):  # written again, nothing is left over
        export.write_files(out, f"{form}{tmp_path / 'out'}")
        assert sorted(x.name for x in (tmp_path / "out" / "codex_cli").iterdir()) == sorted(names.values())
    assert all((tmp_path / "out" / "codex_cli" / n).read_text() == f"of {i}" for i, n in names.items())
    assert {(r.file_name, r.document) for r in export.read_files(spark, str(tmp_path / "out")).collect()} == {(n, f"of {i}") for i, n in names.items()}


def test_lookup_by_prefix(spark):
    ids = [("claude_code", "abc", 1), ("codex_cli", "abcd", 9), ("codex_cli", "abce", 9), ("gemini_cli", "x", 5), ("claude_code", "日本語", 2), ("opencode", "abz", None), ("codex_cli", "abz", 1)]
    sessions = spark.createDataFrame(ids, "provider string, session_id string, at long").select("*", F.timestamp_seconds("at").alias("started_at"))
    keys = ["abc", "abcd", "ab", "", "x", "xy", "日", "abz", None, "abc", "b"]
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (r.provider, r.session_id) for r in catalog.lookup(sessions, asked).collect()}
    order = lambda r: (catalog.LOOKUP_ORDER.index(r[0]), r[2] is None, -(r[2] or 0), r[1])
    want = {k: min((r for r in ids if r[1].startswith(k)), key=order, default=None) for k in set(keys) - {None}}
    assert got == {k: v[:2] for k, v in want.items() if v}
    assert catalog.lookup(sessions, asked.filter("false")).count() == catalog.lookup(sessions.filter("false"), asked).count() == 0
    plan = catalog.lookup(sessions, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gemini_projects_come_from_the_table(spark, tmp_path):
    spark.createDataFrame([(3, 0, "user", "x"), (6, 0, "user", "x"), (10, 0, "user", "x")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    from chatloom.plans import registry

    assert [tuple(r) for r in registry.QUERIES["src_gemini_projects"](spark, str(tmp_path)).collect()] == [("project-3", "/work/project-3")]
