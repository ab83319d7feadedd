"""Readers on small raw records: layouts, tolerance, roles, blocks."""

import json

from pyspark.sql import functions as F

from chatloom.functions import parsing
from chatloom.operators import catalog
from chatloom.sources import claude, codex, copilot, files, gemini, opencode

RAW = "source_path string, ord bigint, value string"


def raw(spark, rows):
    return spark.createDataFrame([(p, n, v if isinstance(v, str) else json.dumps(v)) for n, (p, v) in enumerate(rows)], RAW)


def as_of():
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")


def kinds(df):
    return [(r["role"], [(b["type"], b["text"]) for b in r["content"]]) for r in df.orderBy("session_id", "seq").collect()]


def test_fences(spark):
    text, code = (lambda t: ("text", t, None)), (lambda t, language=None: ("code_block", t, language))
    cases = {
        "": [],
        "plain": [text("plain")],
        "a\n```py\nx = 1\n```\nb": [text("a"), code("x = 1", "py"), text("b")],
        "```\n\n```": [code("")],
        "```sql\nopen": [code("open", "sql")],
        "   ": [text("")],
        "\n\na  \n": [text("a")],
        "a\r\n```rs\r\nlet x;\r\n```": [text("a"), code("let x;", "rs")],
        " ```no\nfence": [text(" ```no\nfence")],
        "````js\n1\n````\n```\n2\n```": [code("1", "js"), code("2")],
        "a\n```\n": [text("a")],
        "one\n\n```c\n  int x;\n\n```\n\n\ntwo\n```\n": [text("one"), code("  int x;", "c"), text("two")],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, t string").select("n", parsing.fences(F.col("t")).alias("b")).orderBy("n").collect()
    for r, (said, want) in zip(rows, cases.items()):
        assert [(b["type"], b["text"], b["language"]) for b in r["b"]] == want, said


def test_claude(spark):
    at = "/h/.c/projects/C--work-app/s1.jsonl"
    lines = raw(spark, [
        (at, {"type": "summary", "timestamp": "2026-02-01T00:00:00Z"}),
        (at, {"type": "user", "uuid": "m1", "timestamp": "2026-02-01T01:00:00Z", "gitBranch": "main", "cwd": "/w/app", "message": {"role": "user", "content": "Fix it"}}),
        (at, "not json"),
        (at, ""),
        (at, {"type": "assistant", "uuid": "m2", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 7, "output_tokens": 3, "cache_read_input_tokens": 1}, "content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "see\n```py\n1\n```"}, {"type": "tool_use", "id": "t1", "name": "Run", "input": {"b": 1, "a": [2]}}, {"type": "tool_result", "content": "not here"}]}}),
        (at, {"type": "user", "uuid": "m3", "timestamp": "2026-02-01T02:00:00+02:00", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}]}]}}),
        (at, {"type": "user", "uuid": 5, "message": 7}),
        ("/h/.c/projects/p/empty.jsonl", {"type": "summary"}),
        ("/other/projects/p/nohistory.jsonl", {"type": "user", "timestamp": "2026-02-01T01:00:00Z", "message": {"content": "a"}}),
    ])
    history = raw(spark, [("/h/.c/history.jsonl", {"display": "first", "timestamp": 1, "sessionId": "s1"}), ("/h/.c/history.jsonl", {"display": "second", "timestamp": 2, "sessionId": "s1"})])
    s = claude.sessions(lines, history).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.session_id, s.project_name, s.git_branch, s.summary, s.model, s.message_count, s.project_path) == ("s1", "C:/work-app", "main", "first", "m", 3, "/w/app")
    assert (s.token_usage.input_tokens, s.token_usage.output_tokens, s.token_usage.cache_read_tokens) == (7, 3, None)
    assert str(s.started_at) == "2026-02-01 00:00:00" and str(s.ended_at) == "2026-02-01 00:00:00"  # first and last in file order
    m = claude.messages(lines.filter(F.col("source_path") == at), as_of()).orderBy("seq").collect()
    assert [r.message_id for r in m] == ["m1", "m2", "m3"]
    assert [(b.type, b.text) for b in m[1].content] == [("thinking", "hm"), ("text", "see"), ("code_block", "1"), ("tool_use", '{"a":[2],"b":1}')]
    assert m[1].timestamp.year == 2026 and m[1].timestamp.month == 1
    assert (m[2].content[0].type, m[2].content[0].text, m[2].content[0].success, m[2].content[0].tool_call_id) == ("tool_result", "x\ny", False, "t1")


def test_copilot_wrong_typed_event_is_dropped(spark):
    at = "/p/one/events.jsonl"
    events = raw(spark, [
        (at, {"id": "e1", "type": "user.message", "data": {"content": "hello"}}),
        (at, {"id": "e2", "type": "assistant.message", "data": {"content": "", "toolRequests": [{"toolCallId": "c", "name": "Lister", "arguments": {"x": 1}}]}}),
        (at, {"id": "e3", "type": "tool.execution_start", "data": {"toolName": "Lister", "toolCallId": "c"}}),
        (at, {"id": "e4", "type": "tool.execution_complete", "data": {"toolCallId": "c", "result": "a string"}}),
        (at, {"id": "e5", "type": "tool.execution_complete", "data": {"toolCallId": "c", "result": {"content": "short", "detailedContent": "long"}}}),
        (at, {"id": "e6", "type": "session.info"}),
    ])
    spaces = raw(spark, [("/p/one/workspace.yaml", 'id: s-1\ncwd: "C:\\\\work\\\\shelf"\ncreated_at: 2026-01-05T00:00:00Z\n'), ("/p/two/workspace.yaml", "cwd: /a/b/\ncreated_at: '2026-01-06T00:00:00Z'\n")])
    notes = raw(spark, [("/p/two/checkpoints/index.md", "# head\ntext"), ("/p/one/checkpoints/index.md", "ignored")])
    s = {r.session_id: r for r in copilot.sessions(spaces, events).collect()}
    assert (s["s-1"].project_name, s["s-1"].message_count, s["two"].project_name, s["two"].message_count) == ("shelf", 5, "b", 0)
    got = kinds(copilot.messages(spaces, events, notes, as_of()))
    assert got == [("user", [("text", "hello")]), ("assistant", [("tool_use", '{"x":1}')]), ("tool", [("tool_use", "")]), ("tool", [("tool_result", "long")]), ("system", [("text", "# head\ntext")])]


def test_gemini_is_all_or_nothing(spark):
    good = {"sessionId": "g1", "startTime": "2026-01-01T00:00:00Z", "lastUpdated": "2026-01-01T01:00:00Z", "messages": [
        {"id": "a", "type": "user", "content": [{"text": "sent"}], "displayContent": [{}]}, {"id": "b", "type": "user", "content": [{"text": "x"}, {"text": "y"}]},
        {"id": "c", "type": "gemini", "content": "ok", "model": "g", "tokens": {"input": 5, "output": 2}, "thoughts": [{"description": "t"}, {}], "toolCalls": [{"name": "ls"}]}, {"type": "info", "content": "n"}]}
    chats = raw(spark, [("/g/tmp/slug/chats/session-1.json", good), ("/g/tmp/slug/chats/session-2.json", {"sessionId": "g2"}), ("/g/tmp/slug/chats/session-3.json", "[")])
    s = gemini.sessions(chats, raw(spark, [("/g/projects.json", {"projects": {"/w/p": "slug"}})])).collect()
    assert [(r.session_id, r.project_path, r.summary, r.message_count, r.token_usage.input_tokens, r.model) for r in s] == [("g1", "/w/p", "x", 3, 5, "g")]
    assert kinds(gemini.messages(chats, as_of())) == [("user", [("text", "x\ny")]), ("assistant", [("text", "ok"), ("thinking", "t"), ("tool_use", "")])]


def test_codex_both_layouts(spark):
    at = "/x/2026/04/08/rollout-a.jsonl"
    lines = raw(spark, [
        (at, {"type": "user", "content": "u", "timestamp": "2026-04-08T00:00:00Z"}), (at, {"type": "tool_use", "content": "shell", "tool_calls": [1]}), (at, {"type": "error", "error": "bad"}),
        (at, {"type": "event_msg", "payload": {"type": "agent_message", "message": "m"}}), (at, {"type": "response_item", "payload": {"type": "function_call", "call_id": "c", "arguments": "{}"}}),
        (at, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": ""}}), (at, {"type": "assistant", "content": ""}),
    ])
    assert kinds(codex.messages(lines, as_of())) == [("user", [("text", "u")]), ("tool", [("tool_use", "[1]")]), ("system", [("error", "bad")]), ("assistant", [("text", "m")]), ("tool", [("tool_use", "{}")])]
    assert [(r.session_id, r.message_count, r.summary) for r in codex.sessions(lines).collect()] == [("rollout-a", 3, "u")]


def test_opencode_parts_and_fallbacks(spark):
    sessions = raw(spark, [("/o/session/p/s.json", {"id": "s", "directory": "/w/app", "time": {"created": 1000}, "model": {"modelID": "o"}}), ("/o/session/p/t.json", {"id": "t", "cwd": "/w/db", "createdAt": "2026-01-01T00:00:00Z"})])
    messages = raw(spark, [
        ("/o/message/s/m1.json", {"id": "m1", "role": "assistant", "time": {"created": 3000}}), ("/o/message/s/m0.json", {"id": "m0", "role": "user", "time": {"created": 2000}, "summary": {"title": "ask"}}),
        ("/o/message/t/m2.json", {"id": "m2", "role": "assistant", "content": "did", "codeChanges": [{"path": "a.rs", "diff": "+1"}, {"diff": ""}]}), ("/o/message/t/m3.json", "{"),
    ])
    parts = raw(spark, [
        ("/o/part/m1/prt-2.json", {"type": "tool", "tool": "read", "callID": "c", "state": {"status": "completed", "input": {"f": 1}, "output": "out"}}), ("/o/part/m1/prt-1.json", {"type": "text", "text": "hi"}),
        ("/o/part/m1/prt-3.json", {"text": "no type"}), ("/o/part/m1/prt-0.json", {"type": "step-start"}),
    ])
    assert {(r.session_id, r.project_name, r.message_count, r.model) for r in opencode.sessions(sessions, messages).collect()} == {("s", "app", 2, "o"), ("t", "db", 2, None)}
    got = kinds(opencode.messages(messages, parts, as_of()))
    assert got == [("user", [("text", "ask")]), ("assistant", [("text", "hi"), ("tool_use", '{"f":1}'), ("tool_result", "out")]), ("assistant", [("text", "did"), ("code_block", "+1")])]


def test_reading_folders(spark, tmp_path):
    day = tmp_path / "codex" / "2026" / "04" / "08"
    day.mkdir(parents=True)
    (day / "rollout-z.JSONL").write_text("\n".join(json.dumps({"type": "user", "content": f"n{k}", "timestamp": "2026-04-08T00:00:00Z"}) for k in range(50)))
    (day / "other.jsonl").write_text("{}")
    made = files.from_paths(spark, codex=[str(tmp_path / "codex"), str(tmp_path / "missing")])
    got = codex.messages(made.rollouts, as_of()).orderBy("seq").collect()
    assert [r.content[0].text for r in got] == [f"n{k}" for k in range(50)]
    assert files.all_sessions(made).count() == 1


def test_reading_folders_of_all_layouts(spark, tmp_path):
    """Files as the tools leave them: several lines in one document, several bases, one that is missing."""

    def put(path, content):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content if isinstance(content, str) else json.dumps(content, indent=2))

    put("claude/projects/D--lib/s1.jsonl", "\n".join(json.dumps({"type": t, "uuid": f"u{k}", "timestamp": f"2026-03-01T00:0{k}:00Z", "message": {"content": f"says {k}"}}) for k, t in enumerate(("user", "assistant"))))
    put("claude/history.jsonl", json.dumps({"display": "a talk", "timestamp": 5, "sessionId": "s1"}))
    put("claude/projects/D--lib/notes.txt", "not a log")
    put("copilot/one/workspace.yaml", "id: w1\ncwd: /work/shop\ncreated_at: 2026-03-02T00:00:00Z\nupdated_at: 2026-03-02T01:00:00Z\n")
    put("copilot/one/events.jsonl", "\n".join(json.dumps({"id": f"e{k}", "type": t, "data": {"content": f"event {k}"}}) for k, t in enumerate(("user.message", "assistant.message"))))
    put("copilot/two/workspace.yaml", "cwd: /work/barn\ncreated_at: 2026-03-03T00:00:00Z\n")
    put("copilot/two/checkpoints/index.md", "# head\n\nwhat was done\n")
    put("gemini/tmp/slug/chats/session-a.json", {"sessionId": "g1", "startTime": "2026-03-04T00:00:00Z", "lastUpdated": "2026-03-04T01:00:00Z", "messages": [{"id": "1", "type": "user", "content": "line one\nline two"}, {"id": "2", "type": "gemini", "content": "ok"}]})
    put("gemini/projects.json", {"projects": {"/work/mill": "slug"}})
    put("codex/2026/03/05/rollout-r.jsonl", "\n".join(json.dumps({"type": t, "content": f"turn {k}", "timestamp": "2026-03-05T00:00:00Z"}) for k, t in enumerate(("user", "assistant"))))
    put("more/2026/03/06/rollout-q.jsonl", json.dumps({"type": "user", "content": "alone", "timestamp": "2026-03-06T00:00:00Z"}))
    put("open/session/p/o1.json", {"id": "o1", "directory": "/work/pond", "time": {"created": 1772668800000}, "title": "pond"})
    put("open/message/o1/m1.json", {"id": "m1", "role": "user", "time": {"created": 1772668801000}})
    put("open/part/m1/prt-1.json", {"type": "text", "text": "part one"})
    at = lambda *names: [str(tmp_path / n) for n in names]
    raw = files.from_paths(spark, claude=at("claude", "missing"), copilot=at("copilot"), gemini=at("gemini"), codex=at("codex", "more", "missing"), opencode=at("open"))
    s = {(r.provider, r.session_id): (r.project_path, r.project_name, r.summary, r.message_count) for r in files.all_sessions(raw).collect()}
    assert s == {
        ("claude_code", "s1"): (None, "D:/lib", "a talk", 2), ("copilot_cli", "w1"): ("/work/shop", "shop", None, 2), ("copilot_cli", "two"): ("/work/barn", "barn", None, 0),
        ("gemini_cli", "g1"): ("/work/mill", "slug", "line one\nline two", 2), ("codex_cli", "rollout-r"): (None, None, "turn 0", 2), ("codex_cli", "rollout-q"): (None, None, "alone", 1), ("opencode", "o1"): ("/work/pond", "pond", "pond", 1),
    }
    m = sorted((r.session_id, r.seq, "|".join(b.text for b in r.content)) for r in files.all_messages(raw, as_of()).collect())
    assert m == [("g1", 0, "line one\nline two"), ("g1", 1, "ok"), ("o1", 0, "part one"), ("rollout-q", 0, "alone"), ("rollout-r", 0, "turn 0"), ("rollout-r", 1, "turn 1"), ("s1", 0, "says 0"), ("s1", 1, "says 1"), ("two", 0, "# head\n\nwhat was done"), ("w1", 0, "event 0"), ("w1", 1, "event 1")]
    owned = {(r.provider, r.session_id): r.n for r in files.session_files(raw).groupBy("provider", "session_id").agg(F.count("*").alias("n")).collect()}
    assert owned == {("claude_code", "s1"): 1, ("copilot_cli", "w1"): 2, ("copilot_cli", "two"): 2, ("gemini_cli", "g1"): 1, ("codex_cli", "rollout-r"): 1, ("codex_cli", "rollout-q"): 1, ("opencode", "o1"): 3}


def test_labels_and_lookup(spark):
    ids = spark.createDataFrame([("codex_cli", "rollout-2026-01-01T00-00-00-12345678-1234-1234-1234-123456789012"), ("codex_cli", "rollout-x"), ("opencode", "a'b"), ("copilot_cli", "k_1.2")], "p string, i string")
    got = [r[0] for r in ids.select(catalog.resume_command(F.col("p"), F.col("i"))).collect()]
    assert got == ["codex resume 12345678-1234-1234-1234-123456789012", "codex resume x", "opencode --session 'a'\\''b'", "copilot --resume=k_1.2"]
    times = spark.sql("select timestampadd(SECOND, -s, timestamp'2026-05-10T00:00:00Z') t from values (5), (300), (7300), (200000), (700000) v(s)")
    assert [r[0] for r in times.select(catalog.relative_time(F.col("t"), F.lit("2026-05-10T00:00:00Z").cast("timestamp"))).collect()] == ["just now", "5m ago", "2h ago", "2d ago", "May 01"]
