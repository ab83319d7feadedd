"""Line numbers that don't depend on splits, and refreshes that open changed files only."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chatloom.functions import parsing
from chatloom.sources import codex, files, manifest


def said(k, text, at="2026-03-01T00:00:00Z"):
    return json.dumps({"type": "user" if k % 2 == 0 else "assistant", "uuid": f"u{k}", "timestamp": at, "content": text, "message": {"content": text}})


def put(root, name, text, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at is not None:
        os.utime(path, (at, at))


def test_numbers_of_lines_are_those_of_the_file(spark, tmp_path):
    long = [said(k, f"line {k} " + "x" * (k * 37 % 300)) for k in range(3000)]
    put(tmp_path, "x/2026/03/01/rollout-long one%20[a].jsonl", "\n".join(long) + "\n")
    put(tmp_path, "x/2026/03/01/rollout-b.jsonl", "\n".join(long[:7]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size, more in (("128m", False), ("20k", False), ("7k", True), ("1k", True)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            if more:
                put(tmp_path, f"x/2026/02/01/rollout-{size}.jsonl", "\n".join(long[:900]))
            rows = files.from_paths(spark, codex=[str(tmp_path / "x")]).rollouts
            assert size == "128m" or rows.select("source_path").count() >= 3000
            got = {(r.source_path.rpartition("/")[2], r.ord): r.value for r in rows.collect()}
            mine = {k: v for k, v in got.items() if "long one" in k[0] or k[0] == "rollout-b.jsonl"}
            assert sorted(n for name, n in mine if name != "rollout-b.jsonl") == list(range(3000))
            assert all(v == long[n] for (name, n), v in mine.items())
            seen.append(mine)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(x == seen[0] for x in seen)


def test_a_session_of_many_parts_is_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PART_LINES", 64)
    lines = [("/x/2026/01/01/rollout-a.jsonl", k * 3, said(k, "" if k % 5 == 0 else f"m{k}")) for k in range(1000)] + [("/x/2026/01/01/rollout-b.jsonl", 0, said(0, "one"))]
    rows = spark.createDataFrame(lines[::-1], files.RAW).repartition(5)
    got = [(r.seq, r.content[0].text) for r in codex.messages(rows, F.current_timestamp()).filter("session_id = 'rollout-a'").orderBy("seq").collect()]
    assert got == list(enumerate(f"m{k}" for k in range(1000) if k % 5))


@pytest.fixture
def logs(tmp_path):
    """Logs of five tools; all files are of one time."""
    def write(name, text, at=1_000_000):
        put(tmp_path, name, text, at)

    for k in range(5):
        write(f"c/projects/p/s{k}.jsonl", said(0, f"hello {k}") + "\n")
        write(f"x/2026/03/01/rollout-{k}.jsonl", said(0, f"ask {k}") + "\n")
    write("c/history.jsonl", json.dumps({"display": "h", "timestamp": 5, "sessionId": "s1"}))
    for k in range(2):
        write(f"p/w{k}/workspace.yaml", f"id: w-{k}\ncwd: /a\ncreated_at: 2026-03-02T00:00:00Z\n")
        write(f"p/w{k}/events.jsonl", json.dumps({"id": "e", "type": "user.message", "data": {"content": "x"}}))
        write(f"g/tmp/slug/chats/session-{k}.json", json.dumps({"sessionId": f"g{k}", "startTime": "2026-03-04T00:00:00Z", "lastUpdated": "2026-03-04T01:00:00Z", "messages": [{"id": "1", "type": "user", "content": "q"}]}))
        write(f"o/session/pr/o{k}.json", json.dumps({"id": f"o{k}", "directory": "/d", "time": {"created": 1}}))
        write(f"o/message/o{k}/m{k}.json", json.dumps({"id": f"m{k}", "role": "user", "time": {"created": 2}}))
        write(f"o/part/m{k}/prt-1.json", json.dumps({"type": "text", "text": f"part {k}"}))
    return write


def names(rows):
    return sorted(r.source_path.split("/", 4)[-1] if False else "/".join(r.source_path.split("/")[-3:]) for r in rows.collect())


def keys(rows):
    return sorted((r.provider, r.session_id) for r in rows.collect())


def test_one_new_file_is_one_session_and_one_file_opened(spark, tmp_path, logs):
    bases = {p: [str(tmp_path / d), str(tmp_path / "missing")] for p, d in (("claude", "c"), ("copilot", "p"), ("gemini", "g"), ("codex", "x"), ("opencode", "o"))}
    first = manifest.change(spark, bases)
    assert len(keys(first.touched)) == 16 and first.manifest.files.count() == first.opened.count() == 23
    same = manifest.change(spark, bases, first.manifest)
    assert keys(same.touched) == [] and names(same.opened) == [f"{tmp_path.name}/c/history.jsonl"]

    # files that haven't changed hold something else now, under their old size and time: nothing reads it
    for k in range(5):
        at = f"x/2026/03/01/rollout-{k}.jsonl"
        logs(at, "#" * os.path.getsize(tmp_path / at))
    logs("x/2026/03/01/rollout-new [1] %41.jsonl", said(0, "fresh") + "\n" + said(1, "reply"), 2_000_000)
    one = manifest.change(spark, bases, same.manifest)
    assert keys(one.touched) == [("codex_cli", "rollout-new [1] %41")]
    assert [n for n in names(one.opened) if "rollout" in n] == ["03/01/rollout-new [1] %41.jsonl"] and one.opened.count() == 2
    m = files.all_messages(one.raw, F.current_timestamp())
    assert [(r.session_id, r.seq, r.content[0].text) for r in m.orderBy("seq").collect()] == [("rollout-new [1] %41", 0, "fresh"), ("rollout-new [1] %41", 1, "reply")]

    # a changed part or event rebuilds its session from all its files; one that is gone is touched
    logs("o/part/m1/prt-2.json", json.dumps({"type": "text", "text": "more"}), 2_000_000)
    logs("p/w0/events.jsonl", json.dumps({"id": "e", "type": "user.message", "data": {"content": "changed"}}), 2_000_000)
    logs("c/projects/p/s4.jsonl", said(0, "hello 4") + "\n" + said(1, "appended") + "\n", 1_000_000)
    os.remove(tmp_path / "c/projects/p/s0.jsonl")
    last = manifest.change(spark, bases, one.manifest, named=1)
    assert keys(last.touched) == [("claude_code", "s0"), ("claude_code", "s4"), ("copilot_cli", "w-0"), ("opencode", "o1")]
    got = sorted((r.session_id, r.seq, r.content[0].text) for r in files.all_messages(last.raw, F.current_timestamp()).collect())
    assert got == [("o1", 0, "part 1"), ("s4", 0, "hello 4"), ("s4", 1, "appended"), ("w-0", 0, "changed")]
    assert keys(manifest.change(spark, bases, last.manifest).touched) == []
    assert ("claude_code", "s0") not in keys(last.manifest.units) and len(keys(last.manifest.units)) == 16


def test_folders_that_are_empty_or_missing(spark, tmp_path):
    (tmp_path / "c").mkdir()
    nothing = manifest.change(spark, {"claude": [str(tmp_path / "c")], "codex": [str(tmp_path / "none")]})
    assert nothing.touched.count() == nothing.manifest.files.count() == files.all_messages(nothing.raw, F.current_timestamp()).count() == 0


def test_tasks_of_a_refresh_dont_grow_with_folders_and_files(spark, tmp_path):
    """Neither is a folder a task of a listing, nor every few files one of a scan; settings are put back."""
    for k in range(120):
        put(tmp_path, f"o/session/pr/o{k}.json", json.dumps({"id": f"o{k}", "directory": "/d", "time": {"created": 1}}))
        put(tmp_path, f"o/message/o{k}/m{k}.json", json.dumps({"id": f"m{k}", "role": "user", "time": {"created": 2}, "content": "x"}))
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    spark.sparkContext.setJobGroup("many-files", "a refresh")
    try:
        first = manifest.change(spark, {"opencode": [str(tmp_path / "o")]})
        for k in range(100):
            put(tmp_path, f"o/message/o{k}/m{k}.json", json.dumps({"id": f"m{k}", "role": "user", "time": {"created": 2}, "content": "longer"}))
        second = manifest.change(spark, {"opencode": [str(tmp_path / "o")]}, first.manifest)
        jobs = spark.sparkContext.statusTracker()
        tasks = [jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("many-files") for s in jobs.getJobInfo(j).stageIds if jobs.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert spark.conf.get("spark.sql.files.openCostInBytes") == held["spark.sql.files.openCostInBytes"]
        spark.conf.set("spark.sql.files.maxPartitionBytes", held["spark.sql.files.maxPartitionBytes"])
    assert len(keys(first.touched)) == 120 and len(keys(second.touched)) == 100 and second.raw.oc_messages.count() == 100
    assert len(tasks) > 10 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert {c: spark.conf.get(c) for c in held} == held


def test_whole_files_are_read_by_the_scan_that_listed_them(spark, tmp_path, logs, monkeypatch):
    """Folders of files that are read whole are listed once, and none is read as whole text, which prepares a job for each file."""
    bases = {p: [str(tmp_path / d)] for p, d in (("claude", "c"), ("copilot", "p"), ("gemini", "g"), ("codex", "x"), ("opencode", "o"))}
    logs("o/notes.txt", "no log")
    logs("o/message/o1/m-\u00e9 [1]%20.json", json.dumps({"id": "m-\u00e9 [1]%20", "role": "user", "time": {"created": 3}}))
    logs("o/part/m-\u00e9 [1]%20/prt-1.json", json.dumps({"type": "text", "text": "line\r\n\u00e9"}))
    loads, texts = [], []
    reader = type(spark.read)
    load, text = reader.load, reader.text
    monkeypatch.setattr(reader, "load", lambda self, path=None, **kw: (loads.append(path), load(self, path, **kw))[1])
    monkeypatch.setattr(reader, "text", lambda self, paths, wholetext=False, **kw: (texts.append(wholetext), text(self, paths, wholetext=wholetext, **kw))[1])
    first = manifest.change(spark, bases)
    assert [sum(p == [str(tmp_path / d)] for p in loads) for d in ("g", "o")] == [1, 1] and True not in texts
    got = {r.source_path: (r.ord, r.value) for r in files.union(first.raw).collect() if "/o/" in r.source_path or "/g/" in r.source_path}
    want = [os.path.join(at, name) for top in ("g", "o") for at, _, names in os.walk(tmp_path / top) for name in names if name.endswith(".json")]
    assert got == {p: (0, open(p, newline="").read()) for p in want}
    logs("o/part/m-\u00e9 [1]%20/prt-1.json", json.dumps({"type": "text", "text": "longer line"}), 2_000_000)
    again = manifest.change(spark, bases, first.manifest)
    assert keys(again.touched) == [("opencode", "o1")] and True not in texts
    assert [r.content[0].text for r in files.all_messages(again.raw, F.current_timestamp()).orderBy("seq").collect()] == ["part 1", "longer line"]


def test_tasks_list_and_read_logs_and_the_driver_names_none(spark, tmp_path, logs, monkeypatch):
    """The same listing and rows as by Spark's scans, whose files the driver holds, and these aren't used."""
    bases = {p: [str(tmp_path / d)] for p, d in (("claude", "c"), ("copilot", "p"), ("gemini", "g"), ("codex", "x"), ("opencode", "o"))}
    logs("c/projects/p/empty.jsonl", "")
    logs("c/projects/p/a b%20[c]+é.jsonl", f"{said(0, 'x')}\r\n\n{said(1, 'y')}")
    for hidden in ("c/projects/.q/s.jsonl", "c/projects/_q/s.jsonl", "c/projects/p/_s.jsonl", "c/projects/p/.s.jsonl", "c/projects/p/s.jsonl._COPYING_"):
        logs(hidden, said(0, "hidden"))
    logs("c/projects/_k=1/s.jsonl", said(0, "a column"))
    os.symlink(tmp_path / "nowhere", tmp_path / "c/projects/p/link.jsonl")
    listed = lambda c: sorted(map(tuple, c.manifest.files.select("kind", "source_path", "unit", "size", "modified").collect()), key=str)
    rows = lambda c: sorted(map(tuple, files.union(c.raw).collect()))
    with monkeypatch.context() as m:
        m.setattr(files, "mounted", lambda *_: False)
        by_scans = manifest.change(spark, bases, named=4)

    def never(*_, **__):
        raise AssertionError("a scan whose files the driver lists")

    monkeypatch.setattr(files, "below", never)
    monkeypatch.setattr(files, "scan_paths", never)
    by_tasks = manifest.change(spark, bases)
    assert listed(by_tasks) == listed(by_scans) and len(listed(by_tasks)) == 25
    assert rows(by_tasks) == rows(by_scans) and keys(by_tasks.touched) == keys(by_scans.touched)
    logs("x/2026/03/01/rollout-3.jsonl", said(0, "longer than before"), 2_000_000)
    assert keys(manifest.change(spark, bases, by_scans.manifest).touched) == [("codex_cli", "rollout-3")]


def test_lines_in_pieces_are_those_of_a_scan_of_text(spark, tmp_path):
    bodies = {"a": b"\xef\xbb\xbfone\r\ntwo\rthree\n\n\r\r\n  four \xff\xfe\n" + "é日".encode() * 30 + b"\nlast", "b": b"\n", "c": b"x", "d": b"\r\n\r\nab\r", "e": b"y" * 100 + b"\n" + b"z" * 70_000 + b"\nq\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    want = {name: [bytes(r.value) for r in spark.read.text(str(tmp_path / name)).select(F.col("value").cast("binary").alias("value")).collect()] for name in bodies}
    rows = spark.createDataFrame([("claude", str(tmp_path / n), len(b)) for n, b in bodies.items()], "kind string, source_path string, size long")
    for piece in (1, 2, 3, 7, 50, 1 << 20):
        few = rows if piece > 3 else rows.filter("size < 1000")
        got = files.contents(few, False, piece).withColumn("at", F.monotonically_increasing_id()).withColumn("value", F.col("value").cast("binary")).collect()
        for name in bodies if piece > 3 else "abcd":
            own = sorted((r.start, r["at"], bytes(r.value)) for r in got if r.source_path == str(tmp_path / name))
            assert [v for *_, v in own] == want[name], (piece, name)
