"""Streams of log files with keyed state."""

import json

from pyspark.sql import functions as F

from chatloom.operators import index
from chatloom.streaming import sessions


def put(root, name, *records):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records))


def test_a_batch_reads_the_sessions_it_touches(spark, tmp_path, monkeypatch):
    """Events of a folder arrive in pieces; what a batch reads doesn't grow with what was read before."""
    logs, target = tmp_path / "logs", str(tmp_path / "index")
    seen = []
    raw_of = sessions.raw_of
    monkeypatch.setattr(sessions, "raw_of", lambda whole, shared: seen.append(whole.count()) or raw_of(whole, shared))
    whole = lambda path: F.regexp_replace(path, "/piece[0-9]+/", "/")

    def run():
        seen.clear()
        with sessions.keyed_state(spark):
            q = sessions.stream_logs(spark, "copilot", str(logs), target, str(tmp_path / "state"), F.lit("2026-01-01T00:00:00Z").cast("timestamp"), whole)
            q.awaitTermination()
        return [p for p in q.recentProgress if p["numInputRows"]]

    event = lambda k, text: {"id": f"e{k}", "type": "user.message", "data": {"content": text}}
    for n in range(20):
        put(logs, f"w{n}/workspace.yaml")
        (logs / f"w{n}/workspace.yaml").write_text(f"id: s{n}\ncwd: /a\ncreated_at: 2026-03-02T00:00:00Z\n")
        put(logs, f"piece1/w{n}/events.jsonl", event(0, f"first {n}"), event(1, f"second {n}"))
    run()
    assert sum(seen) == 40 and index.Index(spark, target).docs().count() == 40
    put(logs, "piece2/w7/events.jsonl", event(2, "third 7"), event(3, "fourth 7"))
    put(logs, "piece2/w8/notes.txt")
    progress = run()
    assert seen == [3] and 1 <= sum(p["numInputRows"] for p in progress) <= 2
    got = sorted((r.session_id, r.seq, r.content) for r in index.Index(spark, target).docs().collect())
    assert len(got) == 42 and [x for x in got if x[0] == "s7"] == [("s7", 0, "first 7"), ("s7", 1, "second 7"), ("s7", 2, "third 7"), ("s7", 3, "fourth 7")]
    assert run() == [] and index.Index(spark, target).docs().count() == 42


def test_a_stream_lists_its_files_in_few_tasks(spark, tmp_path, monkeypatch):
    """The settings hold as long as the stream runs; those of the session that started it are put back."""
    name, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before, raw_of = spark.conf.get(name), sessions.raw_of
    monkeypatch.setattr(sessions, "raw_of", lambda whole, shared: seen.append(int(whole.sparkSession.conf.get(name))) or raw_of(whole, shared))
    for n in range(3):
        put(tmp_path, f"logs/2026/03/01/rollout-{n}.jsonl", {"type": "user", "content": f"said {n}", "timestamp": "2026-03-01T00:00:00Z"})
    with sessions.keyed_state(spark):
        q = sessions.stream_logs(spark, "codex", str(tmp_path / "logs"), str(tmp_path / "index"), str(tmp_path / "state"), F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    assert spark.conf.get(name) == before
    q.awaitTermination()
    assert seen == [4 * spark.sparkContext.defaultParallelism]
    assert sorted(r.content for r in index.Index(spark, str(tmp_path / "index")).docs().collect()) == ["said 0", "said 1", "said 2"]
