"""The search index: segments, versions, pruned reads, bounded top-k and query texts, against plain computations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chatloom.operators import index, search

SHAPE = "provider string, session_id string, seq bigint, message_id string, provider_label string, project string, role_label string, content string, timestamp bigint"
LABELS = {"p": "Claude Code", "q": "Codex CLI"}


def frame(spark, rows):
    """Documents of rows (provider, session, seq, project, role, content)."""
    return spark.createDataFrame([(p, s, n, f"m{s}-{n}", LABELS[p], project, role, text, 0) for p, s, n, project, role, text in rows], SHAPE)


def words(text, longest=40):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w and len(w.encode()) < longest]


def drawn(rng, sessions, messages=4, vocabulary=60):
    pick = lambda: f"w{min(int(rng.expovariate(0.08)), vocabulary)}"
    return [("pq"[s % 2], f"s{s:03}", n, f"proj {s % 5}", rng.choice(("You", "Assistant")), " ".join(pick() for _ in range(rng.randint(1, 25)))) for s in sessions for n in range(rng.randint(1, messages))]


def plain_scores(rows, text, longest=40):
    """BM25 of both fields, summed."""
    out = Counter()
    for at in (5, 3):
        docs = {r[:3]: words(r[at], longest) for r in rows}
        avg = sum(map(len, docs.values())) / max(len(docs), 1)
        for w in set(words(text, longest)):
            df = sum(w in d for d in docs.values())
            for k, d in docs.items():
                if w in d:
                    tf = d.count(w)
                    out[k] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return out


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query string, text string")


def scores(hits):
    out = defaultdict(dict)
    for r in hits.collect():
        out[r.query][(r.provider, r.session_id, r.seq)] = r.score
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


QUESTIONS = ("w1 w3 proj", "w17 W40", "2", "none of these", "  ", "w0")


def test_refreshed_segments_score_like_a_full_build(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = drawn(rng, range(40))
    path = str(tmp_path / "index")
    index.refresh(spark, path, frame(spark, rows))
    tokenised = []
    entries = index._entries
    monkeypatch.setattr(index, "_entries", lambda docs, longest: tokenised.append(docs) or entries(docs, longest))
    live = {r[:3]: r for r in rows}
    for step in range(3):
        touched = rng.sample(range(44), 5)
        keys = [("pq"[s % 2], f"s{s:03}") for s in touched]
        fresh = [r for r in drawn(rng, touched) if r[1] != f"s{touched[0]:03}"]  # the first one goes
        old = [k for k in live if k[:2] in keys]
        tokenised.clear()
        made = index.refresh(spark, path, frame(spark, fresh), spark.createDataFrame(keys, "provider string, session_id string"))
        assert sorted(d.count() for d in tokenised) == sorted((len(old), len(fresh)))
        live = {k: r for k, r in live.items() if k not in old} | {r[:3]: r for r in fresh}
    assert len(made.segments) == 4 and made.number == 4
    now = list(live.values())
    whole = index.refresh(spark, str(tmp_path / "whole"), frame(spark, now))
    merged = index.merge(spark, path)
    assert len(merged.segments) == 1 and len(tokenised) == 3
    for one in (index.Index(spark, path, 4), merged, whole):
        got = scores(index.scored(one, ask(spark, *QUESTIONS)))
        for k, text in enumerate(QUESTIONS):
            same(got[f"q{k}"], plain_scores(now, text))
        assert {(r.field, r.term): r.df for r in one.term_stats().collect()} == Counter((f, w) for r in now for f, at in (("content", 5), ("project", 3)) for w in set(words(r[at])))
        assert sorted((r.provider, r.session_id, r.seq, r.content) for r in one.docs().collect()) == sorted((*r[:3], r[5]) for r in now)
        assert Counter((r.field, r.term, r.provider, r.session_id, r.seq, tuple(r.positions)) for r in one.postings().collect()) == Counter(
            (f, w, *r[:3], tuple(k for k, x in enumerate(words(r[at])) if x == w)) for r in now for f, at in (("content", 5), ("project", 3)) for w in set(words(r[at]))
        )
    index.vacuum(spark, path)
    assert index.versions(spark, path) == [5]
    same(scores(index.scored(index.Index(spark, path), ask(spark, "w1 w3 proj")))["q0"], plain_scores(now, "w1 w3 proj"))


def test_many_refreshes_are_merged(spark, tmp_path):
    path, rows = str(tmp_path / "index"), []
    for k in range(4):
        new = [("p", f"s{k}", 0, "x", "You", f"common word{k}")]
        rows += new
        made = index.refresh(spark, path, frame(spark, new), tables={"units": spark.createDataFrame([(k,)], "k int")}, most=2)
        assert len(made.segments) <= 2 and made.stored("units", "k int").first().k == k
        same(scores(index.scored(made, ask(spark, "common word1")))["q0"], plain_scores(rows, "common word1"))


def test_a_stopped_refresh_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), drawn(random.Random(1), range(6))
    index.refresh(spark, path, frame(spark, rows))
    more = frame(spark, [("p", "s000", 0, "x", "You", "replaced")])

    def stop(*_, **__):
        raise RuntimeError("lost")

    dead = spark.createDataFrame([("gone", 1, 0)], "segment string, doc bigint, chunk bigint")
    for part in ("_write_segment", "publish"):
        with monkeypatch.context() as m:
            m.setattr(index, part, stop)
            with pytest.raises(RuntimeError):
                index.refresh(spark, path, more)
    dead.write.parquet(f"{path}/versions/v=2/dead")  # as if the job had ended before the list of segments
    now = index.Index(spark, path)
    assert now.number == 1 and index.versions(spark, path) == [1]
    same(scores(index.scored(now, ask(spark, "w1 w3")))["q0"], plain_scores(rows, "w1 w3"))
    again = index.refresh(spark, path, more)
    assert again.number == 2 and [r.content for r in again.docs().filter("session_id = 's000'").collect()] == ["replaced"]
    index.vacuum(spark, path)
    assert len(list((tmp_path / "index" / "segments").iterdir())) == 2
    assert index.clear(spark, path).docs().count() == 0 and index.search_texts(index.Index(spark, path), ask(spark, "w1")).count() == 0


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKETS", (32, 64))
    made = index.refresh(spark, str(tmp_path / "index"), frame(spark, drawn(random.Random(2), range(30))))
    reader = index.Reader(made, index._plain(ask(spark, "w3 w11"), 40))
    (segment, buckets), = made.segments
    want = {r[0] for r in spark.createDataFrame([("w3",), ("w11",)], "term string").select(index.bucket(F.col("term"), buckets)).collect()}
    assert set(reader.only[buckets]) == want and len(want) <= 2
    assert {re.search(r"bucket=(\d+)", f)[1] for f in reader.rows.inputFiles()} >= {str(b) for b in want}
    plan = reader.rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)
    files = len(list((tmp_path / "index" / "segments" / segment / "postings").glob("bucket=*")))
    assert files > 10


def test_best_hits_without_opening_every_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CHUNK_BITS", 3)
    rng = random.Random(9)
    rows = drawn(rng, range(120), 3)
    rows += [("p", f"t{k:03}", 0, "x", "You", "rare rare rare tie") for k in range(12)] + [("p", f"u{k:03}", 0, "x", "You", "rare " + "filler " * 60) for k in range(80)]
    path = str(tmp_path / "index")
    index.refresh(spark, path, frame(spark, rows))
    gone = [("p", f"t{k:03}") for k in range(3)]
    made = index.refresh(spark, path, frame(spark, []), spark.createDataFrame(gone, "provider string, session_id string"))
    live = [r for r in rows if r[:2] not in gone]
    texts = ("rare", "w1 w5 w20", "tie w2", "nothing", "filler")
    for k in (1, 5, 9, 40, 10_000):
        got = defaultdict(list)
        for r in index.topk(made, ask(spark, *texts), k, digits=9).orderBy("query", "rank").collect():
            got[r.query].append((r.provider, r.session_id, r.seq))
        for n, text in enumerate(texts):
            want = sorted(plain_scores(live, text).items(), key=lambda x: (-round(x[1], 9), x[0]))
            assert got[f"q{n}"] == [key for key, _ in want[:k]]
    reader = index.Reader(made, index._plain(ask(spark, "rare"), 40))
    _, opened = reader.best(5)
    assert 0 < opened.count() < reader.bounds().count() / 3


def plain_match(row, text):
    """What a query text means, one document at a time."""
    fields = {"content": 5, "project": 3, "role": 4, "session_id": 1}
    found = re.findall(r'([+-]?)(?:(content|project|provider|role|session_id|message_id):)?("[^"]*"?|[^\s"]+)', text)
    musts, mays = [], []
    for k, (sign, field, said) in enumerate(found):
        if said in ("AND", "OR", "NOT") and not sign and not field:
            continue
        plain = lambda j: found[j][2] if 0 <= j < len(found) and not found[j][0] and not found[j][1] else ""
        if not sign:
            sign = "-" if plain(k - 1) == "NOT" else "+" if "AND" in (plain(k - 1), plain(k + 1)) else ""
        said = said.strip('"')
        if field in ("provider", "role", "session_id", "message_id"):
            value = {"provider": LABELS[row[0]], "message_id": f"m{row[1]}-{row[2]}"}.get(field) or row[fields[field]]
            hit = value == said
        else:
            own = words(said)
            if not own:
                continue
            texts = [words(row[fields[f]]) for f in ([field] if field else ("content", "project"))]
            hit = any(own == t[i : i + len(own)] for t in texts for i in range(len(t)))
        if sign == "-":
            if hit:
                return False
        else:
            (musts if sign == "+" else mays).append(hit)
    return all(musts) and bool(musts or any(mays))


def test_query_texts(spark, tmp_path):
    rows = [
        ("p", "a1", 0, "Best Shop", "You", "It's the end, of the road. Under_score x-y"), ("p", "a1", 1, "Best Shop", "Assistant", "of the, best of times"), ("q", "b2", 0, "mill", "You", "the the of end"),
        ("q", "b2", 1, "mill", "Assistant", "It is best"), ("q", "c 3", 0, "", "You", "s it the road"), ("p", "d4", 0, "the mill", "You", "was here"),
    ]
    rows += drawn(random.Random(4), range(10, 14))
    made = index.refresh(spark, str(tmp_path / "index"), frame(spark, rows))
    texts = [
        "it's", '"of the, best"', "+it's end", "best -was.", '-"the road" the', "+the +of", "content:best", "project:best", '+provider:"Codex CLI" the', "role:You -the", "-the", '""', '"', "+!!! road", "a:b", "end AND the", "road NOT it", "end OR was",
        'session_id:"c 3"', "message_id:ma1-0 +role:You", '"the the"', '+"the end" +"of the"', "+nosuch the", 'x-y "under score"', "w1 w2 -w3", "", "   ", "NOT", '+project:"the mill"', "http://x.y",
    ]
    got = scores(index.search_texts(made, ask(spark, *texts)))
    for k, text in enumerate(texts):
        want = {r[:3] for r in rows if plain_match(r, text)}
        assert set(got[f"q{k}"]) == want, text
    best = index.search_texts(made, ask(spark, "best"), k=1).collect()
    assert len(best) == 1 and best[0].rank == 1 and best[0].score == max(got_ for got_ in scores(index.search_texts(made, ask(spark, "best")))["q0"].values())


def test_words_of_any_length_if_the_index_is_told_so(spark, tmp_path):
    long = "x" * 300
    rows = [("p", "s", 0, "y", "You", f"a {long} b"), ("p", "t", 0, "y", "You", "a b")]
    short = index.refresh(spark, str(tmp_path / "short"), frame(spark, rows))
    whole = index.refresh(spark, str(tmp_path / "whole"), frame(spark, rows), longest=1 << 20)
    assert index.scored(short, ask(spark, long)).count() == 0
    assert [r.session_id for r in index.scored(whole, ask(spark, long), longest=1 << 20).collect()] == ["s"]
    assert [r.session_id for r in index.search_texts(whole, ask(spark, f'"a {long}"'), longest=1 << 20).collect()] == ["s"]


def test_odd_documents(spark, tmp_path):
    rows = [("p", "s", 0, "", "You", ""), ("p", "s", 1, "", "You", "!!!"), ("p", "s", 2, "x", "You", "word " * 5000), ("p", "t", 0, "x", "You", "word"), ("p", "t", 0, "x", "You", "word")]
    made = index.refresh(spark, str(tmp_path / "index"), frame(spark, rows))
    assert made.docs().count() == 5 and index.scored(made, ask(spark, "word")).count() == 3
    none = index.refresh(spark, str(tmp_path / "none"), frame(spark, []))
    assert index.topk(none, ask(spark, "word")).count() == index.search_texts(none, ask(spark, "+word")).count() == 0
    assert search.search(frame(spark, []), ask(spark, "word")).count() == 0


def test_texts_are_cut_by_tasks_by_the_cores(spark, tmp_path):
    """One file of documents is cut to words by more than one task."""
    one = spark.range(3000).selectExpr("'codex_cli' as provider", "concat('s', id % 7) as session_id", "id as seq", "'' as message_id", "'Codex' as provider_label", "'p' as project", "'You' as role_label", "concat('word w', id % 5) as content", "0L as timestamp").coalesce(1)
    spark.sparkContext.setJobGroup("cut", "an index")
    try:
        made = index.refresh(spark, str(tmp_path / "i"), one)
        jobs = spark.sparkContext.statusTracker()
        tasks = [jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("cut") for s in jobs.getJobInfo(j).stageIds if jobs.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) >= 4 * spark.sparkContext.defaultParallelism
    assert {(r.field, r.term): r.df for r in made.term_stats().collect()} == {("content", "word"): 3000, ("project", "p"): 3000, **{("content", f"w{k}"): 600 for k in range(5)}}
