"""Runs, mixing and repair against brute force on small tables, with nulls, empty, long and repeated rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import mixing, periodic_runs, turn_repair
from chatloom.llm.words import SPACE, VALUE, prefix, span, words

SHAPE = "doc_id long, text string, source string, runs string, k int, rate int, at int"
WHITE = " \t\n\x0b\f\r"


def table(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3) for i, t, s in rows], SHAPE).repartition(3)


def said(text):
    return re.findall(rf"[^{WHITE}]+", text or "")


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repeating(rng, most=90):
    w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, most))]
    if w and rng.random() < 0.6:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // (3 + rng.randint(0, 7))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    for _ in range(400):
        docs = [repeating(rng) for _ in range(rng.randint(1, 6))]
        docs += docs[:1] * rng.randint(0, 2)
        data = "".join(" ".join(d) for d in docs).encode()
        offsets = np.cumsum([0, *(len(" ".join(d)) for d in docs)])
        code = np.frombuffer(data, np.uint8)
        if not len(code):
            continue
        s, e, at = words(code, offsets, SPACE)
        least = rng.choice([12, 12, 5, 2])
        assert periodic_runs.text_runs(span(prefix(VALUE[code]), s, e), at, least) == [(r, *x) for r, d in enumerate(docs) for x in plain_runs(d, least)]


def test_runs_of_one_word_and_of_marked_lines():
    for w, count in ((["a"] * 30_000, 1), ([x for k in range(4000) for x in (f"n{k}", *"uvwxyz")], 0), ([f"w{k % 900}" for k in range(9000)], 1)):
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        s, e, at = words(data, np.array([0, len(data)]), SPACE)
        assert len(periodic_runs.text_runs(span(prefix(VALUE[data]), s, e), at)) == count


def test_periodic_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(repeating(rng, 200)) for _ in range(120)] + [None, "", " \t ", "one", "a b " * 30, "é日 x\n" * 9, ("tick\x0b tock " * 12_000)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, "again " * 40, "s"), (3, "again " * 40, "s"), (None, "b c " * 20, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, text, _ in rows:
        w = said(text)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        # a stretch of one or two periods is told by its own rule, as the plain one needs the square of its length
        runs = plain_runs(w) if len(w) < 5000 else [(0, len(w), 2)] if len(set(w[::2])) == 1 else None
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        told = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
        want[(i, len(runs), *told, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want and sum(r[1] > 0 for r in got) > 40
    assert periodic_runs.collapse_runs(table(spark, rows).filter("false")).count() == 0


# ---- mixing
def plain_targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, still = {}, share * sum(sizes.values()), set(order)
    while still:
        whole = sum(weight[s] for s in still)
        over = {s for s in still if left * weight[s] / whole > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in still}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        still -= over
    return out


def mixed(rng, many=400):
    names = ["b", "a", "Z", "ä", "日", "", None, "c", "d", "e", "lone"]
    rows = [(k, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), "a" if rng.random() < 0.33 else rng.choice(names[:-1])) for k in range(many)]
    return rows + [(many, "only one document", "lone"), (5, "used id", "a"), (5, "used id", "a"), (None, "x y z", "b"), (None, None, None), (many + 1, "", "quiet"), (many + 2, "v " * 5000, "c")]


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_mixing(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = mixed(random.Random(4))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op12_mixing(spark, str(tmp_path)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(said(t))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(said(t))) for i, t, _ in rows)
    want = plain_targets(dict(sizes))
    full = mixing.mix_sources(table(spark, rows)).collect()
    taken, size = Counter(), defaultdict(list)
    for r in full:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and abs(r.copies - r.rate) < 1
        taken[r.source] += r.taken
        size[r.source].append(r)
    for s, own in size.items():
        assert sum(r.rate * r.size for r in own) == pytest.approx(want[s], rel=1e-6)
        assert abs(taken[s] - want[s]) <= max(r.size for r in own) * (1 if bucket > 40 else 3)
        # one multiplier explains all rates of a source
        lam = [np.log(r.rate) / r.size**0.5 for r in own if r.size and 0 < r.rate < 2]
        assert not lam or np.allclose(lam, lam[0], atol=1e-9)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.op12_mixing(spark, str(tmp_path)).collect()))
    again = mixing.mix_sources(table(spark, rows[::-1]).repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(table(spark, [(1, "a", "s")]).filter("false")).count() == 0
    silent = mixing.mix_sources(table(spark, [(1, None, "s"), (2, " ", None)])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in silent)
    one = mixing.mix_sources(table(spark, [(k, "a b c", "s") for k in range(10)])).collect()
    assert sum(r.taken for r in one) == 45 and {r.taken for r in one} == {3, 6}
    with pytest.raises(ValueError):
        mixing.mix_sources(table(spark, [(1, "a", "s")]), share=3.0)


# ---- repair
def cheapest(turns):
    """Uniform-cost search over (turns done, state) with whole audits, apart from the operator's code."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = "" if not roles else roles if roles == "s" else roles[-1]
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        step = lambda letter, more, n, role: heapq.heappush(heap, (cost + more, audit + letter, i + n, roles + role)) if re.match(r"(s?(ua)*u?)$", roles + role) else None
        for role in "ua":
            step("I", 3, 0, role)
        if i < len(turns):
            role, bad, cut = turns[i]
            step("D", 4, 1, "")
            if not bad:
                step("K", 3 * cut, 1, role)
                for new in "ua":
                    step("R", 3 + 3 * cut, 1, new)
    raise AssertionError


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        text_said = text.strip(WHITE)
        faults.append("b" if not text_said else "d" if (role, text) in seen else "" if text_said[-1] in ".!?" else "t")
        seen.add((role, text))
    cost, audit = cheapest([(r[1][:1] or "?", f in ("b", "d"), f == "t") for r, f in zip(rows, faults)])
    out, i, last = [], 0, ""
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        due = "assistant" if last == "u" else "user"
        role, text = ("", "") if letter == "I" else rows[i][1:]
        role = role if letter == "K" else due
        i += letter != "I"
        out.append(f"{role}:{text}")
        last = role[:1]
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_search_is_optimal_under_any_bound():
    rng = random.Random(2)
    for _ in range(1500):
        turns = [(rng.choice("uuaasx"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 7))]
        want = cheapest([(r, f in (1, 2), f == 3) for r, f in turns])
        for bounds in (None, [[0.0] * 4 for _ in range(len(turns) + 1)]):
            assert turn_repair.search(turns, turn_repair.NONE, turn_repair.ENDS, bounds)[:2] == want
        alone = [turn_repair.search(turns, turn_repair.NONE, (e,)) for e in turn_repair.ENDS]
        assert min(x[:2] for x in alone if x) == want


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_query(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "PIECE_BITS", bits)
    rng = random.Random(6)
    texts = ["Fine.", "cut", "", " \t", "Why?", "Go!", "same.", None, "two\nlines. ", "long " * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]
    rows = [(c, t, rng.choice(roles[: 2 + c % 8]), f"{c} {t}." if rng.random() < 0.5 else rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t}{'.' if t % 5 else ''}") for t in range(400)]
    rows += [(901, None, "user", "a."), (901, None, "assistant", "b."), (901, 7, "user", "c"), (None, 1, "user", "d."), (None, 2, None, None), (902, 5, "user", "e."), (902, 5, "user", "e.")]
    rows += [(903 + k, 0, "user", "only.") for k in range(60)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, at string, cut int, piece int").repartition(5)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    want = {c: repaired(sorted(x, key=order)) for c, x in own.items()}
    got = turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and any(not x for x in own.values())
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    edits = turn_repair.repair(turn_repair.damaged(frame)).turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "n", "edit"))), lambda x: x["edit"]), "").alias("e")).collect()
    assert all(r.e == want[r.conv_id][6].replace("D", "") for r in edits)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = turn_repair.repair(none, none)
    assert done.conversations.count() == done.turns.count() == 0
    listed = turn_repair.repair(none, spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")).conversations.collect()
    assert sorted(((r.conv_id or 0, r.cost, r.audit, r.gaps) for r in listed)) == [(0, 0, "", 0), (1, 0, "", 0)]
