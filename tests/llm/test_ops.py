"""The training-data operators against brute force on small tables, with nulls, empty, long and repeated texts."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import chat_format, decontaminate, embedding_dedup, language_id, license_scan, ngram_join, packing, suffix_dedup, token_counts, token_files, util, words
from chatloom.llm.pretokens import Encoder
from chatloom.llm.util import components

WORD = token_counts.vocabulary("word_bpe_49k.json")
BYTE = token_counts.vocabulary("byte_bpe_50k.json")
SHAPE = "doc_id long, text string, lang string, row string, name int, size int"


def table(spark, texts):
    """Rows (doc_id, text) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in texts], SHAPE).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(60, 260)) for _ in range(25)]
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # exact copies
    for k in range(12):  # near copies of one text
        w = base[2].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "zz" + str(k)
        texts.append(" ".join(w))
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(6)]  # a passage that several share
    texts += [None, "", "   ", "one two", "ONE two", "a" * 1500, "ab" * 900, "éè 日本 <|endoftext|> it's 'LL", prose(rng, 9000), "x"]
    return list(enumerate(texts)) + [(3, base[3]), (3, "other text under a used id"), (None, base[4])]


def test_suffix_dedup(spark, corpus, monkeypatch):
    length = 400
    data = [(i, (t or "").encode()) for i, t in corpus]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in data:
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                mark[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        spans = int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum())
        want[(i, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    for split in (1024, 2):
        monkeypatch.setattr(suffix_dedup, "SPLIT", split)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, corpus)).collect())
        assert got == want
    kept = {(r.doc_id, r.n_bytes): (r.n_removed, r.text) for r in suffix_dedup.remove_repeats(table(spark, corpus)).select("doc_id", "n_bytes", "n_removed", suffix_dedup.kept_text(F.col("kept")).alias("text")).collect()}
    assert all(t is not None and (n or len(t.encode()) == size) for (_, size), (n, t) in kept.items())
    empty = suffix_dedup.remove_repeats(table(spark, corpus).filter("false"))
    assert empty.count() == 0 and suffix_dedup.remove_repeats(table(spark, corpus).filter("false"), size=51).count() == 0


def test_suffix_dedup_keeps_nothing_of_equal_rows(spark):
    rng = random.Random(31)
    long = prose(rng, 90)
    rows = [(1, long), (1, long), (None, long), (2, long[:200])]
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    n = len(long.encode())
    assert got == Counter({(1, n): 2, (None, n): 1, (2, 0): 1})


def test_suffix_dedup_reads_one_of_equal_rows(spark, monkeypatch):
    """However often a row is repeated, its stretches are read once."""
    rng = random.Random(32)
    long = prose(rng, 200)
    sent = []
    bodies = suffix_dedup._bodies
    monkeypatch.setattr(suffix_dedup, "_bodies", lambda asked, length: sent.append(util.written(bodies(asked, length), "bodies")) or sent[-1])
    for copies in (2, 200):
        rows = [(1, long)] * copies + [(2, long[:700] + " other " + long[700:])]
        got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
        assert got[(1, len(long))] == copies and len(got) == 2
    assert sent[0].count() == sent[1].count()


def test_op1_cuts_passages_of_more_than_50_words(spark, tmp_path):
    """Passages of 51 to 60 words that are shorter than 400 bytes are told and cut beside the contract's columns, which stay."""
    rng = random.Random(33)
    short, few, inner, long = prose(rng, 55), prose(rng, 50), prose(rng, 51), prose(rng, 90)
    assert len(short) < 400 and len(inner) < 400 < len(long)
    rows = [(k, f"{prose(rng, 30)} {p} {prose(rng, 20 + k)}") for k, p in enumerate([short, short, short.replace(" ", "\n"), few, few, long, long, short + " " + long])]
    rows += [(20, f"{inner} x {inner}"), (21, None), (22, ""), (23, few), (24, prose(rng, 60)), (24, prose(rng, 60)), (25, short), (25, short), (None, "é" * 300), (None, "é" * 300)]
    spark.createDataFrame([(*r, "en", "x") for r in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    windows, strings, places = Counter(), Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        w = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        places.append((b, w))
        windows.update(tuple(x[2] for x in w[k : k + 51]) for k in range(len(w) - 50))
        strings.update(b[k : k + 400] for k in range(len(b) - 399))
    runs = lambda m: int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
    want = Counter()
    for (i, _), (b, w) in zip(rows, places):
        mark, passage = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if strings[b[k : k + 400]] > 1:
                mark[k : k + 400] = True
        for k in range(len(w) - 50):
            if windows[tuple(x[2] for x in w[k : k + 51])] > 1:
                passage[w[k][0] : w[k + 50][1]] = True
        left, rest = (np.frombuffer(b, np.uint8)[~m].tobytes() for m in (mark, mark | passage))
        want[(i, len(b), int(mark.sum()), runs(mark), hashlib.sha256(left).hexdigest(), left.decode(), runs(passage), int((mark | passage).sum()), rest.decode())] += 1
    got = Counter(tuple(r) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "n_cut", "cut_text").collect())
    assert got == want
    told = {r[0]: (r[2], r[6]) for r in got}
    assert told[0] == told[1] == told[2] == (0, 1) and told[3] == told[24] == (0, 0) and told[7][0] >= 400 and told[20] == (0, 2)


def test_windows_of_words_against_brute_force():
    """The place by which a window is met is the leftmost smallest of its runs, also beside other texts and in short buffers."""
    rng = random.Random(34)
    for n, gram in ((51, 8), (9, 8), (8, 8), (7, 3), (1, 1)):
        texts = [" ".join(rng.choices(["a", "bb", "c", "d"], k=rng.choice([0, 1, n - 1, n, n + 1, 3 * n]))).encode() for _ in range(25)]
        offsets = np.cumsum([0, *map(len, texts)])
        row, first, end, content, where, least = suffix_dedup.windows(np.frombuffer(b"".join(texts), np.uint8), offsets, n, gram)
        found = [(int(r), texts[r][f:e]) for r, f, e in zip(row, first, end)]
        cut = [(k, b" ".join(t.split()[j : j + n])) for k, t in enumerate(texts) for j in range(len(t.split()) - n + 1)]
        assert found == cut
        assert len(set(zip([w for _, w in cut], content.tolist()))) == len({w for _, w in cut}) == len(set(content.tolist()))
        hashes = {}
        flat = [w for t in texts for w in t.split()]
        before = np.cumsum([0, *(len(t.split()) for t in texts)])
        for at, h in zip(where.tolist(), least.tolist()):
            assert hashes.setdefault(tuple(flat[at : at + gram]), h) == h
        inside = Counter(r for r, _ in found)
        start = [before[r] + j for r in sorted(inside) for j in range(inside[r])]
        for s, at, h in zip(start, where.tolist(), least.tolist()):
            known = [hashes.get(tuple(flat[k : k + gram])) for k in range(s, s + n - gram + 1)]
            assert s <= at <= s + n - gram and all(x is None or x >= h for x in known) and known.index(h) == at - s


def test_suffix_arrays_in_pieces():
    rng = random.Random(1)
    for _ in range(30):
        t = bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abcdefgh", k=rng.randint(1, 200))) * rng.randint(1, 3)
        x = np.frombuffer(t, np.uint8)
        order = suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(t)), key=lambda k: t[k:])
        size = suffix_dedup.common_prefixes(x, order, 50)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert size[k] == min(n, 50)


def test_long_text_is_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 5000)
    monkeypatch.setattr(suffix_dedup, "cuts", lambda o, most: [(k, k + 1) for k in range(len(o) - 1)])
    offsets = np.array([0, 17_000])
    pieces = list(suffix_dedup.pieces(offsets, 400))
    starts = sorted(s for a, b, low, high in pieces for s in range(low, high - 399))
    assert starts == list(range(17_000 - 399))


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok \n" * 3000, "\\### Assistant: </turn> ok", "</turn>\n### user: no", "\\\\</turn>", "### ", "plain", None, "", "ends\\", "\n</turn>\n", "a\n</turn>\nb\\### c", "# ## ###x"]
    roles = ["user", "assistant", "tool: x", "a\\b", "line\nfeed", None, "\\n", "system", "\u0001\u0002\\"]
    rows = [(c, t, roles[(c + t) % len(roles)], hard[(c * 3 + t) % len(hard)]) for c in range(6) for t in range(9)] + [(1, 2, "user", "tie"), (None, 0, "user", "x"), (1, 2, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = chat_format.format_conversations(df).collect()
    assert len(got) == 7 and all(r.round_trip for r in got)
    for r in got:
        own = sorted(((t, x is not None, x or "", y or "") for c, t, x, y in rows if c == r.conv_id), key=lambda z: (z[0], z[1], z[2], z[3]))
        assert [(x["role"], x["text"]) for x in r.turns] == [(x, y) for _, _, x, y in own]
        assert r.loss_text == "".join(y for _, _, x, y in own if x == "assistant")
    assert chat_format.format_conversations(df.filter("false")).count() == 0


def test_chat_of_very_long_roles_and_texts(spark):
    """Nothing recurses or starts anew at each character: megabytes of one sign, of escapes, of control strings."""
    n = 1_000_000
    rows = [(1, 0, "r" * n, "a"), (2, 0, ":" * n, "b"), (3, 0, "\\" * n, "c"), (4, 0, "\n:" * (n // 2), "d"), (5, 0, "assistant", "\\" * n + "### "), (6, 0, "assistant", "\\" * n), (7, 0, "assistant", "</turn>" * (n // 7)), (8, 0, "assistant", "x" * n)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {c: (role, text) for c, _, role, text in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.round_trip and [(t["role"], t["text"]) for t in r.turns] == [want[r.conv_id]]


def test_license_scan(spark):
    texts = [
        (1, "Released under the MIT License. mit license"), (2, "see the Apache--License, and GNU General Public License version 3"), (3, None), (4, ""), (5, "mit"), (6, "license mit"), (7, "...MIT\nlicense"),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (9, "Permission is hereby granted to any person obtaining a copy of this software"), (10, "general public " * 500 + "license"), (11, "émit license"), (1, "mit license"), (12, "mit license of an apache license " * 4000),
    ]
    got = license_scan.scan(table(spark, texts)).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        f = [(k, l) for p, l in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(f), min((k for k, _ in f), default=None), max((k for k, _ in f), default=None), ",".join(sorted({l for _, l in f})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "mit-notice" and by[8].score == 1.0
    assert "gpl-3.0" in by[2].labels and all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert [r.labels for r in got if r.doc_id == 9] == [""]  # the key phrase is missing
    assert license_scan.scan(table(spark, texts).filter("false")).count() == 0


def license_chain(w, own, key):
    """The best share of a template that the plain rule finds in the words of a text."""
    k, n = license_scan._offset(" ".join(own), " ".join(key)), len(own)
    band, best = 8 + n // 4, 0.0
    for start in (p for p, x in enumerate(w) if x == key[0]):
        hit = {k}
        for sign in (1, -1):
            p, lost, o = start, 0, k + sign
            while 0 <= o < n:
                stands = lambda d, j=0: 0 <= p + sign * (d + j) < len(w) and 0 <= o + sign * j < n and w[p + sign * (d + j)] == own[o + sign * j]
                near = lambda d: abs((p + sign * d - start) - (o - k)) <= band
                tried = [lost + 1] if stands(lost + 1) and near(lost + 1) else [d for d in range(1, lost + 2 + license_scan.GAP) if stands(d) and near(d) and (not 0 <= o + sign < n or stands(d, 1))]
                if tried:
                    p, lost = p + sign * tried[0], 0
                    hit.add(o)
                else:
                    lost += 1
                o += sign
        if hit.issuperset(range(k, k + len(key))):
            best = max(best, len(hit) / n)
    return best


def plain_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shares = {name: license_chain(w, own.split(), key.split()) for name, own, key in license_scan.TEMPLATES}
    base = {l for p, l in license_scan.BASE.items() if any(w[o : o + len(p.split())] == p.split() for o in range(len(w)))}
    return ",".join(sorted({*base, *(name for name, c in shares.items() if c >= license_scan.COVER)})), max([0.8 if base else 0.0, *(c for c in shares.values() if c >= license_scan.COVER)])


def test_license_templates_are_found_where_enough_words_stand(spark, tmp_path):
    """Every template, whole and with words changed, inserted and left out, against the plain rule and the SQL."""
    import duckdb

    rng = random.Random(17)
    texts = []
    for t, (_, text, _) in enumerate(license_scan.TEMPLATES):
        own = text.split()
        for k, share in enumerate((0, 0.1, 0.19, 0.3)):
            w = list(own)
            for o in rng.sample(range(len(w)), int(share * len(w))):
                w[o] = "x" + str(o)
            texts.append((20 * t + k, f"{prose(rng, 5)} {' '.join(w).upper()}. {prose(rng, 3)}"))
        for k, share in enumerate((0.05, 0.1, 0.3), 4):
            w = [x for o in own for x in ([o] if rng.random() >= share else rng.choice([[], [o, "rem"], [o, "12", "dnl"], ["the", o]]))]
            texts.append((20 * t + k, f"{prose(rng, 5)} {' '.join(w)}"))
        texts.append((20 * t + 7, " ".join(own[: len(own) // 2] + ["rem"] * 5 + own[len(own) // 2 :])))
    texts += [(900, " ".join(t for _, t, _ in license_scan.TEMPLATES)), (901, "the software " * 50), (902, "free of charge " * 300), (903, None), (904, ""), (905, "mit license"), (905, "mit license")]
    docs = table(spark, texts)
    got = license_scan.scan(docs).toPandas()
    assert Counter(zip(got.doc_id, got.labels, got.score)) == Counter((i, *plain_licenses(t)) for i, t in texts)

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
        want = con.execute(license_scan.oracle()).df()
    columns = ["doc_id", "n_words", "n_base", "labels", "score", "template"]
    rows = lambda df: Counter(zip(*(df[c].astype(object).where(df[c].notna(), None) for c in columns)))
    assert rows(got) == rows(want)


def test_license_notices_with_signs_and_numbers_at_lines(spark):
    """A comment word or a line number before each line, a word put in or left out: the labels stay."""
    named = {name: text.split() for name, text, _ in license_scan.TEMPLATES}
    texts, want = [], {}
    for n, name in enumerate(("mit-grant", "apache-2.0-notice", "gpl-notice", "bsd-warranty", "mit-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text")):
        own = named[name]
        lines = [own[k : k + 9] for k in range(0, len(own), 9)]
        made = [
            [x for line in lines for x in ["rem", *line]],
            [x for k, line in enumerate(lines) for x in [str(k + 1), "dnl", *line]],
            own[: len(own) // 2] + ["inserted"] + own[len(own) // 2 :],
            own[:4] + own[5:],
            own + ["and"] + own,
        ]
        for k, w in enumerate(made):
            texts.append((10 * n + k, " ".join(w)))
            want[10 * n + k] = name
    texts.append((900, " ".join(named["bsd"] + ["1"] + named["bsd-source"] + ["2"] + named["bsd-binary"] + ["3"] + named["bsd-names"] + named["bsd-warranty"])))
    want[900] = "bsd-3-clause-text"
    texts.append((901, " ".join(x for o in named["gpl-notice"] for x in [o, "a", "b", "c", "d"])))
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(table(spark, texts)).collect()}
    assert [i for i, name in want.items() if name not in got[i]] == []
    assert "bsd-2-clause-text" not in got[900] and got[901] == [""]


def test_license_at_the_end_of_a_very_long_text(spark):
    """A notice and a base phrase behind megabytes of other words are found, at their places."""
    rng = random.Random(11)
    notice = {name: text for name, text, _ in license_scan.TEMPLATES}["mit-grant"]
    filler = prose(rng, 200_000)
    got = {r.doc_id: r for r in license_scan.scan(table(spark, [(1, f"{filler} {notice} MIT License"), (2, filler)])).collect()}
    n = 200_000 + len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower()))
    assert "mit-grant" in got[1].labels.split(",") and got[1].base_labels == "mit"
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (n + 2, 1, n, n)
    assert (got[2].n_words, got[2].n_base, got[2].labels, got[2].first_word) == (200_000, 0, "", None)


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, *(base[:20] + rng.normal(size=(20, 16)) * s for s in (0.1, 0.2, 0.25, 0.3)), base[:3], base[:3]])
    rows = [(k, [float(v) for v in x[k]], int(k % 3 if k < 60 else k % 20 % 3)) for k in range(len(x))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 16, None), (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    link = {i: [j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.93] for i in good}
    found = sum(got[i].n_links for i in good)
    assert {i: got[i].n_links for i in good} == {i: len(link[i]) for i in good}  # no link is missing here, so components are known
    for i in good:
        seen, todo = {i}, [i]
        while todo:
            more = [j for j in link[todo.pop()] if j not in seen]
            seen.update(more)
            todo += more
        assert got[i].component_id == min(seen)
    assert all(got[i].n_links <= len(link[i]) for i in good) and found >= 0.9 * sum(map(len, link.values()))  # recall
    for i in got:
        if i not in good:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[i].kept == (got[i].component_id == i)
    assert embedding_dedup.near_vectors(df.filter("false")).count() == 0


def test_near_vectors_in_blocks_with_few_pivots(spark, monkeypatch):
    """Long lists in blocks, pairs in small lots, pivots bounded by bytes: with all pivots shared, no link is lost."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 5)
    monkeypatch.setattr(embedding_dedup, "PIVOT_BYTES", 1)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 12))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.1 for _ in range(12)])
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame([(k, [float(v) for v in x[k]], 1) for k in range(len(x))], "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.93
    assert [got[k].n_links for k in range(len(x))] == (link.sum(axis=1) - 1).tolist()
    reach = link
    for _ in range(7):
        reach = (reach.astype(int) @ reach) > 0
    assert [got[k].component_id for k in range(len(x))] == reach.argmax(axis=1).tolist()


def test_near_vectors_by_second_pivots(spark, monkeypatch):
    """Lists beyond the bound on pivots are dealt out by second pivots: the same links, each once, as with whole lists."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "PIVOT_BYTES", 24 * 8 * 16)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.15, 0.2)])
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 1) for k in range(len(x))], "vec_id long, embedding array<double>, label int")
    lists = []
    grouped = embedding_dedup.grouped

    def noted(dealt, *args):
        lists.append(dealt.groupBy("pivot", "second").count().collect())
        return grouped(dealt, *args)

    monkeypatch.setattr(embedding_dedup, "grouped", noted)
    ways = []
    for deep in (1, 10**9):
        monkeypatch.setattr(embedding_dedup, "DEEP", deep)
        ways.append({r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()})
    assert ways[0] == ways[1]
    assert any(r.second >= 0 for r in lists[0]) and all(r.second == -1 for r in lists[1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert all(ways[0][k][0] <= want[k] for k in ways[0]) and sum(n for n, _ in ways[0].values()) >= 0.95 * want.sum()


def test_near_vectors_recall_in_a_dense_cluster(spark):
    """A cluster of many near vectors among unlike ones, with the values of production: recall against brute force."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    x = np.concatenate([rng.normal(size=(1500, 32)), base + rng.normal(size=(400, 32)) * 0.22]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 1) for k in range(len(x))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 10_000 and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.98 * want.sum()


def test_language_codes_are_exact_and_predict():
    rng = random.Random(2)
    parts = {"a": ["ka", "lo", "mi"], "b": ["str", "unt", "ge"], "c": ["ét", "oi", "ce"]}
    text = lambda l, n: " ".join("".join(rng.choices(parts[l], k=3)) for _ in range(n))
    train = {l: [text(l, 40).encode() for _ in range(5)] for l in parts}
    model = language_id.train(train)
    count = {l: {} for l in parts}
    for l, ts in train.items():
        for t in ts:
            t = bytes(language_id.FOLD[np.frombuffer(t, np.uint8)])
            for n in range(language_id.ORDER + 1):
                for k in range(n, len(t)):
                    c = count[l].setdefault(t[k - n : k], {})
                    c[t[k]] = c.get(t[k], 0) + 1

    def cost(l, ctx, ch):
        c = count[l].get(ctx)
        short = (lambda: cost(l, ctx[1:], ch)) if ctx else (lambda: 8.0)
        if c is None:
            return short()
        total, kinds = sum(c.values()), len(c)
        return -math.log2(c[ch] / (total + kinds)) if ch in c else -math.log2(kinds / (total + kinds)) + short()

    tests = [text(l, 15).encode() for l in parts] + [b"q", b"KALO unt \xc3\xa9t", b"\x00\xff"]
    offsets = np.cumsum([0] + [len(t) for t in tests])
    code = language_id.FOLD[np.frombuffer(b"".join(tests), np.uint8)]
    per = model.ready().costs(code, offsets[:-1])
    for t, s, e in zip(tests, offsets, offsets[1:]):
        t = bytes(language_id.FOLD[np.frombuffer(t, np.uint8)])
        for j, l in enumerate(model.languages):
            assert abs(per[s:e, j].sum() - sum(cost(l, t[max(0, k - language_id.ORDER) : k], t[k]) for k in range(len(t)))) < 1e-2


def test_language_of_rows(spark):
    rng = random.Random(3)
    parts = {"a": ["ka", "lo", "mi"], "b": ["str", "unt", "ge"]}
    text = lambda l: " ".join("".join(rng.choices(parts[l], k=3)) for _ in range(30))
    rows = [(k, text("ab"[k % 2]), "ab"[k % 2]) for k in range(60)]
    odd = [(100, None, "a"), (101, "", "a"), (102, "123 !!", "a"), (103, "kalo", None), (None, text("b"), "b"), (104, text("a") * 300, "a")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("bits", F.lit(1))
    got = language_id.predict(df, language_id.fit(df.filter("doc_id < 40"))).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    held = [(r.lang_pred, "ab"[r.doc_id % 2]) for r in got if r.doc_id is not None and 40 <= r.doc_id < 60]
    assert sum(p == q for p, q in held) >= 19
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[100], by[101], by[102], by[103], by[104], by[None]) == ("und", "und", "und", "a", "a", "b")
    twice = language_id.predict(df.unionByName(df), language_id.fit(df.filter("doc_id < 40")))
    assert Counter(tuple(r) for r in twice.collect()) == Counter({tuple(r): 2 for r in got})
    assert language_id.predict(df.filter("false"), language_id.fit(df)).count() == 0
    nothing = language_id.fit(df.filter("false"))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    marks = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(70)]
    text = lambda k, n: " ".join("".join(rng.choices(marks[k], k=4)) for _ in range(n))
    rows = [(100 * k + i, text(k, 20), f"l{k:02}") for k in range(70) for i in range(10)]
    rows += [(9000 + i, "qrst uvwx " * 2100, "long") for i in range(2)]  # only texts above the bound
    rows += [(1, "zzyy yyzz " * 3, "many")] * 400 + [(None, "jjkk kkjj " * 3, "none")]  # one id repeated, and no id
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language_id.sample(df)
    most, window = language_id.bounds(73, language_id.ROWS, language_id.LONGEST)
    assert len(drawn) == 73 and all(1 <= len(t) <= most and max(map(len, t)) <= window for t in drawn.values())
    assert len(language_id.sample(df.filter("lang = 'many'"))["many"]) == language_id.ROWS
    asked = spark.createDataFrame([(k, text(k, 30)) for k in range(70)] + [(70, "qrst uvwx qrst"), (71, "zzyy yyzz"), (72, "jjkk kkjj"), (73, text(69, 3000))], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(asked, language_id.fit(df)).collect()}
    assert got == {k: f"l{k:02}" for k in range(70)} | {70: "long", 71: "many", 72: "none", 73: "l69"}
    assert language_id.bounds(4, 150, 20_000) == (150, 20_000) and language_id.bounds(1000, 150, 20_000) == (1, 768)


def test_long_texts_teach_from_all_of_them(spark):
    text = "aaaa " * 20_000 + "bbbb " * 20_000 + "éééé " * 20_000
    df = spark.createDataFrame([(1, text, "x"), (2, "short", "x")], "doc_id long, text string, lang string")
    drawn = sorted(language_id.sample(df, longest=8000)["x"], key=len)
    assert drawn[0] == b"short" and 7000 <= len(drawn[1]) <= 8000 and all(s in drawn[1] for s in (b"aaaa", b"bbbb", "éééé".encode()))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small", [48, 1])
def test_ngram_join(spark, corpus, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 4 if small == 1 else 2048)
    rows = [(k, t) for k, (_, t) in enumerate(corpus)]
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                f, g = find(a), find(b)
                root[max(f, g)] = min(f, g)
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(k, len(sets[k]), find(k)) for k in sets}


def test_buckets_follow_the_size_of_the_texts():
    assert ngram_join.bucket_count(0, 2) == 2 and ngram_join.bucket_count(1 << 20, 200) == 200
    assert ngram_join.bucket_count(100 << 40, 2) * ngram_join.BUCKET_BYTES >= 100 << 40


def test_ngram_join_in_many_buckets(spark, corpus, monkeypatch):
    """Small buckets and two shuffle partitions find the same groups."""
    rows = table(spark, [(k, t) for k, (_, t) in enumerate(corpus)])
    first = Counter(map(tuple, ngram_join.ngram_join(rows).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 4000)
    assert Counter(map(tuple, ngram_join.ngram_join(rows).select("doc_id", "component_id").collect())) == first


def test_ngram_join_of_copies_right_at_the_threshold(spark, monkeypatch):
    """A cluster of copies of which many lie right at 80 percent of one another, in blocks: no link is lost."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    rng = random.Random(33)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{k}{rng.randrange(99)}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(146)) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                f, g = find(a), find(b)
                root[max(f, g)] = min(f, g)
    leaderless = ngram_join._verified
    # without what the leader round finds, every link comes from the blocks
    calls = []

    def verified(pairs, *rest):
        calls.append(1)
        return leaderless(pairs.filter("false") if len(calls) == 1 else pairs, *rest)

    for first in (leaderless, verified):
        monkeypatch.setattr(ngram_join, "_verified", first)
        got = ngram_join.ngram_join(table(spark, list(enumerate(texts))), n=5, percent=80).collect()
        assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in range(len(sets))}


def test_ngram_join_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 54, n).astype(np.uint64))
        drop = rng.random(len(a)) < rng.random() * 0.09
        b = np.unique(np.concatenate((a[~drop], rng.integers(0, 1 << 54, int(rng.integers(0, max(1, len(a) // 12) + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        keys = np.concatenate((a, b | np.uint64(1 << 54)))
        row, sig = ngram_join.signatures(keys, np.array([len(a), len(b)]), 85)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_ngram_join_odd_rows(spark, corpus):
    got = ngram_join.ngram_join(table(spark, corpus)).collect()  # a used id and a null id
    assert len(got) == len(corpus)
    assert ngram_join.ngram_join(table(spark, corpus).filter("false")).count() == 0


def plain_best_fit(lengths, capacity):
    """Sequences that best fit decreasing needs, piece by piece."""
    rooms = []
    for l in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= l]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= l
        else:
            rooms.append(capacity - l)
    return len(rooms)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_packing_needs_no_more_than_best_fit_on_real_pieces(spark):
    for d in ("sf0.001", "sf0.01"):
        got = packing.op7_best_fit_packing(spark, f"/root/testdata/{d}").collect()
        lengths = [r.length for r in got]
        used = len({r.sequence_id for r in got})
        assert -(-sum(lengths) // 1024) <= used <= plain_best_fit(lengths, 1024)


def test_packing(spark, corpus):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(BYTE)
    got = packing.pack_documents(table(spark, corpus), BYTE, False, 2).collect()
    want = Counter()
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        cut = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), 1024)], [*range(cut, len(ids), 1024), len(ids)])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= plain_best_fit([r.length for r in got], 1024)
    assert packing.pack_documents(table(spark, corpus).filter("false"), BYTE, False, 2).count() == 0


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(1)
    for n in (1, 30, 3000, 200_000):
        x = np.clip(rng.lognormal(5.4, 1, n).astype(int) + 1, 1, 1024)
        h = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
        used, got = packing.configurations(h), Counter()
        for times, found in used:
            assert times > 0 and sum(l * k for l, k in found.items()) <= 1024
            for l, k in found.items():
                got[l] += times * k
        assert got == h and len(used) < 3000
        bound = max(-(-int(x.sum()) // 1024), int((x > 512).sum()))
        assert sum(t for t, _ in used) <= bound * 1.0005 + 1
        if n <= 3000:
            greedy = plain_best_fit(x.tolist(), 1024)
            assert sum(t for t, _ in used) <= greedy == sum(t for t, _ in packing.best_fit_decreasing(h, 1024))


def test_token_files(spark, corpus):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(WORD)
    rows = [(k, t) for k, (_, t) in enumerate(corpus)]
    segments = token_files.write_token_files(table(spark, rows), WORD, True, 1)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(segments).collect())
    at, want = 0, []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(table(spark, rows).filter("false"), WORD, True, 1)).count() == 0
    odd = [(5, "same id, later text"), (5, "a text"), (5, "a text"), (None, "no id"), (None, None), (2, "two")]
    at, want = 0, []
    for i, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        n = len(lib.encode(t or "", add_special_tokens=False).ids) + 1
        want.append((i, at, n))
        at += n
    back = token_files.read_token_files(token_files.write_token_files(table(spark, odd), WORD, True, 1)).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in back), key=lambda r: r[1]) == want


def test_token_files_give_any_id_directly():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0), rng.integers(0, 50_000, 3000), rng.integers(0, 200, 1500), rng.integers(0, 1 << 32, 700)):
        segment = token_files.Segment(token_files.pack(ids))
        assert segment.decode().tolist() == ids.astype(np.int64).tolist()
        for k in range(0, len(ids), 7):
            assert segment[k] == ids[k]


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, 40)) for k in range(8)] + [(8, None), (9, ""), (10, "too short")]
    w = items[1][1].split()
    moved = f"{prose(rng, 30)} {' '.join(w[20:])} {prose(rng, 10)} {' '.join(w[:20])} {prose(rng, 9)}"
    texts = [(1, f"{prose(rng, 50)} {items[0][1].upper()}! {prose(rng, 50)}"), (2, moved), (3, prose(rng, 200)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:10]) + prose(rng, 60)), (7, items[3][1] + " " + items[4][1]), (7, "x"), (None, items[5][1]), (8, "a b " * 4000)]
    for most in (1 << 30, 900, 200):  # in one block, and in several
        got = decontaminate.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=most).collect()
        assert len(got) == len(texts)
        assert sorted((r.doc_id or -1, r.item_ids) for r in got if r.contaminated) == [(-1, [5]), (1, [0]), (2, [1]), (7, [3, 4])]
        assert [(r.item_id, r.n_tiles, r.coverage) for r in got if r.doc_id == 2] == [(1, 2, 1.0)]
        assert decontaminate.decontaminate(table(spark, texts).filter("false"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=most).count() == 0


def test_decontamination_of_a_very_long_text(spark):
    """An item at the very end of a text of megabytes, and one in two halves that lie megabytes apart."""
    rng = random.Random(10)
    items = [(k, prose(rng, 40)) for k in range(3)]
    w = items[1][1].split()
    filler = prose(rng, 250_000)
    texts = [(1, f"{' '.join(w[20:])} {filler} {' '.join(w[:20])} end {items[0][1]}"), (2, filler), (3, "short")]
    got = decontaminate.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: sorted(r.item_ids) for r in got} == {1: [0, 1], 2: [], 3: []}


def test_items_shorter_than_a_seed_are_found(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "delta epsilon zeta"), (4, "one two three four five")]
    texts = [(1, "alpha"), (2, "x beta, GAMMA y"), (3, "delta epsilon zeta"), (4, "gamma beta delta epsilon"), (5, "one two three four"), (6, "q alpha one two three four five")]
    for most in (1 << 30, 100):
        got = decontaminate.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=most).collect()
        assert {r.doc_id: r.item_ids for r in got} == {1: [1], 2: [2], 3: [3], 4: [], 5: [4], 6: [1, 4]}


def test_tiling_matches_the_plain_algorithm():
    rng = random.Random(11)

    def plain(doc, item, least):
        used_d, used_i, covered = set(), set(), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                        n += 1
                    if n > best[0]:
                        best = (n, i, d)
            n, i, d = best
            if n < least:
                return covered
            used_i |= set(range(i, i + n))
            used_d |= set(range(d, d + n))
            covered += n

    for _ in range(40):
        item = [rng.randrange(30) for _ in range(25)]
        cut = rng.randrange(5, 20)
        doc = [rng.randrange(30) for _ in range(8)] + item[cut:] + [99] + item[:cut] + [rng.randrange(30) for _ in range(5)]
        hits = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        covered, _ = decontaminate.tile(np.array([h[0] for h in hits]), np.array([h[1] for h in hits]), 3, len(item))
        assert covered == plain(doc, item, 3)


def test_only_items_that_can_matter_are_tiled(monkeypatch):
    """Many items that share one phrase with a text are passed over; verdicts are those of tiling all of them."""
    rng = random.Random(23)
    pool = [prose(rng, 1) for _ in range(30)]
    phrase = "of the common phrase"
    items = [f"{prose(rng, rng.randint(3, 12))} {phrase} {' '.join(rng.choices(pool, k=rng.randint(0, 9)))}" for _ in range(120)]
    texts = [f"{prose(rng, 9)} {phrase} {' '.join(rng.choices(pool, k=80))}" for _ in range(30)] + [f"{items[5]} {prose(rng, 4)} {items[7]}", f"{phrase} " * 40, "", items[9][: len(items[9]) // 2]]
    index = decontaminate.Index([(k % 90, t.encode()) for k, t in enumerate(items)], 4)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    hashes, at = words.word_hashes(np.frombuffer("".join(texts).encode(), np.uint8), offsets, words.SIGNS)
    plain, tile, called = {}, decontaminate.tile, []
    row, place, item, start = index.hits(hashes, at)
    for r in np.unique(row).tolist():
        found = []
        for i in np.unique(item[row == r]).tolist():
            own = (row == r) & (item == i)
            covered, tiles = tile(place[own], start[own], 4, int(index.words[i]))
            found.append((covered / int(index.words[i]), -int(index.ids[i]), tiles))
        best = max(found, key=lambda f: f[:2])
        plain[r] = (-best[1], best[0], sorted(-n for c, n, _ in found if c >= 0.5))
    monkeypatch.setattr(decontaminate, "tile", lambda *args: called.append(1) or tile(*args))
    got = decontaminate._verdicts(index, hashes, at, 0.5)
    assert {r: (f[0], f[1], sorted(f[3])) for r, f in got.items()} == plain
    assert len(called) < len(set(zip(row.tolist(), item.tolist()))) / 3


def test_decontamination_is_greedy_tiling(spark):
    rng = random.Random(13)
    common = prose(rng, 12).split()
    items = [(k, " ".join(rng.choices(common, k=rng.choice([1, 3, 9, 14])))) for k in range(9)]
    items += [(20, items[2][1]), (20, items[2][1])]  # repeated items
    texts = [(k, " ".join(rng.choices(common, k=rng.randint(0, 40)))) for k in range(25)]
    for k in range(12):
        w = items[k % 9][1].split()
        cut = rng.randrange(len(w) + 1)
        texts.append((100 + k, " ".join([*rng.choices(common, k=4), *w[cut:], "q", *w[:cut]])))
    texts += [texts[3], (None, texts[4][1])]

    def covered(doc, item, least):
        """Plain greedy string tiling: the longest match, the first in the item, on the lowest diagonal."""
        used_d, used_i, n_covered, n_tiles = set(), set(), 0, 0
        while True:
            found = (0, 0, 0)
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                        n += 1
                    found = max(found, (n, -i, i - d))
            n, i = found[0], -found[1]
            if n < least:
                return n_covered, n_tiles
            d = i - found[2]
            used_i |= set(range(i, i + n))
            used_d |= set(range(d, d + n))
            n_covered, n_tiles = n_covered + n, n_tiles + 1

    want = Counter()
    for i, t in texts:
        doc, best, over = t.split(), (0.0, None, 0), []
        for name, text in items:
            item = text.split()
            n, tiles = covered(doc, item, min(4, len(item)))
            if n:
                best = max(best, (n / len(item), -name, tiles), key=lambda f: (f[0], f[1] if f[1] is not None else -99))
                over += [name] if n / len(item) >= 0.5 else []
        want[(i, bool(over), None if best[1] is None else -best[1], round(best[0], 9), best[2], tuple(sorted(over)))] += 1
    for most in (1 << 30, 250):
        got = decontaminate.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=most).collect()
        assert Counter((r.doc_id, r.contaminated, r.item_id, round(r.coverage, 9), r.n_tiles, tuple(r.item_ids)) for r in got) == want


def test_token_counts(spark, corpus):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(WORD)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark, corpus), WORD).collect())
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in corpus)
    assert token_counts.count_tokens(table(spark, corpus).filter("false"), WORD).count() == 0


@pytest.mark.parametrize(("path", "kind"), [(WORD, True), (BYTE, False)])
def test_encoder_is_the_library(path, kind):
    rng = random.Random(6)
    letters = [*"ab st 's've'll'm'd  \n\t 12 ½éÀßıſĲ.,!?'\"$#<|> ’“—€\x85\x1c\x0b\x00İ", " '", "'re", "'LL", " \n", "<|endoftext|>", "日", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(3000)]
    e = Encoder(path, kind, memo_limit=500)  # the memo is cleared many times
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    ids, at = e.encode(b"".join(data), offsets)
    want = e.library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(w.ids == ids[at[k] : at[k + 1]].tolist() for k, w in enumerate(want))
    assert (e.count(b"".join(data), offsets) == np.diff(at)).all()


def test_words_match_regular_expressions():
    rng = random.Random(8)
    texts = ["".join(rng.choices("aB \n\té.-9", k=rng.randint(0, 30))) for _ in range(200)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    s, e, at = words.words(np.frombuffer(b"".join(data), np.uint8), offsets, words.SPACE)
    whole = b"".join(data)
    for k, t in enumerate(texts):
        assert [whole[a:b].decode() for a, b in zip(s[at[k] : at[k + 1]], e[at[k] : at[k + 1]])] == re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("whole", [200_000, 3])
def test_components(spark, monkeypatch, whole):
    monkeypatch.setattr(util, "WHOLE", whole)  # 3: many levels, in the order of ids and salted
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 460)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        f, g = find(a), find(b)
        root[max(f, g)] = min(f, g)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: find(k) for k in root if any(k in e and e[0] != e[1] for e in edges)}


def test_scratch_tables_are_removed(spark, corpus):
    own = util.Scratch()
    with own:
        done = util.written(ngram_join.ngram_join(table(spark, corpus)), "kept")
    outside = util.written(done, "outside")
    assert len(own.tables) > 3
    own.clear(spark)
    assert not own.tables and outside.count() == len(corpus)
    with pytest.raises(Exception):
        spark.read.parquet(done.inputFiles()[0])
