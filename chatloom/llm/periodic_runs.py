r"""Runs of repeating words, from the maximal pairs of each text.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` and 2 q words long, that no neighbour
extends. If words [i, i + l) and [j, j + l) are equal and can be extended neither to the left nor to the right (a *maximal
pair*) and q = j - i <= l, then [i, j + l) is a stretch of period q that can't be extended: the maximal pairs that meet
this and q + l >= ``LEAST`` are the runs, once for each multiple of the period that fits twice, of which the smallest is
kept. Nothing has to be extended afterwards.

1. l is at least half of ``LEAST``, so only places whose next ``LEAST``/2 words recur in their text are looked at. They are
   sorted by the words that follow (ranks doubled in depth within groups), which gives the part of the suffix array that
   matters; neighbours get their common prefix.
2. Groups of places that share these first words are left out if all of them follow one and the same word (no pair could be
   maximal to the left) or if their places lie further apart than their longest common prefix.
3. In the others the LCP-interval tree is walked bottom up. A node holds its places in order, and in a list for each word on
   the left (*class*). Where a child joins its siblings, the places of the smaller side look in the other side for places
   within l words and of another class; then the smaller lists go into the larger ones.

Texts are independent: nothing is shuffled, and a task works on buffers of about half a megabyte (a longer text is a buffer
of its own, as a run may span all of it: some 150 bytes for each of its words).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import carried, carried_kinds, crc32_of_id, documents, tidy, utf8, with_columns
from chatloom.llm.words import SPACE, VALUE, cuts, grams, mix, prefix, span, words

#: Words of the shortest run.
LEAST = 12
#: Bytes of texts that are worked on together.
BUFFER = 500_000


class Places:
    """Places of a node of the tree, in order, and by the word on their left."""

    def __init__(self, at: int, left: int) -> None:
        self.all = [at]
        self.by = {left: [at]}

    def absorb(self, other: Places) -> None:
        few = len(other.all) <= 8
        self.all = _joined(self.all, other.all, few)
        for left, own in other.by.items():
            self.by[left] = _joined(self.by[left], own, few) if left in self.by else own


def _joined(large: list[int], small: list[int], few: bool) -> list[int]:
    if few:
        for x in small:
            insort(large, x)
        return large
    return sorted(large + small)


def _meet(a: Places, b: Places, size: int, left: dict[int, int], least: int, found: dict[tuple[int, int], int]) -> Places:
    """Note the maximal pairs between two children of a node whose places share ``size`` words; the places of both."""
    small, large = (a, b) if len(a.all) <= len(b.all) else (b, a)
    if len(large.by) > 1 or large.by.keys() != small.by.keys():
        for own, places in small.by.items():
            for x in places:
                lo, hi = bisect_left(large.all, x - size), bisect_right(large.all, x + size)
                if hi - lo <= len(large.by):
                    near = [y for y in large.all[lo:hi] if left[y] != own]
                else:  # places of one class may fill the window, so they are passed over as a whole
                    near = [y for k, ys in large.by.items() if k != own for y in ys[bisect_left(ys, x - size) : bisect_right(ys, x + size)]]
                for y in near:
                    q = abs(x - y)
                    if q + size >= least:
                        key = (min(x, y), q + size)
                        if q < found.get(key, q + 1):
                            found[key] = q
    large.absorb(small)
    return large


def maximal_pairs(where: list[int], common: list[int], left: dict[int, int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Walk the LCP-interval tree of places in suffix order bottom up.

    ``common[k]`` is the common prefix of places k - 1 and k. ``found`` gets (start, length) -> smallest period.
    """
    stack: list[tuple[int, Places]] = []
    for k, at in enumerate(where):
        node = Places(at, left[at])
        size = common[k + 1] if k + 1 < len(where) else -1
        while stack and stack[-1][0] >= size:
            depth, held = stack.pop()
            node = _meet(held, node, depth, left, least, found)
            if depth == size:
                break
        stack.append((size, node))


def _suffixes(x: np.ndarray, owner: np.ndarray, end: np.ndarray, places: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in the order of (text, words that follow), and the number of the group that shares the first ``gram`` words.

    ``places`` must hold, with each place whose first ``gram`` words recur in its text, the place ``gram`` words on.
    """
    n = len(places)
    keys = [x[np.minimum(places + k, end[places])] for k in reversed(range(gram))]
    order = places[np.lexsort((*keys, owner[places]))]
    new = np.ones(n, bool)
    if n > 1:
        same = owner[order[1:]] == owner[order[:-1]]
        for k in range(gram):
            own = x[np.minimum(order + k, end[order])]
            same &= own[1:] == own[:-1]
        new[1:] = ~same
    base = np.cumsum(new)
    rank = np.zeros(len(x), np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    where = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = gram
    while len(where):
        p = order[where]
        both = rank[p] * (n + 1) + rank[p + depth]
        o = np.argsort(both, kind="stable")
        p, both = p[o], both[o]
        order[where] = p
        new = np.concatenate(([True], both[1:] != both[:-1]))
        first = np.flatnonzero(new)
        rank[p] = np.repeat(where[first], np.diff(np.append(first, len(p))))
        where = where[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, base


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that follow both at places a and b, by hashes of stretches whose length is halved again and again."""
    room = np.minimum(end[a] - a, end[b] - b)
    size = np.zeros(len(a), np.int64)
    step = 1 << (int(room.max(initial=1)).bit_length() - 1) if len(a) else 0
    while step:
        todo = np.flatnonzero(size + step <= room)
        s, t = a[todo] + size[todo], b[todo] + size[todo]
        same = span(sums, s, s + step) == span(sums, t, t + step)
        size[todo[same]] += step
        step //= 2
    return size


def text_runs(letters: np.ndarray, at: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, in order; ``letters`` are the words' hashes, text r has words at[r]:at[r + 1]."""
    gram = max((least + 1) // 2, 1)
    hashes, begin = grams(letters, at, gram)
    if not len(begin):
        return []
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    key = mix(hashes + mix(row[begin].astype(np.uint64) + np.uint64(1)))
    o = np.argsort(key)
    same = key[o[1:]] == key[o[:-1]]
    twice = np.zeros(len(key), bool)
    twice[o[1:][same]] = twice[o[:-1][same]] = True
    again = begin[twice]
    if not len(again):
        return []
    # each text gets an end of its own behind its words, a letter that is no word
    owner = np.repeat(np.arange(len(count)), count + 1)
    x = np.zeros(len(letters) + len(count), np.uint64)
    x[np.arange(len(letters)) + row] = np.maximum(letters, np.uint64(1))
    end = (at[1:] + np.arange(len(count)))[owner]
    again = again + row[again]
    order, base = _suffixes(x, owner, end, np.union1d(again, again + gram), gram)

    left = np.where(order > 0, x[np.maximum(order - 1, 0)], np.uint64(0))
    first = np.flatnonzero(np.concatenate(([True], base[1:] != base[:-1])))
    inside = np.concatenate(([False], base[1:] == base[:-1]))
    differ = np.concatenate(([False], left[1:] != left[:-1])) & inside
    keep = np.repeat(np.add.reduceat(differ, first) > 0, np.diff(np.append(first, len(base))))
    order, base, left, inside = order[keep], base[keep], left[keep], inside[keep]
    if not len(order):
        return []
    common = np.zeros(len(order), np.int64)
    pair = np.flatnonzero(inside)
    common[pair] = _common(prefix(x), order[pair - 1], order[pair], end)
    first = np.flatnonzero(~inside)
    by_place = order[np.lexsort((order, base))]
    gap = np.full(len(order), len(x))
    gap[pair] = by_place[pair] - by_place[pair - 1]
    close = np.minimum.reduceat(gap, first) <= np.maximum.reduceat(common, first)
    edges = np.append(first, len(order))
    found: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(close).tolist():
        lo, hi = int(edges[k]), int(edges[k + 1])
        where = order[lo:hi].tolist()
        maximal_pairs(where, common[lo:hi].tolist(), dict(zip(where, left[lo:hi].tolist())), least, found)
    begins = at[:-1] + np.arange(len(count))
    out = []
    for (start, size), q in sorted(found.items()):
        r = int(owner[start])
        out.append((r, start - int(begins[r]), size, q))
    return out


def collapse_runs(docs: DataFrame, least: int = LEAST, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; runs are (start, length, period) in words, by start and period.

    Words are parted by ASCII white space and compared byte by byte (by 64-bit hashes). ``collapsed`` are the words that are
    left, joined by one space, if every run keeps its first period. Null and empty texts have no words, no runs and an
    empty ``collapsed``; a text of fewer words than ``least`` has no run; runs may overlap, and of stretches with equal ends
    the smallest period counts; very long texts are worked on whole; repeated rows and null ids are ordinary rows; an
    empty table gives none. Columns named in ``carry`` are passed through, others are ignored.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data, offsets = utf8(whole, "text")
            code = np.frombuffer(data, np.uint8)
            for a, b in cuts(offsets, BUFFER):
                batch = whole.slice(a, b - a)
                own = offsets[a : b + 1] - offsets[a]
                part = code[offsets[a] : offsets[b]]
                s, e, at = words(part, own, SPACE)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                for r, start, size, q in text_runs(span(prefix(VALUE[part]), s, e), at, least):
                    runs[r].append((start, size, q))
                kept = []
                for k in range(b - a):
                    said = bytes(data[offsets[a + k] : offsets[a + k + 1]]).split()
                    if runs[k]:
                        stays = np.ones(len(said), bool)
                        for start, size, q in runs[k]:
                            stays[start + q : start + size] = False
                        said = compress(said, stays.tolist())
                    kept.append(b" ".join(said))
                answer = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(at)), pa.array([[dict(zip(("start", "length", "period"), x)) for x in own] for own in runs], pa.list_(kind)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                yield with_columns(answer, batch, carry)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried(docs, carry))
    shape = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts.mapInArrow(tidy(run), shape + carried_kinds(docs, carry))


def digests(found: DataFrame) -> DataFrame:
    """One row for each of :func:`collapse_runs`: number of runs, the longest one (ties: smallest start, then period), digests."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("_longest", longest)
    size, q = -F.col("_longest.n"), F.col("_longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_longest.start").alias("start"), size.alias("length"), q.alias("period"), F.floor(size * 1000 / q).cast("long").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth (by the checksum of its id) repeats a stretch of its words up to its end."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = crc32_of_id(F.col("doc_id"))
    rows = docs.select("doc_id", text.alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    said = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("w", said).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), _repeated(F.col("w"), F.col("n"), F.col("a"), F.col("p"))).otherwise(F.col("text")).alias("text"))


def _repeated(w: Column, n: Column, a: Column, p: Column) -> Column:
    whole = lambda c: c.cast("int")
    often = F.ceil((n - a) / p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, whole(a + 1), whole(p)), whole(often))), F.lit(1), whole(n - a))
    return F.array_join(F.concat(F.slice(w, F.lit(1), whole(a)), tail), " ")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse_runs(planted(documents(spark, sf_dir).select("doc_id", "text"))))
