"""Removal of repeated passages with suffix arrays over shards.

A passage of ``length`` bytes that starts at two places is repeated. The work is cut so that equal passages meet without
all pairs of shards being compared:

1. Every start is given to the k-gram of smallest hash inside its passage (its *anchor*); runs of starts with one anchor
   form a *stretch*. Equal passages have equal anchors, so only stretches with one anchor hash can share a passage.
2. Stretches that are equal as a whole are settled by counting. Stretches with an anchor that differs otherwise are read
   from the texts, once for each distinct stretch.
3. They are dealt to shards by anchor. A shard's suffix array comes from Larsson-Sadakane refinement (ranks doubled in
   depth within the groups that are not yet singletons), its common prefixes from Kasai's rule in the form for arrays: a
   position whose left neighbours agree inherits its predecessor's prefix less one, only the others are compared.
   Starts of one run of prefixes >= ``length`` are one passage.
4. An anchor with more stretches than a shard holds is split over several shards. Each of these gives its distinct
   passages as a sorted run, cut by binary search at the borders of digest ranges (one range for every ``RUNS`` shards);
   the cuts of a range meet in one task and are merged by binary search.

Hashes are 64-bit; passages across shards are compared by 128-bit digests.

Passages may also be counted in words (``repeated_words``): windows of so many words meet by the run of ``WORD_GRAM``
words of smallest hash inside them. Stretches of windows are settled by counting too, and only the windows of unlike ones
whose run occurs twice are compared, by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import carried, carried_kinds, documents, grouped, tidy, utf8, with_columns, written
from chatloom.llm.words import SPACE, VALUE, cuts, mix, prefix, span, words

LENGTH = 400
GRAM = 32
#: Words of the shortest passage that op1 cuts in ``cut_text``, whatever its bytes.
PASSAGE = 51
#: Words of the run by which windows of words meet.
WORD_GRAM = 8
#: Bytes of stretches in one suffix array.
SHARD = 600_000
#: Stretches of one anchor that go to one shard.
SPLIT = 512
#: Shards of a split anchor whose runs fall into one digest range.
RUNS = 8
_RUN = np.dtype([("digest", "S16"), ("row", "<i8"), ("first", "<i4"), ("known", "?")])
#: Texts longer than this are cut into overlapping pieces before their anchors are sought.
PIECE = 1_000_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a buffer of texts: row, first start, last start (in the text), anchor hash, content hash."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix(VALUE[data])
    at = np.arange(n - gram + 1)
    h = span(sums, at, at + gram)
    # the leftmost smallest hash: the place stands in the low bits, so ties go to the left
    key = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    width = length - gram + 1
    low, size = key, 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - length + 1], low[width - size : width - size + n - length + 1])
    anchor = (low[: n - length + 1] & np.uint64((1 << 24) - 1)).astype(np.int64)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - offsets[:-1], count)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = anchor[start]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (row[1:] != row[:-1]))))
    tail = np.append(head[1:], len(start)) - 1
    s, e, r, p = start[head], start[tail], row[head], a[head]
    content = mix(span(sums, s, e + length) + (p - s).astype(np.uint64))
    return r, s - offsets[r], e - offsets[r], h[p], content


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of buffers; a very long text comes in overlapping pieces."""
    for a, b in cuts(offsets, 500_000):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= PIECE:
            yield a, b, low, high
        else:
            for s in range(low, max(high - length + 1, low + 1), PIECE):
                yield a, b, s, min(s + PIECE + length - 1, high)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: order by 7 bytes, then double the depth inside the groups that are left."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(8)
        key[: n - k] += text[k:].astype(np.uint64) + np.uint64(0)
    # shorter suffixes come first: the number of bytes there are stands in the lowest byte
    key = (key << np.uint64(8)) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank[order] = group
    where = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of the array in groups that are not singletons
    depth = 7
    while len(where):
        p = order[where]
        follow = p + depth
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        # members of a group stand together, so sorting by (group, second) keeps every group in its place
        g = rank[p]
        both = g * (n + 2) + second
        o = np.argsort(both, kind="stable")
        p = p[o]
        order[where] = p
        both = both[o]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        starts = where[np.flatnonzero(new)]
        fresh = np.repeat(starts, np.diff(np.append(np.flatnonzero(new), len(both))))
        rank[p] = fresh
        keep = ~(new & np.append(new[1:], True))
        where = where[keep]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, cut off at ``most``.

    Kasai's rule in text order: where the bytes before a suffix and before its neighbour agree, their prefixes are one
    shorter than those of the previous position. The other positions are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    agree = np.zeros(n, bool)
    agree[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (text[np.maximum(before[1:] - 1, 0)] == text[:-1])
    todo = np.flatnonzero(~agree)
    todo = todo[before[todo] >= 0]
    size = np.zeros(n, np.int64)
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate((text, np.zeros(16, np.uint8))).astype(np.uint64)
    for k in range(8):
        words |= padded[k : n + 8 + k] << np.uint64(8 * k)
    # a position that inherits may lie far from the one that is compared, so those are compared to most + the way
    reach = np.diff(np.append(np.flatnonzero(~agree), n))
    limit = np.zeros(n, np.int64)
    limit[np.flatnonzero(~agree)] = most + reach
    left = todo
    while len(left):
        a, b = left + size[left], before[left] + size[left]
        room = n - np.maximum(a, b)
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) // 8)
        same = np.minimum(same, room)
        size[left] += same
        left = left[(same == 8) & (size[left] < limit[left])]
    base = np.maximum.accumulate(np.where(agree, 0, own))
    out = np.where(agree, np.maximum(size[base] - (own - base), 0), size)
    return np.minimum(out, most)[order]


def shard_classes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class number of the passage at each start: equal numbers, equal passages."""
    order = suffix_array(text)
    size = common_prefixes(text, order, length)
    label = np.empty(len(text), np.int64)
    label[order] = np.cumsum(size < length)
    return label[starts]


def _stretches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch, "text")
            code = np.frombuffer(data, np.uint8)
            ids = batch.column(0)
            for a, b, low, high in pieces(offsets, length):
                own = np.clip(offsets[a : b + 1], low, high) - low
                row, s, e, anchor, content = anchors(code[low:high], own, length, gram)
                shift = np.maximum(low - offsets[a:b], 0)[row]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(row)), pa.array((s + shift).astype(np.int32)), pa.array((e + shift).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["row", "first", "last", "anchor", "content"],
                )

    return texts.mapInArrow(tidy(run), "row long, first int, last int, anchor long, content long")


def _bodies(asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches asked for of every text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                data, offsets = utf8(batch, "text")
                lists = batch.column(2)
                flat = lists.flatten()
                owner = np.asarray(pa.compute.list_parent_indices(lists))
                s = np.asarray(flat.field(1)) + offsets[owner]
                e = np.asarray(flat.field(2)) + offsets[owner] + length
                body = pa.array([bytes(data[x:y]) for x, y in zip(s.tolist(), e.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(flat.field(k) for k in range(6)), body], names)

    names = ["row", "anchor", "first", "last", "times", "kinds", "content", "body"]
    return asked.select("row", "text", "asked").mapInArrow(tidy(run), "row long, anchor long, first int, last int, times long, kinds long, content long, body binary")


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of closed ranges of starts."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1] + 1))
    return first[new], np.append(last[np.flatnonzero(new)[1:] - 1], last[-1])


def _without(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """The union of closed ranges as (start, end), and what is left of the text."""
    if not len(first):
        return [], text
    first, last = _ranges(first, last)
    own = list(zip(first.tolist(), (last + 1).tolist()))
    edges = [0, *(x for s in own for x in s), len(text)]
    return own, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _search(stretches: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated starts within shards, and cut runs of split anchors that are still to be merged.

    Input rows: anchor, salt, parts (shards of the anchor), row, first, last, times, body. Output kind 0: repeated starts
    (row, first, last); kind 1: the part of a sorted run that falls into a digest range (anchor, part, run).
    """

    def classes(held: list) -> Iterator[tuple]:
        text = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
        base = np.cumsum([0, *(len(h[5]) for h in held)])[:-1]
        count = np.array([h[3] - h[2] + 1 for h in held])
        owner = np.repeat(np.arange(len(held)), count)
        starts = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - base, count)
        label = shard_classes(text, starts, length)
        times = np.array([h[4] for h in held])
        _, back = np.unique(label, return_inverse=True)
        weight = np.bincount(back, np.minimum(times, 2)[owner])
        twice = (weight[back] >= 2) & (times[owner] < 2)
        at = starts - base[owner] + np.array([h[2] for h in held])[owner]
        row = np.array([h[1] for h in held])
        if twice.any():
            o, p = owner[twice], at[twice]
            new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1))))
            end = np.append(new[1:], len(p)) - 1
            yield from zip([0] * len(new), row[o[new]].tolist(), p[new].tolist(), p[end].tolist(), [None] * len(new), [None] * len(new), [None] * len(new))
        parts = np.array([h[6] for h in held])
        split = np.flatnonzero(parts[owner] > 1)
        for anchor in {held[k][0] for k in np.unique(owner[split]).tolist()}:
            mine = np.array([h[0] == anchor for h in held])
            todo = split[mine[owner[split]]]
            _, one = np.unique(back[todo], return_index=True)
            todo = todo[one]
            sequence = np.empty(len(todo), _RUN)
            sequence["digest"] = [hashlib.blake2b(text[k : k + length].tobytes(), digest_size=16).digest() for k in starts[todo].tolist()]
            sequence["row"], sequence["first"], sequence["known"] = row[owner[todo]], at[todo], weight[back[todo]] >= 2
            # S16 drops zero bytes at the end, which keeps digests of one passage equal and the order the same
            sequence = np.sort(sequence, order="digest")
            ranges = -(-int(parts[owner[todo[0]]]) // RUNS)
            borders = np.array([(k * (1 << 32) // ranges).to_bytes(4, "big") for k in range(1, ranges)], "S16")
            cuts_at = [0, *np.searchsorted(sequence["digest"], borders).tolist(), len(sequence)]
            for k, (x, y) in enumerate(zip(cuts_at, cuts_at[1:])):
                if y > x:
                    yield 1, None, None, None, int(anchor), k, sequence[x:y].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        key = None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if size >= SHARD and (r[0], r[1]) != key:
                    yield _found(list(classes(held)))
                    held, size = [], 0
                key = (r[0], r[1])
                held.append((r[0], r[3], r[4], r[5], r[6], r[7], r[2]))
                size += len(r[7])
        if held:
            yield _found(list(classes(held)))

    return stretches.select("anchor", "salt", "parts", "row", "first", "last", "times", "body").mapInArrow(tidy(run), "kind int, row long, first int, last int, anchor long, part int, run binary")


def _found(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "row", "first", "last", "anchor", "part", "run"])


def _merge(runs: DataFrame) -> DataFrame:
    """(row, ranges) of starts whose passage also stands in another shard of its anchor."""

    def merge(t: pa.Table) -> pa.Table:
        cut = [np.frombuffer(r, _RUN) for r in t.column("run").to_pylist()]
        whole = np.sort(np.concatenate([c["digest"] for c in cut]))
        hit = [c[(np.searchsorted(whole, c["digest"], "right") - np.searchsorted(whole, c["digest"]) > 1) & ~c["known"]] for c in cut]
        found = np.concatenate(hit)
        found = found[np.lexsort((found["first"], found["row"]))]
        row, first = found["row"].astype(np.int64), found["first"].astype(np.int32)
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)))[: len(row)])
        end = np.append(new[1:], len(row))[: len(new)] - 1
        owner = row[new]
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)])
        pairs = pa.StructArray.from_arrays([pa.array(first[new]), pa.array(first[end])], ["first", "last"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)).astype(np.int32)), pairs)
        return pa.table({"row": pa.array(owner[at]), "ranges": lists})

    return grouped(runs.select("anchor", "part", "run"), ["anchor", "part"], merge, "row long, ranges array<struct<first:int,last:int>>")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, ranges): ranges of starts whose passage also starts elsewhere; ``texts`` has (row, text)."""
    stretches = written(_stretches(texts, length, gram), "anchors")  # read three times
    # one row for each distinct stretch, with how often it occurs and one place of it
    distinct = stretches.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "last")).alias("one"))
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("times").alias("most")).filter("kinds > 1 or most > 1")
    kept = written(distinct.join(kinds, "anchor").select("anchor", "content", "times", "kinds", "one.row", "one.first", "one.last"), "stretches")
    equal = kept.filter("times > 1").select("anchor", "content")
    whole = stretches.join(equal, ["anchor", "content"]).select("row", "first", "last")

    unlike = kept.filter("kinds > 1")
    asked = unlike.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last", "times", "kinds", "content")).alias("asked"))
    parts = F.ceil(F.col("kinds") / SPLIT).cast("int")
    # rows that are equal in id and text hold the same bytes: one of them is read
    cut = _bodies(asked.join(texts.dropDuplicates(["row"]), "row"), length).withColumn("parts", parts).withColumn("salt", F.pmod("content", "parts").cast("int"))
    found = written(_search(cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt"), length), "found")
    inside = found.filter("kind = 0").select("row", "first", "last")
    across = written(_merge(found.filter("kind = 1")), "across")  # apart from the joins below, whose hot keys are split
    single = whole.unionByName(inside).select("row", F.array(F.struct("first", "last")).alias("ranges"))
    return single.unionByName(across).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def windows(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows of ``size`` words, in order: row, first byte, byte after the last (in the text), content hash, and the
    place (word of the buffer) and hash of the leftmost run of ``gram`` words of smallest hash inside."""
    s, e, at = words(data, offsets, SPACE)
    count = np.maximum(np.diff(at) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - at[:-1], count)
    if not len(begin):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    sums = prefix(span(prefix(VALUE[data]), s, e))
    where = np.arange(len(s) - gram + 1)
    least = span(sums, where, where + gram)
    # stretches of runs double in width; runs that reach into another text lie in no window that is read below
    width, wide = size - gram + 1, 1
    while wide < width:
        step = min(wide, width - wide)
        less = least[step:] < least[:-step]
        where, least = np.where(less, where[step:], where[:-step]), np.minimum(least[:-step], least[step:])
        wide += step
    return row, s[begin] - offsets[row], e[begin + size - 1] - offsets[row], span(sums, begin, begin + size), where[begin], least[begin]


def repeated_words(texts: DataFrame, size: int, gram: int = WORD_GRAM) -> DataFrame:
    """(row, passages): first and last bytes of windows of ``size`` words (or of runs of them) that also stand elsewhere;
    ``texts`` has (row, text).

    Words are parted by white space and compared byte by byte; the white space between them may differ. Windows in a row
    that meet by one place form a stretch; equal stretches are settled by counting, and only those whose run of ``gram``
    words also stands in another one are taken apart, one of each kind.
    """
    gram = min(gram, size)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch, "text")
            code = np.frombuffer(data, np.uint8)
            for a, b in cuts(offsets, 500_000):
                row, first, end, content, where, least = windows(code[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, gram)
                head = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))[: len(where)])
                tail = np.append(head[1:], len(where))[: len(head)]
                stretch = span(prefix(content), head, tail)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + row[head])), pa.array(first[head].astype(np.int32)), pa.array((end[tail - 1] - 1).astype(np.int32)), pa.array(least[head].view(np.int64)), pa.array(stretch.view(np.int64))],
                    ["row", "first", "last", "anchor", "content"],
                )

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                data, offsets = utf8(batch, "text")
                lists = batch.column(2)
                flat = lists.flatten()
                owner = np.asarray(pa.compute.list_parent_indices(lists))
                begin, times = np.asarray(flat.field(0)), np.asarray(flat.field(2))
                s = offsets[owner] + begin
                e = offsets[owner] + np.asarray(flat.field(1)) + 1
                at = np.concatenate(([0], np.cumsum(e - s)))
                for a, b in cuts(at, 500_000):
                    # a stretch holds its own windows and no others, so each is a text here
                    code = np.frombuffer(b"".join(data[x:y] for x, y in zip(s[a:b].tolist(), e[a:b].tolist())), np.uint8)
                    k, first, end, content, _, _ = windows(code, at[a : b + 1] - at[a], size, gram)
                    k = a + k
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner[k])), pa.array((begin[k] + first).astype(np.int32)), pa.array((begin[k] + end - 1).astype(np.int32)), pa.array(content.view(np.int64)), pa.array(times[k])],
                        ["row", "first", "last", "content", "times"],
                    )

    stretches = written(texts.mapInArrow(tidy(runs), "row long, first int, last int, anchor long, content long"), "word-stretches")
    # what occurs twice is written, so that the joins with hot keys have a shuffle of their own, which Spark splits
    shared = written(stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared")
    met = written(stretches.join(shared, "anchor"), "met")
    distinct = met.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "last")).alias("one"))
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    kept = written(distinct.join(kinds, "anchor").select("anchor", "content", "times", "kinds", "one.row", "one.first", "one.last"), "word-kinds")
    equal = met.join(kept.filter("times > 1").select("anchor", "content"), ["anchor", "content"]).select("row", "first", "last")

    asked = kept.filter("kinds > 1").groupBy("row").agg(F.collect_list(F.struct("first", "last", F.least("times", F.lit(2)).alias("times"))).alias("asked"))
    read = asked.join(texts.dropDuplicates(["row"]), "row").select("row", "text", "asked")
    found = written(read.mapInArrow(tidy(inside), "row long, first int, last int, content long, times long"), "windows")
    twice = written(found.groupBy("content").agg(F.sum("times").alias("n")).filter("n > 1").select("content"), "twice")
    unlike = found.filter("times = 1").join(twice, "content").select("row", "first", "last")
    return equal.unionByName(unlike).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("passages"))


def kept_text(kept: Column) -> Column:
    """Remaining bytes as text; the rest of a character whose other bytes were removed is dropped."""
    text = kept.cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.replace(F.make_valid_utf8(text), F.lit("\uFFFD"), F.lit("")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, size: int | None = None, apart: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every row.

    Texts are UTF-8 bytes (null: empty); passages never cross documents; a text shorter than ``length`` keeps all.
    ``kept`` are the remaining bytes, ``spans`` the removed (start, end). Rows are told apart by a 64-bit hash of id and
    text, so repeated rows (which remove each other), ties and null ids are ordinary cases; very long texts are worked on in
    pieces, and an empty table gives none. Columns named in ``carry`` are
    passed through, others are ignored. ``size``: repeated passages of so many words are removed too, if shorter as well.
    ``apart``: those passages don't count in the columns above, but in further ones: n_passages (maximal stretches of them),
    n_cut (bytes removed by either rule) and cut (the bytes that remain).
    """
    whole_text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text.alias("text"), *carried(docs, carry)).withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(texts.filter(F.octet_length("text") >= length).select("row", "text"), length, gram)
    passages = F.array().cast("array<struct<first:int,last:int>>")
    if size:
        # a passage has a byte for each word, and one between two words
        ranges = ranges.join(repeated_words(texts.filter(F.octet_length("text") >= 2 * size - 1).select("row", "text"), size), "row", "full")
    else:
        ranges = ranges.withColumn("passages", passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                data, offsets = utf8(batch, "text")
                lists = batch.column(2)
                first_all = np.asarray(lists.flatten().field(0))
                last_all = np.asarray(lists.flatten().field(1))
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                at = np.concatenate(([0], np.cumsum(sizes)))
                said = batch.column(3)
                removed, spans, digest, kept, found = [], [], [], [], []
                stretches, gone, cut = [], [], []
                for k in range(batch.num_rows):
                    whole_bytes = bytes(data[offsets[k] : offsets[k + 1]])
                    more = said[k].values
                    f, t = first_all[at[k] : at[k + 1]], last_all[at[k] : at[k + 1]] + length - 1
                    both_f, both_t = (np.append(f, np.asarray(more.field(0))), np.append(t, np.asarray(more.field(1)))) if more else (f, t)
                    own, text = _without(whole_bytes, *((f, t) if apart else (both_f, both_t)))
                    removed.append(sum(b - a for a, b in own))
                    spans.append(len(own))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                    found.append([{"start": a, "end": b} for a, b in own])
                    if apart:
                        both, rest = _without(whole_bytes, both_f, both_t) if more else (own, text)
                        stretches.append(len(_ranges(both_f[len(f) :], both_t[len(f) :])[0]) if more else 0)
                        gone.append(sum(b - a for a, b in both))
                        cut.append(rest)
                answer = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(offsets[1:] - offsets[:-1]),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()),
                        pa.array(digest),
                        pa.array(kept, pa.binary()),
                        pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        *([pa.array(stretches, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, pa.binary())] if apart else []),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", *(["n_passages", "n_cut", "cut"] if apart else [])],
                )
                yield with_columns(answer, batch, carry)

    further = ", n_passages long, n_cut long, cut binary" if apart else ""
    joined = texts.join(ranges, "row", "left").select("doc_id", "text", "ranges", F.coalesce("passages", passages).alias("passages"), *[f"carry_{n}" for n in carry or []])
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>" + further + carried_kinds(docs, carry))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``text`` go by 400 bytes alone. ``n_passages``, ``n_cut`` and ``cut_text`` tell and cut
    repeated passages of more than 50 words too, many of which are shorter than 400 bytes."""
    found = remove_repeats(documents(spark, sf_dir), size=PASSAGE, apart=True)
    contract = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return found.select(*contract, kept_text(F.col("kept")).alias("text"), "n_passages", "n_cut", kept_text(F.col("cut")).alias("cut_text"))
