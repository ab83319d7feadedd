"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures (Arasu, Ganti, Kaushik 2006).

Sets are put into size bands. Within the instance of a band, sets that are similar enough differ in at most k features.
The feature domain (shingle hashes) is cut into groups, each group into ``PARTS`` ranges, and a group's signatures are the
features in every subset of ``PARTS`` - 1 of its ranges. A group with at most one difference has a subset without any.
Call a group full if the set has features in two of its ranges. Up to the first group that is full for either of two
similar sets and holds at most one difference, every full group holds two or more, so that group is among the first
k // 2 + 1 full groups of both: up to there a set is given signatures, and no link is lost. A set with too few full groups
is hashed anew until it has enough; sets that never have share a signature.

The map side combines: signatures that meet within a batch are known to be shared, and only one of them goes on. Shared
signatures then propose links. First every signature's sets are compared with one leader, the one with most shared
signatures (what others were copied from has the most), so a large group of near copies costs as many comparisons as it
has members. Of what isn't in one component by then, small signatures are compared in all pairs of components; in large
ones, compared in blocks, first a forest of the pairs that are likeliest by their sketches, then all that is still apart. A
1024-bit parity sketch and the sizes exclude pairs exactly; links are decided on the shingles of both texts.

Shingles are compared by 54-bit hashes in a text and sets by 64-bit hashes of their shingles; signatures are cut to 40 bits
in a bucket, which may only propose more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import components, documents, grouped, local_roots, tidy, utf8, written
from chatloom.llm.words import SPACE, cuts, mix, word_hashes

WORDS = 4
PERCENT = 85
_BITS = 54
_MASK = np.uint64((1 << _BITS) - 1)
_ROUNDS = 16
SKETCH = 1024
#: Ranges of a group of features; subsets of all but one are signatures.
PARTS = 3
#: Bits of a signature besides its bucket.
_SIGNATURE = np.uint64(40)
#: Signature groups up to this size are compared by a join, larger ones in blocks.
SMALL = 48
BLOCK = 2048


def bands(percent: int, most: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, groups) of each band up to ``most``; no groups: sets must be equal."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 100 * 100 // (percent * percent), 6)
        k = differences(2 * high, percent)
        full = k // 2 + 1
        out.append((low, high, 0 if k == 0 else full + 1 + full // 16))
        low = high + 1
    return out


def differences(total: int, percent: int) -> int:
    """The most features by which two similar sets of ``total`` features together can differ."""
    return (100 - percent) * total // (100 + percent)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct (row << 54 | 54-bit hash) of every text; at most 1023 texts."""
    hashes, at = word_hashes(data, offsets, SPACE)
    size = np.diff(at)
    keys = []
    full = np.flatnonzero(size >= n)
    if len(full):
        row = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
        count = np.maximum(size - n + 1, 0)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - at[:-1], count)
        h = np.zeros(len(row), np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(3) + hashes[begin + k] + np.uint64(k + 1))
        keys.append((row.astype(np.uint64) << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
    for r in np.flatnonzero((size > 0) & (size < n)).tolist():
        h = np.zeros(1, np.uint64)
        for w in hashes[at[r] : at[r + 1]]:
            h = mix(h * np.uint64(3) + w + np.uint64(77))
        keys.append((np.uint64(r) << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
    if not keys:
        return np.empty(0, np.uint64)
    keys = np.sort(np.concatenate(keys))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def set_facts(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: set size, 64-bit name of the set, parity sketch."""
    row = (keys >> np.uint64(_BITS)).astype(np.int64)
    size = np.bincount(row, minlength=rows)
    name = np.zeros(rows, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        first = np.concatenate(([0], np.cumsum(size[full])[:-1]))
        name[full] = mix(np.add.reduceat(mix((keys & _MASK) + np.uint64(1)), first) + size[full].astype(np.uint64))
    parity = np.bincount(row * SKETCH + (keys & np.uint64(SKETCH - 1)).astype(np.int64), minlength=rows * SKETCH).reshape(rows, SKETCH) & 1
    return size, name, np.packbits(parity.astype(np.uint8), axis=1)


def signatures(keys: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit signature) pairs of every row with a set."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    table_ = bands(percent, int(size.max()) * 100 // percent + 1)
    high = np.array([b[1] for b in table_])
    groups = np.array([b[2] for b in table_])
    own = np.searchsorted(high, size)
    reach = np.searchsorted(high, size * 100 // percent)
    out_row, out_sig = [], []
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    for step in range(int((reach - own).max()) + 1):
        rows = np.flatnonzero((size > 0) & (own + step <= reach))
        band = own[rows] + step
        whole = groups[band] == 0
        if whole.any():
            r = rows[whole]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((keys & _MASK) + np.uint64(3)), dtype=np.uint64)))
            out_row.append(r)
            out_sig.append(mix(sums[first[r] + size[r]] - sums[first[r]] + mix(np.uint64(0xE9) + band[whole].astype(np.uint64))))
            rows, band = rows[~whole], band[~whole]
        need = differences_array(size[rows] + np.minimum(size[rows] * 100 // percent, high[band]), percent) // 2 + 1
        count = size[rows]
        for attempt in range(_ROUNDS + 1):
            if not len(rows):
                break
            if attempt == _ROUNDS:
                out_row.append(rows)
                out_sig.append(mix(np.uint64(0xFE11) + band.astype(np.uint64)))
                break
            total = int(count.sum())
            local = np.repeat(np.arange(len(rows)), count)
            place = np.arange(total) - np.repeat(np.cumsum(count) - count - first[rows], count)
            h = keys[place] & _MASK
            if attempt:
                h = mix(h + np.uint64(attempt * 7919)) >> np.uint64(64 - _BITS)
                order = np.lexsort((h, local))
                h = h[order]
            part = ((h >> np.uint64(22)) * (groups[band] * PARTS)[local].astype(np.uint64)) >> np.uint64(_BITS - 22)
            at = np.flatnonzero(np.concatenate(([True], (local[1:] != local[:-1]) | (part[1:] != part[:-1]))))
            range_sum = np.add.reduceat(mix(h + np.uint64(3)), at)
            range_of, owner = part[at], local[at]
            group = range_of // np.uint64(PARTS)
            head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]))))
            ranges = np.diff(np.append(head, len(at)))
            # sums of the ranges of each group side by side, empty ones as zero
            sums = np.zeros((len(head), PARTS), np.uint64)
            sums[np.repeat(np.arange(len(head)), ranges), (range_of % np.uint64(PARTS)).astype(np.int64)] = range_sum
            group, owner = group[head], owner[head]
            full = (ranges > 1).astype(np.int64)
            before = np.cumsum(full) - full
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            before -= np.repeat(before[start], np.diff(np.append(start, len(owner))))
            number = np.bincount(owner, full, len(rows)).astype(np.int64)
            enough = number >= need
            # a row that will be hashed anew still gives what it has: its partner may have enough
            kept = before < need[owner]
            for left in range(PARTS):
                rest = [k for k in range(PARTS) if k != left]
                some = np.flatnonzero(kept & (sums[:, rest] != 0).any(axis=1))
                tag = mix((band[owner[some]].astype(np.uint64) << np.uint64(40)) + (group[some] << np.uint64(12)) + np.uint64(attempt * PARTS + left))
                value = np.zeros(len(some), np.uint64)
                for k in rest:
                    value = mix(value + sums[some, k] + np.uint64(k + 1))
                out_row.append(rows[owner[some]])
                out_sig.append(mix(value ^ tag))
            rows, band, need, count = rows[~enough], band[~enough], need[~enough], count[~enough]
    return np.concatenate(out_row), np.concatenate(out_sig)


def differences_array(total: np.ndarray, percent: int) -> np.ndarray:
    return (100 - percent) * total // (100 + percent)


#: Bytes of text whose signatures one bucket takes, which is about what they take themselves; a task holds a bucket.
BUCKET_BYTES = 64 << 20


def bucket_count(size: int, least: int) -> int:
    """Buckets of signatures for texts of so many bytes: a bucket stays one size however many texts there are."""
    return min(max(least, -(-size // BUCKET_BYTES)), 1 << 22)


FACTS = "kind int, doc_id long, size long, name long, sig long, sketch array<long>, blob binary, bucket int"


def _facts(texts: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Two kinds of rows: 0, a document (doc_id, size, name, hash of its text as sig, sketch); 1, a set that has a shared signature (sig, name).

    A signature goes to the bucket of its high bits; a batch sends each bucket one blob of (signature, set).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch, "text")
            code = np.frombuffer(data, np.uint8)
            sigs, names = [], []
            for low, high in cuts(offsets, 500_000):
                for a in range(low, high, 1000):
                    b = min(a + 1000, high)
                    keys = shingle_sets(code[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                    size, name, sketch = set_facts(keys, b - a)
                    spread = mix(name + np.arange(b - a).astype(np.uint64)) % np.uint64(buckets)
                    yield _batch(0, doc_id=batch.column(0).slice(a, b - a), size=size, name=name, sig=batch.column(2).slice(a, b - a).to_numpy().view(np.uint64), sketch=sketch, bucket=spread)
                    # one set of those that are equal within the batch
                    once = np.zeros(b - a, bool)
                    full = np.flatnonzero(size)
                    once[full[np.unique(name[full], return_index=True)[1]]] = True
                    row, sig = signatures(keys[once[(keys >> np.uint64(_BITS)).astype(np.int64)]], np.where(once, size, 0), percent)
                    sigs.append(((sig >> _SIGNATURE) % np.uint64(buckets) << _SIGNATURE) | (sig & ((np.uint64(1) << _SIGNATURE) - np.uint64(1))))
                    names.append(name[row])
            sig, name = (np.concatenate(sigs), np.concatenate(names)) if sigs else (np.empty(0, np.uint64), np.empty(0, np.uint64))
            sig, name, head, many = _met(sig, name)
            if many.any():
                yield from _shared(sig[many], name[many], buckets)
            sig, name = sig[head], name[head]
            order = np.lexsort((name, sig >> _SIGNATURE))
            sig, name = sig[order], name[order]
            bucket = (sig >> _SIGNATURE).astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(sig) else np.empty(0, np.int64)
            if len(at):
                blobs = [_packed(sig[i:j], name[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(sig)])]
                yield _batch(2, bucket=bucket[at], blob=blobs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            sig, name = (np.concatenate(c) for c in zip(*(_unpacked(blob, last) for blob in held)))
            sig, name, _, many = _met(sig, name)
            if many.any():
                yield from _shared(sig[many], name[many], 1)

        for batch in batches:
            blobs = np.asarray(batch.column(0)) == 2
            rest = batch.filter(pa.array(~blobs))
            if rest.num_rows:
                yield rest
            for blob, bucket in zip(*(batch.filter(pa.array(blobs)).column(k).to_pylist() for k in (6, 7))):
                if bucket != last and held:
                    yield from close()
                    held = []
                last = bucket
                held.append(blob)
        if held:
            yield from close()

    dealt = texts.mapInArrow(tidy(run), FACTS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(meet), FACTS)


def _met(sig: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order of the signature; which are the first of their signature, which have one of several sets."""
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    if len(sig):
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])))
        sig, name = sig[fresh], name[fresh]
    head = np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)]
    return sig, name, head, ~(head & np.append(head[1:], True)[: len(sig)])


def _packed(sig: np.ndarray, name: np.ndarray) -> bytes:
    """Pairs of one bucket in order of the set: number of sets, sets, signatures of each, five bytes a signature."""
    at = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    count = np.diff(np.append(at, len(name)))
    low = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :5]
    return np.array([len(at)], "<u4").tobytes() + name[at].astype("<u8").tobytes() + count.astype("<u4").tobytes() + low.tobytes()


def _unpacked(blob: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    sets = int(np.frombuffer(blob, "<u4", 1)[0])
    name = np.frombuffer(blob, "<u8", sets, 4)
    count = np.frombuffer(blob, "<u4", sets, 4 + 8 * sets)
    low = np.frombuffer(blob, np.uint8, offset=4 + 12 * sets).reshape(-1, 5)
    sig = np.zeros((len(low), 8), np.uint8)
    sig[:, :5] = low
    return sig.view("<u8")[:, 0] | (np.uint64(bucket) << _SIGNATURE), np.repeat(name, count)


def _batch(kind: int, doc_id=None, size=None, name=None, sig=None, sketch=None, blob=None, bucket=None) -> pa.RecordBatch:
    n = next(len(x) for x in (doc_id, name, bucket) if x is not None)
    whole = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x).astype(np.uint64).view(np.int64))
    words = SKETCH // 64
    listed = pa.nulls(n, pa.list_(pa.int64())) if sketch is None else pa.ListArray.from_arrays(pa.array(np.arange(0, n * words + 1, words, dtype=np.int32)), pa.array(np.ascontiguousarray(sketch).view("<i8").ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()) if doc_id is None else doc_id, whole(size), whole(name), whole(sig), listed, pa.array(blob or [None] * n, pa.binary()), pa.array(np.asarray(bucket).astype(np.int32))],
        ["kind", "doc_id", "size", "name", "sig", "sketch", "blob", "bucket"],
    )


def _shared(sig: np.ndarray, name: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(sig), 100_000):
        own = name[k : k + 100_000]
        yield _batch(1, sig=sig[k : k + 100_000], name=own, bucket=mix(own) % np.uint64(buckets))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Drop pairs that sizes or sketches exclude; columns a, b, size_a, size_b, sketch_a, sketch_b."""
    most = F.floor((100 - percent) * (F.col("size_a") + F.col("size_b")) / (100 + percent))
    apart = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH // 64)), F.lit(0))
    near = (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (apart <= most)
    return pairs.filter(near)


def _verified(pairs: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among pairs (a, b) of set names, decided on the texts of ``held`` (name, size, sketch, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def features(side: int, name: int, text: pa.Scalar) -> np.ndarray:
            """Those of the last text of each side are kept: rows come in the order of one of them."""
            if held.get(side, (None,))[0] != name:
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                held[side] = (name, shingle_sets(data, np.array([0, len(data)]), n))
            return held[side][1]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                x, y = features(0, a, ta), features(1, b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both * 100 >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    for side in ("a", "b"):
        own = held.select(F.col("name").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "sketch", "text")])
        pairs = pairs.join(own, side)
    return _possible(pairs, percent).select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def ngram_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_name) of every row.

    Words are parted by white space, A-Z in lower case; a text with fewer than ``n`` words is one shingle. Null and
    empty texts have an empty set and link with nothing. Rows with the same doc_id are nodes of their own by their set;
    rows with a null id keep a null component unless linked. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("thash", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    facts = written(_facts(texts, n, percent, bucket_count(size, int(spark.conf.get("spark.sql.shuffle.partitions")))), "facts")
    rows = facts.filter("kind = 0").select("doc_id", "size", "name", F.col("sig").alias("thash"), "sketch")
    named = rows.filter("size > 0")
    shared = facts.filter("kind = 1").groupBy("name").agg(F.collect_set("sig").alias("sigs"))
    one = named.groupBy("name").agg(F.min(F.struct("doc_id", "thash")).alias("one"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = written(shared.join(one, "name").select("name", "size", "sketch", "sigs", F.col("one.doc_id").alias("id"), F.col("one.thash").alias("th")), "sets")
    wanted = sets.select("name", "size", "sketch", "id", "th")
    held = written(texts.join(wanted, (F.col("thash") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("name", "size", "sketch", "text").dropDuplicates(["name"]), "texts")

    every = sets.select("name", F.size("sigs").alias("degree"), F.explode("sigs").alias("sig"))
    # written, so that the join on hot signatures has a shuffle of its own, which Spark splits; so below
    leaders = written(every.groupBy("sig").agg(F.max(F.struct("degree", "name"))["name"].alias("leader"), F.count(F.lit(1)).alias("n")), "leaders")
    members = written(every.join(leaders, "sig").select("sig", "name", "n", "leader"), "members")
    pairs = members.filter("name <> leader").select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct()
    links = written(_verified(pairs, held, n, percent), "links")
    state = components(links)

    # pairs that are still apart: of small signatures all, of large ones first the likeliest, then all
    for likeliest in (True, False):
        now = written(_open(members if likeliest else members.filter(F.col("n") > SMALL), state, sets), "open")
        small, large = now.agg(F.count(F.when(F.col("n") <= SMALL, 1)), F.count(F.when(F.col("n") > SMALL, 1))).first()
        if small + large == 0:
            break
        pairs = _joined(now.filter(F.col("n") <= SMALL), percent) if small else None
        if large:
            blocked = _blocked(now.filter(F.col("n") > SMALL), percent, likeliest)
            pairs = blocked if pairs is None else pairs.unionByName(blocked)
        found = written(_verified(pairs.distinct(), held, n, percent), "links")
        if found.head(1):
            state = components(state.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(found))
        if not large:
            break

    least = named.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    linked = least.join(state.select(F.col("id").alias("name"), F.col("component_id").alias("root")), "name", "left")
    linked = linked.withColumn("alone", F.col("root").isNull()).withColumn("root", F.coalesce("root", "name"))
    first = written(linked.filter("not alone").groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    answer = linked.join(first, "root", "left").select("name", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("name")).alias("name")).join(answer, "name", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("name").alias("set_name"),
    )


def _open(members: DataFrame, state: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of signatures whose sets are in more than one component, with the component, size and sketch."""
    placed = members.join(state.select(F.col("id").alias("name"), "component_id"), "name", "left").select("sig", "name", "n", F.coalesce("component_id", "name").alias("component"))
    several = written(placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig"), "several")
    return placed.join(several, "sig").join(sets.select("name", "size", "sketch"), "name")


def _joined(now: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in small signature groups that sizes and sketches don't exclude."""
    left, right = (now.select("sig", *[F.col(c).alias(f"{to}_{s}" if to else s) for c, to in (("name", ""), ("component", "component"), ("size", "size"), ("sketch", "sketch"))]) for s in ("a", "b"))
    return _possible(left.join(right, "sig").filter("a < b and component_a <> component_b"), percent).select("a", "b")


def _blocked(now: DataFrame, percent: int, likeliest: bool) -> DataFrame:
    """Pairs of different components in large signature groups, compared block by block on sizes and sketches.

    ``likeliest``: of each block only the forest of pairs, nearest sketches first, that would join its components.
    """

    def pairs(t: pa.Table) -> pa.Table:
        side = np.asarray(t.column("side"))
        name, comp, size = (np.asarray(t.column(c)) for c in ("name", "component", "size"))
        # numpy counts the bits of a negative number's absolute value, so the words are taken as unsigned
        sketch = np.asarray(t.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(name), -1)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        kinds, number = np.unique(comp, return_inverse=True)
        most = np.bincount(number).argmax()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        # members of the commonest component are compared with the others only
        parts = [(left[number[left] != most], right), (left[number[left] == most], right[number[right] != most])]
        out: list[tuple[np.ndarray, ...]] = []
        for own, other in parts:
            for k in range(0, len(own) if len(other) else 0, 64):
                some = own[k : k + 64]
                apart = np.zeros((len(some), len(other)), np.int64)
                for w in range(sketch.shape[1]):
                    apart += np.bitwise_count(sketch[some, w][:, None] ^ sketch[other, w][None, :])
                x, y = size[some][:, None], size[other][None, :]
                ok = (number[some][:, None] != number[other][None, :]) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent) & (apart <= (100 - percent) * (x + y) // (100 + percent))
                p, q = np.nonzero(ok)
                out.append((some[p], other[q], apart[p, q]))
        p, q, apart = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        if likeliest:
            order = np.argsort(apart, kind="stable")
            p, q = p[order], q[order]
            chosen = _forest(number[p], number[q])
            p, q = p[chosen], q[chosen]
        got = np.unique(np.stack((np.minimum(name[p], name[q]), np.maximum(name[p], name[q])), 1), axis=0)
        return pa.table({"a": got[:, 0].astype(np.int64), "b": got[:, 1].astype(np.int64)})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = now.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = own.select("sig", "name", "component", "size", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "name", "component", "size", "sketch")
    return grouped(placed, ["sig", "i", "j"], pairs, "a long, b long")


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of edges, given from the best to the worst, that join all that they can join: each tree takes its best edge."""
    chosen = [np.empty(0, np.int64)]
    at = np.arange(len(u))
    while len(at):
        ends = np.stack((u, v), 1).ravel()
        _, best = np.unique(ends, return_index=True)
        best = np.unique(best // 2)
        chosen.append(at[best])
        node, root = local_roots(u[best], v[best])
        u, v = (root[np.searchsorted(node, x)] for x in (u, v))
        left = u != v
        u, v, at = u[left], v[left], at[left]
    return np.concatenate(chosen)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
