"""Best-fit packing through the configuration linear program.

A *configuration* is a multiset of piece lengths that fits into one sequence. The linear program (as few configurations
as possible that cover the histogram of lengths) is solved approximately by multiplicative weights: every round prices
the lengths by how far they lag behind, and a knapsack dynamic program finds the dearest configuration. Its solution is
rounded down, then the largest fractions are rounded up where whole uses still fit. What is left is filled by exact subset
sums, longest piece first, or by best fit decreasing, whichever needs fewer sequences; then the worst filled sequences are
taken apart and packed again as long as that saves one. Best fit decreasing over the whole histogram is kept where it is
better still, so the result never needs more.

The solver sees the histogram alone: at most ``capacity`` rows whatever the corpus. Pieces are dealt to slots by their
rank among the pieces of their length, which Spark computes from counts of (length, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.pretokens import encoder, fold_crc
from chatloom.llm.token_counts import vocabulary
from chatloom.llm.util import documents, tidy, utf8, written

CAPACITY = 1024
ROUNDS = 160


def pieces(docs: DataFrame, path: str, words: bool, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token ids of each text and ``end_id``, cut where longer than capacity.

    A document of n ids gives ceil(n / capacity) pieces, all full but the first. Null text is empty (one piece of the
    end id alone); texts of any length are encoded whole. Null and repeated ids are ordinary (repeated rows have pieces of
    their own), an empty table gives none, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, words)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                data, offsets = utf8(batch, "text")
                ids, where = e.encode(data, offsets)
                doc, number, start, size, crc = [], [], [], [], []
                for k, d in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[where[k] : where[k + 1]], np.int32(end_id))
                    cut = len(own) - capacity * (-(-len(own) // capacity) - 1)
                    at = [0, *range(cut, len(own), capacity), len(own)]
                    for j, (a, b) in enumerate(zip(at, at[1:])):
                        doc.append(d)
                        number.append(j)
                        start.append(a)
                        size.append(b - a)
                        crc.append(fold_crc(own[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def priced(lengths: np.ndarray, weights: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration: bounded knapsack by dynamic programming over the capacity (binary splitting)."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for l, w, most in zip(lengths.tolist(), weights.tolist(), np.minimum(limits, capacity // lengths).tolist()):
        k = 1
        while most > 0:
            k = min(k, most)
            most -= k
            size = l * k
            better = best[:-size] + w * k
            gain = better > best[size:] + 1e-12
            if gain.any():
                mask = np.zeros(capacity + 1, bool)
                mask[size:] = gain
                best[size:] = np.where(gain, better, best[size:])
                taken.append((l, k, mask))
            k *= 2
    left, found = int(np.argmax(best)), {}
    for l, k, mask in reversed(taken):
        if mask[left]:
            found[l] = found.get(l, 0) + k
            left -= l * k
    return found


def filled(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest piece left and the pieces that best fill the rest (exact subset sum over bit sets)."""
    top = lengths[0]
    found = {top: 1}
    room = capacity - top
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for l in lengths:
        most = min(counts[l] - (l == top), room // l if l <= room else 0)
        k = 1
        while most > 0:
            k = min(k, most)
            most -= k
            steps.append((l, k, reach))
            reach |= (reach << (l * k)) & full
            k *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    for l, k, before in reversed(steps):
        if not before >> left & 1:
            found[l] = found.get(l, 0) + k
            left -= l * k
    return found


def fractions(left: dict[int, int], capacity: int, rounds: int) -> list[tuple[float, dict[int, int]]]:
    """(uses, configuration): a fractional solution of the linear program by multiplicative weights."""
    lengths = np.array(sorted(left, reverse=True))
    demand = np.array([left[l] for l in lengths.tolist()], float)
    place = {l: k for k, l in enumerate(lengths.tolist())}
    share = math.ceil((lengths * demand).sum() / capacity) / rounds
    done = np.zeros(len(lengths))
    uses: dict[tuple, float] = {}
    for t in range(rounds):
        lag = (t + 1) / rounds - done / demand
        weights = lengths / capacity * np.exp(np.clip(4 * rounds * lag / math.log(rounds + 1) / 10, -30, 30))
        found = priced(lengths, weights, np.maximum(1, np.minimum(capacity, demand / share / 2)).astype(int), capacity)
        for l, k in found.items():
            done[place[l]] += share * k
        name = tuple(sorted(found.items(), reverse=True))
        uses[name] = uses.get(name, 0.0) + share
    return [(x, dict(c)) for c, x in uses.items()]


def taken(used: list, left: dict[int, int], times: int, found: dict[int, int]) -> None:
    """Use a configuration, at most as often as what is left allows."""
    times = min(times, *(left.get(l, 0) // k for l, k in found.items()))
    if times > 0:
        used.append((times, found))
        for l, k in found.items():
            left[l] -= times * k


def subset_sums(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    left = {l: n for l, n in left.items() if n > 0}
    used: list[tuple[int, dict[int, int]]] = []
    now = sorted(left, reverse=True)
    while now:
        found = filled(now, left, capacity)
        taken(used, left, left[now[0]], found)
        now = [l for l in now if left[l] > 0]
    return used


def best_fit_decreasing(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over lengths with counts: sequences of one room and content are one entry."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for l in sorted((l for l, n in left.items() if n > 0), reverse=True):
        n = left[l]
        for room in sorted(r for r in rooms if r >= l):
            each = room // l
            while n > 0 and rooms.get(room):
                times, found = rooms[room].pop()
                k = min(each, n)
                use = min(times, n // k)
                if times > use:
                    rooms[room].append((times - use, found))
                rooms.setdefault(room - l * k, []).append((use, found | {l: k}))
                n -= use * k
        each = capacity // l
        if n >= each:
            rooms.setdefault(capacity - l * each, []).append((n // each, {l: each}))
        if n % each:
            rooms.setdefault(capacity - l * (n % each), []).append((1, {l: n % each}))
    return [x for own in rooms.values() for x in own if x[0]]


def fewest(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    return min((subset_sums(left, capacity), best_fit_decreasing(left, capacity)), key=lambda used: sum(t for t, _ in used))


def repaired(used: list[tuple[int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Take the worst filled sequences apart and pack them anew with some full ones, while that saves a sequence."""
    count = lambda u: sum(t for t, _ in u)
    size = lambda f: sum(l * k for l, k in f.items())
    for most in (8, 32, 128, 512):
        while True:
            order = sorted(used, key=lambda u: (size(u[1]), sorted(u[1].items())))
            room = sum(t * (capacity - size(f)) for t, f in order)
            if room < capacity:
                return used  # no sequence can be saved
            out, rest, left = [], most, {}
            for times, found in order:
                k = min(times, rest)
                rest -= k
                for l, n in found.items():
                    if k:
                        left[l] = left.get(l, 0) + n * k
                if times > k:
                    out.append((times - k, found))
            again = fewest(left, capacity)
            if count(out) + count(again) >= count(used):
                break
            used = out + again
    return used


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(times used, configuration) covering the histogram exactly; the number of entries doesn't grow with the counts."""
    left = {l: n for l, n in histogram.items() if n > 0}
    full: list[tuple[int, dict[int, int]]] = []
    if capacity in left:
        full.append((left.pop(capacity), {capacity: 1}))
    if not left:
        return full
    plain = best_fit_decreasing(left, capacity)
    used: list[tuple[int, dict[int, int]]] = []
    solved = fractions(left, capacity, rounds)
    for x, found in solved:
        taken(used, left, int(x), found)
    for x, found in sorted(solved, key=lambda s: int(s[0]) - s[0]):
        taken(used, left, 1, found)
    used = repaired(used + fewest(left, capacity), capacity)
    return full + min((used, plain), key=lambda u: sum(t for t, _ in u))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length and others).

    Pieces with one length are interchangeable, so ties and repeated rows need no rule; ids are dense from 0. Ranks
    come from row numbers inside (length, bucket), so a length that a third of all pieces have is dealt over many
    buckets; their number grows with the table.
    """
    spark = parts.sparkSession
    names = parts.columns
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_buckets(parts))))
    counts = written(parts.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    used = configurations(histogram, capacity)
    # slots[length]: first rank of each run of slots, sequence of its first slot, slots in a sequence, offset of the first
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    filled_up: dict[int, int] = {}
    sequence = 0
    for times, found in used:
        offset = 0
        for l in sorted(found, reverse=True):
            k = found[l]
            slots.setdefault(l, []).append((filled_up.get(l, 0), sequence, k, offset))
            filled_up[l] = filled_up.get(l, 0) + times * k
            offset += l * k
        sequence += times
    shared = spark.sparkContext.broadcast({l: np.array(s, np.int64).T for l, s in slots.items()})

    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n")
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).select(*names, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for l in np.unique(length).tolist():
                own = length == l
                first, base, k, at = shared.value[l]
                p = np.searchsorted(first, rank[own], "right") - 1
                r = rank[own] - first[p]
                sequence[own] = base[p] + r // k[p]
                offset[own] = at[p] + l * (r % k[p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*names).schema)
    return ranked.mapInArrow(tidy(run, True), f"{kinds}, sequence_id long, offset long")


def _buckets(parts: DataFrame) -> int:
    return max(64, 8 * math.ceil(parts.count() / 100_000))


def pack_documents(docs: DataFrame, path: str, words: bool, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, path, words, end_id, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), False, 2)
