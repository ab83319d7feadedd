"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED`` words that a text shares with a benchmark item, found by their Karp-Rabin fingerprints. Seeds
on one diagonal join to longer matches. Tiling repeatedly marks the longest match that overlaps no marked word of either
side (what is left of a partly covered match is tried again), so passages that were cut up and reordered are still
covered. A document is contaminated by an item when its tiles cover ``COVER`` of the item's words. Items are tiled in the
order of what their seeds cover at most, and left out when that is below both the threshold and the best tiling.

The benchmark is cut by hash into blocks of about ``BLOCK_BYTES``. All documents are compared with one block after another,
so a task holds one block; what earlier blocks found (rows with a shared seed only) is joined to the documents for the last.

Seeds meet by 64-bit fingerprints, whose words are not compared again. Instead of shorter and shorter windows being hashed
anew, the longest matches come from runs of seeds on a diagonal; the tiles are the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import carried, carried_kinds, documents, table, tidy, utf8, with_columns, written
from chatloom.llm.words import SIGNS, cuts, grams, word_hashes

SEED = 4
COVER = 0.5
#: Bytes of benchmark text that are sent to every task at a time.
BLOCK_BYTES = 32_000_000
#: A verdict: best item, its coverage and tiles, all items over the threshold.
Found = tuple[int, float, int, list[int]]
FOUND = "item_id long, coverage double, n_tiles long, item_ids array<long>"


def tile(doc_at: np.ndarray, item_at: np.ndarray, seed: int, words: int) -> tuple[int, int]:
    """Greedy string tiling from seed hits (start in the text, start in the item): words covered, number of tiles."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    diagonal, item = diagonal[order], item_at[order]
    cut = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (item[1:] != item[:-1] + 1))))
    end = np.append(cut[1:], len(item)) - 1
    size = item[end] - item[cut] + seed
    heap = [(-n, i, d) for n, i, d in zip(size.tolist(), item[cut].tolist(), diagonal[cut].tolist())]
    heapq.heapify(heap)
    used_item = np.zeros(words, bool)
    used_doc: set[int] = set()
    covered = tiles = 0
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [k for k in range(i, i - n) if not used_item[k] and k + d not in used_doc]
        if len(free) == -n:
            used_item[i : i - n] = True
            used_doc.update(range(i + d, i + d - n))
            covered -= n
            tiles += 1
            continue
        a = 0
        for b in range(1, len(free) + 1):
            if b == len(free) or free[b] != free[b - 1] + 1:
                if b - a >= seed:
                    heapq.heappush(heap, (a - b, free[a], d))
                a = b
    return covered, tiles


class Index:
    """Seeds of the benchmark items: sorted fingerprints with item and place, and a small table to pass over most words."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        hashes, at = word_hashes(data, offsets, SIGNS)
        self.words = np.diff(at)
        # an item with fewer words than a seed is one seed of its own length
        self.seed = seed
        self.tables = []
        for n in range(1, seed + 1):
            key, begin = grams(hashes, at, n)
            item = np.searchsorted(at, begin, "right") - 1
            own = (self.words[item] == n) | (n == seed)
            if not own.any():
                continue
            key, begin, item = key[own], begin[own], item[own]
            order = np.argsort(key, kind="stable")
            mark = np.zeros(1 << 22, bool)
            mark[(key >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((n, key[order], item[order], (begin - at[item])[order], mark))

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places in the row, items and places in the item of all shared seeds."""
        found = [(np.empty(0, np.int64),) * 4]
        for length, keys, items, places, mark in self.tables:
            key, begin = grams(hashes, at, length)
            maybe = np.flatnonzero(mark[(key >> np.uint64(42)).astype(np.int64)])
            low = np.searchsorted(keys, key[maybe])
            high = np.searchsorted(keys, key[maybe], "right")
            n = high - low
            which = np.repeat(maybe, n)
            p = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.searchsorted(at, begin[which], "right") - 1
            found.append((row, begin[which] - at[row], items[p], places[p]))
        return tuple(np.concatenate(c) for c in zip(*found))


def _verdicts(index: Index, hashes: np.ndarray, at: np.ndarray, cover: float) -> dict[int, Found]:
    """Of rows with a shared seed: best item, its coverage and tiles, and all items over the threshold."""
    row, place, item, start = index.hits(hashes, at)
    out: dict[int, Found] = {}
    if not len(row):
        return out
    length = np.minimum(index.seed, index.words[item])
    # no more words can be covered than those that seeds cover on either side
    group, first, most = _reach(row, item, start, length)
    _, _, other = _reach(row, item, place, length)
    row, place, item, start = row[group], place[group], item[group], start[group]
    end = np.append(first[1:], len(row))
    words, names = index.words[item[first]], index.ids[item[first]]
    bound = np.minimum(most, other) / words
    for k in np.lexsort((names, -bound, row[first])).tolist():
        r, name, a, b = int(row[first[k]]), int(names[k]), int(first[k]), int(end[k])
        old = out.get(r)
        if old is not None and bound[k] < cover and (bound[k], -name) < (old[1], -old[0]):
            continue
        covered, tiles = tile(place[a:b], start[a:b], min(index.seed, int(words[k])), int(words[k]))
        share = covered / int(words[k])
        over = [*(old[3] if old else []), *([name] if share >= cover else [])]
        if old is None or (share, -name) > (old[1], -old[0]):
            out[r] = (name, share, tiles, over)
        else:
            out[r] = (*old[:3], over)
    return out


def _reach(row: np.ndarray, item: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, item, place), where each row and item begins in it, and how many places its seeds cover."""
    order = np.lexsort((at, item, row))
    row, item, at, length = row[order], item[order], at[order], length[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
    step = np.append(np.where(new[1:], length[:-1], np.minimum(at[1:] - at[:-1], length[:-1])), length[-1:])
    first = np.flatnonzero(new)
    return order, first, np.add.reduceat(step, first)


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, cover: float = COVER, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row for each document: contaminated, best item and its coverage, number of tiles, all items over ``cover``.

    Words are runs of letters and digits (bytes outside ASCII count as letters) in lower case. Null and empty texts share
    nothing (item_id null, coverage 0). An item with fewer than ``seed`` words is found where it stands as a whole;
    repeated items each count; without items nothing is contaminated. Very long texts are compared whole, and an empty table
    gives none. Equal coverage: the smallest item_id. Rows are told apart by a 64-bit hash of id and text.
    Columns named in ``carry`` are passed through, others are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried(docs, carry)).withColumn("row", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def verdicts(block: int):
        """A function that gives runs of a batch's rows and what they share with the items of a block."""
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"].encode()) for r in items.filter(block_of == block).toLocalIterator()], seed))

        def run(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[int, Found]]]:
            data, offsets = utf8(batch, "text")
            code = np.frombuffer(data, np.uint8)
            for a, b in cuts(offsets, 500_000):
                hashes, at = word_hashes(code[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SIGNS)
                yield batch.slice(a, b - a), _verdicts(index.value, hashes, at, cover)

        return run

    def hits(block: int) -> DataFrame:
        found = verdicts(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, own in (x for batch in batches for x in found(batch)):
                rows = sorted(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *_columns([own[k] for k in rows])], ["row", *FIELDS])

        return written(texts.select("row", "text").mapInArrow(tidy(run), f"row long, {FOUND}").dropDuplicates(["row"]), "hits")

    if blocks > 1:
        earlier = reduce(DataFrame.unionByName, [hits(k) for k in range(blocks - 1)]).groupBy("row").agg(
            F.max(F.struct("coverage", (-F.col("item_id")).alias("back"), "n_tiles")).alias("best"), F.flatten(F.collect_list("item_ids")).alias("over")
        )
        known = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.back")).alias("item_id"), "best.coverage", "best.n_tiles", F.col("over").alias("item_ids")))
        texts = texts.join(earlier, "row", "left").withColumn("known", known).drop("best", "over")
    else:
        texts = texts.withColumn("known", F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"))
    last = verdicts(blocks - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in (x for batch in batches for x in last(batch)):
            known = [r and tuple(r.values()) for r in part.column(part.schema.get_field_index("known")).to_pylist()]
            both = [_best(r, own.get(k)) for k, r in enumerate(known)]
            over = pa.array([bool(r and r[3]) for r in both], pa.bool_())
            answer = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), over, *_columns(both)], ["doc_id", "contaminated", *FIELDS])
            yield with_columns(answer, part, carry)

    return texts.drop("row").mapInArrow(tidy(run), f"doc_id long, contaminated boolean, {FOUND}" + carried_kinds(docs, carry))


FIELDS = ["item_id", "coverage", "n_tiles", "item_ids"]


def _best(a: Found | None, b: Found | None) -> Found | None:
    if a is None or b is None:
        return b if a is None else a
    return (*max(a, b, key=lambda f: (f[1], -f[0]))[:3], [*a[3], *b[3]])


def _columns(rows: list[Found | None]) -> list[pa.Array]:
    return [
        pa.array([f[0] if f else None for f in rows], pa.int64()),
        pa.array([f[1] if f else 0.0 for f in rows], pa.float64()),
        pa.array([f[2] if f else 0 for f in rows], pa.int64()),
        pa.array([sorted(f[3]) if f else [] for f in rows], pa.list_(pa.int64())),
    ]


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
