"""Token-id files of directly addressable codes (Brisaboa, Ladra, Navarro 2009).

An id is cut into chunks of ``WIDTH`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those
ids that need one, and so on; a bitmap for each level tells which ids go on, and a rank directory over the bitmap
(set bits before every block of ``BLOCK`` bits) gives an id's place in the next level. Any id is read with one bit test
and one rank for each level, without decoding what stands before it.

A segment is ``MAGIC``, the number of ids, the number of levels, and for each level: count, chunk bytes, bitmap bytes,
directory (all little-endian). Segments are the ``payload`` of the rows of a Parquet table in the shared folder, with
the ids of their documents, so that any store Spark can write to will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.pretokens import _ranges, encoder, fold_crc
from chatloom.llm.token_counts import vocabulary
from chatloom.llm.util import table, tidy, utf8, written

MAGIC = b"DAC1"
WIDTH = 8
BLOCK = 512
#: Ids in a segment; a document is never split over segments.
SEGMENT = 1_000_000


def pack(ids: np.ndarray) -> bytes:
    """Encode ids (non-negative, below 2^32) as one segment."""
    left = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = left >> np.uint32(WIDTH)
        on = more != 0
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.empty(0, np.uint32)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append((len(left), (left & np.uint32((1 << WIDTH) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not on.any():
            break
        left = more[on]
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels))]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<Q", n), chunks, bits, ranks]
    return b"".join(out)


class Segment:
    """Random access and whole decoding of one segment."""

    def __init__(self, payload: bytes):
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, levels = struct.unpack_from("<QB", payload, 4)
        at, self.levels = 13, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-n // BLOCK), at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (WIDTH * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            head = bits[block * BLOCK >> 3 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(head).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        return value

    def decode(self) -> np.ndarray:
        out, where = np.zeros(self.n, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(WIDTH * k)
            if where is None:
                out |= part
                where = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            else:
                out[where] |= part
                where = where[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))]
        return out


def write_token_files(docs: DataFrame, path: str, words: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write segments in ascending id order; returns the table of segments.

    Columns: part (range of ids), segment (within the part), ahead (ids of the part before the segment), doc_ids,
    sizes (ids of each document, end id included), n_tokens, payload. One range shuffle of the texts brings the documents into order; null text is empty, rows with
    the same id stay separate (ordered by a hash of the text, then by it), null ids come first; very long texts are
    encoded whole, an empty table gives no segment, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, segment, ahead = encoder(path, words), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        total = 0

        def close() -> pa.RecordBatch:
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            row = [[part], [segment], [ahead], [[d for h in held for d in h[0]]], [sizes.tolist()], [len(ids)], [pack(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        for batch in batches:
            column = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                data, offsets = utf8(batch.slice(at, 256), "text")
                ids, where = e.encode(data, offsets)
                sizes = np.diff(where) + 1
                ends = np.cumsum(sizes)
                whole = np.full(int(ends[-1]), end_id, np.int32)
                whole[_ranges(ends - sizes, sizes - 1)] = ids
                held.append((column.slice(at, 256).to_pylist(), sizes, whole))
                total += len(whole)
                if total >= SEGMENT:
                    yield close()
                    held, total, segment, ahead = [], 0, segment + 1, ahead + total
        if held:
            yield close()

    names = ["part", "segment", "ahead", "doc_ids", "sizes", "n_tokens", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows of one id, or of none, may be many: they are told apart by their text
    ordered = ordered.withColumn("own", F.xxhash64("text")).repartitionByRange("doc_id", "own").sortWithinPartitions("doc_id", "own", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(tidy(run, True), "part int, segment int, ahead long, doc_ids array<long>, sizes array<long>, n_tokens long, payload binary"), "tokens")


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments.

    Start positions are a running sum over one row for each part (as many as the writer had partitions), which is
    small enough to send to every task; the payloads are not shuffled.
    """
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, doc_ids, sizes, payload in zip(*(batch.column(k) for k in range(4))):
                ids = Segment(payload.as_buffer()).decode()
                n = np.asarray(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                crc = [fold_crc(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - n + base.as_py(), pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    based = segments.join(F.broadcast(before), "part").select((F.col("part_start") + F.col("ahead")).alias("base"), "doc_ids", "sizes", "payload")
    return based.mapInArrow(tidy(run, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), True, 1))
