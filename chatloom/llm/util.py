"""Shared pieces: tables, written intermediate tables, streaming groups inside tasks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.words import mix

#: Edges that one task contracts alone; more are dealt over several.
WHOLE = 200_000


#: Bytes of the Arrow batches that tasks exchange with Python, where the session has Spark's default.
BATCH = 8 << 20
_written: list[str] | None = None


class Scratch:
    """Notes the tables that :func:`written` makes inside a ``with`` block; ``clear`` removes them when nothing reads them."""

    def __init__(self) -> None:
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        global _written
        self._outer, _written = _written, self.tables
        return self

    def __exit__(self, *_) -> None:
        global _written
        _written = self._outer

    def clear(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        while self.tables:
            path = jvm.org.apache.hadoop.fs.Path(self.tables.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a batch of long texts takes in the executor and its Python worker: a setting of the session, which stays so
    unless it had a value of its own (results are read later than this returns)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. If the scan has fewer splits than there are cores (one large row group is one split), the rows are
    dealt over the cores, as what follows costs more than moving them; a larger table is not moved."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chatloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written is not None:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(batch: pa.RecordBatch, name: str) -> tuple[bytes, "object"]:
    """The bytes of a string column, nulls as empty, and its row offsets (int64, length rows + 1)."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


def carried(df: DataFrame, names: list[str] | None) -> list[Column]:
    """Columns that a mapper passes through, under names that can't clash with its own."""
    return [F.col(n).alias(f"carry_{n}") for n in names or []]


def carried_kinds(df: DataFrame, names: list[str] | None) -> str:
    return "".join(f", `{n}` {df.schema[n].dataType.simpleString()}" for n in names or [])


def with_columns(answer: pa.RecordBatch, batch: pa.RecordBatch, names: list[str] | None) -> pa.RecordBatch:
    """The mapper's answer and the columns passed through (the rows of both agree)."""
    if not names:
        return answer
    own = [batch.column(batch.schema.get_field_index(f"carry_{n}")) for n in names]
    return pa.RecordBatch.from_arrays([*answer.columns, *own], [*answer.schema.names, *names])


def tidy(run: Callable, tokens: bool = False) -> Callable:
    """A mapper that gives memory back when its task ends; workers live on and would keep what they once needed.

    ``tokens``: keep the encoder's memo for the next task.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chatloom.llm import pretokens

        if not tokens:
            pretokens.drop()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give freed memory of this process back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def grouped(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``function`` to the rows of each key, streaming over sorted partitions.

    Unlike one grouped call per key, small groups cost no round trip between JVM and Python. A group must be
    bounded by its caller; several groups are never held together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_schema(df.sparkSession, schema))
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        last = None
        results: list[pa.Table] = []
        rows = 0

        def close() -> None:
            nonlocal held, rows
            if held:
                got = function(pa.Table.from_batches(held))
                if got is not None and got.num_rows:
                    results.append(got.cast(out))
                    rows += got.num_rows
                held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            change = None
            for k in keys:
                c = batch.column(batch.schema.get_field_index(k))
                d = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                change = d if change is None else pc.or_(change, d)
            cuts = [0, *(np.flatnonzero(np.asarray(change.fill_null(True))) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                key = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
                if key != last:
                    close()
                    last = key
                held.append(part)
                if rows > 20_000:
                    yield from _merged(results)
                    results, rows = [], 0
        close()
        yield from _merged(results)

    return dealt.sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def _merged(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    if tables:
        yield from pa.concat_tables(tables).combine_chunks().to_batches()


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def local_roots(a: np.ndarray, b: np.ndarray, salt: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the root of each: the smallest node it reaches, or the one of smallest salted hash."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    if salt is not None:
        order = np.argsort(mix(ids.view(np.uint64) + mix(np.uint64([salt]))), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, at = ids[order], place[at]
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[u], root[v]
        if (p == q).all():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (id, component_id) for every node that has an edge to another one.

    component_id is the smallest id of the component. Each level contracts the graph: every task finds the roots of its own
    edges, a node then knows its roots in all tasks (at most one each, so hubs gather nothing else) and points to the
    least; the other roots and that one are the edges of the next level. Nodes that are a root nowhere are thereby gone,
    and with them all that a task could settle alone. Levels whose edges don't fit in one task take turns between the
    order of ids and a salted order, in which any graph shrinks. Each level is a written table.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    levels: list[DataFrame] = []
    salted = whole = False
    while True:
        salt = len(levels) if len(levels) % 2 and not whole else None
        salted |= salt is not None

        def run(batches: Iterator[pa.RecordBatch], salt: int | None = salt) -> Iterator[pa.RecordBatch]:
            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if held:
                node, root = local_roots(*(np.concatenate(c) for c in zip(*held)), salt)
                for k in range(0, len(node), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000]), pa.array(root[k : k + 100_000])], ["id", "root"])

        local = now.mapInArrow(tidy(run), "id long, root long")
        if whole:
            levels.append(written(local, "components"))
            break
        pointed = local.groupBy("id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        level = written(pointed.select("id", "root", F.array_except("roots", F.array("root")).alias("others")), "components")
        left = level.agg(F.sum(F.size("others"))).first()[0]
        levels.append(level.select("id", "root"))
        if not left:
            break
        now = level.select(F.explode("others").alias("a"), F.col("root").alias("b")).distinct()
        whole = left <= WHOLE
        now = now.coalesce(1) if whole else now.hint("rebalance", "b")
    found = levels.pop()
    while levels:
        upper = found.select(F.col("id").alias("root"), F.col("root").alias("top"))
        found = levels.pop().join(upper, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    if salted:
        least = found.groupBy("root").agg(F.min("id").alias("least"))
        found = found.join(least, "root").select("id", F.col("least").alias("root"))
    return found.select("id", F.col("root").alias("component_id"))


def crc32_of_id(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))
