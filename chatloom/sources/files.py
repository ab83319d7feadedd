"""Readers of log folders into raw rows (source_path, ord, value); missing folders give no rows."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields
from functools import reduce
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chatloom.functions.parsing import base_name, numbered, stem
from chatloom.operators.tables import materialized
from chatloom.sources import claude, codex, copilot, gemini, opencode

RAW = "source_path string, ord bigint, value string"


class Kind(NamedTuple):
    """Files of a provider: what their names match, whether a file is one record, and which paths count."""

    provider: str
    pattern: str
    whole: bool
    keep: str


#: The files that the tools write.
KINDS = {
    "claude": Kind("claude", "*.jsonl", False, r"/projects/[^/]+/[^/]+\.jsonl$"),
    "history": Kind("claude", "history.jsonl", False, r"/history\.jsonl$"),
    "workspaces": Kind("copilot", "workspace.yaml", True, r"/workspace\.yaml$"),
    "events": Kind("copilot", "events.jsonl", False, r"/events\.jsonl$"),
    "checkpoints": Kind("copilot", "index.md", True, r"/checkpoints/index\.md$"),
    "chats": Kind("gemini", "session-*", True, r"/tmp/[^/]+/chats/session-[^/]*\.(?i:json)$"),
    "projects": Kind("gemini", "projects.json", True, r"/projects\.json$"),
    "rollouts": Kind("codex", "rollout-*", False, r"/\d{4}/\d{2}/\d{2}/rollout-[^/]*\.(?i:jsonl)$"),
    "oc_sessions": Kind("opencode", "*.json", True, r"/session/[^/]+/[^/]+\.json$"),
    "oc_messages": Kind("opencode", "*.json", True, r"/message/[^/]+/[^/]+\.json$"),
    "oc_parts": Kind("opencode", "*.json", True, r"/part/[^/]+/[^/]+\.json$"),
}


#: Bytes that opening a file counts as when small files are put together to tasks, and tasks of a listing for each core.
OPEN_COST, LISTING_TASKS = "64k", 4


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Listings and scans inside take tasks by the cores and the bytes; else a folder is a task (up to 10,000), and so is every few files.

    The session's settings are put back after.
    """
    own = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": OPEN_COST}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def plain_path(path: Column) -> Column:
    """Local paths without their scheme; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def scanned_path() -> Column:
    """The path of a scanned row's file; scans give it with its signs escaped."""
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.url_decode(path))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(kind, source_path, ord, value) of lines (kind, source_path, start, value) as scans of text give them; ``start``: of the split.

    ``ord`` is the number of the line in its file, from 0 on, whatever the size of the splits and whatever else is read. The
    lines of a split follow one another in its task; they are counted for each (file, split), the counts of a file summed
    up (a row a split), and a number is what came before its split plus the place in it. No file is read by one task.
    """
    held = materialized(lines.withColumn("at", F.monotonically_increasing_id()).hint("rebalance"), "lines")
    splits = held.groupBy("source_path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return held.join(splits, ["source_path", "start"]).select("kind", "source_path", (F.col("before") + F.col("at") - F.col("first")).alias("ord"), "value")


def kind_of(path: Column, kinds: list[str]) -> Column:
    """Which of the kinds a file is, null for others."""
    out = F.lit(None).cast("string")
    for kind in kinds:
        out = F.when(path.rlike(KINDS[kind].keep), kind).otherwise(out)
    return out


def below(spark: SparkSession, kinds: list[str]) -> DataFrameReader:
    """A reader of folders: listed in parallel and recursively; names are filtered on the path, so case is free."""
    patterns = sorted({KINDS[k].pattern for k in kinds})
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(patterns) + "}")


def scan_paths(spark: SparkSession, paths: list[str], kinds: list[str], recursive: bool = True) -> DataFrame:
    """(kind, source_path, start, value) of files in folders (``recursive``), or of the files that are named.

    The kinds are all read whole, or all by lines; folders are listed once for all of them.
    """
    scan = below(spark, kinds) if recursive else spark.read
    at = paths if recursive else [_literal(p) for p in paths]
    if KINDS[kinds[0]].whole:
        return whole_files(scan.format("binaryFile").load(at), kinds)
    rows = scan.text(at).select(scanned_path().alias("source_path"), F.col("_metadata.file_block_start").alias("start"), "value")
    return rows.select(kind_of(F.col("source_path"), kinds).alias("kind"), "source_path", "start", "value").filter("kind is not null")


def whole_files(scan: DataFrame, kinds: list[str]) -> DataFrame:
    """The rows of :func:`scan_paths` from a scan of binary files (one of whole texts makes a job's configuration and looks for codecs for each file)."""
    at = plain_path(F.col("path"))
    return scan.select(kind_of(at, kinds).alias("kind"), at.alias("source_path"), F.lit(0).cast("long").alias("start"), F.col("content").cast("string").alias("value")).filter("kind is not null")


def scan_folders(spark: SparkSession, bases: dict[str, list[str]]) -> list[DataFrame]:
    """Scans of the base folders of each provider; missing folders hold nothing."""
    scans = []
    for provider, own in bases.items():
        there = existing(spark, list(own))
        for whole in (True, False):
            kinds = [k for k, kind in KINDS.items() if kind.provider == provider and kind.whole == whole]
            if not there or not kinds:
                continue
            scans.append(scan_paths(spark, there, kinds))
    return scans


def with_numbers(spark: SparkSession, scans: list[DataFrame]) -> DataFrame:
    """(kind, source_path, ord, value) of scans: lines with their numbers in their files, whole files as number 0."""
    whole = [k for k, own in KINDS.items() if own.whole]
    out = spark.createDataFrame([], f"kind string, {RAW}")
    if scans:
        rows = reduce(DataFrame.unionByName, scans)
        out = out.unionByName(rows.filter(F.col("kind").isin(whole)).select("kind", "source_path", F.lit(0).cast("long").alias("ord"), "value"))
        out = out.unionByName(numbered_lines(rows.filter(~F.col("kind").isin(whole))))
    return out


# ---- mounted folders of any number of files: listed and read by tasks, so that the driver holds no names
ENTRIES = "path string, folder boolean, length bigint, modificationTime timestamp"
#: Bytes in which files of lines are cut for the tasks, how many a task gets, and those that a task hands on at once.
PIECE, TASK_BYTES, HANDED = 16 << 20, 64 << 20, 4 << 20


def entries(path: str) -> Iterator[pa.RecordBatch]:
    """What stands in a folder (a file: itself), but names that Spark's listings pass over, and empty files, as its scans do."""
    path = re.sub("^file:/+", "/", path)
    own: list[tuple] = []
    if os.path.isfile(path):
        own.append((path, False, os.stat(path)))
    else:
        with os.scandir(path) as found:
            for x in found:
                try:
                    x.name.encode()
                    if not re.match(r"\.|_(?!common_metadata|metadata)[^=]*$|.*\._COPYING_$", x.name, re.DOTALL) and (x.is_dir() or x.is_file()):
                        own.append((f"{path.rstrip('/')}/{x.name}", x.is_dir(), x.stat()))
                except (FileNotFoundError, UnicodeEncodeError):
                    continue  # gone meanwhile, a link to nothing, or no name that Spark has
                if len(own) == 10_000:
                    yield _entries(own)
                    own = []
    yield _entries(own)


def _entries(own: list[tuple]) -> pa.RecordBatch:
    own = [x for x in own if x[1] or x[2].st_size]
    times = pa.array([s.st_mtime_ns // 1_000_000 * 1000 for *_, s in own], pa.int64()).cast(pa.timestamp("us", "UTC"))
    columns = [pa.array([p for p, *_ in own], pa.string()), pa.array([x for _, x, _ in own], pa.bool_()), pa.array([s.st_size for *_, s in own], pa.int64()), times]
    return pa.RecordBatch.from_arrays(columns, ["path", "folder", "length", "modificationTime"])


class Folders(DataSource):
    """What stands directly in the folders that are named."""

    @classmethod
    def name(cls) -> str:
        return "chatloom_folders"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return FoldersReader(json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]])


class FoldersReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from entries(partition.value)


def listed(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """(provider, path, length, modificationTime) of the files below ``folders`` of providers, all of which are :func:`mounted`.

    Tasks list a level of folders at a time, which are dealt over them; the next level is what they found. A folder is
    listed by one task, which hands on a part of it at a time.
    """
    spark.dataSource.register(Folders)
    named = [spark.read.format(Folders.name()).load(there).select(F.lit(provider).alias("provider"), "*") for provider, there in folders.items()]
    level, found = reduce(DataFrame.unionByName, named), []

    def below_these(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for provider, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for own in entries(path):
                    yield pa.RecordBatch.from_arrays([pa.array([provider] * own.num_rows, pa.string()), *own.columns], ["provider", *own.schema.names])

    while True:
        found.append(materialized(level, "level"))
        deeper = found[-1].filter("folder").select("provider", "path")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found).filter("not folder").drop("folder")
        level = deeper.repartition(LISTING_TASKS * spark.sparkContext.defaultParallelism).mapInArrow(below_these, f"provider string, {ENTRIES}")


def lines_of(file: BinaryIO, start: int, end: int) -> list[bytes]:
    """The lines of a file that begin at its bytes ``start`` to ``end``, by the line ends (LF, CR LF, CR) of Spark's scans of text."""
    low = max(start - 1, 0)  # a line begins at ``start`` if one ends before it
    file.seek(low)
    data = file.read(end - low)
    if start and not re.search(rb"[\r\n]", data):
        return []
    while data and data[-1:] not in b"\r\n":
        more = file.read(1 << 16)
        if not more:
            break
        stop = re.search(rb"[\r\n]", more)
        data += more[: stop.end()] if stop else more
    if not start:
        data = data.removeprefix(b"\xef\xbb\xbf")
    lines = re.split(rb"\r\n|\r|\n", data)[1 if start else 0 :]
    return lines if not lines or lines[-1] else lines[:-1]


def contents(rows: DataFrame, whole: bool, piece: int = PIECE) -> DataFrame:
    """(kind, source_path, start, value) of files (kind, source_path, size): each whole, or its lines.

    Tasks open the files; long ones of lines are cut into pieces of ``piece`` bytes, and pieces are dealt over the tasks, which
    are as many as cores and bytes need. The driver sees the sum of the sizes.
    """
    cores, total = rows.sparkSession.sparkContext.defaultParallelism, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = F.lit(0).cast("long") if whole else F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece).cast("long")))
    pieces = rows.select("kind", "source_path", "size", cut.alias("start")).repartition(max(LISTING_TASKS * cores, -(-total // TASK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, weight = [], 0
            for kind, path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with open(path, "rb") as file:
                    values = [file.read()] if whole else lines_of(file, start, min(start + piece, size))
                for value in values:
                    held.append((kind, path, start, value))
                    weight += len(value) + len(path)
                    if weight > HANDED:
                        yield _handed(held)
                        held, weight = [], 0
            yield _handed(held)

    return pieces.mapInArrow(run, "kind string, source_path string, start bigint, value binary").withColumn("value", F.col("value").cast("string"))


def _handed(held: list[tuple]) -> pa.RecordBatch:
    kinds = (("kind", pa.string()), ("source_path", pa.string()), ("start", pa.int64()), ("value", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def read_listed(rows: DataFrame) -> DataFrame:
    """(kind, source_path, ord, value) of listed files (kind, source_path, size): lines with their numbers, whole files as number 0."""
    one = F.col("kind").isin([k for k, own in KINDS.items() if own.whole])
    whole = contents(rows.filter(one), True).select("kind", "source_path", F.lit(0).cast("long").alias("ord"), "value")
    return whole.unionByName(numbered_lines(contents(rows.filter(~one), False)))


def read_paths(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Raw rows (source_path, ord, value) of one kind of files in folders."""
    return with_numbers(spark, [scan_paths(spark, paths, [kind])] if paths else []).drop("kind")


def _literal(path: str) -> str:
    """A path whose signs aren't taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def existing(spark: SparkSession, bases: list[str]) -> list[str]:
    return [b.rstrip("/") for b in bases if _exists(spark, b)]


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, store = _place(spark, path)
    return store.exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as scans give it: with its store, or plain if that is the machines' own."""
    at, store = _place(spark, path)
    return re.sub("^file:/+", "/", store.makeQualified(at).toString())


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is one of the machines' own (a mounted folder), which tasks open by its name."""
    return qualified(spark, path).startswith("/")


@dataclass
class Raw:
    """Raw rows of all providers; any of them may be empty."""

    claude: DataFrame
    history: DataFrame
    workspaces: DataFrame
    events: DataFrame
    checkpoints: DataFrame
    chats: DataFrame
    projects: DataFrame
    rollouts: DataFrame
    oc_sessions: DataFrame
    oc_messages: DataFrame
    oc_parts: DataFrame


def from_paths(spark: SparkSession, claude: list[str] = (), copilot: list[str] = (), gemini: list[str] = (), codex: list[str] = (), opencode: list[str] = ()) -> Raw:
    """Read base folders; several bases of a provider are one union."""
    with many_files(spark):
        return split(with_numbers(spark, scan_folders(spark, {"claude": claude, "copilot": copilot, "gemini": gemini, "codex": codex, "opencode": opencode})))


def all_sessions(raw: Raw) -> DataFrame:
    """Union of all providers' sessions (union all; each provider is a branch of its own)."""
    out = claude.sessions(raw.claude, raw.history)
    for more in (gemini.sessions(raw.chats, raw.projects), copilot.sessions(raw.workspaces, raw.events), codex.sessions(raw.rollouts), opencode.sessions(raw.oc_sessions, raw.oc_messages)):
        out = out.unionByName(more)
    return out


def all_messages(raw: Raw, as_of: Column) -> DataFrame:
    """Union of all providers' messages, numbered together."""
    out = claude.placed_messages(raw.claude, as_of)
    for more in (
        gemini.placed_messages(raw.chats, as_of), copilot.placed_messages(raw.workspaces, raw.events, raw.checkpoints, as_of), codex.placed_messages(raw.rollouts, as_of), opencode.placed_messages(raw.oc_messages, raw.oc_parts, as_of),
    ):
        out = out.unionByName(more)
    return numbered(out)


def union(raw: Raw) -> DataFrame:
    """All raw rows of one table, with the kind of file they come from."""
    return reduce(DataFrame.unionByName, [getattr(raw, f.name).select(F.lit(f.name).alias("kind"), "source_path", F.col("ord").cast("long").alias("ord"), "value") for f in fields(raw)])


def split(rows: DataFrame) -> Raw:
    """Raw rows by kind again (``union``, stored by kind)."""
    return Raw(*[rows.filter(F.col("kind") == f.name).select("source_path", "ord", "value") for f in fields(Raw)])


def session_files(raw: Raw) -> DataFrame:
    """(source_path, provider, session_id) of every file that belongs to one session."""
    path = F.col("source_path")
    named = lambda df, provider, session: df.select(path, F.lit(provider).alias("provider"), session.alias("session_id"))
    folders = copilot.workspaces(raw.workspaces).select("folder", F.coalesce("id", base_name(F.col("folder"))).alias("session_id"))
    own = raw.workspaces.select("source_path").unionByName(raw.events.select("source_path")).unionByName(raw.checkpoints.select("source_path")).distinct()
    own = own.withColumn("folder", F.regexp_replace("source_path", r"/(workspace\.yaml|events\.jsonl|checkpoints/index\.md)$", "")).join(folders, "folder")
    messages = raw.oc_messages.select("source_path", F.regexp_extract("source_path", r"/message/([^/]+)/", 1).alias("session_id"), stem(path).alias("message"))
    parts = raw.oc_parts.select("source_path", F.regexp_extract("source_path", r"/part/([^/]+)/", 1).alias("message")).join(messages.select("session_id", "message").distinct(), "message")
    all_ = [
        named(raw.claude, claude.PROVIDER, stem(path)),
        named(own, copilot.PROVIDER, F.col("session_id")),
        named(gemini.chats(raw.chats), gemini.PROVIDER, F.col("r.sessionId")),
        named(raw.rollouts, codex.PROVIDER, stem(path)),
        named(raw.oc_sessions, opencode.PROVIDER, stem(path)),
        named(messages, opencode.PROVIDER, F.col("session_id")),
        named(parts, opencode.PROVIDER, F.col("session_id")),
    ]
    return reduce(DataFrame.unionByName, all_).distinct()
