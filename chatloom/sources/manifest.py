"""What changed in log folders since they were last read, told by names, sizes and times; only such files are opened.

A *unit* is what is rebuilt together, and follows from names alone: a file of Claude Code, Gemini and Codex, a folder of
Copilot, a session of OpenCode with its messages and parts. History and project maps belong to no unit: they are small, always
read, and don't make a session a changed one.

The manifest is two tables: ``files`` (kind, source_path, unit, size, modified) and ``units`` (unit, provider, session_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.parsing import stem
from chatloom.operators.tables import materialized
from chatloom.sources import files
from chatloom.sources.files import KINDS, Raw

FILES = "kind string, source_path string, unit string, size bigint, modified timestamp"
UNITS = "unit string, provider string, session_id string"
SESSION = ["provider", "session_id"]
#: Paths that are named to one scan; more are read block by block.
NAMED = 50_000
#: Kinds that are read whenever anything is.
SHARED = ("history", "projects")


def listing(spark: SparkSession, bases: dict[str, list[str]]) -> DataFrame:
    """``files`` of the folders of each provider. No file is opened, and tasks list those that are mounted."""
    found, by_tasks = [], {}
    of = lambda provider: [k for k, own in KINDS.items() if own.provider == provider]
    for provider in sorted({own.provider for own in KINDS.values()}):
        there = files.existing(spark, list(bases.get(provider, ())))
        if there and all(files.mounted(spark, p) for p in there):
            by_tasks[provider] = there
        elif there:
            found.append(files.below(spark, of(provider)).format("binaryFile").load(there).select(F.lit(provider).alias("provider"), "path", "length", "modificationTime"))
    if by_tasks:
        found.append(files.listed(spark, by_tasks))
    if not found:
        return spark.createDataFrame([], FILES)
    at, kind = files.plain_path(F.col("path")), F.lit(None).cast("string")
    for provider in {own.provider for own in KINDS.values()}:
        kind = F.when(F.col("provider") == provider, files.kind_of(at, of(provider))).otherwise(kind)
    rows = reduce(DataFrame.unionByName, found).select(kind.alias("kind"), at.alias("source_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter("kind is not null")
    return _with_units(rows.dropDuplicates(["kind", "source_path"]))


def _with_units(rows: DataFrame) -> DataFrame:
    path, kind = F.col("source_path"), F.col("kind")
    # a part names its message alone, so the name of the message's file tells the session
    message = rows.filter(kind == "oc_messages").select(_base("message", path).alias("base"), stem(path).alias("message"), _session("message", path).alias("owner"))
    parts = rows.filter(kind == "oc_parts").withColumn("base", _base("part", path)).withColumn("message", F.regexp_extract(path, r"/part/([^/]+)/[^/]+$", 1))
    parts = parts.join(message, ["base", "message"], "left").withColumn("unit", F.concat("base", F.lit("#"), "owner")).select("kind", "source_path", "unit", "size", "modified")
    return rows.filter(kind != "oc_parts").withColumn("unit", unit_of(kind, path)).select("kind", "source_path", "unit", "size", "modified").unionByName(parts)


def unit_of(kind: Column, path: Column) -> Column:
    """The unit of a file by its kind and path; null for kinds that belong to none, and for parts of OpenCode."""
    return (
        F.when(kind.isin("claude", "chats", "rollouts"), path)
        .when(kind.isin("workspaces", "events", "checkpoints"), F.regexp_replace(path, r"/(workspace\.yaml|events\.jsonl|checkpoints/index\.md)$", ""))
        .when(kind == "oc_sessions", F.concat(_base("session", path), F.lit("#"), stem(path)))
        .when(kind == "oc_messages", F.concat(_base("message", path), F.lit("#"), _session("message", path)))
    )


def _base(folder: str, path: Column) -> Column:
    return F.regexp_extract(path, rf"^(.*)/{folder}/[^/]+/[^/]+$", 1)


def _session(folder: str, path: Column) -> Column:
    return F.regexp_extract(path, rf"/{folder}/([^/]+)/[^/]+$", 1)


@dataclass
class Manifest:
    files: DataFrame
    units: DataFrame


def empty(spark: SparkSession) -> Manifest:
    return Manifest(spark.createDataFrame([], FILES), spark.createDataFrame([], UNITS))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_path, unit, state) of files that are ``new``, ``changed`` in size or time, or ``gone``."""
    old = before.select("kind", "source_path", F.col("unit").alias("old_unit"), F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    both = now.join(old, ["kind", "source_path"], "full")
    state = F.when(F.col("old_size").isNull(), "new").when(F.col("size").isNull(), "gone").when((F.col("size") != F.col("old_size")) | (F.col("modified") != F.col("old_modified")), "changed")
    # a part whose message appeared or went belongs elsewhere now, which touches both
    moved = F.array_distinct(F.array("unit", "old_unit"))
    touched = F.when(state.isNull() & ~F.col("unit").eqNullSafe(F.col("old_unit")), "changed").otherwise(state)
    return both.withColumn("state", touched).filter("state is not null").select("source_path", F.explode(moved).alias("unit"), "state").filter("unit is not null or state <> 'gone'")


@dataclass
class Change:
    """What a refresh has to do: the sessions it replaces, the raw rows they are rebuilt from, and the manifest it leaves."""

    touched: DataFrame
    raw: Raw
    manifest: Manifest
    #: (kind, source_path) of the files that were opened.
    opened: DataFrame


def _blocks(rows: DataFrame, size: int) -> Iterator[tuple[str, list[str]]]:
    """(kind, paths) of at most ``size`` paths, read from (kind, source_path) one part after another."""
    held: dict[str, list[str]] = {}
    for r in rows.toLocalIterator():
        held.setdefault(r.kind, []).append(r.source_path)
        if len(held[r.kind]) == size:
            yield r.kind, held.pop(r.kind)
    yield from held.items()


def change(spark: SparkSession, bases: dict[str, list[str]], before: Manifest | None = None, named: int = NAMED) -> Change:
    """Compare the folders with the manifest ``before`` (none: everything is new) and read what changed.

    Sessions are touched if a file of their unit is new, changed or gone; all files of these units are read, no others but the
    shared kinds. Tasks list the folders and open the files, and the driver holds no names. In stores that aren't mounted
    Spark's scans do it: the driver lists their files, and paths are named to scans, ``named`` at a time, one scan after
    another. ``touched`` holds sessions that are gone too.
    """
    with files.many_files(spark):
        return _change(spark, bases, before, named)


def _change(spark: SparkSession, bases: dict[str, list[str]], before: Manifest | None, named: int) -> Change:
    before = before or empty(spark)
    now = materialized(listing(spark, bases).hint("rebalance"), "listing")
    units = materialized(compared(now, before.files).filter("unit is not null").select("unit").distinct(), "units")
    own = now.join(units, "unit", "left_semi").unionByName(now.filter(F.col("kind").isin(*SHARED)))
    opened = materialized(own.select("kind", "source_path", "size").hint("rebalance"), "opened")
    remote = [files.qualified(spark, p) for there in bases.values() for p in there if not files.mounted(spark, p)]
    by_scans = reduce(lambda a, p: a | F.col("source_path").startswith(p), remote, F.lit(False))
    rows = files.read_listed(opened.filter(~by_scans))
    if remote:
        blocks = [materialized(files.scan_paths(spark, paths, [kind], recursive=False), "block") for kind, paths in _blocks(opened.filter(by_scans), named)]
        rows = rows.unionByName(files.with_numbers(spark, blocks))
    raw = files.split(materialized(rows.hint("rebalance").sortWithinPartitions("kind"), "changed"))
    opened = opened.drop("size")
    found = files.session_files(raw).join(now.select("source_path", "unit"), "source_path").filter("unit is not null").select("unit", *SESSION).distinct()
    found = materialized(found, "found")
    gone = before.units.join(units, "unit", "left_semi")
    touched = materialized(found.unionByName(gone).select(*SESSION).distinct(), "touched")
    after = Manifest(now, materialized(before.units.join(units, "unit", "left_anti").unionByName(found), "after"))
    return Change(touched, raw, after, opened)
