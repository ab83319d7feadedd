"""Log files as a stream with keyed state: a batch reads its own sessions, however much was read before it.

A file that arrives goes to the state of its unit (see ``sources.manifest``), which holds the unit's files in the state store;
the batch gets all files of the units it touches, rebuilds their sessions and refreshes the search index with them. A
batch that is run again replaces the same sessions by the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatloom.operators import index, search
from chatloom.operators.tables import materialized
from chatloom.sources import files, manifest
from chatloom.sources.files import KINDS, Raw

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files that a unit gives out at a time.
PIECE = 8 << 20


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session's streams use the state store that keeps map state; its setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Units(StatefulProcessor):
    """Keeps the files of a unit, by path, and gives out all of them when one arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "kind string, logical string, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for path, *own in zip(batch["source_path"], batch["kind"], batch["logical"], batch["value"]):
                self.files.updateValue((path,), tuple(own))
        held, size = [], 0
        for path, own in self.files.iterator():
            held.append((key[0], path[0], *own))
            size += len(own[2])
            if size >= PIECE:
                yield pd.DataFrame(held, columns=COLUMNS)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["unit", "source_path", "kind", "logical", "value"]


def raw_of(whole: DataFrame, shared: dict[str, DataFrame]) -> Raw:
    """Raw rows of whole files (kind, logical, source_path, value); files of one logical path follow one another by path."""
    lines = whole.withColumn("lines", F.split("value", "\r?\n"))
    earlier = Window.partitionBy("kind", "logical").orderBy("source_path").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum(F.size("lines")).over(earlier), F.lit(0)))
    lines = lines.select("kind", "before", F.col("logical").alias("source_path"), F.posexplode("lines").alias("at", "line"))
    found = {}
    for kind, own in KINDS.items():
        if kind in shared:
            found[kind] = shared[kind]
        elif own.whole:
            found[kind] = whole.filter(F.col("kind") == kind).select(F.col("logical").alias("source_path"), F.lit(0).cast("long").alias("ord"), "value")
        else:
            found[kind] = lines.filter(F.col("kind") == kind).select("source_path", (F.col("before") + F.col("at")).cast("long").alias("ord"), F.col("line").alias("value"))
    return Raw(**found)


def stream_logs(spark: SparkSession, provider: str, folder: str, target: str, checkpoint: str, as_of: Column, logical=None):
    """Read new files of one provider below ``folder`` and keep the search index at ``target``; ends when all has been read.

    ``logical`` (column to column): the path a file counts as, so that a log that was cut into several files is one. A file
    is read once, whole (files of a stream are pieces; for logs that grow in place see ``manifest.change``). Files that belong
    to no unit, as history, are read anew for each batch; parts of OpenCode, whose session their name doesn't tell, aren't
    followed. The state store of the session must be one that keeps map state (``STORE``).
    """
    path = F.col("source_path")
    rows = spark.readStream.format("text").option("recursiveFileLookup", True).option("wholetext", True).load(folder).select(files.scanned_path().alias("source_path"), "value")
    named = rows.withColumn("logical", logical(path) if logical else path).withColumn("kind", files.kind_of(F.col("logical"), [k for k, own in KINDS.items() if own.provider == provider]))
    owned = named.withColumn("unit", manifest.unit_of(F.col("kind"), F.col("logical"))).filter("unit is not null")
    held = owned.groupBy("unit").transformWithStateInPandas(Units(), ", ".join(f"{c} string" for c in COLUMNS), "Append", "None")

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        whole = materialized(batch.drop("unit"), "batch")
        bases = {p: [folder] if p == provider else [] for p in {k.provider for k in KINDS.values()}}
        shared = {k: files.read_paths(own, files.existing(own, bases[KINDS[k].provider]), k) for k in manifest.SHARED}
        raw = raw_of(whole, shared)
        docs = materialized(search.documents(files.all_messages(raw, as_of), files.all_sessions(raw)), "batch-docs")
        index.refresh(own, target, docs, files.session_files(raw).select(*manifest.SESSION).distinct())

    # a stream keeps the settings that it was started with; a batch names its files to a scan, which lists each of them
    with files.many_files(spark):
        return held.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
