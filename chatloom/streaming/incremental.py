"""Incremental refresh of the search documents: what changed, upsert, clear, statistics, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators.tables import materialized

KEY = ["provider", "session_id"]


def fingerprints(raw: DataFrame, session: DataFrame) -> DataFrame:
    """(provider, session_id, fingerprint) over all lines or files that make up a session.

    ``session`` maps source_path to (provider, session_id). Count, size and an order-free hash of the content: appends
    and edits both change it.
    """
    one = raw.join(session, "source_path").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("size"), F.bit_xor(F.xxhash64("source_path", "ord", "value")).alias("h"))
    return one.select(*KEY, F.concat_ws("-", "n", "size", F.hex("h")).alias("fingerprint"))


def changed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions that are new or whose fingerprint differs from the manifest's."""
    old = manifest.select(*KEY, F.col("fingerprint").alias("old"))
    return current.join(old, KEY, "left").filter("old is null or old <> fingerprint").drop("old")


def upsert(documents: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents with those of the touched sessions replaced."""
    return documents.join(touched.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh.join(touched.select(*KEY).distinct(), KEY, "left_semi"))


def updated_manifest(manifest: DataFrame, touched: DataFrame) -> DataFrame:
    return manifest.join(touched.select(*KEY), KEY, "left_anti").select(*KEY, "fingerprint").unionByName(touched.select(*KEY, "fingerprint"))


def cleared(documents: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables empty, so that the next build is a full one."""
    return documents.filter("false"), manifest.filter("false")


def stats(fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """(sessions_indexed, messages_indexed) of a build."""
    sessions = touched.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("sessions_indexed"))
    messages = fresh.join(touched.select(*KEY).distinct(), KEY, "left_semi").agg(F.count(F.lit(1)).alias("messages_indexed"))
    return sessions.crossJoin(messages)


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a stored table (without the marks of its buckets)."""
    return spark.read.parquet(path).filter("marked is null").drop("bucket", "marked")


def refresh_stored(spark: SparkSession, fresh: DataFrame, touched: DataFrame, path: str, buckets: int = 64) -> None:
    """Upsert into a stored table: documents of the ``touched`` sessions are replaced by the ``fresh`` ones, or go where
    there are none. Only buckets of touched sessions are read and rewritten (dynamic overwrite of partitions). Each of them
    also gets a mark, a row that is no document, so that a bucket that loses its last session is overwritten too.
    """
    keys = touched.select(*KEY).distinct()
    hit = keys.select(bucket(buckets).alias("bucket")).distinct()
    new = fresh.join(keys, KEY, "left_semi").withColumn("bucket", bucket(buckets)).withColumn("marked", F.lit(None).cast("boolean"))
    try:
        old = spark.read.parquet(path).filter("marked is null").join(hit, "bucket", "left_semi").join(keys, KEY, "left_anti").select(*new.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = new.filter("false")
    marks = hit.withColumn("marked", F.lit(True))
    # the old rows are read from the folder that is written, so the result is cut off from it first
    whole = materialized(old.unionByName(new).unionByName(marks, allowMissingColumns=True), "upsert")
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, ord, value, round) of every file as it was last read."""
    kept = spark.read.schema("source_path string, ord bigint, value string, round int, batch bigint").parquet(path)
    last = kept.groupBy("source_path").agg(F.max("round").alias("round"))
    return kept.join(last, ["source_path", "round"]).drop("batch")


def _rebuild(spark: SparkSession, paths: DataFrame, sessions, build, target: str, lines: str) -> None:
    """Rebuild the sessions that the files ``paths`` belong to from all their stored lines."""
    stored = _stored_lines(spark, lines).select("source_path", "ord", "value")
    owner = sessions(stored).select("source_path", *KEY).distinct()
    touched = materialized(owner.join(paths.select("source_path").distinct(), "source_path", "left_semi").select(*KEY).distinct(), "touched")
    own = owner.join(touched, KEY, "left_semi").select("source_path").distinct()
    refresh_stored(spark, build(stored.join(own, "source_path", "left_semi")), touched, target)


def stream_lines(spark: SparkSession, folder: str, build, target: str, checkpoint: str, sessions):
    """New log files as a stream: their lines are appended to the lines stored at ``target``-lines, and the sessions they
    belong to are rebuilt from all their stored lines and upserted at ``target``.

    ``sessions`` gives (source_path, provider, session_id) of lines (source_path, ord, value), ``build`` the documents of
    such lines. A batch that is run again replaces its own lines. Ends when what is there has been read. A file is read
    once; for lines appended later see ``refresh_lines``.
    """
    from_file = [F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("start"), "value"]
    new = spark.readStream.format("text").option("recursiveFileLookup", True).load(folder).select(*from_file)

    def one(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy("source_path").orderBy("start", "at")
        placed = batch.withColumn("at", F.monotonically_increasing_id()).select("source_path", F.row_number().over(order).cast("long").alias("ord"), "value")
        path = f"{target}-lines/round=0/batch={number}"
        placed.write.mode("overwrite").parquet(path)
        _rebuild(batch.sparkSession, batch.sparkSession.read.schema(placed.schema).parquet(path), sessions, build, target, f"{target}-lines")

    return new.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_lines(spark: SparkSession, raw: DataFrame, build, target: str, sessions) -> None:
    """Files of ``raw`` (source_path, ord, value) whose lines differ from the stored ones replace them, and their sessions
    are rebuilt: the batch refresh for lines that were appended to files a stream has read already.

    ``raw`` names files and numbers lines in the order of the stream, from 1 on.
    """
    lines = f"{target}-lines"
    mark = lambda df: df.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("ord", "value")).alias("h"))
    stored = _stored_lines(spark, lines)
    differ = materialized(mark(raw).exceptAll(mark(stored)).select("source_path"), "differ")
    number = (stored.agg(F.max("round")).first()[0] or 0) + 1
    raw.join(differ, "source_path", "left_semi").select("source_path", "ord", "value").write.mode("overwrite").parquet(f"{lines}/round={number}/batch=0")
    _rebuild(spark, differ, sessions, build, target, lines)
