r"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, how often the mix takes it. Of all rates between 0 and ``most`` under which each source
gives its target of words, those with the least sum of ``size**spread * (r ln r - r)`` are wanted: they change the documents
as little as they can. Their form is r = min(most, exp(lambda * x)) with x = (size / mean)**(1 - spread), one lambda for each
source: an exponential tilt. ``spread`` 1 would count words, so that all documents of a source had one rate; 0 counts documents,
so that a few long ones bear all the change; the default lies between.

1. Documents are counted by (source, size), so what is iterated over holds a row for each size that occurs.
2. Sources are numbered in order (code points, none last) by ranges, and their targets found by sharing again and again what
   exceeds ``most`` times a source.
3. The convex dual (sum of exp(lambda x) words less lambda times the target) is solved by Newton steps for all sources at once: each
   is one aggregation of gradient and second derivative by source. A step that leaves the interval known to hold the
   solution halves it instead, so it always converges.
4. Rates become copies: a source's documents are dealt to buckets by hash, and go by from the longest to the shortest; each
   is taken as often as its rate rounded down or up, whichever keeps the words taken nearer to those wanted so far.

No source is ever gathered in one task, and the driver sees sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import documents, tidy, written

#: Of the words of all documents, and how often one may be taken.
SHARE, MOST = 1.5, 2
#: Weights of the sources in order, again from the first after the last.
WEIGHTS = (3, 1, 2)
SPREAD = 0.5
#: Documents that are rounded one after another.
BUCKET = 2_000
#: Of a source's target, what its rates may miss it by before they are rounded; and the most steps to get there.
EXACT, STEPS = 1e-9, 200


def numbered(sources: DataFrame) -> DataFrame:
    """With ``k``: the place of each row in the order of ``source`` (null last), from 0 on; no task sees all of them."""
    order = F.col("source").asc_nulls_last()
    dealt = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = dealt.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("part", part).join(starts, "part").withColumn("k", place).drop("part", "at", "before")


def targets(sources: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """With ``target``: ``share`` of all words by weight, at most ``most`` times a source's own.

    ``sources`` has (k, source_size). What exceeds a bound is shared by weight among those below theirs until none exceeds it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    goal = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, bounded = 0.0, -1
    while True:
        full = F.col("bound") <= F.col("weight") * F.lit(level)
        r = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("bound")).otherwise(0.0)).alias("held"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if r.n == bounded or not r.open:
            return rows.withColumn("target", F.least(F.col("bound"), F.col("weight") * F.lit(level) if r.open else F.col("bound"))).drop("weight", "bound")
        bounded, level = r.n, max((goal - r.held) / r.open, 0.0)


def balanced(cells: DataFrame, sources: DataFrame, most: float = MOST, spread: float = SPREAD) -> DataFrame:
    """``sources`` (k, source_size, target, mean) with ``lam``: the multiplier of each source that is neither empty nor full.

    ``cells`` has (k, size, n): how many documents of a source have a size.
    """
    tilt = F.pow(F.col("size") / F.col("mean"), F.lit(1.0 - spread))
    within = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    held = cells.filter("size > 0")
    least = held.groupBy("k").agg(F.min("size").alias("least"))
    start = sources.filter(within).join(least, "k").withColumn("x", F.pow(F.col("least") / F.col("mean"), F.lit(1.0 - spread)))
    # at these ends the rates give too little and too much
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("x"))
    state = written(start.select("k", "target", "mean", F.lit(0.0).alias("lam"), low.alias("low"), (F.log(F.lit(float(most))) / F.col("x")).alias("high"), F.lit(None).cast("double").alias("miss")), "newton")
    for _ in range(STEPS):
        words = F.col("size") * F.col("n")
        free = F.exp(F.col("lam") * tilt)
        given = F.sum(words * F.least(free, F.lit(float(most)))).alias("given")
        slope = F.sum(F.when(free < most, words * tilt * free).otherwise(0.0)).alias("slope")
        sums = held.join(state, "k").groupBy("k", "target", "mean", "lam", "low", "high").agg(given, slope)
        over = F.col("given") - F.col("target")
        step = F.col("lam") - over / F.col("slope")
        moved = sums.withColumn("low", F.when(over < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("lam")).otherwise(F.col("high")))
        done = F.abs(over) <= EXACT * F.col("target")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        lam = F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = written(moved.select("k", "target", "mean", lam.alias("lam"), "low", "high", F.when(done, 0.0).otherwise(F.abs(over) / F.col("target")).alias("miss")), "newton")
        if not state.agg(F.max("miss")).first()[0]:
            break
    return sources.join(state.select("k", "lam"), "k", "left")


def rounded(rates: DataFrame, buckets: str = "buckets") -> DataFrame:
    """(…, copies): ``rates`` has (k, size, rate, buckets) and further columns; each bucket of a source is rounded by itself."""
    names = [c for c in rates.columns if c not in (buckets, "rate")]
    shape = ", ".join(f"`{n}` {rates.schema[n].dataType.simpleString()}" for n in names) + ", copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owed = None, 0.0
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            copies = []
            for k, b, size, rate in zip(*(batch.column(at[n]).to_pylist() for n in ("k", "_bucket", "size", "rate"))):
                if (k, b) != key:
                    key, owed = (k, b), 0.0
                least = int(rate)
                owed += (rate - least) * size
                more = rate > least and 2 * owed >= size > 0
                owed -= size * more
                copies.append(least + more)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(copies, pa.int64())], [*names, "copies"])

    dealt = rates.withColumn("_tie", F.xxhash64("doc_id")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(1)), F.col(buckets)))
    dealt = dealt.repartition("k", "_bucket").sortWithinPartitions("k", "_bucket", F.col("size").desc(), "_tie", "doc_id")
    return dealt.select(*names, "rate", "_bucket").mapInArrow(tidy(run), shape)


def mix_sources(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: float = MOST, spread: float = SPREAD) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row.

    ``size`` are words parted by ASCII white space (null and empty texts: 0, never taken more than 0 words), counted whole
    whatever their length. Rows without a source are a source of their own, the last one. Repeated rows and null ids are rows like
    others; of rows equal in id and size it makes no difference which is taken. If no document has a word, all targets are 0;
    an empty table gives none; other columns are ignored. ``share`` must not exceed ``most``.
    """
    if share > most:
        raise ValueError("the mix can't hold more words than `most` times all of them")
    source = F.col("source").cast("string")
    counted = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(counted, F.lit(0)).cast("long").alias("size")), "sizes")
    by_size = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
    whole = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("said"))
    listed = written(targets(numbered(whole), share, weights, most).withColumn("mean", F.col("source_size") / F.greatest("said", F.lit(1))), "targets")
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    names = listed.select("source", "k")
    cells = written(by_size.join(names, same(by_size, names)).select("k", "size", "n"), "cells")
    solved = written(balanced(cells, listed.drop("source"), most, spread).join(names, "k"), "solved")
    tilt = F.pow(F.col("size") / F.col("mean"), F.lit(1.0 - spread))
    rate = F.when(F.col("lam").isNotNull(), F.least(F.exp(F.col("lam") * tilt), F.lit(float(most)))).when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("rows") / BUCKET)
    rates = rows.join(solved, same(rows, solved)).select("doc_id", rows["source"], "k", "size", "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"), buckets.alias("buckets"))
    done = rounded(rates.withColumn("wanted", F.col("rate")))
    return done.select("doc_id", "source", "size", "source_size", "target", F.col("wanted").alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
