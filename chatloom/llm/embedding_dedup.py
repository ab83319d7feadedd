"""Near-duplicate vectors with a pivot-permutation index.

Pivots come from a sample of the distinct vectors: ``PIVOTS`` x the square root of their number, and at most
``PIVOT_BYTES``, which bounds what is sent to every task (fewer pivots make longer lists, which lose nothing). They lie
apart from one another, as many pivots inside one dense cluster would be ranked by noise. A vector is described by its
``NEAREST`` nearest pivots. Two vectors are candidates when they share at least ``SHARED`` pivots, and each candidate pair
is verified by its cosine in double precision. In the order of how often pivots occur, the rarest first, the first shared
pivot of such a pair is among the first ``NEAREST`` - ``SHARED`` + 1 of both, so a vector is in so many inverted lists (of
its label) only, and a pair belongs to the list of the first pivot it shares.

Equal vectors are one entry with a count, so a common vector costs as much as any. Where pivots are at their bound and
lists grow with the table, a list of more than ``DEEP`` blocks is dealt out by the second pivot that a pair shares: a
vector is then in one shorter list for each pivot that follows, and the pairs are the same. This is done where the
counted lengths say that less is compared; a cluster whose vectors all share all pivots stays one list. Lists longer
than ``BLOCK`` are compared block by block in separate tasks. A block gives, for each of its vectors, the number of links and one edge to a
representative of its links, never all pairs.

Recall: a pair above the threshold is lost only if the two share fewer than ``SHARED`` pivots; tests measure it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import components, grouped, local_roots, table, tidy, written

COSINE = 0.93
PIVOTS = 4.0
#: The most that the pivots may take, as doubles.
PIVOT_BYTES = 64_000_000
NEAREST = 6
SHARED = 2
#: Cosines that pivots may have with one another at most; the next where that leaves fewer than half of those wanted.
APART = (0.8, 0.9, 0.95, 2.0)
BLOCK = 2048
#: Blocks of a list beyond which it may be dealt out by second pivots.
DEEP = 4
#: Pairs whose pivots are compared at a time.
PAIRS = 65_536


def can_link() -> Column:
    """A label, and a vector of finite components that is not zero."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("label").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: float = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Labels must be equal for a link. Vectors that are null, zero, or hold null or non-finite components, and rows without
    label, link with nothing and are kept. Vectors of different dimension never link; of any dimension, all components count.
    Rows with the same id and vector count as copies of one another, rows without id like others; an empty table gives
    none; other columns are ignored. A text column, however long its texts, is never read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind))
    entries = written(
        rows.filter(can_link()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")).withColumn("entry", F.xxhash64("label", "embedding")),
        "vectors",
    )
    count, widest = entries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    most = max(16, min(int(pivots * math.sqrt(count)), PIVOT_BYTES // (8 * (widest or 1))))
    wide: dict[int, list] = {}
    for r in entries.select("entry", "embedding").orderBy("entry").limit(most).toLocalIterator():
        wide.setdefault(len(r["embedding"]), []).append(np.array(r["embedding"], float))
    sent = spark.sparkContext.broadcast({d: apart(_unit(np.array(v))) for d, v in wide.items()})
    number = "f4" if kind == "array<float>" else "f8"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets))
            values = np.asarray(lists.flatten())
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                raw = values[(ends[own] - d)[:, None] + np.arange(d)]
                matrix = sent.value.get(d)
                if matrix is None:
                    near = np.zeros((len(own), 1), np.int32)  # no pivot of this dimension was drawn: one list
                else:
                    near = np.empty((len(own), min(nearest, len(matrix))), np.int32)
                    x = _unit(raw.astype(float))
                    for a in range(0, len(own), 2048):
                        sims = x[a : a + 2048] @ matrix.T
                        near[a : a + 2048] = np.argpartition(-sims, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
                    near.sort(axis=1)  # pivots that are equally rare come in one order in all vectors
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), pa.array(np.full(len(own), d, np.int32)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array([v.tobytes() for v in near], pa.binary()), pa.array([v.astype(number).tobytes() for v in raw], pa.binary())],
                    ["label", "d", "entry", "times", "near", "vector"],
                )

    described = written(entries.select("label", "entry", "times", "embedding").mapInArrow(tidy(describe), "label string, d int, entry long, times long, near binary, vector binary"), "described")

    def ordered(near: list[bytes], rank: dict[int, np.ndarray] | None, d: np.ndarray) -> list[np.ndarray]:
        """Pivots of each row, rarest first."""
        own = [np.frombuffer(x, np.int32) for x in near]
        return own if rank is None else [x[np.argsort(rank[k][x], kind="stable")] for x, k in zip(own, d.tolist())]

    def listed(rank: dict[int, np.ndarray] | None, near: bool, rest: int):
        """Rows (label, d, pivot) of the lists that every vector is in (all without ``rank``), with its pivots if ``near`` and the ``rest`` columns after them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column(1).to_numpy()
                own = ordered(batch.column(2).to_pylist(), rank, d)
                lists = own if rank is None else [x[: max(1, len(x) - shared + 1)] for x in own]
                pick = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                out = [batch.column(0).take(pick), pa.array(d).take(pick), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))]
                if near:
                    out.append(pa.array(own, pa.list_(pa.int32())).take(pick))
                out += [batch.column(3 + k).take(pick) for k in range(rest)]
                yield pa.RecordBatch.from_arrays(out, ["label", "d", "pivot", "near", "entry", "times", "vector"][: len(out)])

        return tidy(run)

    keys, key_kinds = ["label", "d", "pivot"], "label string, d int, pivot int"
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    # one row for each pivot at most
    often = described.select("label", "d", "near").mapInArrow(listed(None, False, 0), key_kinds).groupBy("d", "pivot").agg(F.count(F.lit(1)).alias("n"))
    rank: dict[int, np.ndarray] = {d: np.zeros(len(m), np.int64) for d, m in sent.value.items()}
    for r in often.toLocalIterator():
        rank.setdefault(r["d"], np.zeros(1, np.int64))[r["pivot"]] = r["n"]
    sizes = described.select("label", "d", "near").mapInArrow(listed(rank, False, 0), key_kinds).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    long_lists = written(sizes.filter(F.col("n") > BLOCK).select(*keys, "n", blocks), "lists")
    posted = described.select("label", "d", "near", "entry", "times", "vector").mapInArrow(listed(rank, True, 3), f"{key_kinds}, near array<int>, entry long, times long, vector binary")
    placed = posted.join(long_lists.drop("n"), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("second", F.lit(-1))
    # pivots after that of the list; with one pivot in all there are none, and a pair may share that one only
    after = F.slice("near", F.array_position("near", F.col("pivot")).cast("int") + 1, F.size("near"))
    deep = long_lists.filter(F.col("blocks") > DEEP)
    if shared > 1 and not deep.isEmpty():
        pivoted = described.select("label", "d", "near").mapInArrow(listed(rank, True, 0), f"{key_kinds}, near array<int>").filter(F.size("near") > 1)
        parts = written(pivoted.join(deep.select(*keys), keys, "left_semi").withColumn("second", F.explode(after)).groupBy(*keys, "second").agg(F.count(F.lit(1)).alias("n")), "parts")
        paying = parts.groupBy(*keys).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        dealt_out = written(deep.join(paying, keys).filter(F.col("work") < F.col("n").cast("double") * F.col("n")).select(*keys, F.lit(True).alias("by_second")), "deep")
        seconds = parts.join(dealt_out, keys, "left_semi").select(*keys, "second", blocks.alias("part_blocks"))
        placed = placed.join(dealt_out, keys, "left").withColumn("second", F.explode(F.when(F.col("by_second"), after).otherwise(F.array(F.lit(-1)))))
        placed = placed.join(seconds, [*keys, "second"], "left").withColumn("blocks", F.coalesce("part_blocks", "blocks"))
    keys.append("second")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "entry", "times", "near", "vector")

    def links(t: pa.Table) -> pa.Table:
        pivot, second_pivot, d = (t.column(k)[0].as_py() for k in ("pivot", "second", "d"))
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        side = np.asarray(t.column("side"))
        entry, times = np.asarray(t.column("entry")), np.asarray(t.column("times"))
        x = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), number).reshape(-1, d).astype(float))
        near = np.asarray(pc.list_flatten(t.column("near"))).reshape(len(entry), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        degree = np.zeros(len(entry), np.int64)
        least = min(shared, near.shape[1])
        first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def owned(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Those of the pairs that share enough pivots, this one (and the second, where the list has one) first."""
            hit = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2)
            at = hit.argmax(axis=1)
            ok = (hit.sum(axis=1) >= least) & (near[p, at] == pivot)
            if second_pivot >= 0:
                hit[np.arange(len(p)), at] = False
                ok &= near[p, hit.argmax(axis=1)] == second_pivot
            return p[ok], q[ok]

        for a in range(0, len(left), 512):
            own = left[a : a + 512]
            p, q = np.nonzero(x[own] @ x[right].T >= cosine)
            p, q = own[p], right[q]
            if same:
                p, q = p[p < q], q[p < q]
            for b in range(0, len(p), PAIRS):
                f, g = owned(p[b : b + PAIRS], q[b : b + PAIRS])
                np.add.at(degree, f, times[g])
                np.add.at(degree, g, times[f])
                first.append(f)
                second.append(g)
                if len(first) > 16:  # a forest is enough for what follows
                    first, second = ([c] for c in local_roots(np.concatenate(first), np.concatenate(second)))
        keep, top = local_roots(np.concatenate(first), np.concatenate(second))
        return pa.table({"entry": entry[keep], "other": entry[top], "n": degree[keep]})

    found = written(grouped(dealt, [*keys, "i", "j"], links, "entry long, other long, n long"), "near")
    degree = found.groupBy("entry").agg(F.sum("n").alias("n"))
    joined = components(found.filter("entry <> other"), "entry", "other")
    named = entries.select("entry", "rep", "times").join(joined.select(F.col("id").alias("entry"), F.col("component_id").alias("root")), "entry", "left")
    named = named.withColumn("alone", F.col("root").isNull()).withColumn("root", F.coalesce("root", "entry"))
    # written, so that the join on a hot component has a shuffle of its own, which Spark splits
    least = written(named.filter("not alone").groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    whole = named.join(least, "root", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    facts = whole.join(degree, "entry", "left").select("entry", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    keyed = rows.withColumn("key", F.xxhash64("label", "embedding"))
    good = keyed.filter(can_link()).select("vec_id", "key").join(facts.withColumnRenamed("entry", "key"), "key").select("vec_id", "n_links", "component_id")
    alone = keyed.filter(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def apart(pool: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Those of the unit vectors, in order, that lie apart from the ones before them."""
    chosen = np.empty(0, np.int64)
    for most in APART:
        for low in range(0, len(pool), chunk):
            some = np.setdiff1d(np.arange(low, min(low + chunk, len(pool))), chosen)
            far = some[(pool[some] @ pool[chosen].T).max(axis=1, initial=-2.0) < most]
            sims = pool[far] @ pool[far].T
            free = np.ones(len(far), bool)
            for k in range(len(far)):
                if free[k]:
                    free[k + 1 :] &= sims[k, k + 1 :] < most
            chosen = np.append(chosen, far[free])
        if 2 * len(chosen) >= len(pool):
            break
    return pool[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
