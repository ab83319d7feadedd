"""The search index as tables that are refreshed by segments and published as versions.

A *segment* is written once: ``docs`` (numbered in the order of their keys, ``1 << CHUNK_BITS`` to a *chunk*), ``postings`` (a row
for each field, term and chunk with its documents, counts, lengths and positions, and the bounds of its weights), ``terms``
(document counts) and ``fields`` (documents and words). Postings and terms are partitioned by a hash of the term, so a search reads
the buckets of its words alone, and sorted by term, so most row groups of these are skipped too.

A refresh tokenises the new documents of touched sessions and the old ones that they replace, nothing else: the former are
a new segment, the latter are noted as dead, and what they counted for is taken off in the new segment's statistics. Numbers
of documents and words add up over segments, so scores are those of a full build. Too many segments are merged into one
without tokenising.

A *version* (``versions/v=N``) lists segments, dead documents and the manifest of what was read. Its list of segments is
written last and makes it valid: a job that stops before leaves the version before it. One job at a time may write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators import search
from chatloom.operators.search import FIELDS, KEYS, B, K1
from chatloom.operators.tables import materialized

#: Documents of a chunk: a number of bits.
CHUNK_BITS = 10
#: Documents for each bucket of terms, and how many buckets there may be.
BUCKET_DOCS, BUCKETS = 20_000, (8, 4096)
#: Documents for each task that cuts texts to words, and how many tasks a core gets at least.
CUT_DOCS, CUT_TASKS = 20_000, 4
#: Segments of a version; more are merged.
SEGMENTS = 8
#: Words that are named to the scan; of more, only the buckets are.
NAMED = 500
SESSION = ["provider", "session_id"]
_DOCS = "doc bigint, chunk bigint, provider string, session_id string, seq bigint, message_id string, provider_label string, project string, role_label string, content string, timestamp bigint"
_POSTINGS = "field string, term string, chunk bigint, n int, most int, least int, entries array<struct<doc:bigint,tf:int,dl:int,positions:array<int>>>, bucket int"
_TERMS = "field string, term string, df bigint, bucket int"
_FIELDS = "field string, n_docs bigint, words bigint"
_DEAD = "segment string, doc bigint, chunk bigint"
_SEGMENTS = "segment string, buckets int"
#: Fields that match as a whole, and the column they are in.
WHOLE = {"provider": "provider_label", "role": "role_label", "session_id": "session_id", "message_id": "message_id"}


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were published, in order."""
    at, store = _files(spark, f"{path}/versions")
    if not store.exists(at):
        return []
    names = [f.getPath().getName() for f in store.listStatus(at)]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
    return [n for n in numbers if store.exists(_files(spark, f"{path}/versions/v={n}/segments/_SUCCESS")[0])]


@dataclass
class Index:
    """One version of an index, the newest unless a number is given."""

    spark: SparkSession
    path: str
    number: int | None = None

    def __post_init__(self) -> None:
        found = versions(self.spark, self.path)
        if self.number is None and found:
            self.number = found[-1]
        if self.number is not None and self.number not in found:
            raise ValueError(f"no version {self.number} at {self.path}")
        # a row a segment, of which there are few
        self.segments = [] if self.number is None else sorted((r.segment, r.buckets) for r in self._own("segments", _SEGMENTS).collect())

    def _own(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(f"{self.path}/versions/v={self.number}/{name}")

    def _union(self, name: str, shape: str, only: dict[int, list[int]] | None = None) -> DataFrame:
        rows = []
        for segment, buckets in self.segments:
            own = self.spark.read.schema(shape).parquet(f"{self.path}/segments/{segment}/{name}")
            rows.append((own if only is None else own.filter(F.col("bucket").isin(only.get(buckets, [])))).withColumn("segment", F.lit(segment)))
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], f"{shape}, segment string")

    def dead(self) -> DataFrame:
        return self.spark.createDataFrame([], _DEAD) if self.number is None else self._own("dead", _DEAD)

    def stored(self, name: str, shape: str) -> DataFrame:
        """A table that was published with the version; without rows if there was none."""
        at = f"{self.path}/versions/v={self.number}/{name}"
        there, store = _files(self.spark, at)
        return self._own(name, shape) if self.number is not None and store.exists(there) else self.spark.createDataFrame([], shape)

    def docs(self) -> DataFrame:
        """(segment, doc, …) of the documents that are alive."""
        return self._union("docs", _DOCS).join(self.dead(), ["segment", "doc"], "left_anti")

    def postings(self) -> DataFrame:
        """(field, term, provider, session_id, seq, tf, positions, dl) of all documents."""
        one = self._union("postings", _POSTINGS).select("segment", "field", "term", F.explode("entries").alias("e"))
        return one.select("segment", "field", "term", "e.*").join(self.docs().select("segment", "doc", *KEYS), ["segment", "doc"]).select("field", "term", *KEYS, "tf", "positions", "dl")

    def term_stats(self, only: dict[int, list[int]] | None = None) -> DataFrame:
        """(field, term, df) over all segments."""
        return self._union("terms", _TERMS, only).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def field_stats(self) -> DataFrame:
        """(field, n_docs, avgdl)."""
        sums = self._union("fields", _FIELDS).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
        return sums.filter("n_docs > 0").select("field", "n_docs", (F.col("words") / F.col("n_docs")).alias("avgdl"))

    def buckets_of(self, terms: DataFrame) -> dict[int, list[int]]:
        """For each number of buckets that occurs, those of ``terms``; the driver sees no more than there are buckets."""
        kinds = sorted({b for _, b in self.segments})
        if not kinds:
            return {}
        which = F.explode(F.array(*[F.struct(F.lit(b).alias("of"), bucket(F.col("term"), b).alias("at")) for b in kinds])).alias("x")
        out: dict[int, list[int]] = {b: [] for b in kinds}
        for r in terms.select(which).distinct().select("x.*").collect():
            out[r.of].append(r.at)
        return out

    def blocks(self, terms: DataFrame, only: dict[int, list[int]]) -> DataFrame:
        """Postings of the buckets ``only``, and if ``terms`` are few, of these."""
        rows = self._union("postings", _POSTINGS, only)
        few = [r.term for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
        return rows if len(few) > NAMED else rows.filter(F.col("term").isin(few))


# ---- writing
def _entries(docs: DataFrame, longest: int) -> DataFrame:
    """(doc, chunk, field, term, tf, positions, dl) of numbered documents."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), search.tokens(F.col(f), longest).alias("t")) for f in FIELDS]))
    one = docs.select("doc", "chunk", fields.alias("x")).select("doc", "chunk", "x.field", F.size("x.t").alias("dl"), F.explode(search.runs(F.col("x.t"))).alias("q"))
    return one.select("doc", "chunk", "field", "q.term", F.size("q.positions").alias("tf"), F.transform("q.positions", lambda p: p.cast("int")).alias("positions"), "dl")


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents by ranges of their keys, numbered in order."""
    names = [c.split()[0] for c in _DOCS.split(", ")]
    at = docs.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("doc", F.monotonically_increasing_id())
    return at.withColumn("chunk", F.shiftright("doc", CHUNK_BITS)).select(*names)


def _write_segment(spark: SparkSession, path: str, docs: DataFrame, entries, minus: tuple[DataFrame, DataFrame] | None = None) -> tuple[str, int]:
    """Write documents and what ``entries(numbered documents)`` gives; the name of the segment and its buckets.

    ``minus``: (field, term, df) and (field, n_docs, words) to be added to its statistics, with a sign of their own.
    """
    segment = uuid.uuid4().hex
    root = f"{path}/segments/{segment}"
    _numbered(docs).write.parquet(f"{root}/docs")
    held = spark.read.schema(_DOCS).parquet(f"{root}/docs")
    count = held.count()
    buckets = min(max(-(-count // BUCKET_DOCS), BUCKETS[0]), BUCKETS[1])
    # cutting texts takes long for their bytes, by which the files are dealt; chunks stay together
    tasks = max(CUT_TASKS * spark.sparkContext.defaultParallelism, -(-count // CUT_DOCS))
    rows = entries(held.repartition(tasks, "chunk"))
    entry = F.struct("doc", "tf", "dl", "positions")
    grouped = rows.groupBy("field", "term", "chunk").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.sort_array(F.collect_list(entry)).alias("entries"))
    # a very common term has a row a chunk: partitions that are too large are split, small ones put together
    dealt = grouped.withColumn("bucket", bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "chunk")
    dealt.write.partitionBy("bucket").parquet(f"{root}/postings")
    made = spark.read.schema(_POSTINGS).parquet(f"{root}/postings")
    terms = made.groupBy("field", "term").agg(F.sum("n").alias("df"))
    words = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["tf"])
    fields = made.groupBy("field").agg(F.sum(words).alias("words")).select("field", F.lit(0).cast("long").alias("n_docs"), "words")
    fields = fields.unionByName(spark.createDataFrame([(f, count, 0) for f in FIELDS], _FIELDS))
    if minus is not None:
        terms = terms.unionByName(minus[0]).groupBy("field", "term").agg(F.sum("df").alias("df"))
        fields = fields.unionByName(minus[1])
    terms.withColumn("bucket", bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/terms")
    fields.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words")).coalesce(1).write.parquet(f"{root}/fields")
    return segment, buckets


def publish(spark: SparkSession, path: str, segments: list[tuple[str, int]], dead: DataFrame, tables: dict[str, DataFrame] | None = None) -> Index:
    """Make a version of these segments and tables; it is valid once its list of segments is written."""
    found = versions(spark, path)
    number = (found[-1] if found else 0) + 1
    root = f"{path}/versions/v={number}"
    for name, rows in (tables or {}).items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
    dead.write.mode("overwrite").parquet(f"{root}/dead")
    spark.createDataFrame(segments, _SEGMENTS).coalesce(1).write.mode("overwrite").parquet(f"{root}/segments")
    return Index(spark, path, number)


def refresh(spark: SparkSession, path: str, docs: DataFrame, touched: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, most: int = SEGMENTS, longest: int = search.LONGEST) -> Index:
    """Replace the documents of the ``touched`` sessions by those of ``docs`` (sessions without any go) and publish.

    ``touched`` (provider, session_id) none: all sessions of ``docs``. ``tables`` are published with the version. ``longest``: bytes from which
    on words are not indexed; it must be that of the segments that are there.
    """
    now = Index(spark, path)
    dead, minus, fresh = now.dead(), None, docs
    if touched is not None or now.segments:
        keys = materialized((docs if touched is None else touched).select(*SESSION).distinct(), "touched")
        fresh = docs.join(keys, SESSION, "left_semi")
    if now.segments:
        gone = materialized(now.docs().join(keys, SESSION, "left_semi"), "replaced")
        old = _entries(gone, longest)
        counts = materialized(old.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("words")), "taken-off")
        there = gone.agg((-F.count(F.lit(1))).alias("n_docs"))
        less = counts.groupBy("field").agg(F.sum("words").alias("words")).select("field", F.lit(0).cast("long").alias("n_docs"), "words")
        for f in FIELDS:
            less = less.unionByName(there.select(F.lit(f).alias("field"), "n_docs", F.lit(0).cast("long").alias("words")))
        minus = counts.select("field", "term", "df"), less
        dead = dead.unionByName(gone.select("segment", "doc", "chunk"))
    own = _write_segment(spark, path, fresh, lambda held: _entries(held, longest), minus)
    made = publish(spark, path, [*now.segments, own], dead, tables)
    return made if len(made.segments) <= most else merge(spark, path)


def merge(spark: SparkSession, path: str) -> Index:
    """One segment of all documents that are alive. Postings are renumbered and regrouped, texts aren't read again."""
    now = Index(spark, path)
    if not now.segments:
        return now
    live = materialized(now.docs(), "live")
    old = now._union("postings", _POSTINGS).select("segment", "field", "term", F.explode("entries").alias("e")).select("segment", "field", "term", "e.*")

    def renumbered(held: DataFrame) -> DataFrame:
        place = live.select("segment", F.col("doc").alias("was"), *KEYS).join(held.select("doc", "chunk", *KEYS), list(KEYS)).select("segment", "was", "doc", "chunk")
        return old.withColumnRenamed("doc", "was").join(place, ["segment", "was"]).drop("segment", "was")

    own = _write_segment(spark, path, live, renumbered)
    tables = {}
    at, store = _files(spark, f"{path}/versions/v={now.number}")
    for f in store.listStatus(at):
        name = f.getPath().getName()
        if name not in ("dead", "segments"):
            tables[name] = spark.read.parquet(f"{path}/versions/v={now.number}/{name}")
    return publish(spark, path, [own], now.dead().filter("false"), tables)


def clear(spark: SparkSession, path: str) -> Index:
    """A version that holds nothing."""
    return publish(spark, path, [], spark.createDataFrame([], _DEAD))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove versions but the last ``keep``, unfinished ones too, and segments that none of these lists."""
    found = versions(spark, path)[-keep:]
    used = {s for n in found for s, _ in Index(spark, path, n).segments}
    for folder, kept in (("versions", {f"v={n}" for n in found}), ("segments", used)):
        at, store = _files(spark, f"{path}/{folder}")
        for f in store.listStatus(at) if store.exists(at) else []:
            if f.getPath().getName() not in kept:
                store.delete(f.getPath(), True)


# ---- reading
class Reader:
    """The words of a table of queries in an index: their weights, and the blocks that hold them.

    ``wanted`` has (query, field, term), each once.
    """

    def __init__(self, index: Index, wanted: DataFrame, digits: int | None = None) -> None:
        self.index, self.digits = index, digits
        self.only = index.buckets_of(wanted)
        stats = index.term_stats(self.only).join(F.broadcast(index.field_stats()), "field")  # a row a field
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = materialized(wanted.join(stats, ["field", "term"]).select("query", "field", "term", idf.alias("idf"), "avgdl"), "weights")
        self.rows = index.blocks(wanted, self.only)

    @staticmethod
    def _weight(tf: Column, dl: Column) -> Column:
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

    def score(self, chunks: DataFrame | None = None) -> DataFrame:
        """(query, segment, doc, score) of the documents with a word of the query; ``chunks``: of these (query, segment, chunk) alone."""
        hit = self.rows.select("segment", "field", "term", "chunk", F.transform("entries", lambda e: F.struct(e["doc"].alias("doc"), e["tf"].alias("tf"), e["dl"].alias("dl"))).alias("entries")).join(self.weights, ["field", "term"])
        if chunks is not None:
            hit = hit.join(chunks.select("query", "segment", "chunk"), ["query", "segment", "chunk"], "left_semi")
        one = hit.select("query", "segment", "idf", "avgdl", F.explode("entries").alias("e"))
        sums = one.groupBy("query", "segment", F.col("e.doc").alias("doc")).agg(F.sum(self._weight(F.col("e.tf"), F.col("e.dl"))).alias("score"))
        sums = sums if self.digits is None else sums.withColumn("score", F.round("score", self.digits))
        return sums.join(self.index.dead(), ["segment", "doc"], "left_anti")

    def bounds(self) -> DataFrame:
        """(query, segment, chunk, bound, n): no document of the chunk scores higher, and at least n that are alive hold a word."""
        best = self._weight(F.col("most"), F.col("least"))
        rows = self.rows.select("segment", "field", "term", "chunk", "n", "most", "least").join(self.weights, ["field", "term"]).groupBy("query", "segment", "chunk").agg(F.sum(best).alias("bound"), F.max("n").alias("n"))
        dead = self.index.dead().groupBy("segment", "chunk").agg(F.count(F.lit(1)).alias("dead"))
        return rows.join(dead, ["segment", "chunk"], "left").select("query", "segment", "chunk", "bound", F.greatest(F.col("n") - F.coalesce("dead", F.lit(0)), F.lit(0)).alias("n"))

    def best(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The hits (query, segment, doc, score) that may be among the best ``k`` of each query, and the chunks they come from.

        Chunks are taken from the highest bound on until they hold ``k`` hits; the k-th score of these is one that the others
        have to reach. Chunks with a bound below it are not opened. Of the others all documents are scored, so nothing is lost,
        ties included.
        """
        slack = 1e-6  # sums in another order, and rounded scores
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "segment", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chunks = materialized(self.bounds().withColumn("first", ahead < k), "chunks")
        early = materialized(self.score(chunks.filter("first")), "early")
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc())
        needed = early.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k).groupBy("query").agg(F.when(F.max("r") == k, F.min("score")).alias("needed"))
        needed = materialized(needed, "needed")
        late = chunks.filter("not first").join(needed, "query", "left").filter(F.col("needed").isNull() | (F.col("bound") + slack >= F.col("needed")))
        late = materialized(late.select("query", "segment", "chunk"), "late")
        hits = early.unionByName(self.score(late))
        kept = hits.join(needed, "query", "left").filter(F.col("needed").isNull() | (F.col("score") >= F.col("needed"))).drop("needed")
        return kept, chunks.filter("first").select("query", "segment", "chunk").unionByName(late)


def with_keys(index: Index, hits: DataFrame) -> DataFrame:
    """(query, provider, session_id, seq, score) of hits (query, segment, doc, score)."""
    return hits.join(index._union("docs", _DOCS).select("segment", "doc", *KEYS), ["segment", "doc"]).select("query", *KEYS, "score")


def _plain(queries: DataFrame, longest: int) -> DataFrame:
    fields = F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field")
    return search.query_terms(queries, longest).select("query", fields, "term")


def scored(index: Index, queries: DataFrame, digits: int | None = None, longest: int = search.LONGEST) -> DataFrame:
    """(query, keys, score) of every document that holds a word of the query (query, text)."""
    return with_keys(index, Reader(index, _plain(queries, longest), digits).score())


def topk(index: Index, queries: DataFrame, k: int = 200, digits: int | None = None, longest: int = search.LONGEST) -> DataFrame:
    """The best ``k`` hits of each query with their rank; ties by key. Chunks that can't hold one are not opened."""
    return search.topk(with_keys(index, Reader(index, _plain(queries, longest), digits).best(k)[0]), k)


# ---- query texts
_CLAUSE = r'[+\-]?(?:(?:' + "|".join((*FIELDS, *WHOLE)) + r'):)?(?:"[^"]*"?|[^\s"]+)'
_PARTS = r'^([+\-]?)(?:(' + "|".join((*FIELDS, *WHOLE)) + r'):)?"?([^"]*)"?$'


def clauses(queries: DataFrame, longest: int = search.LONGEST) -> DataFrame:
    """(query, clause, sign, field, said, words) of query texts (query, text).

    A clause is a word or a quoted phrase; ``+`` before it: required, ``-``: excluded; ``field:`` restricts it to content or
    project, or compares provider, role, session_id or message_id as a whole. ``a AND b`` requires both, ``NOT a`` excludes, OR is what
    words do anyway. Words are cut as the index cuts texts, so a word with signs inside is a phrase; what holds no word is no
    clause. There are no brackets. A text of blanks has no clause.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_CLAUSE), F.lit(0))
    rows = queries.select("query", found.alias("all")).select("query", "all", F.posexplode("all").alias("clause", "said"))
    near = lambda n: F.coalesce(F.get("all", F.col("clause") + n), F.lit(""))
    part = lambda n: F.regexp_extract("said", _PARTS, n)
    own, before, after = part(1), near(-1), near(1)
    sign = F.when(own != "", own).when(before == "NOT", "-").when((before == "AND") | (after == "AND"), "+").otherwise("")
    rows = rows.filter(~F.col("said").isin("AND", "OR", "NOT")).select("query", "clause", sign.alias("sign"), F.nullif(part(2), F.lit("")).alias("field"), part(3).alias("said"))
    rows = rows.withColumn("words", F.when(F.coalesce("field", F.lit("")).isin(*WHOLE), F.array().cast("array<string>")).otherwise(search.tokens(F.col("said"), longest)))
    return rows.filter((F.size("words") > 0) | (F.coalesce("field", F.lit("")).isin(*WHOLE) & (F.col("said") != "")))


def search_texts(index: Index, queries: DataFrame, k: int | None = None, digits: int | None = None, longest: int = search.LONGEST) -> DataFrame:
    """Hits (query, keys, score, rank) of a table of query texts (query, text); see :func:`clauses`.

    A hit meets every required clause and no excluded one, or, if none is required, at least one clause. The words of clauses that
    aren't excluded are scored, also where a phrase isn't met; whole fields add nothing. A query that only excludes finds nothing.
    """
    asked = materialized(clauses(queries, longest), "clauses")
    text = asked.filter(F.size("words") > 0)
    fields = F.explode(F.when(F.col("field").isNull(), F.array(*[F.lit(f) for f in FIELDS])).otherwise(F.array("field"))).alias("field")
    words = text.select("query", "clause", "sign", F.size("words").alias("of"), fields, F.posexplode("words").alias("k", "term"))
    reader = Reader(index, words.select("query", "field", "term").distinct(), digits)
    wanted = materialized(words, "words")

    held = reader.rows.join(wanted, ["field", "term"])
    single = held.filter("of = 1").select("query", "clause", "segment", F.explode(F.transform("entries", lambda e: e["doc"])).alias("doc"))
    several = held.filter("of > 1").select("query", "clause", "segment", "field", "of", "k", F.explode("entries").alias("e")).select("query", "clause", "segment", "field", "of", "k", "e.doc", F.explode("e.positions").alias("p"))
    phrase = several.groupBy("query", "clause", "segment", "field", "doc", "of", (F.col("p") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("met")).filter("met = of")
    met = single.unionByName(phrase.select("query", "clause", "segment", "doc"))
    docs = index._union("docs", _DOCS)
    for name, column in WHOLE.items():
        one = asked.filter(F.col("field") == name).select("query", "clause", F.col("said").alias(column))
        met = met.unionByName(docs.select("segment", "doc", column).join(one, column).select("query", "clause", "segment", "doc"))
    met = met.distinct().join(asked.select("query", "clause", "sign"), ["query", "clause"])
    count = lambda s: F.count_if(F.col("sign") == s)
    needs = asked.groupBy("query").agg(count("+").alias("needs"))
    found = met.groupBy("query", "segment", "doc").agg(count("+").alias("has"), count("-").alias("not"), count("").alias("may")).join(needs, "query")
    kept = found.filter("has = needs and not = 0 and (needs > 0 or may > 0)".replace("not =", "`not` =")).select("query", "segment", "doc")
    scoring = wanted.filter("sign <> '-'").select("query", "field", "term").distinct()
    reader.weights = materialized(reader.weights.join(scoring, ["query", "field", "term"], "left_semi"), "weights")
    hits = kept.join(index.dead(), ["segment", "doc"], "left_anti").join(reader.score(), ["query", "segment", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), *KEYS)
    ranked = with_keys(index, hits).withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
