"""Full-text search: documents, postings with positions, statistics, BM25 queries, snippets.

BM25 (Robertson and Zaragoza 2009) per field, fields summed: ln(1 + (N - df + 0.5) / (df + 0.5)) times
tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.parsing import let
from chatloom.operators.catalog import label, role_label

K1, B = 1.2, 0.75
#: Words of this many bytes or more are not indexed, unless an index is told otherwise.
LONGEST = 40
KEYS = ("provider", "session_id", "seq")
FIELDS = ("content", "project")


def block_text(content: Column) -> Column:
    """All block bodies, one after another on lines."""
    return F.array_join(F.transform(content, lambda b: b["text"]), "\n")


def documents(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """A search document for each message with text, under the display labels."""
    project = sessions.select("provider", "session_id", F.coalesce("project_name", F.lit("")).alias("project")).dropDuplicates(["provider", "session_id"])
    rows = messages.withColumn("body", block_text(F.col("content"))).filter("body <> ''")
    return rows.join(project, ["provider", "session_id"]).select(
        *KEYS, "message_id", label(F.col("provider")).alias("provider_label"), "project", role_label(F.col("role")).alias("role_label"), F.col("body").alias("content"), F.unix_timestamp("timestamp").alias("timestamp")
    )


def tokens(text: Column, longest: int = LONGEST) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < longest))


def runs(found: Column) -> Column:
    """(term, positions) of each distinct term: tokens are sorted in the row, and a run of equal ones is cut out."""

    def cut(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["term"] != F.coalesce(F.get(s, i - 2)["term"], F.lit(""))))
        return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1)["term"].alias("term"), F.transform(F.slice(s, i, F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i), lambda x: x["p"]).alias("positions"))))

    placed = F.array_sort(F.transform(found, lambda t, i: F.struct(t.alias("term"), i.alias("p"))))
    return F.when(F.size(found) > 0, let(placed, cut))


def postings(docs: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """(field, term, keys, tf, positions, dl). Terms are counted inside the row: distinct ones leave it, nothing is shuffled."""
    one = docs.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"))
    rows = one.select(*KEYS, "x.field", F.size("x.t").alias("dl"), F.explode(runs(F.col("x.t"))).alias("q"))
    return rows.select("field", "q.term", *KEYS, F.size("q.positions").alias("tf"), "q.positions", "dl")


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(docs: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """(field, n_docs, avgdl): one row for each field."""
    one = docs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("dl")) for f in fields])).alias("x"))
    return one.groupBy("x.field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("x.dl").alias("avgdl"))


def query_terms(queries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(query, term) of (query, text); blank texts have none."""
    return queries.select("query", F.explode(F.array_distinct(tokens(F.col("text"), longest))).alias("term"))


def scored(docs: DataFrame, queries: DataFrame, fields: tuple = FIELDS, posted: DataFrame | None = None) -> DataFrame:
    """(query, keys, score, terms) of every document that holds a word of the query.

    Only postings of the queries' words are weighed; the words go to the postings (Spark sends them when they are few),
    and the sums meet by (query, document).
    """
    posted = postings(docs, fields) if posted is None else posted
    wanted = query_terms(queries)
    hit = posted.join(wanted.select("term").distinct(), "term", "left_semi")
    weighed = hit.join(term_stats(hit), ["field", "term"]).join(F.broadcast(field_stats(docs, fields)), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighed.withColumn("w", weight).join(wanted, "term").groupBy("query", *KEYS).agg(F.sum("w").alias("score"), F.count_distinct("term").alias("terms"))


def topk(hits: DataFrame, k: int = 200) -> DataFrame:
    """The best ``k`` hits of each query with their rank; ties by key."""
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), *KEYS)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """OR queries over content and project, best first."""
    return topk(scored(docs, queries).drop("terms"), k)


def snippet(text: Column, query: Column, width: int = 120, before: int = 60) -> Column:
    """A window around the first place of the whole query (else from the start), blanks joined, dots at cut ends."""
    at = F.instr(F.lower(text), F.lower(query)) - 1
    start = F.greatest(F.when((at > before) & (query != ""), at - before).otherwise(F.lit(0)), F.lit(0))
    end = F.least(start + width, F.length(text))
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"\s+", " "))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))


def hit_sessions(hits: DataFrame) -> DataFrame:
    """Distinct sessions of each query in order of their best hit."""
    return hits.groupBy("query", "provider", "session_id").agg(F.min("rank").alias("rank"))


def filtered_sessions(hits: DataFrame, sessions: DataFrame, providers=None, project=None, first=None, last=None) -> DataFrame:
    """Known sessions among the hits, then the catalog's filters (after the hit limit)."""
    from chatloom.operators.catalog import filter_all

    return filter_all(sessions.join(hit_sessions(hits), ["provider", "session_id"]), providers, project, first, last)
