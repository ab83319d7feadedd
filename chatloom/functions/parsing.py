"""Column functions over raw log records: JSON lines, times, content blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.tables import materialized
from chatloom.schema import BLOCK, MESSAGES, SESSIONS, USAGE

_FENCE = r"(?dm)^```[^\n]*(?:\n|\z)"
_LANGUAGE = r"(?dm)^```([^\n]*)"
_BLOCKS = f"array<{BLOCK}>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, also where ``use`` reads it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(make: Callable[[], object]) -> Callable[[], object]:
    """Columns that depend on nothing are made once: a large expression takes longer to build than to plan."""
    held: dict[int, object] = {}

    @wraps(make)
    def get() -> object:
        key = id(SparkContext._gateway)
        if key not in held:
            held.clear()
            held[key] = make()
        return held[key]

    return get


def no_blocks() -> Column:
    return F.array().cast(_BLOCKS)


def block(kind: str | Column, text: Column, language=None, tool_call_id=None, tool_name=None, success=None) -> Column:
    null = F.lit(None)
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        text.alias("text"),
        (null if language is None else language).cast("string").alias("language"),
        (null if tool_call_id is None else tool_call_id).cast("string").alias("tool_call_id"),
        (null if tool_name is None else tool_name).cast("string").alias("tool_name"),
        (null if success is None else success).cast("boolean").alias("success"),
    ).cast(BLOCK)


def fences(text: Column) -> Column:
    """Text and code blocks of a text, cut at lines that start with three backticks.

    Segment parity tells text from code. A text is kept if anything but line feeds is in it; code ended by a fence is
    kept even when empty. Null gives no blocks.
    """

    def blocks(t: Column) -> Column:
        both = F.struct(F.split(t, _FENCE, -1).alias("s"), F.regexp_extract_all(t, F.lit(_LANGUAGE), F.lit(1)).alias("l"))
        return let(both, cut)

    def cut(z: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            body = F.regexp_replace(s, r"\A\n+", "")
            plain = F.regexp_replace(body, r"(?U)\s+\z", "")
            lang = F.nullif(F.regexp_replace(F.get(z["l"], i - 1), r"(?U)\A`*\s*|\s+\z", ""), F.lit(""))
            code = i % 2 == 1
            keep = F.when(code & (i < F.size(z["s"]) - 1), F.lit(True)).otherwise(body != "")
            return F.when(keep, F.when(code, block("code_block", plain, language=lang)).otherwise(block("text", plain)))

        return F.filter(F.transform(z["s"], one), lambda b: b.isNotNull())

    return F.coalesce(let(F.replace(text, F.lit("\r\n"), F.lit("\n")), blocks), no_blocks())


def iso_time(text: Column) -> Column:
    """ISO time with a zone, else null (Spark alone would accept local times and bare dates)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def millis(number: Column) -> Column:
    return F.timestamp_millis(number.cast("long"))


def utc_text(ts: Column, form: str) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), form)


def json_lines(raw: DataFrame, schema: str, keep_bad: bool = False) -> DataFrame:
    """(source_path, ord, r, bad) of the lines that parse; blank lines are skipped, wrong-typed ones dropped whole."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = raw.filter(F.trim("value") != "").withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", options))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.col("value").rlike(r"\}\s*$") | ~F.col("value").rlike(r"^\s*\{")
    parsed = parsed.withColumn("bad", bad)
    return parsed if keep_bad else parsed.filter("not bad")


def from_variant(v: Column, path: str) -> Column:
    """The string at a path of a variant, null unless it is a string there."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def canonical_json(v: Column) -> Column:
    """Compact JSON of a variant, '' where absent."""
    return F.coalesce(F.to_json(v), F.lit(""))


def usage(present: Column, input_tokens: Column, output_tokens: Column, cache_read=None, cache_write=None) -> Column:
    null = F.lit(None).cast("long")
    return F.when(
        present,
        F.struct(
            F.coalesce(input_tokens, F.lit(0)).cast("long").alias("input_tokens"),
            F.coalesce(output_tokens, F.lit(0)).cast("long").alias("output_tokens"),
            (null if cache_read is None else cache_read).cast("long").alias("cache_read_tokens"),
            (null if cache_write is None else cache_write).cast("long").alias("cache_write_tokens"),
        ),
    ).cast(USAGE)


def summed_usage(input_total: Column, output_total: Column) -> Column:
    return usage((input_total > 0) | (output_total > 0), input_total, output_total)


def base_name(path: Column) -> Column:
    """Last part of a path with either kind of slash; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def first_by(value: Column, order: str = "ord", where: Column | None = None) -> Column:
    """First non-null value in file order, as a partial aggregate (no lines are collected)."""
    ok = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min_by(F.when(ok, value), F.when(ok, F.col(order)))


def last_by(value: Column, order: str = "ord") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def as_sessions(df: DataFrame, provider: str) -> DataFrame:
    return _shaped(df.withColumn("provider", F.lit(provider)), SESSIONS)


#: How a message is placed in its session: parts that follow one another, and the order inside a part.
PLACE = "part bigint, number bigint, name string"
#: Lines, and seconds, of a part.
PART_LINES, PART_SECONDS = 1 << 16, 3600


def placed(df: DataFrame, provider: str, as_of: Column, by_time: bool = False) -> DataFrame:
    """Messages that have blocks, missing times filled with ``as_of``, with their place (``PLACE``) instead of a number.

    The place comes from ``ord``, the line number in a file or the name of a file; ``by_time``: from the time first.
    """
    full = df.filter(F.size("content") > 0).withColumn("timestamp", F.coalesce("timestamp", as_of)).withColumn("provider", F.lit(provider))
    if by_time:
        part, number = F.floor(F.unix_timestamp("timestamp") / PART_SECONDS), F.unix_micros("timestamp")
    else:
        part, number = F.floor(F.col("ord") / PART_LINES), F.col("ord")
    full = full.withColumn("part", part).withColumn("number", number).withColumn("name", F.col("ord").cast("string"))
    return _shaped(full.withColumn("message_id", F.coalesce("message_id", F.lit(""))), f"{MESSAGES}, {PLACE}")


def numbered(rows: DataFrame) -> DataFrame:
    """``seq`` of placed messages: 0, 1, ... inside each session and source.

    No session is sorted as a whole: its parts are dealt over the tasks and written in order; the rows of a part are counted,
    the counts of a session (a row a part) summed up, and a number is what came before its part plus the place in it.
    """
    own = ["provider", "session_id", "source_path"]
    dealt = rows.repartition(*own, "part").sortWithinPartitions(*own, "part", "number", "name").withColumn("at", F.monotonically_increasing_id())
    held = materialized(dealt.drop("number", "name"), "placed")
    parts = held.groupBy(*own, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return _shaped(held.join(parts, [*own, "part"]).withColumn("seq", F.col("before") + F.col("at") - F.col("first")), MESSAGES)


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl).fields
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
