"""Claude Code logs: ``projects/<project>/<session>.jsonl`` and ``history.jsonl``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import as_sessions, block, canonical_json, fences, first_by, from_variant, iso_time, json_lines, last_by, millis, no_blocks, numbered, once, placed, stem, summed_usage, usage

PROVIDER = "claude_code"
SCHEMA = (
    "type string, uuid string, timestamp string, gitBranch string, cwd string, message struct<role:string,model:string,content:variant,"
    "usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
)
HISTORY = "display string, timestamp bigint, project string, sessionId string"


def _rows(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    return json_lines(lines, SCHEMA, keep_bad).withColumn("session_id", stem(F.col("source_path")))


def history(lines: DataFrame) -> DataFrame:
    """(base, ord, session_id, display, millis) of the history files."""
    return json_lines(lines, HISTORY).filter("r.timestamp is null or r.timestamp >= 0").select(_base(), "ord", F.col("r.sessionId").alias("session_id"), F.col("r.display").alias("display"), F.col("r.timestamp").alias("millis"))


def _base() -> Column:
    return F.regexp_replace("source_path", r"/(history\.jsonl|projects/[^/]+/[^/]+)$", "").alias("base")


def project_name() -> Column:
    return F.replace(F.regexp_extract("source_path", r"/projects/([^/]+)/[^/]+$", 1), F.lit("--"), F.lit(":/"))


def sessions(lines: DataFrame, history_lines: DataFrame) -> DataFrame:
    """A base folder without a history file gives nothing; the first history line of a session gives its summary."""
    r = lambda n: F.col(f"r.{n}")
    spoken = F.coalesce(r("type").isin("user", "assistant"), F.lit(False))
    answer = F.coalesce(r("type") == "assistant", F.lit(False))
    token = lambda n: F.coalesce(F.sum(F.when(answer, F.coalesce(r(f"message.usage.{n}"), F.lit(0)))), F.lit(0))
    rolled = _rows(lines).withColumn("ts", iso_time(r("timestamp"))).groupBy("source_path", "session_id").agg(
        first_by(F.col("ts")).alias("first_ts"),
        last_by(F.col("ts")).alias("ended_at"),
        F.count_if(spoken).alias("message_count"),
        first_by(r("gitBranch"), where=spoken).alias("git_branch"),
        first_by(r("cwd"), where=spoken).alias("project_path"),
        first_by(r("message.model"), where=answer).alias("model"),
        token("input_tokens").alias("input"),
        token("output_tokens").alias("output"),
    )
    past = history(history_lines)
    first = past.filter("session_id is not null").groupBy("base", "session_id").agg(F.min_by(F.struct("display", "millis"), "ord").alias("h"))
    rolled = rolled.withColumn("base", _base()).join(past.select("base").distinct().unionByName(history_lines.select(_base()).distinct()).distinct(), "base", "left_semi")
    out = rolled.join(first, ["base", "session_id"], "left")
    out = out.withColumn("started_at", F.coalesce("first_ts", millis(F.col("h.millis")))).withColumn("summary", F.col("h.display"))
    out = out.withColumn("project_name", project_name()).withColumn("token_usage", summed_usage(F.col("input"), F.col("output")))
    return as_sessions(out.filter("message_count > 0 and started_at is not null"), PROVIDER)


def tool_result_text(item: Column) -> Column:
    """Text of a tool result: a string as it is, or the texts of an array's text items, one a line."""
    inner = F.try_variant_get(item, "$.content", "variant")
    kind = F.schema_of_variant(inner)
    parts = F.coalesce(F.try_variant_get(item, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(F.transform(parts, lambda v: F.when(from_variant(v, "$.type") == "text", from_variant(v, "$.text"))), lambda t: t.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(item, "$.content", "string")).when(kind.startswith("ARRAY"), F.array_join(texts, "\n")).otherwise("")


def blocks(content: Column, role: Column) -> Column:
    """Blocks of a message's content, which is a string or an array of typed items."""

    def item(v: Column) -> Column:
        kind = from_variant(v, "$.type")
        thought = from_variant(v, "$.thinking")
        args = F.try_variant_get(v, "$.input", "variant")
        error = F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False))
        return (
            F.when(kind == "text", fences(from_variant(v, "$.text")))
            .when((kind == "thinking") & (thought != ""), F.array(block("thinking", thought)))
            .when(kind == "tool_use", F.array(block("tool_use", canonical_json(args), tool_call_id=F.coalesce(from_variant(v, "$.id"), F.lit("")), tool_name=F.coalesce(from_variant(v, "$.name"), F.lit("unknown")))))
            .when((kind == "tool_result") & (role == "user"), F.array(block("tool_result", tool_result_text(v), tool_call_id=F.coalesce(from_variant(v, "$.tool_use_id"), F.lit("")), success=~error)))
            .otherwise(no_blocks())
        )

    def whole(c: Column) -> Column:
        kind = F.schema_of_variant(c)
        items = F.try_variant_get(c, "$", "array<variant>")
        return F.when(kind == "STRING", fences(F.try_variant_get(c, "$", "string"))).when(kind.startswith("ARRAY"), F.flatten(F.transform(items, item))).otherwise(no_blocks())

    return F.coalesce(whole(content), no_blocks())


@once
def _blocks() -> Column:
    return blocks(F.col("r.message.content"), F.col("role"))


def annotated(lines: DataFrame) -> DataFrame:
    role = F.when(F.col("r.type").isin("user", "assistant") & F.col("r.message").isNotNull(), F.col("r.type"))
    rows = _rows(lines, True).withColumn("role", F.when(~F.col("bad"), role))
    u = lambda n: F.col(f"r.message.usage.{n}")
    return rows.select(
        "source_path", "session_id", "ord", "bad", "role", F.col("r.uuid").alias("message_id"), iso_time(F.col("r.timestamp")).alias("timestamp"),
        F.when(F.col("role").isNotNull(), _blocks()).otherwise(no_blocks()).alias("content"),
        F.col("r.message.model").alias("model"),
        usage(F.col("r.message.usage").isNotNull(), u("input_tokens"), u("output_tokens"), u("cache_read_input_tokens"), u("cache_creation_input_tokens")).alias("token_usage"),
    )


def placed_messages(lines: DataFrame, as_of: Column) -> DataFrame:
    return placed(annotated(lines).filter("not bad and role is not null"), PROVIDER, as_of)


def messages(lines: DataFrame, as_of: Column) -> DataFrame:
    return numbered(placed_messages(lines, as_of))
