"""Data-quality reports: what could not be parsed, and what is ill-formed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.catalog import content_blocks, newest_first
from chatloom.sources import claude, codex, copilot, gemini, opencode
from chatloom.sources.files import Raw


def parse_counters(annotated: DataFrame) -> DataFrame:
    """(source_path, lines, parse_errors, skipped_types, empty_content, messages) of a source's annotated rows.

    A row is a line, or where a file holds a list of messages, one of these (or the file, if it doesn't parse).
    """
    good = ~F.col("bad")
    spoken = good & F.col("role").isNotNull()
    full = F.coalesce(F.size("content"), F.lit(0)) > 0
    return annotated.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("bad").alias("parse_errors"),
        F.count_if(good & F.col("role").isNull()).alias("skipped_types"),
        F.count_if(spoken & ~full).alias("empty_content"),
        F.count_if(spoken & full).alias("messages"),
    )


def all_counters(raw: Raw) -> DataFrame:
    """The counters of every provider's log files."""
    own = {
        claude.PROVIDER: claude.annotated(raw.claude), copilot.PROVIDER: copilot.annotated(raw.events), gemini.PROVIDER: gemini.annotated(raw.chats),
        codex.PROVIDER: codex.annotated(raw.rollouts), opencode.PROVIDER: opencode.annotated(raw.oc_messages, raw.oc_parts),
    }
    return reduce(DataFrame.unionByName, [parse_counters(rows).select(F.lit(name).alias("provider"), "*") for name, rows in own.items()])


def format_mismatch(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions that claim messages and load none."""
    return sessions.filter("message_count > 0").join(messages.select("provider", "session_id").distinct(), ["provider", "session_id"], "left_anti").select("provider", "session_id", "message_count")


def block_checks(messages: DataFrame) -> DataFrame:
    """(rule, broken) for each rule of well-formed blocks."""
    b = content_blocks(messages)
    blank = F.trim("text") == ""
    rules = {f"empty_{k}": (F.col("type") == k) & blank for k in ("text", "thinking", "code_block", "error")}
    rules["tool_without_name"] = (F.col("type") == "tool_use") & (F.coalesce("tool_name", F.lit("")) == "")
    rules["result_without_call"] = (F.col("type") == "tool_result") & (F.coalesce("tool_call_id", F.lit("")) == "")
    one = b.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("x")).select("x.*")


def provider_sample(sessions: DataFrame, messages: DataFrame, n: int = 5) -> DataFrame:
    """The newest sessions of each provider: claimed and loaded messages, and the roles that occur."""
    newest = sessions.withColumn("n", F.row_number().over(Window.partitionBy("provider").orderBy(*newest_first()))).filter(F.col("n") <= n)
    loaded = messages.groupBy("provider", "session_id").agg(F.count(F.lit(1)).alias("loaded"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    return newest.join(loaded, ["provider", "session_id"], "left").select("provider", "session_id", "message_count", F.coalesce("loaded", F.lit(0)).cast("long").alias("loaded"), F.coalesce("roles", F.lit("")).alias("roles"))
