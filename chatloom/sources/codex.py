"""Codex CLI rollouts: ``YYYY/MM/DD/rollout-*.jsonl``, flat and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import as_sessions, block, canonical_json, fences, first_by, iso_time, json_lines, last_by, no_blocks, numbered, once, placed, stem

PROVIDER = "codex_cli"
SCHEMA = "type string, content string, timestamp string, error string, tool_calls variant, payload struct<type:string,message:string,name:string,call_id:string,arguments:string,output:string>"


def _rows(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    return json_lines(lines, SCHEMA, keep_bad).withColumn("session_id", stem(F.col("source_path")))


def sessions(lines: DataFrame) -> DataFrame:
    r = lambda n: F.col(f"r.{n}")
    nested = r("type") == "event_msg"
    said = nested & r("payload.type").isin("user_message", "agent_message")
    counted = F.coalesce(r("type").isin("user", "assistant") | said, F.lit(False))
    first_user = F.when(r("type") == "user", r("content")).when(nested & (r("payload.type") == "user_message"), r("payload.message"))
    out = _rows(lines).withColumn("ts", iso_time(r("timestamp"))).groupBy("source_path", "session_id").agg(
        first_by(F.col("ts")).alias("started_at"),
        last_by(F.col("ts")).alias("ended_at"),
        F.count_if(counted).alias("message_count"),
        F.left(first_by(first_user), F.lit(80)).alias("summary"),
    )
    return as_sessions(out.filter("message_count > 0 and started_at is not null"), PROVIDER)


@once
def _content() -> tuple[Column, Column]:
    r = lambda n: F.col(f"r.{n}")
    some = lambda c: c.isNotNull() & (c != "")
    kind, inner = r("type"), r("payload.type")
    said = lambda name: (kind == "event_msg") & (inner == name) & some(r("payload.message"))
    call = (kind == "response_item") & (inner == "function_call")
    result = (kind == "response_item") & (inner == "function_call_output") & some(r("payload.output"))
    role = (
        F.when(kind == "user", "user").when(kind == "assistant", "assistant").when(kind == "tool_use", "tool").when(kind == "error", "system")
        .when(said("user_message"), "user").when(said("agent_message"), "assistant").when(call | result, "tool")
    )
    content = (
        F.when((kind == "tool_use") & some(r("content")), F.array(block("tool_use", canonical_json(r("tool_calls")), tool_call_id=F.lit(""), tool_name=r("content"))))
        .when(kind.isin("user", "assistant") & some(r("content")), fences(r("content")))
        .when((kind == "error") & r("error").isNotNull(), F.array(block("error", r("error"))))
        .when(said("user_message") | said("agent_message"), fences(r("payload.message")))
        .when(call, F.array(block("tool_use", F.coalesce(r("payload.arguments"), F.lit("")), tool_call_id=F.coalesce(r("payload.call_id"), F.lit("")), tool_name=F.coalesce(r("payload.name"), F.lit("unknown")))))
        .when(result, F.array(block("tool_result", r("payload.output"), tool_call_id=F.coalesce(r("payload.call_id"), F.lit("")), success=F.lit(True))))
        .otherwise(no_blocks())
    )
    return role, content


def annotated(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its role (null: not a message) and blocks; ``bad`` lines included."""
    role, content = _content()
    return _rows(lines, True).select("source_path", "session_id", "ord", "bad", F.lit("").alias("message_id"), F.when(~F.col("bad"), role).alias("role"), iso_time(F.col("r.timestamp")).alias("timestamp"), content.alias("content"))


def placed_messages(lines: DataFrame, as_of: Column) -> DataFrame:
    return placed(annotated(lines).filter("not bad and role is not null"), PROVIDER, as_of)


def messages(lines: DataFrame, as_of: Column) -> DataFrame:
    return numbered(placed_messages(lines, as_of))
