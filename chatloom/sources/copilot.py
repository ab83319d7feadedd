"""Copilot CLI logs: ``<dir>/workspace.yaml`` with ``events.jsonl`` or ``checkpoints/index.md``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import as_sessions, base_name, block, canonical_json, fences, iso_time, json_lines, no_blocks, numbered, once, placed, usage

PROVIDER = "copilot_cli"
SCHEMA = (
    "id string, type string, timestamp string, content string, model string, toolName string, toolCallId string, toolArgs variant, "
    "usage struct<inputTokens:bigint,outputTokens:bigint>, data struct<content:string,toolRequests:array<struct<toolCallId:string,name:string,arguments:variant>>,"
    "toolName:string,toolCallId:string,arguments:variant,success:boolean,result:struct<content:string,detailedContent:string>>"
)
#: Events that count as messages.
COUNTED = ('"user.message"', '"assistant.message"', '"tool.execution_start"', '"tool.execution_complete"')


def _folder(file: str) -> Column:
    return F.regexp_replace("source_path", f"/{file}$", "").alias("folder")


def workspaces(files: DataFrame) -> DataFrame:
    """(folder, id, cwd, created_at, updated_at) of the flat YAML files."""

    def value(key: str) -> Column:
        raw = F.regexp_extract("value", rf"(?m)^{key}:[ \t]*(.*?)[ \t\r]*$", 1)
        return F.nullif(F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2"), F.lit("")).alias(key)

    return files.select(_folder(r"workspace\.yaml"), value("id"), value("cwd"), value("created_at"), value("updated_at"))


def sessions(files: DataFrame, events: DataFrame) -> DataFrame:
    """Counts are of raw lines that contain one of the four event names; sessions without messages stay."""
    hit = F.lit(False)
    for name in COUNTED:
        hit = hit | F.col("value").contains(name)
    counts = events.filter(hit).groupBy(_folder(r"events\.jsonl")).agg(F.count(F.lit(1)).alias("message_count"))
    out = workspaces(files).join(counts, "folder", "left").select(
        F.coalesce("id", base_name(F.col("folder"))).alias("session_id"),
        F.col("cwd").alias("project_path"),
        base_name(F.col("cwd")).alias("project_name"),
        iso_time(F.col("created_at")).alias("started_at"),
        iso_time(F.col("updated_at")).alias("ended_at"),
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.col("folder").alias("source_path"),
    )
    return as_sessions(out.filter("started_at is not null"), PROVIDER)


def _role() -> Column:
    kind = F.coalesce(F.col("r.type"), F.lit(""))
    return F.when(kind.contains("user"), "user").when(kind.contains("assistant.message"), "assistant").when(kind.contains("tool"), "tool")


@once
def _content() -> Column:
    r = lambda n: F.col(f"r.{n}")
    kind = F.coalesce(r("type"), F.lit(""))
    plain = ~kind.contains("user") & ~kind.contains("assistant.message")
    start, end = plain & (kind == "tool.execution_start"), plain & (kind == "tool.execution_complete")
    name = lambda c: F.coalesce(c, F.lit("unknown"))
    text_of = lambda c: F.coalesce(c, F.lit(""))
    output = F.coalesce(r("data.result.detailedContent"), r("data.result.content"), F.lit(""))
    said = F.coalesce(r("content"), r("data.content"))
    asked = F.transform(r("data.toolRequests"), lambda t: block("tool_use", canonical_json(t["arguments"]), tool_call_id=text_of(t["toolCallId"]), tool_name=name(t["name"])))
    tools = F.when(r("toolName").isNotNull(), F.array(block("tool_use", canonical_json(r("toolArgs")), tool_call_id=text_of(r("toolCallId")), tool_name=r("toolName")))).otherwise(F.coalesce(asked, no_blocks()))
    return (
        F.when(start & r("data").isNull(), no_blocks())
        .when(start, F.array(block("tool_use", canonical_json(r("data.arguments")), tool_call_id=text_of(r("data.toolCallId")), tool_name=name(r("data.toolName")))))
        .when(end & (r("data").isNull() | (output == "")), no_blocks())
        .when(end, F.array(block("tool_result", output, tool_call_id=text_of(r("data.toolCallId")), success=F.coalesce(r("data.success"), F.lit(True)))))
        .otherwise(F.concat(fences(said), tools))
    )


def annotated(events: DataFrame) -> DataFrame:
    rows = json_lines(events, SCHEMA, True).withColumn("role", F.when(~F.col("bad"), _role()))
    u = lambda n: F.col(f"r.usage.{n}")
    plain = ~F.col("r.type").isin("tool.execution_start", "tool.execution_complete")
    return rows.select(
        _folder(r"events\.jsonl"), "source_path", "ord", "bad", "role", F.col("r.id").alias("message_id"), iso_time(F.col("r.timestamp")).alias("timestamp"),
        F.when(F.col("role").isNotNull(), _content()).otherwise(no_blocks()).alias("content"), F.when(plain, F.col("r.model")).alias("model"),
        usage(plain & F.col("r.usage").isNotNull(), u("inputTokens"), u("outputTokens")).alias("token_usage"),
    )


def checkpoint_rows(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """One System message for each checkpoint file of a folder without events; headings and tables alone don't count."""
    kept = checkpoints.withColumn("folder", F.regexp_replace("source_path", r"/checkpoints/index\.md$", "")).join(events.select(_folder(r"events\.jsonl")).distinct(), "folder", "left_anti")
    idle = F.forall(F.split("value", "\r?\n"), lambda x: x.startswith("#") | x.startswith("|") | (F.trim(x) == ""))
    return kept.filter(~idle).select(
        "folder", "source_path", F.lit(0).cast("long").alias("ord"), F.lit(False).alias("bad"), F.lit("system").alias("role"), F.lit("checkpoint").alias("message_id"),
        F.lit(None).cast("timestamp").alias("timestamp"), fences(F.col("value")).alias("content"), F.lit(None).cast("string").alias("model"), usage(F.lit(False), F.lit(0), F.lit(0)).alias("token_usage"),
    )


def placed_messages(files: DataFrame, events: DataFrame, checkpoints: DataFrame, as_of: Column) -> DataFrame:
    rows = annotated(events).filter("not bad and role is not null")
    rows = rows.unionByName(checkpoint_rows(checkpoints, events).select(*[F.col(c).cast(t) for c, t in rows.dtypes]))
    named = workspaces(files).select("folder", F.coalesce("id", base_name(F.col("folder"))).alias("session_id"))
    return placed(rows.join(named, "folder").drop("source_path").withColumnRenamed("folder", "source_path"), PROVIDER, as_of)


def messages(files: DataFrame, events: DataFrame, checkpoints: DataFrame, as_of: Column) -> DataFrame:
    return numbered(placed_messages(files, events, checkpoints, as_of))
