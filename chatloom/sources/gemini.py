"""Gemini CLI chats: ``tmp/<slug>/chats/session-*.json`` and ``projects.json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import as_sessions, block, canonical_json, fences, iso_time, json_lines, let, no_blocks, numbered, once, placed, summed_usage, usage

PROVIDER = "gemini_cli"
_PARTS = "array<struct<text:string>>"
SCHEMA = (
    "sessionId string, startTime string, lastUpdated string, messages array<struct<id:string,timestamp:string,type:string,content:variant,"
    f"displayContent:{_PARTS},thoughts:array<struct<description:string>>,tokens:struct<input:bigint,output:bigint,cached:bigint>,"
    "toolCalls:array<struct<id:string,name:string,args:variant>>,model:string>>"
)


def chats(files: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Whole files that parse; a file that lacks a required field is left out as a whole (or kept as ``bad``)."""
    rows = json_lines(files.withColumn("ord", F.lit(0)), SCHEMA, True)
    need = "r.sessionId is not null and r.startTime is not null and r.lastUpdated is not null and r.messages is not null and forall(r.messages, m -> m.type is not null)"
    rows = rows.select("source_path", "r", (F.col("bad") | ~F.coalesce(F.expr(need), F.lit(False))).alias("bad"))
    return rows if keep_bad else rows.filter("not bad").drop("bad")


def projects(files: DataFrame) -> DataFrame:
    """(base, slug, project_path) from the projects files."""
    one = files.select(F.regexp_replace("source_path", r"/projects\.json$", "").alias("base"), F.explode(F.from_json("value", "projects map<string,string>")["projects"]).alias("path", "slug"))
    return one.groupBy("base", "slug").agg(F.max("path").alias("project_path"))


def _texts(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())


def _parts(m: Column) -> Column:
    return F.coalesce(F.try_variant_get(m["content"], "$", _PARTS), F.array().cast(_PARTS))


def _is_text(m: Column) -> Column:
    return m["content"].isNull() | (F.schema_of_variant(m["content"]) == "STRING")


def user_text(m: Column) -> Column:
    """First text of a user message; shown parts win over sent ones, and none of them is no text."""
    shown = F.when(m["displayContent"].isNotNull(), F.get(_texts(m["displayContent"]), F.lit(0))).otherwise(F.get(_texts(_parts(m)), F.lit(0)))
    return F.when(_is_text(m), F.coalesce(F.try_variant_get(m["content"], "$", "string"), F.lit(""))).otherwise(shown)


def sessions(files: DataFrame, project_files: DataFrame) -> DataFrame:
    m = F.col("r.messages")
    total = lambda n: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"][n], F.lit(0)))
    first = lambda values: F.get(F.filter(values, lambda t: t.isNotNull()), F.lit(0))
    out = chats(files).select(
        "source_path",
        F.regexp_extract("source_path", r"^(.*)/tmp/([^/]+)/chats/[^/]+$", 1).alias("base"),
        F.regexp_extract("source_path", r"/tmp/([^/]+)/chats/[^/]+$", 1).alias("slug"),
        F.col("r.sessionId").alias("session_id"),
        iso_time(F.col("r.startTime")).alias("started_at"),
        iso_time(F.col("r.lastUpdated")).alias("ended_at"),
        F.size(F.filter(m, lambda x: x["type"].isin("user", "gemini"))).alias("message_count"),
        F.left(first(F.transform(m, lambda x: F.when(x["type"] == "user", user_text(x)))), F.lit(80)).alias("summary"),
        first(F.transform(m, lambda x: x["model"])).alias("model"),
        summed_usage(total("input"), total("output")).alias("token_usage"),
    )
    out = out.join(projects(project_files), ["base", "slug"], "left").withColumn("project_name", F.col("slug"))
    return as_sessions(out.filter("message_count > 0 and started_at is not null"), PROVIDER)


def blocks(m: Column, role: Column) -> Column:
    parts = F.when((role == "user") & m["displayContent"].isNotNull(), m["displayContent"]).otherwise(_parts(m))
    text = F.when(_is_text(m), F.coalesce(F.try_variant_get(m["content"], "$", "string"), F.lit(""))).otherwise(F.array_join(_texts(parts), "\n"))
    thoughts = F.filter(F.transform(m["thoughts"], lambda t: F.when(t["description"] != "", block("thinking", t["description"]))), lambda b: b.isNotNull())
    tools = F.transform(m["toolCalls"], lambda t: block("tool_use", canonical_json(t["args"]), tool_call_id=F.coalesce(t["id"], F.lit("")), tool_name=F.coalesce(t["name"], F.lit("unknown"))))
    return F.concat(let(text, fences), F.coalesce(thoughts, no_blocks()), F.coalesce(tools, no_blocks()))


def annotated(files: DataFrame) -> DataFrame:
    """A row for each message with its role (null: not a message) and blocks, and one for each file that is ``bad``."""
    rows = chats(files, True).select("source_path", "bad", F.explode_outer(F.when(~F.col("bad"), F.col("r.messages"))).alias("m"))
    m = F.col("m")
    role = F.when(m["type"] == "user", "user").when(m["type"] == "gemini", "assistant")
    return rows.filter("bad or m is not null").withColumn("role", role).select("source_path", "bad", "role", F.when(F.col("role").isNotNull(), _blocks()).otherwise(no_blocks()).alias("content"))


@once
def _blocks() -> Column:
    """Blocks of the message ``m`` under its ``role``."""
    return blocks(F.col("m"), F.col("role"))


def placed_messages(files: DataFrame, as_of: Column) -> DataFrame:
    rows = chats(files).select("source_path", F.col("r.sessionId").alias("session_id"), F.posexplode("r.messages").alias("ord", "m"))
    m = F.col("m")
    role = F.when(m["type"] == "user", "user").when(m["type"] == "gemini", "assistant")
    t = m["tokens"]
    out = rows.withColumn("role", role).filter("role is not null").select(
        "source_path", "session_id", "ord", "role", m["id"].alias("message_id"), iso_time(m["timestamp"]).alias("timestamp"), _blocks().alias("content"), m["model"].alias("model"),
        usage(t.isNotNull(), t["input"], t["output"], t["cached"]).alias("token_usage"),
    )
    return placed(out, PROVIDER, as_of)


def messages(files: DataFrame, as_of: Column) -> DataFrame:
    return numbered(placed_messages(files, as_of))
