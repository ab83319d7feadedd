"""OpenCode storage: ``session/<project>/*.json``, ``message/<session>/*.json``, ``part/<message>/*.json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import as_sessions, base_name, block, canonical_json, fences, iso_time, json_lines, millis, no_blocks, numbered, once, placed, usage

PROVIDER = "opencode"
SESSION = "id string, title string, directory string, cwd string, createdAt string, updatedAt string, time struct<created:bigint,updated:bigint>, model struct<modelID:string>"
MESSAGE = (
    "id string, role string, content string, timestamp string, codeChanges array<struct<path:string,diff:string>>, time struct<created:bigint,completed:bigint>, "
    "summary struct<title:string>, tokens struct<input:bigint,output:bigint,cache:struct<read:bigint,write:bigint>>, model struct<modelID:string>"
)
PART = "type string, text string, tool string, callID string, state struct<status:string,input:variant,output:string>"


def _whole(files: DataFrame, schema: str) -> DataFrame:
    return json_lines(files.withColumn("ord", F.lit(0)), schema)


def _base(kind: str) -> Column:
    return F.regexp_extract("source_path", rf"^(.*)/{kind}/[^/]+/[^/]+$", 1).alias("base")


def sessions(session_files: DataFrame, message_files: DataFrame) -> DataFrame:
    """Counts are of message files, whether they parse or not; sessions without messages stay."""
    counts = message_files.groupBy(_base("message"), F.regexp_extract("source_path", r"/message/([^/]+)/[^/]+\.json$", 1).alias("session_id")).agg(F.count(F.lit(1)).alias("message_count"))
    r = lambda n: F.col(f"r.{n}")
    path = F.coalesce(r("directory"), r("cwd"))
    out = _whole(session_files, SESSION).filter("r.id is not null").select(
        _base("session"),
        r("id").alias("session_id"),
        path.alias("project_path"),
        base_name(path).alias("project_name"),
        F.coalesce(millis(r("time.created")), iso_time(r("createdAt"))).alias("started_at"),
        F.coalesce(millis(r("time.updated")), iso_time(r("updatedAt"))).alias("ended_at"),
        r("title").alias("summary"),
        r("model.modelID").alias("model"),
    )
    out = out.join(counts, ["base", "session_id"], "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return as_sessions(out.filter("started_at is not null").withColumn("source_path", F.col("base")), PROVIDER)


@once
def _part() -> Column:
    """Blocks of a part."""
    r = lambda n: F.col(f"r.{n}")
    output = F.coalesce(r("state.output"), F.lit(""))
    call = F.coalesce(r("callID"), F.lit(""))
    use = block("tool_use", canonical_json(r("state.input")), tool_call_id=call, tool_name=F.coalesce(r("tool"), F.lit("unknown")))
    result = block("tool_result", output, tool_call_id=call, success=F.coalesce(r("state.status") == "completed", F.lit(False)))
    return F.when(r("type") == "text", fences(r("text"))).when((r("type") == "tool") & (output != ""), F.array(use, result)).when(r("type") == "tool", F.array(use)).otherwise(no_blocks())


def part_blocks(part_files: DataFrame) -> DataFrame:
    """(base, message_id, parts): blocks of a message's parts, ordered by file name; invalid files are skipped."""
    rows = _whole(part_files, PART).filter("r.type is not null").select(
        _base("part"), F.regexp_extract("source_path", r"/part/([^/]+)/[^/]+$", 1).alias("message_id"), F.regexp_extract("source_path", r"([^/]+)$", 1).alias("name"), _part().alias("blocks")
    )
    return rows.groupBy("base", "message_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("name", "blocks"))), lambda x: x["blocks"])).alias("parts"))


@once
def _content() -> Column:
    """Blocks of a message: of its parts, else of its own text and changes, else its title."""
    r = lambda n: F.col(f"r.{n}")
    diffs = F.filter(
        F.transform(r("codeChanges"), lambda c: F.when(F.coalesce(c["diff"], F.lit("")) != "", block("code_block", c["diff"], language=F.concat(F.lit("diff ("), F.coalesce(c["path"], F.lit("diff")), F.lit(")"))))),
        lambda b: b.isNotNull(),
    )
    legacy = F.concat(fences(r("content")), F.coalesce(diffs, no_blocks()))
    title = F.when(F.coalesce(r("summary.title"), F.lit("")) != "", F.array(block("text", r("summary.title")))).otherwise(no_blocks())
    return F.when(F.size("parts") > 0, F.col("parts")).when(F.size(legacy) > 0, legacy).otherwise(title)


def annotated(message_files: DataFrame, part_files: DataFrame) -> DataFrame:
    r = lambda n: F.col(f"r.{n}")
    rows = json_lines(message_files.withColumn("ord", F.regexp_extract("source_path", r"([^/]+)$", 1)), MESSAGE, True).select(
        _base("message"), F.regexp_extract("source_path", r"/message/([^/]+)/[^/]+$", 1).alias("session_id"), "ord", "bad", "r", F.coalesce("r.id", F.lit("")).alias("message_id")
    )
    rows = rows.join(part_blocks(part_files), ["base", "message_id"], "left")
    t = r("tokens")
    return rows.select(
        F.col("base").alias("source_path"), "session_id", "ord", "bad", F.when(~F.col("bad") & r("role").isin("user", "assistant"), r("role")).alias("role"), "message_id",
        F.coalesce(millis(r("time.created")), iso_time(r("timestamp"))).alias("timestamp"), _content().alias("content"), r("model.modelID").alias("model"),
        usage(t.isNotNull(), t["input"], t["output"], t["cache"]["read"], t["cache"]["write"]).alias("token_usage"),
    )


def placed_messages(message_files: DataFrame, part_files: DataFrame, as_of: Column) -> DataFrame:
    """Ordered by time (then file name)."""
    return placed(annotated(message_files, part_files).filter("not bad and role is not null"), PROVIDER, as_of, by_time=True)


def messages(message_files: DataFrame, part_files: DataFrame, as_of: Column) -> DataFrame:
    return numbered(placed_messages(message_files, part_files, as_of))
