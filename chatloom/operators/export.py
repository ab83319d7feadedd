"""Export of whole conversations to Markdown, JSON and HTML: blocks are rendered in the row, then met once a session."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.parsing import utc_text
from chatloom.operators.catalog import label, role_label
from chatloom.operators.tables import materialized
from chatloom.schema import MESSAGES, SESSIONS

EXTENSIONS = {"markdown": "md", "json": "json", "html": "html"}


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _indented(texts: Column) -> Column:
    """JSON texts with indentation, other texts as they are. The one place without a built-in (Arrow-batched)."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        import json

        def one(v):
            try:
                return json.dumps(json.loads(v), indent=2, ensure_ascii=False)
            except (TypeError, ValueError):
                return v

        return rows.map(lambda own: None if own is None else [one(v) for v in own])

    return run(texts)


def with_indented(messages: DataFrame) -> DataFrame:
    """Messages whose tool arguments are indented; rows without a tool call send Python nothing."""
    asked = F.when(F.exists("content", lambda b: b["type"] == "tool_use"), F.transform("content", lambda b: F.when(b["type"] == "tool_use", b["text"])))
    rows = messages.withColumn("_args", _indented(asked))
    body = F.transform("content", lambda b, i: b.withField("text", F.coalesce(F.get("_args", i), b["text"])))
    return rows.withColumn("content", F.when(F.col("_args").isNull(), F.col("content")).otherwise(body)).drop("_args")


#: The Markdown below is the format of the exported documents.
def markdown_block(b: Column) -> Column:
    kind, text = b["type"], b["text"]
    status = F.when(b["success"], "Success").otherwise("Error")
    return (
        F.when(kind == "text", _cat(text, "\n\n"))
        .when(kind == "code_block", _cat("```", F.coalesce(b["language"], F.lit("")), "\n", text, "\n```\n\n"))
        .when(kind == "tool_use", _cat("<details>\n<summary>Tool: ", b["tool_name"], "</summary>\n\n```json\n", text, "\n```\n\n</details>\n\n"))
        .when(kind == "tool_result", _cat("<details>\n<summary>Tool Result (", status, ")</summary>\n\n```\n", text, "\n```\n\n</details>\n\n"))
        .when(kind == "thinking", _cat("<details>\n<summary>Thinking</summary>\n\n", text, "\n\n</details>\n\n"))
        .otherwise(_cat("> **Error**: ", text, "\n\n"))
    )


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_block(b: Column) -> Column:
    kind, text = b["type"], escaped(b["text"])
    status = F.when(b["success"], "Success").otherwise("Error")
    language = F.coalesce(_cat(' class="language-', escaped(b["language"]), '"'), F.lit(""))
    details = lambda head, body: _cat("<details><summary>", head, "</summary><pre>", body, "</pre></details>\n")
    return (
        F.when(kind == "text", _cat('<p class="text">', text, "</p>\n"))
        .when(kind == "code_block", _cat("<pre><code", language, ">", text, "</code></pre>\n"))
        .when(kind == "tool_use", details(_cat("Tool: ", escaped(b["tool_name"])), text))
        .when(kind == "tool_result", details(_cat("Tool Result (", status, ")"), text))
        .when(kind == "thinking", details(F.lit("Thinking"), text))
        .otherwise(_cat('<p class="error">', text, "</p>\n"))
    )


def _documents(sessions: DataFrame, messages: DataFrame, part: Column, most: int | None, note: Callable[[Column, Column], Column]) -> DataFrame:
    """All messages of a session in order. ``most``: only so many, and ``note`` says how many there are."""
    rows = with_indented(messages if most is None else messages.filter(F.col("seq") < most)).select("provider", "session_id", F.struct("seq", part.alias("part")).alias("m"))
    joined = rows.groupBy("provider", "session_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["part"]).alias("parts"))
    out = sessions.join(joined, ["provider", "session_id"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    if most is None:
        return out.withColumn("note", F.lit(""))
    there = messages.groupBy("provider", "session_id").agg(F.count(F.lit(1)).alias("there"))
    return out.join(there, ["provider", "session_id"], "left").withColumn("note", F.when(F.col("there") > most, note(F.size("parts").cast("string"), F.col("there").cast("string"))).otherwise(""))


def to_markdown(sessions: DataFrame, messages: DataFrame, most: int | None = None) -> DataFrame:
    """(provider, session_id, document) of whole conversations, or of their first ``most`` messages."""
    part = _cat("## ", role_label(F.col("role")), "\n\n", F.array_join(F.transform("content", markdown_block), ""))
    head = _cat(
        "# ", F.coalesce("project_name", F.lit("Conversation")), "\n\n- **Provider**: ", label(F.col("provider")), "\n- **Date**: ", utc_text(F.col("started_at"), "yyyy-MM-dd HH:mm"), " UTC\n",
        F.coalesce(_cat("- **Branch**: ", F.col("git_branch"), "\n"), F.lit("")), F.coalesce(_cat("- **Model**: ", F.col("model"), "\n"), F.lit("")), "\n---\n\n",
    )
    made = _documents(sessions, messages, part, most, lambda shown, there: _cat("*Showing ", shown, " of ", there, " messages*\n"))
    return made.select("provider", "session_id", _cat(head, F.array_join("parts", ""), F.col("note")).alias("document"))


#: Of the exported pages.
STYLE = (
    "body{font-family:sans-serif;max-width:60rem;margin:auto}pre{background:#eee;padding:1em;overflow:auto}.user{border-left:4px solid #36c}"
    ".assistant{border-left:4px solid #393}.error{color:#b00}section{padding:0 1em}"
)


def to_html(sessions: DataFrame, messages: DataFrame, most: int | None = None) -> DataFrame:
    """As ``to_markdown``; all texts are escaped."""
    part = _cat('<section class="message ', F.col("role"), '"><h2>', role_label(F.col("role")), "</h2>\n", F.array_join(F.transform("content", html_block), ""), "</section>\n")
    title = escaped(F.coalesce("project_name", F.lit("Conversation")))
    fact = lambda name, value: F.coalesce(_cat(f"<dt>{name}</dt><dd>", escaped(value), "</dd>"), F.lit(""))
    head = _cat(
        '<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>', title, f"</title>\n<style>{STYLE}</style></head><body>\n<h1>", title, "</h1>\n<dl>", fact("Provider", label(F.col("provider"))),
        fact("Date", _cat(utc_text(F.col("started_at"), "yyyy-MM-dd HH:mm"), " UTC")), fact("Branch", F.col("git_branch")), fact("Model", F.col("model")), "</dl>\n",
    )
    made = _documents(sessions, messages, part, most, lambda shown, there: _cat("<p>Showing ", shown, " of ", there, " messages</p>\n"))
    return made.select("provider", "session_id", _cat(head, F.array_join("parts", ""), F.col("note"), "</body></html>\n").alias("document"))


def _data(b: Column) -> Column:
    """The value under ``data`` of a block in JSON: text alone, or an object by the block's type."""
    kind, text = b["type"], b["text"]
    make = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return (
        F.when(kind == "code_block", make(b["language"].alias("language"), text.alias("code")))
        .when(kind == "tool_use", make(b["tool_call_id"].alias("id"), b["tool_name"].alias("name"), text.alias("arguments")))
        .when(kind == "tool_result", make(b["tool_call_id"].alias("tool_call_id"), b["success"].alias("success"), text.alias("output")))
        .otherwise(quoted)
    )


def to_json_document(sessions: DataFrame, messages: DataFrame, most: int | None = None) -> DataFrame:
    """``{"session": ..., "messages": [...]}``; nulls are kept, blocks are ``{"type", "data"}``; see ``to_markdown``."""
    time = lambda c: utc_text(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.transform("content", lambda b: _cat('{"type":"', b["type"], '","data":', _data(b), "}"))
    options = {"ignoreNullFields": "false"}
    facts = F.to_json(F.struct(F.col("message_id").alias("id"), "role", time("timestamp").alias("timestamp"), "model", "token_usage"), options)
    part = _cat(F.regexp_replace(facts, r"\}$", ""), ',"content":[', F.array_join(body, ","), "]}")
    own = F.to_json(
        F.struct(F.col("session_id").alias("id"), "provider", "project_path", "project_name", "git_branch", time("started_at").alias("started_at"), time("ended_at").alias("ended_at"), "summary", "model", "token_usage", "message_count", "source_path"), options
    )
    made = _documents(sessions, messages, part, most, lambda shown, there: _cat(',"shown":', shown, ',"of":', there))
    return made.select("provider", "session_id", _cat('{"session":', own, ',"messages":[', F.array_join("parts", ","), "]", F.col("note"), "}").alias("document"))


def export(sessions: DataFrame, messages: DataFrame, form: str) -> DataFrame:
    """(provider, session_id, file_name, document) in a named format; an unknown name is an error."""
    if form not in EXTENSIONS:
        raise ValueError(f"unknown export format: {form}")
    made = {"markdown": to_markdown, "json": to_json_document, "html": to_html}[form](sessions, messages)
    return made.join(file_names(sessions, form), ["provider", "session_id"])


def file_names(sessions: DataFrame, form: str) -> DataFrame:
    """(provider, session_id, file_name): the short name, or one with the whole id where sessions of a provider share it.

    No two sessions of a provider get one name: signs are escaped one to one, and who has a short id that is the start of
    another one shares its short name.
    """
    named = sessions.select("provider", "session_id", file_name(F.col("session_id"), form).alias("file_name")).distinct()
    shared = named.groupBy("provider", "file_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    longer = _named(F.col("session_id"), form)
    return named.join(shared, ["provider", "file_name"], "left").select("provider", "session_id", F.when(F.col("n").isNull(), F.col("file_name")).otherwise(longer).alias("file_name"))


#: Bytes of an escaped id in a file name; longer ones end in a digest of the whole id.
LONGEST_NAME = 180


def file_name(session_id: Column, form: str) -> Column:
    return _named(F.left(session_id, F.lit(8)), form)


def _named(text: Column, form: str) -> Column:
    safe = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("."), F.lit("%2E")), F.lit("*"), F.lit("%2A"))
    short = F.when(F.length(safe) > LONGEST_NAME, _cat(F.left(safe, F.lit(LONGEST_NAME - 65)), "~", F.sha2(text.cast("binary"), 256))).otherwise(safe)
    return _cat("conversation-", short, f".{EXTENSIONS[form]}")


def write_documents(documents: DataFrame, path: str) -> DataFrame:
    """Write each document (path, document) to a file of that name under a folder; (path, bytes) of what was written.

    Tasks write to a name of their own and move the file when it is whole, so a task that is run again, or twice at a time,
    leaves the same files, and no reader sees half of one. ``path`` is any place that Arrow's file systems reach. Files that
    are there are replaced, others stay; null documents are empty files.
    """

    uri = re.sub(r"^(file:)?/+", "file:///", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{root.rstrip('/')}/{name}"
                folder, _, own = at.rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                body = (text or "").encode()
                early = f"{folder}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(early) as out:
                    out.write(body)
                store.move(early, at)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return materialized(documents.select(F.col("path"), F.col("document").cast("string")).mapInArrow(run, "path string, bytes long"), "files")


def write_files(exported: DataFrame, path: str) -> DataFrame:
    """One file for each session, under its name in a folder of its provider; (path, bytes) of them."""
    return write_documents(exported.select(F.concat_ws("/", "provider", "file_name").alias("path"), "document"), path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(provider, file_name, document) of written files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)$", k)
    return found.select(name(1).alias("provider"), name(2).alias("file_name"), F.col("content").cast("string").alias("document"))


def write_tables(sessions: DataFrame, messages: DataFrame, path: str) -> str:
    """Normalised tables as Parquet, partitioned by provider, as a version of its own below ``path``; where that is.

    Sessions are written last, and a version without them isn't one: readers see both tables of a version or none of it.
    """
    version = f"{path}/{uuid.uuid4().hex}"
    messages.write.partitionBy("provider").parquet(f"{version}/messages")
    sessions.write.partitionBy("provider").parquet(f"{version}/sessions")
    return version


def read_tables(spark: SparkSession, version: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of a version."""
    read = lambda name, shape: spark.read.schema(shape).parquet(f"{version}/{name}")
    return read("sessions", SESSIONS), read("messages", MESSAGES)
