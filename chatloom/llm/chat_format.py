r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar (``\n`` is a line feed)::

    conversation = turn*
    turn         = "### " role ": " text "\n</turn>\n"

``### `` and ``</turn>`` are control strings. Inside a text a control string is escaped by one backslash before it; where
backslashes stand right before one already, it gets one more, so unescaping is exact. Inside a role, ``:``, ``\`` and
line feeds are written ``\c``, ``\\`` and ``\n``, so the first colon ends it; null is written ``\0``. The terminator can't occur in an escaped text,
so a split at it is a deterministic parser.

A text is first rendered as it is and parsed again; only where what comes back differs from the source is it escaped.
One level always suffices, as the escaped form contains no bare control string. ``round_trip`` says whether the parse
of the final output equals the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import table

START, END = "### ", "</turn>"
# a run of backslashes is looked at once, from its start: texts may hold millions
_CONTROL = r"(?<!\\)(\\*+)(### |</turn>)"
_ESCAPED = r"(?<!\\)\\(\\*+)(### |</turn>)"
_TAIL = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2")


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(":"), F.lit("\\c"))
    return F.coalesce(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\\0"))


def unescape_role(role: Column) -> Column:
    # cut into escapes and runs between them, so that what follows a backslash pair is never taken for an escape
    parts = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1))
    plain = lambda x: F.when(x == "\\n", "\n").when(x == "\\c", ":").when(x == "\\0", "").when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)
    return F.array_join(F.transform(parts, plain), "")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit(": "), text, F.lit(_TAIL))


def parse(formatted: Column) -> Column:
    """Array of (role, text) recovered from formatted text."""
    bodies = F.filter(F.split(formatted, r"\n</turn>\n"), lambda x: x != "")
    head = r"(?s)^### ([^:]*+): (.*)$"
    return F.transform(
        bodies,
        lambda x: F.struct(unescape_role(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")),
    )


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns (recovered), loss_text, round_trip.

    Null text is empty, null role comes back as empty, null conv_id is a conversation of its own; turns with the same
    number are ordered by role and text (nulls first), repeated rows are kept; other columns are ignored. Roles and texts
    of any length are kept whole, and an empty table gives none. Rows of a conversation meet once, in one partial-less collect: a conversation is one output value by its nature.
    """
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), source.alias("source"))
    # level 0: as it is, if that parses back to the source; else level 1
    again = parse(render_turn(F.lit("user"), F.col("source")))
    safe = F.when(~F.col("source").contains(END) & ~F.col("source").contains(START), F.lit(True)).otherwise((F.size(again) == 1) & (again[0]["text"] == F.col("source")))
    turns = plain.withColumn("body", F.when(safe, F.col("source")).otherwise(escape(F.col("source"))))
    turns = turns.withColumn("out", render_turn(F.col("role"), F.col("body")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "source", "out"))).alias("t"))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), x["source"].alias("text"))).alias("given"))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return whole.select("conv_id", "formatted", "turns", loss.alias("loss_text"), (F.col("turns") == F.col("given")).alias("round_trip"))


def conflict_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7: both texts hold the control strings themselves."""
    say = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_conversations(rows.unionByName(conflict_rows(spark)))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


#: Turn texts are compared with the source, so the oracle works on the source alone; only formatted_chars renders.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')) AS escaped FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(4 + coalesce(length(role), 2) + 2 + escaped + 9)::BIGINT AS formatted_chars,
  true AS round_trip
FROM sized GROUP BY conv_id
"""
