"""The session catalog: order, counts, filters, lookups, labels, capped transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import utc_text
from chatloom.schema import LOOKUP_ORDER, PROVIDERS, ROLES


def label(provider: Column) -> Column:
    out = provider
    for name, (text, _) in PROVIDERS.items():
        out = F.when(provider == name, text).otherwise(out)
    return out


def role_label(role: Column) -> Column:
    out = role
    for name, text in ROLES.items():
        out = F.when(role == name, text).otherwise(out)
    return out


def provider_rank(provider: Column, order: tuple = tuple(PROVIDERS)) -> Column:
    out = F.lit(len(order))
    for k, name in enumerate(order):
        out = F.when(provider == name, k).otherwise(out)
    return out


def newest_first() -> list[Column]:
    return [F.col("started_at").desc(), provider_rank(F.col("provider")), F.col("session_id")]


def sort(sessions: DataFrame) -> DataFrame:
    """Newest first over the whole catalog (a range shuffle; prefer ``recent`` where a limit will do)."""
    return sessions.orderBy(*newest_first())


def provider_counts(sessions: DataFrame) -> DataFrame:
    """(provider, sessions): one row for each provider, and the grand total under null."""
    return sessions.rollup("provider").agg(F.count(F.lit(1)).alias("sessions"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def recent(sessions: DataFrame, n: int = 20) -> DataFrame:
    """The newest sessions as display rows (top-k, no full sort)."""
    return sessions.orderBy(*newest_first()).limit(n).select(
        utc_text(F.col("started_at"), "yyyy-MM-dd HH:mm").alias("started"),
        label(F.col("provider")).alias("provider"),
        F.coalesce("project_name", F.lit("(unknown)")).alias("project"),
        F.coalesce("git_branch", F.lit("")).alias("branch"),
        shortened(F.coalesce("summary", F.lit("")), 60).alias("summary"),
        "session_id",
    )


def relative_time(ts: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d")).otherwise(utc_text(ts, "MMM dd"))


def list_labels(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.select(
        "provider", "session_id", F.coalesce("project_name", F.lit("(unknown project)")).alias("project"), shortened(F.coalesce("summary", F.lit("")), 80).alias("summary"), relative_time(F.col("started_at"), as_of).alias("age")
    )


def filter_provider(sessions: DataFrame, providers: list[str] | None) -> DataFrame:
    return sessions if not providers else sessions.filter(F.col("provider").isin(*providers))


def filter_project(sessions: DataFrame, text: str | None) -> DataFrame:
    """Substring of project name or path, whatever the case; an empty text filters nothing."""
    if not text:
        return sessions
    has = lambda c: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return sessions.filter(has(F.col("project_name")) | has(F.col("project_path")))


def filter_dates(sessions: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """UTC date of the start between both dates, each inclusive and optional: a range of times, which scans can skip by."""
    midnight = lambda day: F.lit(f"{day}T00:00:00Z").cast("timestamp")
    if first:
        sessions = sessions.filter(F.col("started_at") >= midnight(first))
    return sessions.filter(F.col("started_at") < midnight(last) + F.expr("INTERVAL '24' HOUR")) if last else sessions


def filter_all(sessions: DataFrame, providers=None, project=None, first=None, last=None) -> DataFrame:
    return filter_dates(filter_project(filter_provider(sessions, providers), project), first, last)


def enabled_providers(sessions: DataFrame, slugs: list[str]) -> DataFrame:
    """Sessions of the providers named by configuration slugs; unknown slugs are ignored, an empty list disables all."""
    known = {slug: name for name, (_, slug) in PROVIDERS.items()}
    names = [known[s] for s in slugs if s in known]
    return sessions.filter(F.col("provider").isin(*names) if names else F.lit(False))


def lookup(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """For each ``key``, the first session whose id is the key or starts with it.

    First by provider in lookup order, then newest. Ids give their prefixes of the lengths that occur among the keys (as many
    as the longest id has characters, at most); of each prefix the first session is kept while partial results are still in the
    tasks, so a prefix that all sessions share moves a row a task, and keys meet it by equality. A key that no id starts
    with gives no row, nor does a null one; the empty key is the start of all.
    """
    sizes = [r.n for r in keys.select(F.length("key").alias("n")).filter("n is not null").distinct().collect()]
    first = F.struct(
        provider_rank(F.col("provider"), LOOKUP_ORDER).alias("rank"), F.coalesce(-F.unix_micros("started_at"), F.lit((1 << 63) - 1)).alias("age"), "session_id", "provider", "started_at"
    )
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("session_id")), lambda n: F.left(F.col("session_id"), n))
    best = sessions.select(F.explode(starts).alias("key"), first.alias("s")).groupBy("key").agg(F.min("s").alias("s"))
    return keys.select("key").distinct().join(best, "key").select("key", "s.provider", "s.session_id", "s.started_at")


def capped(messages: DataFrame, most: int = 5000) -> DataFrame:
    """The first ``most`` messages of each session (their numbers are dense), with how many there are."""
    totals = messages.groupBy("provider", "session_id").agg(F.count(F.lit(1)).alias("total"))
    return messages.filter(F.col("seq") < most).join(totals, ["provider", "session_id"])


def transcript(messages: DataFrame, show_tools: bool = False, args_lines: int = 20, output_lines: int = 10, thinking_lines: int = 5) -> DataFrame:
    """Readable rows: user messages of tool results alone are hidden, long bodies cut to lines, tools to their name."""
    only_results = (F.col("role") == "user") & F.forall("content", lambda b: b["type"] == "tool_result")
    rows = messages.filter(~only_results).select("provider", "session_id", "seq", role_label(F.col("role")).alias("speaker"), F.posexplode("content").alias("pos", "b"))
    kind, text = F.col("b.type"), F.col("b.text")
    lines = lambda n: F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")
    shown = F.when(kind == "tool_use", F.when(F.lit(show_tools), lines(args_lines)).otherwise(F.lit(""))).when(kind == "tool_result", F.when(F.lit(show_tools), lines(output_lines)).otherwise(F.lit(""))).when(kind == "thinking", lines(thinking_lines)).otherwise(text)
    return rows.select("provider", "session_id", "seq", "pos", "speaker", kind.alias("kind"), F.col("b.tool_name").alias("tool"), shown.alias("body"))


def token_label(sessions: DataFrame) -> DataFrame:
    """Total tokens in thousands, null where there are none."""
    total = F.col("token_usage.input_tokens") + F.col("token_usage.output_tokens")
    return sessions.select("provider", "session_id", F.when(total > 0, F.concat(F.floor(total / 1000).cast("string"), F.lit("k tokens"))).alias("tokens"))


def shell_quoted(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z0-9._-]*$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def resume_command(provider: Column, session_id: Column) -> Column:
    tail = F.regexp_extract(session_id, r"(.{8}-.{4}-.{4}-.{4}-.{12})$", 1)
    codex = F.when(tail != "", tail).otherwise(F.regexp_replace(session_id, "^rollout-", ""))
    # fixed values: commands of the tools
    said = {"claude_code": "claude --resume ", "copilot_cli": "copilot --resume=", "gemini_cli": "gemini --resume ", "codex_cli": "codex resume ", "opencode": "opencode --session "}
    out = F.lit(None).cast("string")
    for name, start in said.items():
        out = F.when(provider == name, F.concat(F.lit(start), shell_quoted(codex if name == "codex_cli" else session_id))).otherwise(out)
    return out


def content_blocks(messages: DataFrame) -> DataFrame:
    """One row for each block."""
    return messages.select("provider", "session_id", "seq", "message_id", "role", F.posexplode("content").alias("pos", "b")).select("provider", "session_id", "seq", "message_id", "role", "pos", "b.*")
