"""Raw provider logs rendered from the table ``conversations``, so that parsers can be checked on it as a round trip.

provider: by conv_id mod 5; project: by conv_id mod 7; times: 2025-01-01 plus conv_id hours plus 5 seconds a turn.
Assistant texts get a fenced code block. Every other conversation uses the newer record layout of its provider. In the
newer layouts of Claude Code, Copilot, Gemini and OpenCode assistants also call a tool; Claude Code and Gemini tell what they
think, Claude Code has the result in the user's message, OpenCode beside the call (it failed on odd turns). In the older
Codex layout what the system says is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.sources.files import Raw

PROVIDER_AT = ("claude_code", "copilot_cli", "gemini_cli", "codex_cli", "opencode")
FENCE = "```"


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def conversations(rows: DataFrame) -> DataFrame:
    said = F.when(F.col("role") == "assistant", F.concat("text", F.lit(f"\n{FENCE}sql\nselect "), F.col("turn").cast("string"), F.lit(f"\n{FENCE}"))).otherwise(F.col("text"))
    epoch = F.lit(1735689600) + F.col("conv_id") * 3600 + F.col("turn") * 5
    iso = F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return rows.select(
        "conv_id", "turn", "role", said.alias("said"), epoch.alias("epoch"), iso.alias("iso"), (F.col("conv_id") % 5).alias("kind"), (F.col("conv_id") % 2 == 1).alias("newer"),
        F.concat(F.lit("project-"), (F.col("conv_id") % 7).cast("string")).alias("project"), F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("sid"),
        (F.length("text") % 500).cast("long").alias("input"), (F.length("text") % 300).cast("long").alias("output"),
    )


def _lines(df: DataFrame, path, value) -> DataFrame:
    """Lines with a corrupt one after every 17th and a blank one after every 11th."""
    rows = df.select(path.alias("source_path"), (F.col("turn") * 10).alias("ord"), value.alias("value"), ((F.col("conv_id") + F.col("turn")) % 17 == 0).alias("bad"), ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("blank"))
    noise = rows.filter("bad").select("source_path", (F.col("ord") + 3).alias("ord"), F.lit('{"type": "user", "broken').alias("value"))
    blank = rows.filter("blank").select("source_path", (F.col("ord") + 6).alias("ord"), F.lit("   ").alias("value"))
    return rows.select("source_path", "ord", "value").unionByName(noise).unionByName(blank)


def _files(df: DataFrame, path, value) -> DataFrame:
    return df.select(path.alias("source_path"), F.lit(0).cast("long").alias("ord"), value.alias("value"))


def render(rows: DataFrame) -> Raw:
    c = conversations(rows)
    of = lambda k: c.filter(F.col("kind") == k)
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    st = F.struct
    answer = F.col("role") == "assistant"
    tokens = st(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"))

    # Claude Code: newer layout holds an array of items
    claude = of(0)
    number = F.col("turn").cast("string")
    call, null = cat("c-", number), F.lit(None)
    item = lambda kind, text=null, thinking=null, id=null, name=null, input=null, use=null, failed=null, content=null: st(
        F.lit(kind).alias("type"), text.cast("string").alias("text"), thinking.cast("string").alias("thinking"), id.cast("string").alias("id"), name.cast("string").alias("name"), input.cast("struct<n:bigint>").alias("input"),
        use.cast("string").alias("tool_use_id"), failed.cast("boolean").alias("is_error"), content.cast("string").alias("content"),
    )
    said = item("text", F.col("said"))
    asked = item("tool_use", id=call, name=F.lit("Lookup"), input=st(F.col("turn").cast("long").alias("n")))
    given = item("tool_result", use=call, failed=F.col("turn") % 2 == 1, content=cat("found ", number))
    items = F.when(answer, F.array(said, item("thinking", thinking=cat("weighing ", number)), asked)).when(F.col("role") == "user", F.array(said, given)).otherwise(F.array(said))
    body = lambda content: F.to_json(
        st(
            F.col("role").alias("type"), cat("m-", F.col("turn").cast("string")).alias("uuid"), F.col("iso").alias("timestamp"), F.lit("main").alias("gitBranch"), cat("/work/", F.col("project")).alias("cwd"),
            st(F.col("role").alias("role"), F.when(answer, "model-a").alias("model"), content.alias("content"), F.when(answer, tokens).alias("usage")).alias("message"),
        )
    )
    claude_lines = _lines(claude, cat("/c/projects/", F.col("project"), "/", F.col("sid"), ".jsonl"), F.when(F.col("newer"), body(items)).otherwise(body(F.col("said"))))
    first = claude.groupBy("conv_id", "sid").agg(F.min("epoch").alias("epoch"))
    history = _files(first, F.lit("/c/history.jsonl"), F.to_json(st(cat("talk ", F.col("conv_id").cast("string")).alias("display"), (F.col("epoch") * 1000).alias("timestamp"), F.col("sid").alias("sessionId")))).withColumn("ord", F.monotonically_increasing_id())

    # Copilot CLI
    copilot = of(1)
    kind = F.when(F.col("role") == "user", "user.message").when(answer, "assistant.message").otherwise("session.info")
    flat = F.to_json(st(cat("e-", F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("iso").alias("timestamp"), F.col("said").alias("content"), F.when(answer, st(F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"))).alias("usage")))
    nested = F.to_json(st(cat("e-", F.col("turn").cast("string")).alias("id"), kind.alias("type"), F.col("iso").alias("timestamp"), st(F.col("said").alias("content"), F.when(answer, F.array(st(cat("c-", F.col("turn").cast("string")).alias("toolCallId"), F.lit("Lookup").alias("name"), st(F.col("turn").cast("long").alias("n")).alias("arguments")))).alias("toolRequests")).alias("data")))
    folder = cat("/p/", F.col("sid"))
    events = _lines(copilot, cat(folder, "/events.jsonl"), F.when(F.col("newer"), nested).otherwise(flat))
    bounds = copilot.groupBy("conv_id", "sid", "project").agg(F.min("iso").alias("a"), F.max("iso").alias("b"))
    yaml = cat("id: ", F.col("sid"), "\ncwd: '/work/", F.col("project"), "'\ncreated_at: ", F.col("a"), "\nupdated_at: \"", F.col("b"), '"\n')
    workspaces = _files(bounds, cat(folder, "/workspace.yaml"), yaml)

    # Gemini CLI
    gemini = of(2)
    kind = F.when(F.col("role") == "user", "user").when(answer, "gemini").otherwise("info")
    more = F.col("newer") & answer
    thoughts = F.when(more, F.array(st(cat("weighing ", number).alias("description")))).alias("thoughts")
    calls = F.when(more, F.array(st(call.alias("id"), F.lit("Lookup").alias("name"), st(F.col("turn").cast("long").alias("n")).alias("args")))).alias("toolCalls")
    message = lambda content: st(
        cat("g-", F.col("turn").cast("string")).alias("id"), F.col("iso").alias("timestamp"), kind.alias("type"), content.alias("content"),
        F.when(answer, st(F.col("input").alias("input"), F.col("output").alias("output"))).alias("tokens"), F.when(answer, "model-g").alias("model"), thoughts, calls,
    )
    one = F.when(F.col("newer"), F.to_json(message(F.array(st(F.col("said").alias("text")))))).otherwise(F.to_json(message(F.col("said"))))
    whole = gemini.groupBy("sid", "project").agg(F.min("iso").alias("a"), F.max("iso").alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(st("turn", one.alias("j")))), lambda x: x["j"]), ",").alias("m"))
    chats = _files(whole, cat("/g/tmp/", F.col("project"), "/chats/session-", F.col("sid"), ".json"), cat('{"sessionId":"', F.col("sid"), '","startTime":"', F.col("a"), '","lastUpdated":"', F.col("b"), '","messages":[', F.col("m"), "]}"))
    # the last of the seven projects is in no map, so that sessions without a known path occur
    entry = cat('"/work/', F.col("project"), '":"', F.col("project"), '"')
    known = c.filter(F.col("conv_id") % 7 < 6).agg(F.array_join(F.sort_array(F.collect_set(entry)), ",").alias("m"))
    projects = _files(known, F.lit("/g/projects.json"), cat('{"projects":{', F.col("m"), "}}"))

    # Codex CLI
    codex = of(3)
    failed = F.col("role") == "system"
    old = F.to_json(st(F.when(failed, "error").otherwise(F.col("role")).alias("type"), F.when(~failed, F.col("said")).alias("content"), F.when(failed, F.col("said")).alias("error"), F.col("iso").alias("timestamp")))
    inner = F.when(F.col("role") == "user", "user_message").when(answer, "agent_message").otherwise("note")
    new = F.to_json(st(F.col("iso").alias("timestamp"), F.lit("event_msg").alias("type"), st(inner.alias("type"), F.col("said").alias("message")).alias("payload")))
    rollouts = _lines(codex, cat("/x/2025/01/01/rollout-", F.col("sid"), ".jsonl"), F.when(F.col("newer"), new).otherwise(old))

    # OpenCode
    opencode = of(4)
    bounds = opencode.groupBy("conv_id", "sid", "project", "newer").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"), F.min("iso").alias("ia"), F.max("iso").alias("ib"))
    title, place = cat("talk ", F.col("conv_id").cast("string")), cat("/work/", F.col("project"))
    session = F.when(
        F.col("newer"), F.to_json(st(F.col("sid").alias("id"), title.alias("title"), place.alias("directory"), st((F.col("a") * 1000).alias("created"), (F.col("b") * 1000).alias("updated")).alias("time"), st(F.lit("model-o").alias("modelID")).alias("model")))
    ).otherwise(F.to_json(st(F.col("sid").alias("id"), title.alias("title"), place.alias("cwd"), F.col("ia").alias("createdAt"), F.col("ib").alias("updatedAt"))))
    oc_sessions = _files(bounds, cat("/o/session/", F.col("project"), "/", F.col("sid"), ".json"), session)
    mid = cat(F.col("sid"), "-", F.lpad(F.col("turn").cast("string"), 4, "0"))
    new = F.to_json(st(mid.alias("id"), F.col("role").alias("role"), st((F.col("epoch") * 1000).alias("created")).alias("time"), F.when(answer, st(F.col("input").alias("input"), F.col("output").alias("output"))).alias("tokens")))
    old = F.to_json(st(mid.alias("id"), F.col("role").alias("role"), F.col("iso").alias("timestamp"), F.col("said").alias("content"), F.when(answer, st(F.col("input").alias("input"), F.col("output").alias("output"))).alias("tokens")))
    oc_messages = _files(opencode, cat("/o/message/", F.col("sid"), "/", mid, ".json"), F.when(F.col("newer"), new).otherwise(old))
    oc_parts = _files(opencode.filter("newer"), cat("/o/part/", mid, "/prt-001.json"), F.to_json(st(F.lit("text").alias("type"), F.col("said").alias("text"))))
    state = st(F.when(F.col("turn") % 2 == 0, "completed").otherwise("error").alias("status"), st(F.col("turn").cast("long").alias("n")).alias("input"), cat("found ", number).alias("output")).alias("state")
    tools = _files(opencode.filter(F.col("newer") & answer), cat("/o/part/", mid, "/prt-002.json"), F.to_json(st(F.lit("tool").alias("type"), F.lit("Lookup").alias("tool"), call.alias("callID"), state)))
    oc_parts = oc_parts.unionByName(tools)

    none = claude_lines.filter("false")
    return Raw(claude_lines, history, workspaces, events, none, chats, projects, rollouts, oc_sessions, oc_messages, oc_parts)
