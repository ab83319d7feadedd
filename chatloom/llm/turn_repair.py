r"""Repair of the structure of conversations by depth-first branch-and-bound.

A repaired conversation is empty or goes ``system? (user assistant)+``, told by the first letters of its roles. Edits, and
what they cost: Keep 0, Rerole 3 (to user or assistant), Delete 4 (a must for blank and repeated turns), Insert 3 (an empty
turn of user or assistant); a truncated turn that stays costs 3 more. Of the cheapest edits, those whose initials in order
(the *audit*) come first in ASCII are taken.

The search goes over nodes (turns done, state); the state says which role is due. Each node has an explicit place on a stack;
children are taken in the order of their letters. A node is dropped if its cost and the lower bound of what is left exceed the
incumbent (cost, audit), or if the table of its node holds a better (cost, audit): costs
add up, and of two different audits of one cost at one node neither is the start of the other, so the worse stays worse
whatever follows. The bound of a suffix is the least cost of its turns from each state, found backward.

A conversation of any length is split: turns are sorted by ranges of (conversation, turn), cut into pieces of at most
2**``PIECE_BITS`` turns, and each piece is searched from each state it may be entered in to each state it may be left in. The answers
of the pieces of one conversation meet (a row a piece), are combined, and go back to the pieces, which apply their part of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import small_batches, table, tidy, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a piece: a number of bits.
PIECE_BITS = 12
#: States: nothing said; a system turn; a user's turn, which wants an answer; an answer.
NONE, SYSTEM, USER, ANSWER = range(4)
#: What Insert and Rerole say in each state, and the state after it.
NEXT = ((USER, "user"), (USER, "user"), (ANSWER, "assistant"), (USER, "user"))
ENDS = (NONE, ANSWER)
#: Faults of a turn.
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACE = " \t\n\x0b\f\r"


def after_keep(state: int, initial: str) -> int | None:
    """The state after a turn that stays as it is, none if its role isn't due."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "a":
        return ANSWER if state == USER else None
    return USER if initial == "u" and state != USER else None


def moves(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, turns taken, state after) of the edits at a turn, in the order of the letters."""
    yield "D", DELETE, 1, state
    yield "I", INSERT, 0, NEXT[state][0]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        kept = after_keep(state, initial)
        if kept is not None:
            yield "K", KEEP + more, 1, kept
        yield "R", REROLE + more, 1, NEXT[state][0]


#: The edits of each kind of turn and state, last letter first; after the last turn there are only inserts.
_INITIALS = {"s": 0, "u": 1, "a": 2}
_MOVES = [[[tuple(reversed(list(moves(q, i, f)))) for q in range(4)] for f in range(4)] for i in ("s", "u", "a", "")]
_LAST = [(("I", INSERT, 0, NEXT[q][0]),) for q in range(4)]
_INF = float("inf")


def _edits(turn: tuple[str, int]) -> list[tuple]:
    return _MOVES[_INITIALS.get(turn[0], 3)][turn[1]]


def suffix_bounds(turns: list[tuple[str, int]], ends: tuple) -> list[list[float]]:
    """bounds[i][state]: least cost of turns i and later from a state to one of ``ends``."""

    def closed(row: list[float]) -> list[float]:
        # what an insert leads to; two of them return to a state, so each is looked at once
        none, system, user, answer = row
        user = min(user, INSERT + answer)
        return [min(none, INSERT + user), min(system, INSERT + user), user, min(answer, INSERT + user)]

    out = [closed([0.0 if q in ends else _INF for q in range(4)])]
    for turn in reversed(turns):
        last = out[-1]
        out.append(closed([min(cost + last[after] for _, cost, taken, after in edits if taken) for edits in _edits(turn)]))
    return out[::-1]


def search(turns: list[tuple[str, int]], start: int, ends: tuple, bounds: list[list[float]] | None = None) -> tuple[int, str, int] | None:
    """The best (cost, audit, end) from the state ``start`` to one of ``ends``, none if none can be reached."""
    bounds = suffix_bounds(turns, ends) if bounds is None else bounds
    steps = [_edits(t) for t in turns] + [_LAST]
    incumbent: tuple[float, str, int] = (_INF, "", 0)
    table: dict[tuple[int, int], tuple[float, str]] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        low = cost + bounds[i][state]
        if low == _INF or (low, audit) > incumbent[:2] or table.get((i, state), (_INF, "")) <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == len(turns) and state in ends:
            incumbent = min(incumbent, (cost, audit, state))
        for letter, more, taken, after in steps[i][state]:
            stack.append((i + taken, after, cost + more, audit + letter))
    return None if incumbent[0] == _INF else incumbent


def applied(turns: Iterator[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves, from a state on; takes as many (role, text) as the audit has."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        after, due = NEXT[state]
        if letter == "K":
            yield role, text, letter
            after = after_keep(state, role[:1])
        else:
            yield due, text, letter
        state = after


_PIECE = "piece long, conv long, first int, last int, initial string, final string, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, ways array<struct<start:int,end:int,cost:long,audit:string>>"
_LEGAL = ("su", "ua", "au")


def _summary(piece: int, conv: int | None, rows: list[tuple], first: bool, last: bool) -> dict:
    """What a piece of a conversation adds up to. ``rows``: (turn, initial of the role, fault); ``first``, ``last``: known to be so."""
    faults = [f for *_, f in rows]
    turns = [(initial, f) for _, initial, f in rows]
    numbers = [t for t, *_ in rows if t is not None]
    ways = []
    for ends in (ENDS,) if last else ((NONE,), (SYSTEM,), (USER,), (ANSWER,)):
        bounds = suffix_bounds(turns, ends)
        for start in (NONE,) if first else (NONE, SYSTEM, USER, ANSWER):
            found = search(turns, start, ends, bounds)
            if found is not None:
                ways.append({"start": start, "end": found[2], "cost": int(found[0]), "audit": found[1]})
    pairs = (a[0] + b[0] for a, b in zip(turns, turns[1:]))
    return {
        "piece": piece, "conv": conv, "initial": turns[0][0], "final": turns[-1][0], "least": numbers[0] if numbers else None, "most": numbers[-1] if numbers else None, "turns": len(set(numbers)),
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(p not in _LEGAL for p in pairs), "ways": ways,
    }


def fault(text: Column, again: Column) -> Column:
    said = F.rtrim(text, F.lit(_SPACE))
    return F.when(said == "", BLANK).when(again, DUPLICATE).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], bool, bool]]:
    """(rows, first, last): rows (cut, at, conv, …) of one cut and one conversation, in order, and whether another conversation
    stands before and after them in the cut, so that they are known to hold its first and its last turn."""
    held: list[tuple] = []
    first = False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[0], row[2]) != (held[0][0], held[0][2]):
                same = row[0] == held[0][0]
                yield held, first, same
                held, first = [], same
            held.append(row)
    if held:
        yield held, first, False


def _answers(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _mapped(df: DataFrame, each: Callable, shape: str) -> DataFrame:
    """``each(pieces)`` over the sorted rows of each task, its dicts written out in batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for row in each(batches):
            out.append(row)
            size += 1 + len(row.get("text") or "") // 100
            if size > 5000:
                yield _answers(out, schema)
                out, size = [], 0
        if out:
            yield _answers(out, schema)

    return df.mapInArrow(tidy(run), shape)


class Repaired(NamedTuple):
    #: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation.
    conversations: DataFrame
    #: (conv_id, at, n, role, text, edit): the turns that are left, in the order of (at, n).
    turns: DataFrame


def _ways(held: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest way through the pieces, and the (start state, audit) of each of them."""
    best: dict[int, tuple[int, str, tuple | None]] = {NONE: (0, "", None)}
    for p in held:
        now: dict[int, tuple[int, str, tuple | None]] = {}
        for way in p["ways"]:
            if way["start"] in best:
                cost, audit, back = best[way["start"]]
                more = (cost + way["cost"], audit + way["audit"], (back, way["start"], way["audit"]))
                if way["end"] not in now or more[:2] < now[way["end"]][:2]:
                    now[way["end"]] = more
        best = now
    cost, _, back = min((best[q] for q in ENDS if q in best), key=lambda x: x[:2])
    path = []
    while back is not None:
        back, start, audit = back
        path.append((start, audit))
    return cost, path[::-1]


_PLAN = "piece long, conv long, state int, audit string, head boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, whole string"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row for each piece of a conversation with its part of the audit; the first has what the conversation adds up to."""

    def close(held: list[dict]) -> Iterator[dict]:
        rows = [p for p in held if p["ways"] is not None]
        cost, path = _ways(rows)
        said = {n: sum(p[n] for p in rows) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
        said["illegal"] += sum(a["final"] + b["initial"] not in _LEGAL for a, b in zip(rows, rows[1:]))
        told = [p for p in rows if p["least"] is not None]
        distinct = said.pop("turns") - sum(a["most"] == b["least"] for a, b in zip(told, told[1:]))
        said["gaps"] = told[-1]["most"] - told[0]["least"] + 1 - distinct if told else 0
        head = {"conv": held[0]["conv"], "head": True, "cost": int(cost), "whole": "".join(a for _, a in path), **said}
        if not rows:
            yield head
        for p, (state, audit) in zip(rows, path):
            yield {"piece": p["piece"], "state": state, "audit": audit, **(head if p is rows[0] else {"conv": p["conv"], "head": False})}

    held: list[dict] = []
    for batch in batches:
        for p in batch.to_pylist():
            if held and p["conv"] != held[0]["conv"]:
                yield from close(held)
                held = []
            held.append(p)
    if held:
        yield from close(held)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> Repaired:
    """Faults, cheapest edits and repaired turns of all conversations of ``rows`` (conv_id, turn, role, text).

    Turns are taken in the order of turn (none first), then role and text. Null roles and texts are one space. A row's first
    fault counts: blank, duplicate (role and text stood earlier; told by 64-bit hashes inside a conversation), truncated. Null conv_ids are a conversation of their own, repeated
    rows are duplicates, very long texts are passed on whole, and further columns are ignored. ``conversations`` (conv_id) may
    name more of them, without rows: they cost nothing and have an empty audit. An empty table gives none.
    """
    spark = rows.sparkSession
    plain = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"))
    order = ["conv", "turn", "role", "text"]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("told", F.xxhash64("role", "text")), "turns")
    first = placed.groupBy("conv", "told").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("conv2"), F.col("told").alias("told2"), "first")
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("told") == F.col("told2"))
    marked = placed.join(written(first, "repeated"), same, "left").withColumn("fault", fault(F.col("text"), F.coalesce("first", "at") < F.col("at")))
    cut = F.shiftright("at", PIECE_BITS).alias("cut")
    marked = written(marked.select(cut, "at", F.lit(1).alias("kind"), "conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "role", "text"), "marked")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held, begins, ends in _pieces(batches):
            yield _summary(held[0][1], held[0][2], [r[3:] for r in held], begins, ends)

    summaries = _mapped(marked.drop("kind", "role", "text").repartition("cut").sortWithinPartitions("cut", "at"), summed, _PIECE)
    if conversations is not None:
        summaries = summaries.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct(), allowMissingColumns=True)
    plan = written(_mapped(summaries.repartition("conv").sortWithinPartitions("conv", F.col("piece").asc_nulls_first()), _combined, _PLAN), "plan")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, at, _, conv, state, audit, *_ in rows:  # the plan of a piece; its turns are taken by what applies it
            for n, (role, text, edit) in enumerate(applied((r[6:8] for r in rows), audit, state)):
                yield {"conv_id": conv, "at": at, "n": n, "role": role, "text": text, "edit": edit}

    parts = plan.filter("piece is not null").select(F.shiftright("piece", PIECE_BITS).alias("cut"), F.col("piece").alias("at"), F.lit(0).alias("kind"), "conv", "state", "audit")
    both = parts.unionByName(marked.drop("turn", "initial", "fault"), allowMissingColumns=True).select("cut", "at", "kind", "conv", "state", "audit", "role", "text")
    turns = _mapped(both.repartition("cut").sortWithinPartitions("cut", "at", "kind"), edited, "conv_id long, at long, n long, role string, text string, edit string")
    heads = plan.filter("head").select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("whole").alias("audit"))
    return Repaired(heads, turns)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as faults leave them, by a checksum of their key: dropped, emptied, without ends, repeated, of another role."""
    plain = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), which.alias("which")).filter("which <> 0")
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("which") == 4, "user").otherwise(F.col("role"))
    often = F.when(F.col("which") == 3, 2).otherwise(1)
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), often)).alias("copy")).drop("copy")


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of each conversation, streamed in order (no conversation is held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        digest, conv = None, None
        for batch in batches:
            for own, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if digest is None or own != conv:
                    if digest is not None:
                        yield {"conv_id": conv, "sha256": digest.hexdigest()}
                    digest, conv = hashlib.sha256(), own
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield {"conv_id": conv, "sha256": digest.hexdigest()}

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "n").select("conv_id", "role", "text")
    return _mapped(ordered, run, "conv_id long, sha256 string")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows), rows)
    digest = text_digests(done.turns).select(F.col("conv_id").alias("own"), "sha256")
    nothing: Column = F.sha2(F.lit("").cast("binary"), 256)
    found = done.conversations.join(digest, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", nothing).alias("repaired_sha256"))
