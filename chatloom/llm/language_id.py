"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with counts. The code length of a byte after a context
is -log2 of count / (total + distinct) where the context has met it, else an escape, distinct / (total + distinct), and
the code length after the next shorter context (method C; the shortest is uniform over 256 bytes). The statistics are
frozen after training, so a text's exact code length is a sum of table entries: one for each of its (context, byte)
strings. Tables hold all languages side by side and are looked up with array operations.

Training: a bounded sample of labelled rows for each language (``ROWS``), drawn by the hash of the id; of rows longer than
``LONGEST`` bytes, drawn only where shorter ones are too few, pieces from the start to the end are read, as many bytes together. Every label is learned:
the tables grow with the square of the number of languages, so beyond 16 of them each gets fewer rows (``CELLS``), and when
it has one row only, fewer bytes. The tables are therefore bounded whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.util import carried, carried_kinds, crc32_of_id, documents, release, table, tidy, utf8, with_columns

ORDER = 4
ROWS = 150
LONGEST = 20_000
#: Pieces in which a longer text is drawn.
PIECES = 8
#: Rows a language times the square of the number of languages, at most.
CELLS = ROWS * 16 * 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> np.ndarray:
    """Letters A-Z in lower case; all other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = _fold()


class Lookup:
    """Open addressing over packed byte strings (up to 7 bytes and their length) with array operations."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.slot = np.zeros(1 << self.bits, np.uint64)
        self.row = np.zeros(1 << self.bits, np.int32)
        at = self._hash(keys)
        left = np.arange(len(keys))
        self.steps = 0
        while len(left):
            self.steps += 1
            p = at[left]
            free = self.slot[p] == 0
            self.slot[p[free]] = keys[left[free]]
            won = self.slot[p] == keys[left]
            self.row[p[won]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't held."""
        at = self._hash(keys)
        out = np.where(self.slot[at] == keys, self.row[at], np.int32(-1))
        todo = np.flatnonzero((out < 0) & (self.slot[at] != 0))
        for _ in range(self.steps):
            if not len(todo):
                break
            p = (at[todo] + 1) & ((1 << self.bits) - 1)
            at[todo] = p
            hit = self.slot[p] == keys[todo]
            out[todo[hit]] = self.row[p[hit]]
            todo = todo[~hit & (self.slot[p] != 0)]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by length n from 1: packed strings of n bytes that some language has met, sorted
    costs: list[np.ndarray]  # code length of the last byte after the others, in every language
    contexts: list[np.ndarray]  # by length n from 0: packed contexts of n bytes
    escapes: list[np.ndarray]  # escape cost in every language, 0 where it hasn't met the context

    def ready(self) -> "Scorer":
        return Scorer(self)


def packed(data: np.ndarray, n: int) -> np.ndarray:
    """Strings of n bytes that end at each place (from n - 1 on), with n in the top byte; never 0."""
    out = np.full(len(data) - n + 1, np.uint64(n) << np.uint64(56), np.uint64)
    for k in range(n):
        out |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * (n - 1 - k))
    return out


def train(texts: dict[str, list[bytes]]) -> Model:
    languages = sorted(texts)
    if not languages:
        return Model([], [], [], [], [])
    counts = []  # [length][language] -> (keys, counts)
    for n in range(1, ORDER + 2):
        own = []
        for lang in languages:
            parts = [packed(d, n) for t in texts[lang] if len(d := FOLD[np.frombuffer(t, np.uint8)]) >= n]
            own.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64)))
        counts.append(own)
    model = Model(languages, [], [], [], [])
    shorter = None
    for n in range(1, ORDER + 2):
        keys = np.unique(np.concatenate([k for k, _ in counts[n - 1]]))
        mask = np.uint64((1 << (8 * n)) - 1)
        heads = np.unique((keys & mask) >> np.uint64(8)) | (np.uint64(n - 1) << np.uint64(56)) if len(keys) else np.empty(0, np.uint64)
        if n == 1:
            heads = np.zeros(1, np.uint64)
        cost = np.zeros((len(keys), len(languages)), np.float32)
        escape = np.zeros((len(heads), len(languages)), np.float32)
        tails = (keys & np.uint64((1 << (8 * (n - 1))) - 1)) | (np.uint64(n - 1) << np.uint64(56))
        for j, (k, c) in enumerate(counts[n - 1]):
            head = np.searchsorted(heads, ((k & mask) >> np.uint64(8)) | (np.uint64(n - 1) << np.uint64(56)) if n > 1 else np.zeros(len(k), np.uint64))
            total = np.bincount(head, c, len(heads))
            distinct = np.bincount(head, minlength=len(heads))
            met = total > 0
            escape[met, j] = -np.log2(distinct[met] / (total[met] + distinct[met]))
            at = np.searchsorted(keys, k)
            # strings that this language has not met: escape, then the shorter context
            base = np.full(len(keys), 8.0) if n == 1 else shorter[1][np.searchsorted(shorter[0], tails), j]
            place = np.searchsorted(heads, ((keys & mask) >> np.uint64(8)) | (np.uint64(n - 1) << np.uint64(56))) if n > 1 else np.zeros(len(keys), np.int64)
            cost[:, j] = escape[place, j] + base
            cost[at, j] = -np.log2(c / (total[head] + distinct[head]))
        model.grams.append(keys)
        model.costs.append(cost)
        model.contexts.append(heads)
        model.escapes.append(escape)
        shorter = (keys, cost)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.gram = [Lookup(k) for k in model.grams]
        self.context = [Lookup(k) for k in model.contexts[1:]]

    def costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of every byte in every language; ``starts`` are the first bytes of the texts."""
        n = len(data)
        out = np.zeros((n, len(self.model.languages)), np.float32)
        if not n:
            return out
        first = np.zeros(n, np.int64)
        own = starts[starts < n]
        first[own] = own
        back = np.minimum(np.arange(n) - np.maximum.accumulate(first), ORDER)  # bytes of context there are
        left = None
        for length in range(ORDER + 1, 0, -1):
            if length == ORDER + 1:
                todo = np.flatnonzero(back >= ORDER)
            else:
                todo = np.concatenate((left, np.flatnonzero(back == length - 1)))
            if not len(todo):
                left = todo
                continue
            key = np.full(len(todo), np.uint64(length) << np.uint64(56), np.uint64)
            for k in range(length):
                key |= data[todo - (length - 1 - k)].astype(np.uint64) << np.uint64(8 * (length - 1 - k))
            row = self.gram[length - 1](key)
            hit = row >= 0
            out[todo[hit]] += self.model.costs[length - 1][row[hit]]
            left = todo[~hit]
            if len(left):
                if length == 1:
                    out[left] += self.model.escapes[0][0] + 8.0
                else:
                    head = ((key[~hit] & np.uint64((1 << (8 * length)) - 1)) >> np.uint64(8)) | (np.uint64(length - 1) << np.uint64(56))
                    place = self.context[length - 2](head)
                    met = place >= 0
                    out[left[met]] += self.model.escapes[length - 1][place[met]]
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def bounds(languages: int, rows: int, longest: int) -> tuple[int, int]:
    """Rows and bytes of each that a language may have among so many."""
    cells = max(languages, 1) ** 2
    fewer = max(1, min(rows, CELLS // cells))
    return fewer, max(64, min(longest, longest * CELLS // (fewer * cells)))


def sample(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> dict[str, list[bytes]]:
    """At most ``rows`` labelled texts for each language, of each at most ``longest`` bytes; fewer if there are many languages."""
    labelled = docs.select(F.col("doc_id"), F.col("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    labelled = labelled.withColumn("hash", F.xxhash64("text"))
    rows, window = bounds(labelled.select("lang").distinct().count(), rows, longest)
    most = Window.partitionBy("lang").orderBy("long", F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "hash")
    drawn = labelled.withColumn("long", F.octet_length("text") > longest).select("lang", "doc_id", "hash", F.row_number().over(most).alias("n")).filter(F.col("n") <= rows)
    # equal rows are drawn as often as they were numbered
    keys = drawn.groupBy("lang", "doc_id", "hash").agg(F.count(F.lit(1)).alias("times")).select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), F.col("hash").alias("h"), "times")
    same = (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    found = labelled.join(F.broadcast(keys), same).groupBy("lang", "doc_id", "hash").agg(F.first(drawn_pieces(F.col("text"), window)).alias("pieces"), F.first("times").alias("times"))
    out: dict[str, list[bytes]] = {}
    for lang, pieces, times in found.select("lang", "pieces", "times").collect():
        most = window if len(pieces) == 1 else window // PIECES - 1
        out.setdefault(lang, []).extend([b" ".join(p.encode()[:most] for p in pieces)] * times)
    return out


def drawn_pieces(text: Column, window: int) -> Column:
    """A text of at most ``window`` bytes whole; of a longer one, pieces at even distances from its start to its end."""
    size = F.least(F.lit(window), F.length(text)) / PIECES
    piece = F.greatest(size.cast("int"), F.lit(1))
    at = lambda k: (1 + k * (F.length(text) - piece) / (PIECES - 1)).cast("int")
    several = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, at(k), piece))
    return F.when(F.octet_length(text) > window, several).otherwise(F.array(text))


def fit(docs: DataFrame, rows: int = ROWS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang); rows without text or language teach nothing."""
    model = train(sample(docs, rows))
    release()
    return model


def words_of(text: str) -> str:
    """The words of letters and their marks, one space between: numbers, keys, markup and controls tell no language.

    What stands with numbers between white space is left out, unless there is nothing else (as in scripts without spaces).
    """
    kinds = lambda t: [unicodedata.category(c)[0] for c in t]
    plain = lambda t: "".join(c if k in "LMN" else " " for c, k in zip(t, kinds(t))).split()
    return " ".join(plain(" ".join(t for t in text.split() if "N" not in kinds(t)))) or " ".join(w for w in plain(text) if "N" not in kinds(w))


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None, foreign: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits) for every row of (doc_id, text); lang_pred is ``und`` without any letter.

    Columns named in ``carry`` are passed through. Texts of more than ``foreign`` bits are predicted anew from their words alone, and
    score and bits are those of the words then.

    bits: code length for each byte in the best language. score: how much shorter the best code is than the second
    best, as the logistic posterior of the two at one byte in eight, between 0 and 1; 0 for ``und``, 1 if one language
    was learned. Ties go to the first language in order. Null text counts as empty; very long texts are scored whole, repeated
    rows each by itself; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages = model.languages

    def totals(scorer: Scorer, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(offsets) - 1, max(1, len(languages))))
        if languages:
            code = FOLD[np.frombuffer(data, np.uint8)]
            most = max(4096, 250_000 * 16 // max(16, len(languages)))
            for a, b in _cuts(offsets, most):
                if offsets[b] - offsets[a] > most:  # one long text: pieces that see the bytes before them
                    for low_at in range(offsets[a], offsets[b], most):
                        lead = min(ORDER, low_at - offsets[a])
                        piece = code[low_at - lead : min(low_at + most, offsets[b])]
                        total[a] += scorer.costs(piece, np.zeros(1, np.int64))[lead:].sum(axis=0, dtype=np.float64)
                    continue
                part = scorer.costs(code[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
                filled = np.flatnonzero(offsets[a + 1 : b + 1] > offsets[a:b])
                if len(filled):
                    total[a + filled] = np.add.reduceat(part, (offsets[a:b] - offsets[a])[filled], axis=0, dtype=np.float64)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.ready()
        for whole in batches:
            for low in range(0, whole.num_rows, 128):
                batch = whole.slice(low, 128)
                data, offsets = utf8(batch, "text")
                letters = batch.column(batch.schema.get_field_index("letters")).to_numpy(zero_copy_only=False)
                rows = len(offsets) - 1
                total, size = totals(scorer, data, offsets), np.diff(offsets)
                if foreign is not None:
                    again = np.flatnonzero(letters.astype(bool) & (total.min(axis=1) > foreign * size))
                    words = [words_of(bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")).encode() for k in again]
                    size[again] = [len(w) for w in words]
                    total[again] = totals(scorer, b"".join(words), np.concatenate(([0], np.cumsum(size[again]))))
                best = total.argmin(axis=1)
                low_bits = total[np.arange(rows), best]
                if total.shape[1] > 1:
                    second = np.partition(total, 1, axis=1)[:, 1]
                    score = 1 / (1 + np.exp2(-np.minimum((second - low_bits) / 8, 60)))
                else:
                    score = np.ones(rows)
                known = letters.astype(bool) & bool(languages)
                answer = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())], pa.string()),
                        pa.array(np.where(known, score, 0.0)),
                        pa.array(np.where(size > 0, low_bits / np.maximum(size, 1), 0.0)),
                    ],
                    ["doc_id", "lang_pred", "score", "bits"],
                )
                yield with_columns(answer, batch, carry)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), has_letter(F.col("text").cast("string")).alias("letters"), *carried(docs, carry))
    return plain.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, bits double" + carried_kinds(docs, carry))


def _cuts(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes; a longer row is a run of its own."""
    out, a, rows = [], 0, len(offsets) - 1
    while a < rows:
        b = a + 1
        while b < rows and offsets[b + 1] - offsets[a] <= most:
            b += 1
        out.append((a, b))
        a = b
    return out


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = crc32_of_id(F.col("doc_id")) % 4 == 2
    model = fit(docs.filter(~F.coalesce(out, F.lit(False))))
    return predict(documents(spark, sf_dir).select("doc_id", "text"), model).select("doc_id", F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
