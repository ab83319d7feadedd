"""Token ids of many texts with few calls of the tokenizers library.

A byte-pair tokenizer splits a text into pre-tokens and merges inside each one, so the ids of a text are the ids of
its pre-tokens one after another. Words repeat: :class:`Encoder` finds the pre-tokens of a whole batch with array
operations, and asks the library only for those that this worker hasn't met yet. A text that the array rules do not
cover (code points outside ``_TOP``, the tokenizer's own special strings) goes to the library whole. The memo is
cleared when it reaches ``memo_limit`` entries; results don't depend on it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np

#: Code points below this are split by the array rules: Latin letters, ASCII and Latin-1 signs.
_TOP = 0x250
#: Typographic punctuation that occurs in ordinary prose and is neither letter, number nor space.
_SIGNS = (*range(0x2010, 0x2028), *range(0x2030, 0x203F), 0x20AC, 0x2122, 0x2026)
_SIZE = 0x20D0 + 0x60
_LETTER, _NUMBER, _OTHER, _SPACE, _FAR = 0, 1, 2, 3, 4
_TAILS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    import regex

    table = np.full(_SIZE, _FAR, np.uint8)
    for code in (*range(_TOP), *_SIGNS):
        c = chr(code)
        table[code] = _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SPACE if regex.match(r"\s", c) else _OTHER
    table[0x130] = _FAR  # its lower case has two code points
    table[0x1C:0x20] = _FAR  # separators on which regular-expression libraries differ
    return table


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_gpt(kind: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens under ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``first`` marks the first code point of each text.
    """
    n = len(code)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    before_word = np.zeros(n, bool)  # the last space before something else in the same text
    before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= before_word
    joined = np.zeros(n, bool)
    joined[1:] = before_word[:-1] & (code[:-1] == 32)
    start &= ~joined
    _contract(kind, code, first, start)
    at = np.flatnonzero(start)
    return at, np.append(at[1:], n)


def spans_word(kind: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``; ``code`` is in lower case."""
    n = len(code)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start |= kind == _NUMBER
    _contract(kind, code, first, start)
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    keep = kind[at] != _SPACE
    return at[keep], end[keep]


def _contract(kind: np.ndarray, code: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    n = len(code)
    at = np.flatnonzero((code == 39) & start)
    for tail in _TAILS:
        k = len(tail)
        p = at[at + k < n]
        for j, c in enumerate(tail):
            p = p[(code[p + 1 + j] == ord(c)) & ~first[p + 1 + j]]
        start[p + 1] = False
        if k == 2:
            start[p + 2] = False
        start[p[p + 1 + k < n] + 1 + k] = True


@dataclass
class Encoder:
    """``words``: the word tokenizer (lower case, no white space); else the byte-level one."""

    path: str
    words: bool
    memo_limit: int = 800_000
    kinds: np.ndarray = field(default_factory=_classes)

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the library's merges without its own cache: each pre-token is asked for once
        more = {"end_of_word_suffix": model["end_of_word_suffix"]} if model["end_of_word_suffix"] else {}
        self.merges = BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0, **more).tokenize
        self.bytes = _byte_letters()
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = len(self.kinds)
        self.lower = np.arange(size, dtype=np.uint32)
        if self.words:
            for c in range(size):
                low = chr(c).lower()
                if len(low) == 1 and ord(low) < size and self.kinds[ord(low)] != _FAR:
                    self.lower[c] = ord(low)
                else:
                    self.kinds[c] = _FAR
        self.value = _mix(np.arange(1, size + 1))
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self.proven: np.ndarray | None = None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base, back = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, back, np.uint64))), dtype=np.uint64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = [[t.id for t in self.merges((x if x.isascii() else x.encode().decode("latin-1")).translate(self.bytes))] for x in texts]
        size = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for e in got for x in e), np.int32, int(size.sum()))
        merged = np.concatenate((self.keys, keys))
        order = np.argsort(merged, kind="stable")  # two sorted runs: merged in linear time
        self.keys = merged[order]
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(size) - size))[order]
        self.sizes = np.concatenate((self.sizes, size))[order]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(len(ids), self.used) + 1024, np.int32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def whole(self) -> np.ndarray:
        """Keys of the vocabulary strings proven to be one token each.

        The proof is by trial: a string is kept when the whole library, with its normalizer and its split, gives
        exactly that one id for it. As merges never cross pre-tokens, a pre-token that equals such a string is one
        token wherever it stands.
        """
        if self.proven is None:
            letters = {v: k for k, v in self.bytes.items()}
            tail = "</w>" if self.words else ""
            texts, ids = [], []
            for text, number in self.library.get_vocab(with_added_tokens=False).items():
                if not text.endswith(tail):
                    continue
                raw = bytes(letters[c] for c in text[: len(text) - len(tail)])
                try:
                    word = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if word and all(ord(c) < len(self.kinds) and self.kinds[ord(c)] != _FAR for c in word):
                    texts.append(word)
                    ids.append(number)
            got = self.library.encode_batch_fast(texts, add_special_tokens=False)
            alone = [t for t, i, e in zip(texts, ids, got) if e.ids == [i]]
            keys = []
            for t in alone:
                code = np.array([ord(c) for c in t], np.uint32)
                self._powers(len(code) + 1)
                keys.append(self._keys(self.lower[code] if self.words else code, np.array([0]), np.array([len(code)]))[0])
            self.proven = np.unique(np.array(keys, np.uint64))
        return self.proven

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the row offsets into them."""
        texts = self._run(data, offsets, False)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return (np.concatenate(texts) if texts else np.empty(0, np.int32)), np.concatenate(([0], np.cumsum(sizes)))

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text. Pre-tokens proven to be whole tokens are counted without being merged."""
        return np.array(self._run(data, offsets, True), np.int64)

    def _run(self, data: bytes, offsets: np.ndarray, counting: bool) -> list:
        rows = len(offsets) - 1
        out: list = [None] * rows
        # pieces of at most 500 kB keep the arrays in cache; one very long text is a piece of its own
        a = 0
        while a < rows:
            b = a + 1
            while b < rows and offsets[b + 1] - offsets[a] <= 500_000:
                b += 1
            self._piece(bytes(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], out, a, counting)
            a = b
        return out

    def _piece(self, data: bytes, offsets: np.ndarray, out: list, base: int, counting: bool) -> None:
        rows = len(offsets) - 1
        whole = data.decode("utf-8", "replace")
        if len(whole) == len(data):
            code = np.frombuffer(data, np.uint8).astype(np.uint32)
            at = offsets
        else:
            code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            raw = np.frombuffer(data, np.uint8)
            at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
        n = len(code)
        far = np.zeros(rows, bool)
        safe = np.minimum(code, len(self.kinds) - 1)
        kind = np.where(code >= len(self.kinds), np.uint8(_FAR), self.kinds[safe])
        odd = np.flatnonzero(kind == _FAR)
        if len(odd):
            far[np.searchsorted(at, odd, "right") - 1] = True
        for s in self.special:
            mark = s.encode()
            p = data.find(mark)
            while p >= 0:
                far[np.searchsorted(offsets, p, "right") - 1] = True
                p = data.find(mark, p + 1)
        if n:
            sizes, ids, s = self._memo(safe, kind, at, n, far, counting)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            where = ends[np.searchsorted(s, at)]
        else:
            ids, where = np.empty(0, np.int32), np.zeros(rows + 1, np.int64)
        for r in np.flatnonzero(far).tolist():
            got = self.library.encode(data[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids
            out[base + r] = len(got) if counting else np.asarray(got, np.int32)
        near = np.flatnonzero(~far).tolist()
        if counting:
            number = np.diff(where).tolist()
            for r in near:
                out[base + r] = number[r]
        else:
            w = where.tolist()
            for r in near:
                out[base + r] = ids[w[r] : w[r + 1]]

    def _keys(self, code: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[code] * self.power[: len(code)], dtype=np.uint64)))
            return _mix((total[e] - total[s]) * self.inverse[s] + (e - s).astype(np.uint64))

    def _memo(self, safe: np.ndarray, kind: np.ndarray, at: np.ndarray, n: int, far: np.ndarray, counting: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Number of ids of each pre-token, the ids (unless counting), and where the pre-tokens start."""
        first = np.zeros(n, bool)
        first[at[:-1][at[:-1] < n]] = True
        if self.words:
            safe = self.lower[safe]
            s, e = spans_word(kind, safe, first)
        else:
            s, e = spans_gpt(kind, safe, first)
        if far.any():
            near = ~far[np.searchsorted(at, s, "right") - 1]
            s, e = s[near], e[near]
        self._powers(n + 1)
        keys = self._keys(safe, s, e)
        order = np.argsort(keys)  # sorted queries keep the searches in cache, and repeated words fall together
        asked = keys[order]
        head = np.concatenate(([True], asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, bool)
        distinct = asked[head]
        sample = order[head]
        sizes = np.ones(len(distinct), np.int64)
        rest = np.arange(len(distinct))
        if counting:
            rest = np.flatnonzero(~_within(self.whole(), distinct))
        starts = np.zeros(len(distinct), np.int64)
        if len(rest):
            place = self._find(distinct[rest])
            if (place < 0).any():
                if len(self.keys) + len(rest) > self.memo_limit:
                    self._forget()
                    place[:] = -1
                new = rest[place < 0]
                p = sample[new]
                self._learn(distinct[new], [safe[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace") for a, b in zip(s[p].tolist(), e[p].tolist())])
                place = self._find(distinct[rest])
            sizes[rest] = self.sizes[place]
            starts[rest] = self.starts[place]
        group = np.cumsum(head) - 1
        back = np.empty(len(keys), np.int64)
        back[order] = group
        size = sizes[back]
        return size, None if counting else self.ids[_ranges(starts[back], size)], s

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys in the memo, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        p = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        p[self.keys[p] != keys] = -1
        return p


def _within(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes - starts, sizes)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One encoder for each worker process; Spark reuses workers, so the memo serves many tasks."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


def drop() -> None:
    """Forget all encoders of this worker."""
    _ENCODERS.clear()


def fold_crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) & 0xFFFFFFFF
