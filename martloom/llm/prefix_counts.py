"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A sequence of tokens is what byte-pair merging makes of its text just if each two neighbours are what it makes of theirs. So
the encoding of a prefix ends in the one token that fits behind the encoding of the prefix before it, and its count is
that one's plus one. Two tables run along a word: tokens inside it, and, for a text that ends here, the token that closes
it. With the counts of all prefixes at hand, truncation and budget questions need no further encoding.

The vocabulary folds case, composes characters (NFC), parts text at white space, between letters, digits and other marks, and at English
contractions. All of it is followed character by character, so the counts hold for prefixes that end inside of any of these, too.
Words between ASCII white space are independent; their tables are kept and used again.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import coded_words, in_slices, packed

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048  # tokens
TEXT_BYTES = 1 << 22  # text worked on at once
CACHE_CHARS = 8_000_000  # characters of words whose tables a worker keeps
LONG_PIECE = 64  # bytes; longer pieces are read one by one, shorter ones together
ENDS = "</w>"
# The vocabulary's contractions, of one letter and of two.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others for those from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


_kind: dict[str, str] = {}


def _kind_of(char: str) -> str:
    """L letter, N number, S white space, O other."""
    if char not in _kind:
        if len(_kind) > 200_000:
            _kind.clear()
        category = unicodedata.category(char)
        space = category in ("Zs", "Zl", "Zp") or char in "\t\n\v\f\r\x85"
        _kind[char] = "S" if space else category[0] if category[0] in "LN" else "O"
    return _kind[char]


class _Piece:
    """A run of letters or of other marks so far: its symbols, and per prefix the last token and the number of tokens inside it."""

    __slots__ = ("kind", "text", "last", "count")

    def __init__(self, kind: str, text: str = "", last: list | None = None, count: list | None = None):
        self.kind, self.text = kind, text
        self.last, self.count = last or [None], count or [0]


class Vocabulary:
    """Merges of a tokenizer file and the tables that follow from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            have = json.load(file)
        model = have["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self._inside = {t for t in model["vocab"] if not t.endswith(ENDS)}
        self._closing = {t[: -len(ENDS)] for t in model["vocab"] if t.endswith(ENDS)}
        self.widest = max(map(len, [*self._inside, *self._closing]))
        self.special = sorted((t["content"] for t in have["added_tokens"]), key=len, reverse=True)
        self._symbols = _byte_symbols()
        made = {a + b: k for (a, b), k in reversed(self._rank.items())}
        if any(k < max(made.get(a, -1), made.get(b, -1)) for (a, b), k in self._rank.items()):
            raise ValueError("a merge ranks before its parts")
        self._edges: dict[tuple[str, bool, bool], list[tuple[str, int]] | None] = {}
        self._trie()

    def merged(self, symbols: list[str]) -> list[str]:
        """What byte-pair merging makes of the symbols: the pair of lowest rank, leftmost first, until none is left."""
        rank = self._rank
        while len(symbols) > 1:
            ranks = [rank.get(p, len(rank)) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == len(rank):
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _edge(self, token: str, closing: bool, left: bool) -> list[tuple[str, int]] | None:
        """The symbols at one end of a token while merging builds it, each with the rank of the merge that takes it in; None if merging does
        not make this token of its symbols."""
        key = token, closing, left
        if key not in self._edges:
            symbols = list(token)
            if closing:
                symbols[-1] += ENDS
            out, rank, none = [], self._rank, len(self._rank)
            while len(symbols) > 1:
                ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:])]
                best = min(ranks)
                if best == none:
                    break
                at = ranks.index(best)
                if at == (0 if left else len(symbols) - 2):
                    out.append((symbols[0 if left else -1], best))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            out.append((symbols[0 if left else -1], none))
            self._edges[key] = out if len(symbols) == 1 else None
        return self._edges[key]

    def fits(self, before: str | None, token: str, closing: bool) -> bool:
        """Whether merging leaves the two tokens side by side (or the first token alone) as they are.

        Both are built as if alone unless a merge across the gap comes first. Merges come by rank, since a merge ranks behind those
        that make its parts, and leftmost first among equals.
        """
        ours = self._edge(token, closing, True)
        if before is None or ours is None:
            return ours is not None
        theirs = self._edge(before, False, False)
        if theirs is None:
            return False
        rank, none, i, j = self._rank, len(self._rank), 0, 0
        while True:
            (a, up), (b, down) = theirs[i], ours[j]
            across = rank.get((a, b), none)
            if across < up and across <= down and across < none:
                return False
            if up == down == none:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def _trie(self) -> None:
        """Tokens by their bytes from the last to the first: steps, and the numbers of the tokens that end there."""
        value = {c: b for b, c in enumerate(self._symbols)}
        steps: dict[int, int] = {}
        inside, closing = [-1], [-1]
        self._tokens: list[str] = []
        for ends, tokens in ((inside, self._inside), (closing, self._closing)):
            for token in sorted(tokens):
                if any(c not in value for c in token):
                    continue  # control tokens
                node = 0
                for c in reversed(token):
                    step = node << 8 | value[c]
                    node = steps.setdefault(step, len(steps) + 1)
                    if node == len(inside):
                        inside.append(-1)
                        closing.append(-1)
                ends[node] = len(self._tokens)
                self._tokens.append(token)
        self._step_keys, self._step_nodes = (np.array(x, np.int64) for x in zip(*sorted(steps.items())))
        self._ends = np.array(inside, np.int64), np.array(closing, np.int64)
        self._pair_keys, self._pair_fits = np.array([-1], np.int64), np.zeros(1, bool)

    def _pairs_fit(self, before: np.ndarray, token: np.ndarray, closing: bool) -> np.ndarray:
        """``fits`` for many pairs of token numbers; number ``len(self._tokens)`` stands for no token."""
        keys = before * (len(self._tokens) + 1) + token
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        unknown = np.unique(keys[self._pair_keys[at] != keys])
        if len(unknown):
            names = [*self._tokens, None]
            told = [self.fits(names[k // len(names)], names[k % len(names)], closing) for k in unknown.tolist()]
            where = np.searchsorted(self._pair_keys, unknown)
            self._pair_keys, self._pair_fits = np.insert(self._pair_keys, where, unknown), np.insert(self._pair_fits, where, told)
            at = np.searchsorted(self._pair_keys, keys)
        return self._pair_fits[at]

    def closed_counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece if it ended after its first, second, … character, one piece after the other, and the pieces' characters. The
        pieces come longest first, and the tables of all of them grow together, column by column."""
        sizes = np.array(list(map(len, pieces)), np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begins = sizes.cumsum() - sizes
        tables = begins + np.arange(len(pieces))  # each table has a column for the empty prefix too
        last, count = np.full(len(data) + len(pieces), -1, np.int64), np.zeros(len(data) + len(pieces), np.int64)
        closed = np.zeros_like(count)
        last[tables] = len(self._tokens)
        for k in range(1, int(sizes.max(initial=0)) + 1):
            rows = np.arange(int(np.searchsorted(-sizes, -k, side="right")))
            node = np.zeros(len(rows), np.int64)
            for wide in range(1, min(k, self.widest) + 1):
                step = node << 8 | data[begins[rows] + k - wide]
                at = np.minimum(np.searchsorted(self._step_keys, step), len(self._step_keys) - 1)
                on = self._step_keys[at] == step
                rows, node = rows[on], self._step_nodes[at[on]]
                if not len(rows):
                    break
                here, back = tables[rows] + k, tables[rows] + k - wide
                for ends, closing, open_ in ((self._ends[0], False, last[here] < 0), (self._ends[1], True, closed[here] == 0)):
                    token = ends[node]
                    some = np.flatnonzero((token >= 0) & open_)
                    some = some[self._pairs_fit(last[back[some]], token[some], closing)]
                    if closing:
                        closed[here[some]] = count[back[some]] + 1
                    else:
                        last[here[some]], count[here[some]] = token[some], count[back[some]] + 1
                on = (last[here] < 0) | (closed[here] == 0)
                rows, node = rows[on], node[on]
        whole = np.r_[data[1:] & 0xC0 != 0x80, np.ones(min(len(data), 1), bool)]  # bytes that end a character
        chars = np.diff(np.r_[0, whole.cumsum()][np.r_[0, sizes.cumsum()]])
        return closed[np.arange(len(data)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)][whole], chars

    def grow(self, piece: _Piece, char: str) -> None:
        """Adds a character's symbols to the piece, and a column to its tables for each."""
        for byte in char.encode("utf-8", "surrogatepass"):
            piece.text += self._symbols[byte]
            text, last, count = piece.text, piece.last, piece.count
            n = len(text)
            for k in range(max(0, n - self.widest), n):
                token = text[k:]
                if token in self._inside and (k == 0 or last[k] is not None) and self.fits(last[k], token, False):
                    last.append(token)
                    count.append(count[k] + 1)
                    break
            else:
                raise ValueError("a prefix without an encoding")

    def closed(self, piece: _Piece) -> int:
        """Tokens of the piece if it ends here."""
        text, last, n = piece.text, piece.last, len(piece.text)
        for k in range(max(0, n - self.widest), n):
            token = text[k:]
            if token in self._closing and (k == 0 or last[k] is not None) and self.fits(last[k], token, True):
                return piece.count[k] + 1
        raise ValueError("a prefix without an encoding")

    def alone(self, text: str) -> int:
        piece = _Piece("O")
        for c in text:
            self.grow(piece, c)
        return self.closed(piece)


class _Reader:
    """Follows normalised text character by character; ``now`` is the number of tokens of what was read."""

    def __init__(self, vocabulary: Vocabulary, start: int = 0):
        self._v, self.done, self.now = vocabulary, start, start
        self._piece: _Piece | None = None
        self._quote: str | None = None  # an apostrophe that began a piece, with the first letter of a two-letter contraction behind it
        self._base = 0

    def fork(self) -> _Reader:
        """A copy to go on with for a few characters; it shares what is long."""
        new = _Reader(self._v, self.done)
        new.now, new._quote, new._base = self.now, self._quote, self._base
        if p := self._piece:
            wide = self._v.widest
            cut = max(0, len(p.text) - wide)
            new._piece = _Piece(p.kind, p.text[cut:], p.last[cut:], p.count[cut:])
        return new

    def read(self, char: str) -> int:
        kind, quote = _kind_of(char), self._quote
        self._quote = None
        if quote == "'":
            if char in SHORT:
                return self._whole("'" + char)
            if any(x[0] == char for x in LONG):
                self._quote = "'" + char
        elif quote and quote[1] + char in LONG:
            return self._whole(quote + char)
        if kind == "S":
            self.done, self._piece = self.now, None
        elif kind == "N":
            self.now = self.done = self.now + self._v.alone(char)
            self._piece = None
        else:
            if self._piece is None or self._piece.kind != kind:
                self.done = self.now
                self._piece = _Piece(kind)
                if char == "'":
                    self._quote, self._base = "'", self.done
            self._v.grow(self._piece, char)
            self.now = self.done + self._v.closed(self._piece)
        return self.now

    def _whole(self, contraction: str) -> int:
        self.now = self.done = self._base + self._v.alone(contraction)
        self._piece = None
        return self.now


_seconds: set[str] = set()


def _joins(char: str) -> bool:
    """Whether composition may join a character to what stands before it."""
    if not _seconds:
        for k in range(128, sys.maxunicode + 1):
            parts = unicodedata.decomposition(chr(k))
            if parts and parts[0] != "<":
                _seconds.update(chr(int(x, 16)) for x in parts.split()[1:])
        _seconds.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # vowels and finals of Hangul
    return unicodedata.combining(char) > 0 or char in _seconds


def _folded(text: str) -> str:
    return "".join(c.lower() for c in unicodedata.normalize("NFC", text))


def word_counts(v: Vocabulary, word: str) -> list[int]:
    """Tokens of the first 1, 2, … characters of a word without ASCII white space."""
    start, total, out = 0, 0, []
    while True:
        # Control tokens stand for themselves once they are whole; up to there their characters are ordinary.
        found = min(((at, s) for s in v.special if (at := word.find(s, start)) >= 0), key=lambda f: f[0], default=None)
        end = found[0] + len(found[1]) if found else len(word)
        out += _plain_counts(v, word[start:end], total)
        if not found:
            return out
        before = out[found[0] - 1] if found[0] > start else total
        total = out[-1] = before + 1
        start = end


def _plain_counts(v: Vocabulary, text: str, start: int) -> list[int]:
    reader, out = _Reader(v, start), []
    if text.isascii():
        return [reader.read(c) for c in text.lower()]
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and _joins(text[end]):
            end += 1
        for k in range(at + 1, end):
            other = reader.fork()
            for c in _folded(text[at:k]):
                other.read(c)
            out.append(other.now)
        for c in _folded(text[at:end]):
            reader.read(c)
        out.append(reader.now)
        at = end
    return out


# What a simple word falls apart into. Apostrophes and control tokens are left to the reader.
_PIECES = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _simple(word: str) -> list[str] | None:
    """The pieces of a word whose characters keep their places when it is folded, else None."""
    if "'" in word or "<|" in word or len(word) > LONG_PIECE // 4 and len(word.encode("utf-8", "surrogatepass")) > LONG_PIECE:
        return None
    low = word.lower()
    if not word.isascii() and (len(low) != len(word) or "\u03a3" in word or not unicodedata.is_normalized("NFC", word)):
        return None
    pieces = _PIECES.findall(low)
    return pieces if sum(map(len, pieces)) == len(word) else None


class _Pool:
    """Tables of different lengths, found by number."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes, self.totals = (np.zeros(0, np.int32) for _ in range(4))

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Tables, none of them empty, one after the other."""
        ends = sizes.cumsum()
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes]).astype(np.int32)
        self.sizes = np.concatenate([self.sizes, sizes]).astype(np.int32)
        self.totals = np.concatenate([self.totals, flat[ends - 1]]).astype(np.int32)
        self.flat = np.concatenate([self.flat, flat]).astype(np.int32)

    def joined(self, numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The tables of ``numbers`` one after the other, each raised by the count before it."""
        sizes = self.sizes[numbers].astype(np.int64)
        within = np.arange(int(sizes.sum())) - np.repeat(sizes.cumsum() - sizes - self.starts[numbers], sizes)
        return self.flat[within] + np.repeat(before, sizes)


class Counter:
    """Tables of whole texts; those of words and of their pieces are kept, and all dropped together once they are too many."""

    def __init__(self, path: str):
        self._v = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        self._piece: dict[str, int] = {}
        self._words, self._pieces = _Pool(), _Pool()

    def _learn_pieces(self, pieces: list[str]) -> None:
        raw = sorted(((p.encode("utf-8", "surrogatepass"), p) for p in pieces), key=lambda x: -len(x[0]))
        have = len(self._pieces.sizes)
        self._pieces.add(*self._v.closed_counts([r for r, _ in raw]))
        self._piece.update((p, have + k) for k, (_, p) in enumerate(raw))

    def _learn(self, new: list[bytes]) -> None:
        known, simple, parted, other = self._piece, [], [], []
        for w in new:
            text = w.decode("utf-8", "surrogatepass")
            if pieces := _simple(text):
                simple.append(w)
                parted.append(pieces)
            else:
                other.append((w, text))
        if fresh := {p for pieces in parted for p in pieces if p not in known}:
            self._learn_pieces(list(fresh))
        flat = np.array([known[p] for pieces in parted for p in pieces], np.int64)
        many = np.array(list(map(len, parted)), np.int64)
        ends = many.cumsum()
        sums = np.r_[0, self._pieces.totals[flat].cumsum()]
        counts = self._pieces.joined(flat, sums[:-1] - np.repeat(sums[ends - many], many))
        chars = np.diff(np.r_[0, self._pieces.sizes[flat].cumsum()][np.r_[0, ends]])
        tables = [word_counts(self._v, text) for _, text in other]
        have = len(self._words.sizes)
        self._words.add(np.concatenate([counts, *tables]).astype(np.int64), np.concatenate([chars, np.array(list(map(len, tables)), np.int64)]))
        self._number.update((w, have + k) for k, w in enumerate([*simple, *(w for w, _ in other)]))

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its counts after 0, 1, 2, … characters."""
        whole = "\n".join([*texts, ""])
        placed, words = coded_words(whole.encode("utf-8", "surrogatepass"))
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.r_[False, (chars != 32) & ((chars < 9) | (chars > 13)), False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        if len(self._words.flat) > CACHE_CHARS:
            self._forget()
        if new := [w for w in words if w not in self._number]:
            self._learn(new)
        number = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))[placed]
        sums = np.r_[0, self._words.totals[number].cumsum()]
        # After each character: the words before it, and its own word's table.
        out = np.zeros(len(chars) + 1, np.int64)
        out[1:] = sums[np.cumsum(np.bincount(ends, minlength=len(chars) + 1)[: len(chars)])]
        sizes = ends - begins
        places = np.arange(int(sizes.sum())) + np.repeat(begins - sizes.cumsum() + sizes, sizes)
        out[1 + places] = self._words.joined(number, sums[:-1])
        stops = np.cumsum([len(t) + 1 for t in texts])
        return [out[b : e] - out[b] for b, e in zip(np.r_[0, stops[:-1]].tolist(), stops.tolist())] if texts else []


def counter(path: str) -> Counter:
    """One per Python worker, kept between tasks in a module of its own: functions sent by value have no lasting globals."""
    kept = sys.modules.setdefault("martloom_worker_state", types.ModuleType("martloom_worker_state"))
    have = vars(kept).setdefault("counters", {})
    if path not in have:
        have[path] = Counter(path)
    return have[path]


class Prefixes:
    """Reads one stored table."""

    def __init__(self, stored: bytes):
        self.counts = np.cumsum(np.frombuffer(zlib.decompress(stored), "<i2"), dtype=np.int64)

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        return int(self.counts[chars])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        return longest(self.counts, budget)


def longest(counts: np.ndarray, budget: int) -> int:
    """A longer prefix may have fewer tokens, so the last place within the budget counts."""
    return int(np.flatnonzero(counts <= max(budget, 0))[-1])


def stored(counts: np.ndarray) -> bytes:
    """Steps from one prefix to the next, compressed. A step is the tokens of a few characters at most."""
    return zlib.compress(np.diff(counts, prepend=0).astype("<i2").tobytes(), 1)


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "surrogatepass") for t in column.cast(pa.binary()).to_pylist()]


def _rows(path: str, limit: int, keep: bool):
    schema = TABLES if keep else REPORT

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for few in in_slices(batches, TEXT_BYTES):
            texts = _texts(few.column(1))
            tables = count.tables(texts)
            totals = [int(t[-1]) for t in tables]
            if keep:
                columns = (few.column(0), [len(t) for t in texts], totals, list(map(stored, tables)))
            else:
                fit = [len(t) if n <= limit else longest(c, limit) for t, c, n in zip(texts, tables, totals)]
                columns = (few.column(0), [len(t.encode("utf-8", "surrogatepass")) for t in texts], totals, [n > limit for n in totals], fit)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return build


TABLES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("prefixes", pa.binary())])
REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fitting_chars", pa.int64())])


def _pairs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row ``doc_id``, ``n_chars``, ``n_tokens`` and ``prefixes``, the counts of all prefixes for :class:`Prefixes`.

    Null texts are empty and have the one count 0. Rows are counted one by one, repeated rows as often as they stand, and nothing is shuffled.
    Memory is that of a slice of texts, or of one longer text, and of kept word tables, which are bounded.
    """
    return _pairs(docs).mapInArrow(_rows(path or tokenizer_path(), 0, True), "doc_id long, n_chars long, n_tokens long, prefixes binary")


def report(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Per row ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fitting_chars``, the characters of the longest prefix within the limit. Rows as
    in :func:`prefix_tables`."""
    return _pairs(docs).mapInArrow(_rows(path or tokenizer_path(), limit, False), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def truncated(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``docs`` in its own columns, each text cut to its longest prefix of at most ``limit`` tokens; null texts stay null."""
    where = path or tokenizer_path()

    def cut(batches):
        count = counter(where)
        for batch in batches:
            texts = _texts(batch.column(0))
            fit = []
            for few in in_slices([pa.record_batch([batch.column(0)], names=["t"])], TEXT_BYTES, 0):
                fit += [longest(c, limit) for c in count.tables(_texts(few.column(0)))]
            kept = [None if v is None else t[:n] for v, t, n in zip(batch.column(0).is_valid().to_pylist(), texts, fit)]
            at = batch.schema.get_field_index("__row")
            yield pa.record_batch([pa.array(kept, pa.string()), batch.column(at)], schema=pa.schema([("__cut", pa.string()), batch.schema.field(at)]))

    rows = packed(docs, F.col("text").cast("string").alias("__cut")).select("__cut", "__row")
    done = rows.mapInArrow(cut, rows.schema)
    return done.withColumn("__row", F.col("__row").withField("text", F.when(F.col("__row.text").isNotNull(), F.col("__cut")))).select("__row.*")
