"""Secret scan: fixed patterns, plus credential-context values that would be costly to guess.

A value beside a credential word is cut into the segments that an attacker would guess most cheaply (words, dates,
repeats, keyboard walks, single characters by brute force). The cheapest cut over all segmentations, found by dynamic
programming, is the value's guess cost; costly values are machine-made and reported as ``guess`` spans. Words are guessed by
their rank: in a short list of usual passwords, or by how often all texts have them outside such values. A word that is one in f of all words
has fewer than f words before it, so f stands for its rank.

Texts are read twice. The first reading finds the base spans and the values; the second counts those words only that occur in some
value. Values are then costed once each, with the counts of their own words, and joined back to where they stand.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import coded_words, in_slices, row_key, written

# The kinds in their order, and the patterns of the base scan.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# Words that make what follows a credential, looked for in the lower-cased text before any pattern runs.
CONTEXT_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "credential", "authorization", "bearer")
CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|bearer)"
    r"[\"']?(?:\x20*(?:=>|:=|[:=])\x20*(?:([\"'`])((?:(?!\1)[\x20-~]){8,})\1|[\"'`]?([!-~]{8,}))|(?:\x20+is)?\x20+[\"'`]?([!-~]{8,}))", re.IGNORECASE | re.ASCII,
)
GUESS_AT = 7.5  # log10 of the guesses from which a value counts as a secret: eight random characters cost 8, less a short chance word

# Guessable words, commonest first; a word's guesses are its place in this list.
WORDS = {w: k for k, w in enumerate((
    "password", "secret", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "hello", "freedom", "whatever",
    "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "trust", "access", "love", "summer", "winter",
    "spring", "autumn", "change", "changeme", "default", "example", "sample", "test", "testing", "demo", "guest", "user", "root",
    "server", "system", "public", "private", "token", "value", "string", "your", "here", "none", "null", "true", "false", "my",
    "the", "key", "pass", "word", "account", "service", "client", "api", "placeholder", "insert", "enter", "undefined", "redacted",
    "hunter",
), 1)}
LONGEST_WORD = 24
LEAST_LETTERS, LEAST_COUNT = 4, 3  # of a word from the texts; shorter ones turn up in random values
SLOTS, MOST_SLOTS = 1 << 20, 1 << 27  # of the bitmap of values' words: as many as keep it sparse, at the least and at the most
SPARSE = 32  # slots for a piece, so that about one other word in 32 is let through whatever the number of pieces
TEXT_BYTES = 1 << 22  # text read at once
LEET = str.maketrans("01345$@7", "oleassat")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d")


def _segments(value: str, words: dict[str, int] = WORDS) -> list[list[tuple[int, float]]]:
    """For each start, the ends and costs (log10 of guesses) of the cheap segments that begin there."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for end in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            for text, extra in ((low, 0.0), (plain, math.log10(4))):
                if (rank := words.get(text[i:end])) is not None:
                    cost = math.log10(rank + 1) + extra + (0.0 if value[i:end].islower() else math.log10(4))
                    out[i].append((end, cost))
        if (m := DATE.match(value, i)):
            out[i].append((m.end(), math.log10(130) if m.end() - i == 4 else math.log10(130 * 365 * 4)))
    i = 0
    while i < n - 1:  # keyboard and alphabet walks
        j = i
        while j < n - 1 and (low[j], low[j + 1]) in _NEXT:
            j += 1
        if j - i >= 3:
            for a in range(i, j - 2):
                out[a].append((j + 1, math.log10(50) + math.log10(j + 1 - a)))
        i = max(j, i + 1)
    for size in range(1, 5):  # the same one to four characters again and again
        i = 0
        while i + size < n:
            j = i + size
            while j < n and value[j] == value[j - size]:
                j += 1
            times = (j - i) // size
            if times >= 3 or (times >= 2 and size >= 3):
                out[i].append((i + times * size, size * BRUTE + math.log10(times)))
            i = max(j - size + 1, i + 1)
    return out


BRUTE = 1.0  # log10 of guesses for one character by brute force


def guess_cost(value: str, words: dict[str, int] = WORDS) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; 0 for an empty value."""
    n, cheap = len(value), _segments(value, words)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + BRUTE)
        for end, cost in cheap[i]:
            best[end] = min(best[end], best[i] + cost)
    return best[n]


_HEX_MARK = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the credential-context values of a text. A value goes to its closing quote where it is assigned in quotes, spaces
    included, and to the next space otherwise."""
    out = []
    for m in CONTEXT.finditer(text):
        k = next(i for i in (2, 3, 4) if m[i] is not None)
        value = m[k] if k == 2 else m[k].rstrip("\"'`,;.)")
        out.append((m.start(k), m.start(k) + len(value), value))
    return out


def searched(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans (start, kind, end) in order, and the values to be costed, of a whole text; null is empty.

    The searches for fixed bytes only spare the patterns texts in which they cannot match.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found, guessed = [], []
    if _has_context(raw):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        guessed = values(text)
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found), guessed


def _has_context(raw: bytes) -> bool:
    low = raw.lower()
    return any(w.encode() in low for w in CONTEXT_WORDS)


def spans(text: str | None, guess_at: float = GUESS_AT, words: dict[str, int] = WORDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind in its order; null and empty texts have none."""
    found, guessed = searched(text)
    found += [(start, 3, end) for start, end, value in guessed if guess_cost(value, words) >= guess_at]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


_LETTERS = re.compile(r"[a-z]+")


def words_in(value: str) -> set[str]:
    """What a segmentation of the value could take for a word of the texts: its stretches of letters, also with digits and marks read as letters."""
    low = value.lower()
    out = set()
    for text in {low, low.translate(LEET)}:
        for m in _LETTERS.finditer(text):
            run = m[0]
            out |= {run[i : i + n] for n in range(LEAST_LETTERS, min(len(run), LONGEST_WORD) + 1) for i in range(len(run) - n + 1)}
    return out


def ranks(counts: dict[str, int], total: int) -> dict[str, int]:
    """Guesses for words: the short list's places, or, if fewer, the number of words of which the texts have one of this."""
    found = {w: max(1, total // n) for w, n in counts.items() if n >= LEAST_COUNT}
    return {w: min(WORDS.get(w, total), found.get(w, total)) for w in {**WORDS, **found}}


# Bytes of words; a word is a run of them that has letters only.
_WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_/+=" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def slots_for(pieces: int) -> int:
    """The bitmap's size, a power of two."""
    return min(MOST_SLOTS, max(SLOTS, 1 << (SPARSE * pieces - 1).bit_length() if pieces else 0))


def lets_through(wanted: np.ndarray, word: bytes) -> bool:
    """Whether the packed bitmap has the word's checksum."""
    slot = zlib.crc32(word) % (8 * len(wanted))
    return bool(wanted[slot >> 3] >> (slot & 7) & 1)


def counted(raws: list[bytes], wanted: np.ndarray | None = None) -> tuple[dict[str, int], int]:
    """How often texts have the words that ``wanted``, a packed bitmap of checksums, lets through, and how many words there are. Values are left out."""
    plain = []
    for raw in raws:
        if _has_context(raw):
            raw = CONTEXT.sub(" ", raw.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
        plain.append(raw.translate(_WORD_BYTES))
    placed, words = coded_words(b" ".join(plain))
    times = np.bincount(placed, minlength=len(words)).tolist()
    whole = [(w, n) for w, n in zip(words, times) if LEAST_LETTERS <= len(w) <= LONGEST_WORD and w.isalpha()]
    return {w.decode(): n for w, n in whole if wanted is None or lets_through(wanted, w)}, sum(n for _, n in whole)


FOUND = "base array<struct<start: int, kind: int, stop: int>>, base_sha256 string, guessed array<struct<start: int, stop: int, value: string>>"


def _searched(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, guessed = searched(text)
        digest = hashlib.sha256(joined([(a, b, KINDS[k]) for a, k, b in base]).encode()).hexdigest()
        rows.append(([dict(zip(("start", "kind", "stop"), s)) for s in base], digest, [dict(zip(("start", "stop", "value"), g)) for g in guessed]))
    return pd.DataFrame(rows, columns=["base", "base_sha256", "guessed"])


def _bitmap(pieces: DataFrame) -> np.ndarray:
    """Which checksums the pieces have, packed. A number for 64 slots each comes to the driver, at most 16 MB of them.

    Its size follows the number of pieces: in a bitmap of one size more and more words that are in no value would pass as the pieces grow.
    """
    size = slots_for(pieces.count())
    slot = F.crc32(F.col("piece").cast("binary")) % size
    words = pieces.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():
        bits[r["word"]] = r["bits"]
    return bits.astype("<i8").view(np.uint8)


def word_counts(docs: DataFrame, pieces: DataFrame) -> tuple[DataFrame, int]:
    """(``piece``, ``n``) for the pieces that are words of the texts, credential values left out, and the number of all such words."""
    wanted = _bitmap(pieces)
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(batches, TEXT_BYTES, 0):
            found, total = counted([t or b"" for t in few.column(0).cast(pa.binary()).to_pylist()], wanted)
            yield pa.record_batch([pa.array([None, *found], pa.string()), pa.array([total, *found.values()], pa.int64())], schema=schema)

    rows = written(docs.select(F.col("text").cast("string")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    total = rows.filter("piece is null").first()
    return rows.join(pieces, "piece", "left_semi").filter(F.col("n") >= LEAST_COUNT), total["n"] if total else 0


def _costs(docs: DataFrame, guessed: DataFrame) -> DataFrame:
    """(``value``, ``cost``), each value once, by its own words' counts."""
    known = written(guessed.select("value").distinct())
    pieces = F.pandas_udf(lambda v: v.map(lambda x: sorted(words_in(x))), "array<string>")
    parts = written(known.select("value", F.explode(pieces("value")).alias("piece")))
    counts, total = word_counts(docs, parts.select("piece").distinct())
    own = parts.join(counts, "piece").groupBy("value").agg(F.collect_list(F.struct("piece", "n")).alias("__words"))

    def cost(values: pd.Series, words: pd.Series) -> pd.Series:
        listed = [{} if w is None else {x["piece"]: int(x["n"]) for x in w} for w in words]
        return pd.Series([guess_cost(v, ranks(c, total)) for v, c in zip(values, listed)], dtype=float)

    cost.__annotations__ = {"values": pd.Series, "words": pd.Series, "return": pd.Series}
    return known.join(own, "value", "left").select("value", F.pandas_udf(cost, "double")("value", "__words").alias("cost"))


def scanned(docs: DataFrame, guess_at: float = GUESS_AT) -> DataFrame:
    """``doc_id`` and what its whole text holds, one row per row: counts by kind, the digest of the base spans, and all ``spans``.

    Null and empty texts hold nothing; equal rows get equal results. A value's cost depends on how common its words are in all texts, not on where it stands.
    """
    keys = ["__h1", "__h2"]
    part = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(part.select("doc_id", *row_key(part), F.pandas_udf(_searched, FOUND)("text").alias("__f")).select("doc_id", *keys, "__f.*"))
    guessed = rows.select(*keys, F.explode("guessed").alias("__g")).select(*keys, "__g.*").distinct()
    costly = _costs(part, guessed).filter(F.col("cost") >= guess_at).select("value")
    more = guessed.join(costly, "value").groupBy(*keys).agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("__more"))
    whole = rows.join(more, keys, "left")
    every = F.array_sort(F.concat("base", F.coalesce("__more", F.array().cast("array<struct<start: int, kind: int, stop: int>>"))))
    names = F.array(*map(F.lit, KINDS))
    many = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    shown = F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]))
    guesses = F.coalesce(F.size("__more"), F.lit(0)).cast("long").alias("n_guess")
    return whole.select("doc_id", many(0), many(1), many(2), guesses, "base_sha256", F.array_join(shown, ",").alias("spans"))
