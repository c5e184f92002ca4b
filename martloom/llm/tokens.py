"""Token ids in wavelet matrices, one per shard.

A shard holds the ids of consecutive documents as 16 bit-planes. Each plane lists one bit of every id, after the ids
were parted by their higher bits; planes are cut into blocks that are compressed one by one, with the number
of ones before each block beside them. Any id, the count of an id before a place, and the place of an id's k-th
occurrence are found from the shard alone, unpacking a block per plane.

Shards are rows of a Parquet table (``part``, ``shard``, ``n_docs``, ``n_tokens``, ``payload``), which any store that Spark
can write to holds; each ``payload`` is one self-contained compressed file.
"""

from __future__ import annotations

import struct
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martloom.llm.common import given_back, in_slices, written

MAGIC = b"WMT1"
PLANES = 16
BLOCK = 1 << 15  # bits of a plane compressed together
SHARD_TOKENS = 1 << 21  # a shard is closed by the document that reaches this
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _deflated(raw: bytes) -> bytes:
    """Bits of a plane hold runs but hardly any other repeats, whose search takes most of the time."""
    squeeze = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return squeeze.compress(raw) + squeeze.flush()


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The payload of one shard. ``ids`` are below 65536 and hold the documents one after the other."""
    ids = ids.astype(np.uint16)
    zeros, planes = [], []
    for bit in range(PLANES - 1, -1, -1):
        if bit == 7:
            ids = ids.astype(np.uint8)  # only the lower half still counts
        ones = ids & ids.dtype.type(1 << bit) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        zeros.append(len(ids) - int(ones.sum()))
        ids = np.concatenate([ids.compress(~ones), ids.compress(ones)])
    head = struct.pack("<4sQI", MAGIC, len(ids), len(doc_ids))
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    table = zlib.compress(names + np.array(lengths, "<u4").tobytes(), 1)
    parts = [head, struct.pack("<I", len(table)), table, np.array(zeros, "<u8").tobytes()]
    body, ends, ranks, at = [], [], [], 0
    for plane in planes:
        seen = 0
        for start in range(0, max(len(plane), 1), BLOCK // 8):
            block = plane[start : start + BLOCK // 8]
            small = _deflated(block.tobytes())
            ranks.append(seen)
            seen += int(np.bitwise_count(block).sum())
            body.append(small)
            at += len(small)
            ends.append(at)
    return b"".join([*parts, np.array(ends, "<u8").tobytes(), np.array(ranks, "<u4").tobytes(), *body])


class Shard:
    """Reads one payload; nothing is unpacked before it is asked for."""

    def __init__(self, payload: bytes):
        magic, self.n_tokens, n_docs = struct.unpack_from("<4sQI", payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sQI")
        (size,) = struct.unpack_from("<I", payload, at)
        table = zlib.decompress(payload[at + 4 : at + 4 + size])
        at += 4 + size
        ids, nulls = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [None if none else int(d) for d, none in zip(ids, nulls)]
        self.lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        self._zeros = np.frombuffer(payload, "<u8", PLANES, at).astype(np.int64)
        at += 8 * PLANES
        self._blocks = max(1, -(-(-(-self.n_tokens // 8)) // (BLOCK // 8)))
        many = PLANES * self._blocks
        self._ends = np.frombuffer(payload, "<u8", many, at).astype(np.int64)
        self._ranks = np.frombuffer(payload, "<u4", many, at + 8 * many).astype(np.int64)
        self._body, self._payload = at + 12 * many, payload
        self._open: dict[int, np.ndarray] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        k = plane * self._blocks + block
        if k not in self._open:
            start = self._body + (int(self._ends[k - 1]) if k else 0)
            raw = zlib.decompress(self._payload[start : self._body + int(self._ends[k])])
            self._open[k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._open[k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._bits(plane, i // BLOCK)[i % BLOCK])

    def _rank(self, plane: int, bit: int, i: int) -> int:
        """How often ``bit`` occurs before place ``i`` of a plane."""
        if i == 0:
            return 0
        block = min(i // BLOCK, self._blocks - 1)
        ones = int(self._ranks[plane * self._blocks + block]) + int(self._bits(plane, block)[: i - block * BLOCK].sum(dtype=np.int64))
        return ones if bit else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        token = 0
        for plane in range(PLANES):
            bit = self._bit(plane, i)
            token = token << 1 | bit
            i = self._rank(plane, bit, i) + (int(self._zeros[plane]) if bit else 0)
        return token

    def count(self, token: int, before: int | None = None) -> int:
        """Occurrences of ``token`` before a place (default: in the shard)."""
        return self._narrow(token, before)[1]

    def _narrow(self, token: int, before: int | None) -> tuple[int, int]:
        low, high = 0, self.n_tokens if before is None else before
        for plane in range(PLANES):
            bit = token >> (PLANES - 1 - plane) & 1
            shift = int(self._zeros[plane]) if bit else 0
            low, high = self._rank(plane, bit, low) + shift, self._rank(plane, bit, high) + shift
        return low, high - low

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence of ``token``, from 0."""
        low, many = self._narrow(token, None)
        if not 0 <= k < many:
            raise IndexError(k)
        i = low + k
        for plane in range(PLANES - 1, -1, -1):
            bit = token >> (PLANES - 1 - plane) & 1
            want = i - int(self._zeros[plane]) if bit else i
            left, right = 0, self.n_tokens  # the first place after which ``bit`` has occurred want + 1 times
            while left < right:
                middle = (left + right) // 2
                if self._rank(plane, bit, middle + 1) > want:
                    right = middle
                else:
                    left = middle + 1
            i = left
        return i

    def ids(self) -> np.ndarray:
        """All ids, planes undone from the last to the first."""
        out = np.zeros(self.n_tokens, np.uint8)
        for plane in range(PLANES - 1, -1, -1):
            if plane == PLANES - 9:
                out = out.astype(np.uint16)
            raw = [self._payload[self._body + (int(self._ends[k - 1]) if k else 0) : self._body + int(self._ends[k])] for k in range(plane * self._blocks, (plane + 1) * self._blocks)]
            flat = np.frombuffer(b"".join(map(zlib.decompress, raw)), np.uint8)
            ones = np.unpackbits(flat, bitorder="little")[: self.n_tokens].view(bool)
            before, z = np.empty_like(out), int(self._zeros[plane])
            # Places rather than masks: these are several times faster where ones and zeros alternate.
            before[np.flatnonzero(~ones)] = out[:z]
            before[np.flatnonzero(ones)] = out[z:] | out.dtype.type(1 << (PLANES - 1 - plane))
            out = before
        return out


# Letters that end with an ASCII one, then ASCII marks: the vocabulary's pattern always parts a word there.
_LETTERS, _MARKS = "^[A-Za-z\\x{80}-\\x{10FFFF}]*[A-Za-z]$", ".,!?;:%*#&$|"


def _listed(words: pa.Array) -> list[bytes]:
    """Strings as a list, cut from one buffer, which is several times faster than a conversion one by one."""
    words = words.cast(pa.binary())
    _, ends, raw = words.buffers()
    at = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).tolist() if len(words) else []
    whole = raw.to_pybytes() if raw else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class _Pool:
    """Id runs of variable length, found by number."""

    def __init__(self) -> None:
        self.starts, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint16)
        self.many = self.used = 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        def room(values: np.ndarray, need: int) -> np.ndarray:
            return values if need <= len(values) else np.r_[values, np.zeros(max(need - len(values), len(values)), values.dtype)]

        many, used = self.many + len(sizes), self.used + len(ids)
        self.starts, self.sizes, self.ids = room(self.starts, many), room(self.sizes, many), room(self.ids, used)
        self.starts[self.many : many] = self.used + sizes.cumsum() - sizes
        self.sizes[self.many : many] = sizes
        self.ids[self.used : used] = ids
        self.many, self.used = many, used

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the runs ``at``, one after the other."""
        sizes = self.sizes[at]
        ends = sizes.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        return sizes, self.ids[np.arange(total) + np.repeat(self.starts[at] - ends + sizes, sizes)]


class Encoder:
    """Ids of whole texts. Words stand apart at white space for this vocabulary, so the ids of a word are kept and used again, whatever the text.

    New words are taken apart further, into letters and the marks behind them, so that the tokenizer sees each piece of a batch once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # Small ASCII letters are what they are after the vocabulary's normalizer and pattern, which are spared for them.
        self._plain = Tokenizer(self._tokenizer.model)
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._tokenizer.get_vocab()
        if len(vocabulary) > 1 << PLANES:
            raise ValueError("ids do not fit the planes")
        self._ends_word = np.zeros(1 << PLANES, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._number: dict[bytes, int] = {}  # in the order of the numbers
        self._words, self._uses = _Pool(), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drops words that came in one batch only; of the others the most used stay, in half of the room."""
        uses = self._uses
        keep = np.flatnonzero(uses > 1)
        keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: CACHE_WORDS // 2]])
        words, names = _Pool(), list(self._number)
        words.add(*self._words.take(keep))
        self._number = {names[k]: i for i, k in enumerate(keep.tolist())}
        self._words, self._uses = words, np.ones(len(keep), np.int64)

    def _lines(self, tokenizer, texts: pa.Array, at: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts ``at``, 256 of them in a line."""
        offsets = pa.array(np.r_[0 : len(at) : 256, len(at)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(offsets, texts.take(pa.array(at))), " ").to_pylist()
        return [np.array(e.ids, np.uint16) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def _pieces(self, texts: pa.Array) -> _Pool:
        """The ids of distinct pieces."""
        # A piece of letters only gives one run of ids, closed by the one id that ends a word.
        small = pc.and_(pc.ascii_is_alpha(texts), pc.ascii_is_lower(texts)).to_numpy(zero_copy_only=False)
        letters = pc.ascii_is_alpha(texts).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~letters & ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False))
        named = [t.decode() for t in _listed(texts.take(pa.array(other)))]
        # Of all letters only the dotted capital I is none in lower case: it becomes two characters.
        letters[other] = np.array([t.isalpha() and "\u0130" not in t and unicodedata.is_normalized("NFC", t) for t in named], bool)
        lines, wide, rest = np.flatnonzero(small), np.flatnonzero(letters & ~small), np.flatnonzero(~letters)
        plain = np.r_[lines, wide]
        together = [*self._lines(self._plain, texts, lines), *self._lines(self._tokenizer, texts, wide)]
        alone = [np.array(e.ids, np.uint16) for e in self._tokenizer.encode_batch_fast(texts.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint16), *together])
        sizes = np.diff(np.flatnonzero(self._ends_word[flat]), prepend=-1)
        if len(sizes) != len(plain) or sizes.sum() != len(flat):
            raise ValueError("words did not come apart in the vocabulary's ids")
        found = _Pool()
        found.add(sizes, flat)
        found.add(np.array(list(map(len, alone)), np.int64), np.concatenate([np.zeros(0, np.uint16), *alone]))
        place = np.empty(len(texts), np.int64)
        place[np.r_[plain, rest]] = np.arange(len(texts))
        ordered = _Pool()
        ordered.add(*found.take(place))
        return ordered

    def _learn(self, new: list[bytes]) -> None:
        words = pa.array(new, pa.binary()).view(pa.string())
        # Only words that end in marks are parted.
        cut = pc.ascii_rtrim(words, characters=_MARKS)
        parted = pc.and_(pc.less(pc.binary_length(cut), pc.binary_length(words)), pc.match_substring_regex(cut, _LETTERS))
        ending = pc.filter(words, parted)
        letters = pc.if_else(parted, cut, words)
        marks = pc.replace_with_mask(pa.array([""], pa.string()).take(pa.array(np.zeros(len(words), np.int32))), parted, pc.replace_substring_regex(ending, "^.*[A-Za-z]", ""))
        # The vocabulary is lower-case, but for control tokens; other letters are left to it.
        simple = pc.and_not(pc.string_is_ascii(letters), pc.match_substring(letters, "<"))
        letters = pc.if_else(simple, pc.ascii_lower(letters), letters)
        coded = pa.concat_arrays([letters, marks]).dictionary_encode()
        sizes, ids = self._pieces(coded.dictionary).take(coded.indices.to_numpy().reshape(2, -1).T.ravel())
        have = self._words.many
        self._words.add(sizes[::2] + sizes[1::2], ids)
        self._number.update(zip(new, range(have, have + len(new))))
        self._uses = np.r_[self._uses, np.zeros(len(new), np.int64)]

    def encode(self, texts: pa.Array) -> tuple[list[int], np.ndarray]:
        """Lengths and ids of all texts, each closed by the end id."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = _listed(coded.dictionary)
        if len(self._number) > CACHE_WORDS:
            self._forget()
        number = np.fromiter(map(self._number.get, words, repeat(-1)), np.int64, len(words))
        if len(unknown := np.flatnonzero(number < 0)):
            number[unknown] = len(self._number) + np.arange(len(unknown))
            self._learn([words[k] for k in unknown.tolist()])
        self._uses[number] += 1
        sizes, ids = self._words.take(number[coded.indices.to_numpy()])
        ends = np.r_[0, sizes.cumsum()]
        offsets = split.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        return (np.diff(bounds) + 1).tolist(), np.insert(ids, bounds[1:], END_ID)


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks in a module of its own: functions sent by value have no lasting globals."""
    kept = sys.modules.setdefault("martloom_worker_state", types.ModuleType("martloom_worker_state"))
    have = vars(kept).setdefault("encoders", {})
    if path not in have:
        have[path] = Encoder(path)
    return have[path]


SHARDS = "part int, shard int, n_docs long, n_tokens long, payload binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
TEXT_BYTES = 1 << 23  # text encoded together


def _written_shards(path: str, limit: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        encode = encoder(path).encode
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal shard
            ids = np.concatenate(held)
            row = pa.record_batch([pa.array([v], t) for v, t in zip((part, shard, len(names), len(ids), pack(names, sizes, ids)), _SHARDS.types)], schema=_SHARDS)
            shard += 1
            names.clear(), sizes.clear(), held.clear()
            return row

        for few in in_slices(batches, TEXT_BYTES):
            lengths, ids = encode(few.column(1))
            ends = np.cumsum(lengths)
            start = 0
            for doc, length, end in zip(few.column(0).to_pylist(), lengths, ends):
                names.append(doc)
                sizes.append(length)
                held.append(ids[start:end])
                start = end
                if len(names) % 64 == 0 and sum(sizes) >= limit or length >= limit:
                    yield close()
        if names:
            yield close()
        given_back()

    return build


def write_shards(docs: DataFrame, path: str | None = None, limit: int = SHARD_TOKENS) -> DataFrame:
    """Encodes whole texts (null: empty), writes shards in ascending order of ``doc_id`` (null first, ties by text) and returns them as read back.

    Documents are dealt by range of id before they are encoded, so each is encoded once, where its shard is made; equal ids
    are split by the text's hash. ``(part, shard)`` is the order of the shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("__text", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "__text").sortWithinPartitions("doc_id", "__text").select("doc_id", "text")
    return written(dealt.mapInArrow(_written_shards(path or tokenizer_path(), limit), SHARDS))


_DOCS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
            shard = Shard(payload)
            raw = memoryview(shard.ids().astype("<u4").tobytes())
            ends = shard.lengths.cumsum()
            starts = ends - shard.lengths
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(sums)
            columns = ([part] * n, [number] * n, shard.doc_ids, starts, shard.lengths, sums)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _DOCS.types)], schema=_DOCS)


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` per document, from the shards.

    A document starts where its shard starts, plus its place inside; the running sum over shards takes two numbers a shard.
    """
    earlier = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("__before"))
    docs = shards.select("part", "shard", "payload").mapInArrow(_read_docs, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("__before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
