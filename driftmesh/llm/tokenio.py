"""Token-id output: encoded documents in wavelet-matrix shards, read back from their files.

A shard is one row of a Parquet file: the ids of a run of documents as a wavelet matrix over the shard's
own alphabet, that is one bit-plane per bit of an id's rank in it, each plane stably partitioned by the bits above it. Planes are packed and
compressed with zstandard; rank samples every 512 bits are rebuilt when a shard is opened.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, put_at, shuffle_parts

MAGIC = b"WMX1"
SHARD_TOKENS = 1 << 18
CACHE_PIECES = 900_000


class WaveletMatrix:
    """Sequence of unsigned ids with access, rank, select and count through rank-indexed bit-planes."""

    STEP = 512

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes
        self.levels = len(planes)
        self._ranks: list[np.ndarray | None] = [None] * self.levels

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        x = np.asarray(ids)
        there = np.bincount(x) > 0
        alphabet = np.flatnonzero(there).astype(np.uint32)
        levels = max(1, (len(alphabet) - 1).bit_length())
        x = (np.cumsum(there) - 1).astype(np.uint16 if levels <= 16 else np.uint32)[x]
        zeros, planes = [], []
        for b in range(levels - 1, -1, -1):
            bit = (x >> x.dtype.type(b) & x.dtype.type(1)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = x[~bit]
            zeros.append(len(low))
            x = np.concatenate((low, x[bit]))
        return cls(len(ids), alphabet, zeros, planes)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def _samples(self, level: int) -> np.ndarray:
        if self._ranks[level] is None:
            ones = np.bitwise_count(self.planes[level]).astype(np.int64)
            step = self.STEP // 8
            pad = np.concatenate((ones, np.zeros(-len(ones) % step, np.int64)))
            self._ranks[level] = np.concatenate(([0], np.cumsum(pad.reshape(-1, step).sum(axis=1))))
        return self._ranks[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // self.STEP
        got = int(self._samples(level)[block])
        at, end = block * self.STEP // 8, i // 8
        got += int(np.bitwise_count(self.planes[level][at:end]).sum(dtype=np.int64))
        if i % 8:
            got += (int(self.planes[level][end]) & ((1 << i % 8) - 1)).bit_count()
        return got

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value in a plane."""
        s = self._samples(level)
        blocks = s if bit else np.minimum(np.arange(len(s)) * self.STEP, self.n) - s
        block = int(np.searchsorted(blocks, k, side="right")) - 1
        lo = block * self.STEP
        part = np.unpackbits(self.planes[level][lo // 8 : (lo + self.STEP) // 8], bitorder="little")
        return lo + int(np.flatnonzero(part == bit)[k - int(blocks[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        got = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            got = got << 1 | bit
        return int(self.alphabet[got])

    def _symbol(self, value: int) -> int:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else -1

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi, value = 0, end, self._symbol(value)
        if value < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` is among the first ``i`` ids."""
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, value = lo + k, self._symbol(value)
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> Iterator[int]:
        return (self.select(value, k) for k in range(self.count(value)))

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit, z = self.bits(level), self.zeros[level]
            up = np.empty(self.n, kind)
            up[~bit] = x[:z]
            up[bit] = x[z:] | kind(1 << (self.levels - 1 - level))
            x = up
        return self.alphabet[x]

    def to_bytes(self) -> bytes:
        c = zstandard.ZstdCompressor(level=1)
        packed = [c.compress(p.tobytes()) for p in self.planes]
        names = c.compress(self.alphabet.astype("<u4").tobytes())
        head = struct.pack("<4sQBQ", MAGIC, self.n, self.levels, len(names))
        return b"".join((head, names, *(struct.pack("<QQ", z, len(p)) for z, p in zip(self.zeros, packed)), *packed))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, levels, size = struct.unpack_from("<4sQBQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at, d = 21 + size, zstandard.ZstdDecompressor()
        alphabet = np.frombuffer(d.decompress(data[21:at]), "<u4")
        heads = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(levels)]
        at += 16 * levels
        planes = []
        for _, size in heads:
            planes.append(np.frombuffer(d.decompress(data[at : at + size]), np.uint8))
            at += size
        return cls(n, alphabet, [z for z, _ in heads], planes)


LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 0, 3, 4
KNOWN_POINTS = 0x30000
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point; ``UNSURE`` where Unicode versions differ, or beyond ``KNOWN_POINTS`` (the last entry)."""
    old, out = unicodedata.ucd_3_2_0, np.full(KNOWN_POINTS + 1, UNSURE, np.uint8)
    for cp in range(KNOWN_POINTS):
        kind = old.category(chr(cp))
        if kind == unicodedata.category(chr(cp)) and kind not in ("Cn", "Cs"):
            out[cp] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[list(_SPACES)] = SPACE
    return out


@lru_cache(1)
def _point_hashes() -> np.ndarray:
    return np.random.default_rng(10).integers(0, 1 << 63, KNOWN_POINTS + 1, dtype=np.uint64)


@lru_cache(1)
def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: 256 + k for k, b in enumerate(hidden)}


BLOCK_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.full(BLOCK_CHARS, _BASE, np.uint64))
_DOWN = np.cumprod(np.full(BLOCK_CHARS, pow(_BASE, -1, 1 << 64), np.uint64))


def piece_starts(points: np.ndarray, kinds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pieces begin, by byte-level BPE's usual split, in texts that begin at ``heads`` (none is empty).

    Runs of letters, of numbers and of other characters are pieces, with one space before them. Of the white space
    before something else the last character stands apart. An apostrophe that begins a piece takes a
    contraction's letters with it.
    """
    n = len(points)
    new = np.ones(n + 1, bool)
    new[1:n] = kinds[1:] != kinds[:-1]
    new[heads] = True
    first = np.zeros(n + 1, bool)
    first[heads] = first[n] = True
    ends = np.flatnonzero(new[1:] & (kinds == SPACE) & ~first[1:])  # the last of white space that something follows
    new[ends] = True
    new[ends[points[ends] == 0x20] + 1] = False
    marks = np.flatnonzero((points == 0x27) & new[:n])
    if len(marks):
        text_end = np.append(heads[1:], n)[np.searchsorted(heads, marks, "right") - 1]
        one = np.where(marks + 1 < text_end, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < text_end, points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((marks[short], 2), (marks[long], 3)):
            new[hit + 1] = False
            new[hit + size] = True
    return np.flatnonzero(new[:n])


class PieceEncoder:
    """Whole-text encoder that encodes each distinct piece once and keeps a bounded cache of them.

    Pieces never merge with each other, so a text's ids are those of its pieces in order. Pieces are cut and looked up
    for a block of texts together, by hashes whose finds are compared character by character. Texts with a
    character of ``UNSURE`` class or a special token's string go to the tokenizer as they are; so do all texts
    if the file splits or normalises in another way. ``special_as_text`` takes such strings for ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        self.plain = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not made.get("normalizer") and split.get("type") == "ByteLevel"
        self.plain = self.plain and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.special = [] if special_as_text else [t["content"] for t in made.get("added_tokens", [])]
        # added tokens that aren't special are matched in any text
        self.special += [t["content"] for t in made.get("added_tokens", []) if special_as_text and not t["special"]]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.slots, self.keys = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint64)
        self.known, self.n_ids, self.n_chars = 0, 0, 0
        self.first, self.sizes, self.begin, self.lens = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.flat, self.chars = np.zeros(1 << 16, self.kind), np.zeros(1 << 16, np.uint32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at, out, left = self._slot(h), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(left):
            there = self.keys[at]
            hit = there == h[left]
            out[left[hit]] = self.slots[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Enter distinct hashes that aren't there yet."""
        if 3 * self.known > len(self.keys):
            full = self.keys != 0
            keys, slots = self.keys[full], self.slots[full]
            size = 8 << (self.known.bit_length())
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put_all(keys, slots)
        self._put_all(h, numbers)

    def _put_all(self, h: np.ndarray, numbers: np.ndarray) -> None:
        at, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            mine = free & (self.keys[at] == h[left])
            self.slots[at[mine]] = numbers[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        # a piece alone needs no split: the model takes it in the alphabet of bytes
        of, letters = self.tokenizer.model.tokenize, _byte_letters()
        ids = [[t.id for t in of(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        sizes, lens = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, pieces))
        got = np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum()))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        n = self.known
        self.first = put_at(self.first, n, self.n_ids + np.cumsum(sizes) - sizes)
        self.begin = put_at(self.begin, n, self.n_chars + np.cumsum(lens) - lens)
        self.sizes, self.lens = put_at(self.sizes, n, sizes), put_at(self.lens, n, lens)
        self.flat, self.chars = put_at(self.flat, self.n_ids, got), put_at(self.chars, self.n_chars, points)
        self.known, self.n_ids, self.n_chars = n + len(pieces), self.n_ids + len(got), self.n_chars + len(points)
        self._put(h, np.arange(n, self.known))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that together have at most ``BLOCK_CHARS`` characters, none of them empty."""
        if self.known > CACHE_PIECES:
            self._forget()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low = np.minimum(points, KNOWN_POINTS)
        kinds, n = _classes()[low], len(points)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        heads = np.append(0, ends[:-1])
        starts = piece_starts(points, kinds, heads)
        lens = np.diff(np.append(starts, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_point_hashes()[low] * _UP[:n], out=sums[1:])
        h = (sums[starts + lens] - sums[starts]) * _DOWN[starts]
        h ^= (h >> np.uint64(31)) + lens.astype(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h |= np.uint64(1)
        got = self._find(h)
        new = np.flatnonzero(got < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at = starts[new[at]], lens[new[at]]
            self._learn(keys, [joined[a : a + k] for a, k in zip(at[0].tolist(), at[1].tolist())])
            got[new] = self._find(h[new])
        # each find's characters are the piece's own
        same = self.lens[got] == lens
        if not same.all():
            raise ValueError("two pieces of one block share a hash")
        differ = points != self.chars[np.repeat(self.begin[got] - starts, lens) + np.arange(n)]
        odd = (kinds == UNSURE) | differ
        sizes = self.sizes[got]
        stops = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.first[got] - (stops - sizes), sizes) + np.arange(int(stops[-1]))]
        cuts = np.append(0, stops)[np.searchsorted(starts, np.append(heads, n))]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        whole = set(np.searchsorted(ends, np.flatnonzero(odd), "right").tolist())
        for mark in self.special:
            if mark in joined:
                whole |= {k for k, t in enumerate(texts) if mark in t}
        for k in whole:
            out[k] = self._whole(texts[k])
        return out

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        part, size = [], 0

        def flush() -> Iterator[np.ndarray]:
            got = iter(self._encode([t for t in part if t]) if size else [])
            return (next(got) if t else np.empty(0, self.kind) for t in part)

        for t in texts:
            if part and size + len(t) > BLOCK_CHARS:
                yield from flush()
                part, size = [], 0
            if not self.plain or len(t) > BLOCK_CHARS:
                yield from flush()
                part, size = [], 0
                yield self._whole(t)
            else:
                part.append(t)
                size += len(t)
        yield from flush()


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder per worker process and way."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = PieceEncoder(path, special_as_text)
    return _encoders[path, special_as_text]


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False
) -> str:
    """Encode whole texts, append ``end_id`` to each and write wavelet-matrix shards in ascending id order.

    Returns the folder in the shared store. Null texts count as empty; null ids come first, equal ids
    in the order of their texts' hashes. Ranges are dealt by id and hash, so one repeated id splits too. Tasks cut
    shards at ``SHARD_TOKENS`` ids (so that a plane's partition stays in cache), and no text or id list leaves its task otherwise.
    A special token's string in a text becomes that token's id, as the library does it, unless ``special_as_text``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer_path, special_as_text), TaskContext.get().partitionId()
        names, sizes, ids, held, seq, before = [], [], [], 0, 0, 0

        def shard() -> pd.DataFrame:
            wm = WaveletMatrix.build(np.concatenate(ids))
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_tokens": [wm.n], "doc_ids": [names], "sizes": [sizes], "planes": [wm.to_bytes()]})

        for pdf in frames:
            known = pdf["doc_id"].tolist()
            for name, got in zip(known, enc(pdf["t"].tolist())):
                names.append(None if pd.isna(name) else int(name))
                sizes.append(len(got) + 1)
                ids += (got, np.array([end_id], enc.kind))
                held += len(got) + 1
                if held >= SHARD_TOKENS:
                    yield shard()
                    names, sizes, ids, held, seq, before = [], [], [], 0, seq + 1, before + held
        if names:
            yield shard()

    path = new_path(spark, "tokens")
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(shuffle_parts(spark), F.col("doc_id").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "t")
        .select("doc_id", "t")
        .mapInPandas(run, "part int, seq int, before long, n_tokens long, doc_ids array<long>, sizes array<int>, planes binary")
        .write.option("compression", "none")
        .parquet(path)
    )
    return path


def read_token_shards(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the shard files.

    A shard holds its place in the part that one task wrote. The parts' sums, one row for each task of the write, are
    added up in a small table that is broadcast.
    """
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("base"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first, names, sizes, planes in zip(pdf["first"].tolist(), pdf["doc_ids"], pdf["sizes"], pdf["planes"]):
                ids = WaveletMatrix.from_bytes(planes).decode()
                sizes = np.asarray(sizes, np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": first + ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    placed = shards.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "sizes", "planes")
    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
