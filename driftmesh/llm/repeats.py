"""Exact removal of repeated byte strings of a fixed length, by a sampled (difference-cover) suffix method.

A difference cover samples suffixes so that any two equal strings meet in sampled places at the same
offset. Here the cover is chosen by content (a string synchronising set): the places whose ``gram``-byte
hash is the least of ``length - gram + 1`` neighbouring ones, the last of equal ones. Two equal strings of
``length`` bytes have their least place at the same offset, so

1. sampled grams are sorted and named; a string whose sampled gram is unique is unique;
2. names recurse to contexts: samples whose whole surroundings (all bytes of all strings that they stand
   for) are equal get one name, and one sample of each name stays for the rest;
3. where a gram has several names, a sample's strings are merged in blocks of ever fewer neighbouring
   offsets, down to one. A block drops out if its core (the bytes that all its strings have) is unique, and is
   settled if its own surroundings have an equal; only the others are cut further.

Exact copies of whole texts are named first of all. Strings are told apart by 128 hashed bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, semi_join

LENGTH = 400
GRAM = 128
BLOCKS = (32, 8, 1)
TILE = 1 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(s).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (1, 2)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Hasher:
    """Polynomial hashes modulo 2**64 of all strings of a byte array, through prefix sums."""

    def __init__(self, which: int):
        self.base, self.table = (_B1, _B2)[which], _TABLES[which]
        self.up, self.down = _powers(self.base, TILE + LENGTH + 1), _powers(_inverse(self.base), TILE + LENGTH + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def strings(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        x = (prefix[size:] - prefix[:n]) * self.down[:n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


_hashers: list[_Hasher] = []


def _hasher(which: int) -> _Hasher:
    if not _hashers:
        _hashers.extend((_Hasher(0), _Hasher(1)))
    return _hashers[which]


def _sliding_last_min(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values, the place of its least value, the last of equal ones."""
    n = len(x) - w + 1
    # a place in the low bits makes keys distinct: reversed, so that the last of equal ones is least
    bits = np.uint64(TILE + LENGTH).item().bit_length()
    mask = np.uint64((1 << bits) - 1)
    key = (x & ~mask) | (np.uint64((1 << bits) - 1) - np.arange(len(x), dtype=np.uint64))
    pad = -len(key) % w
    k = np.concatenate((key, np.full(pad, np.uint64(2**64 - 1)))).reshape(-1, w)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (mask - (least & mask)).astype(np.int64)


def samples(data: np.ndarray, length: int, gram: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each sample its gram's hash and place, and the strings (first, last start) it stands for.

    ``data`` holds the bytes of one text, or of several that end at ``ends`` (at most ``TILE`` bytes in all); strings across two texts
    don't count. Runs of strings with the same sample are contiguous. A long text is read in tiles that overlap by ``length - 1``.
    """
    h = _hasher(0)
    hashes, place, first, last = [], [], [], []
    n, w = len(data) - length + 1, length - gram + 1
    for at in range(0, max(0, n), TILE):
        tile = data[at : at + TILE + length - 1]
        g = h.strings(h.prefix(tile), gram)
        least = _sliding_last_min(g, w)
        valid = np.ones(len(least), bool)
        if ends is not None:
            for back in ends[:-1]:
                valid[max(0, back - length + 1) : back] = False
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        new = np.flatnonzero(new)
        hashes.append(g[least[new]])
        place.append(at + least[new])
        first.append(at + new)
        last.append(at + np.flatnonzero(stop))
    if not hashes:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    return np.concatenate(hashes), np.concatenate(place), np.concatenate(first), np.concatenate(last)


KEY = ["k1", "k2"]


def _samples_of(length: int, gram: int):
    def of(part: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        """The samples of texts, whose bytes are looked through together."""
        sizes = np.array([len(x[2]) for x in part])
        ends = np.cumsum(sizes)
        h, place, first, last = samples(np.frombuffer(b"".join(x[2] for x in part), np.uint8), length, gram, ends if len(part) > 1 else None)
        which = np.searchsorted(ends, first, "right")
        back = (ends - sizes)[which]
        k1, k2 = (np.array([x[k] for x in part], np.int64)[which] for k in (0, 1))
        return pd.DataFrame({"k1": k1, "k2": k2, "h": h.view(np.int64), "g": place - back, "first": first - back, "last": last - back})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            part, size = [], 0
            for k1, k2, t in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["t"]):
                raw = (t or "").encode()
                if part and size + len(raw) > TILE // 2:
                    yield of(part)
                    part, size = [], 0
                part.append((k1, k2, raw))
                size += len(raw)
            if part:
                yield of(part)

    return run


def _digest(*parts: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_BLOCK = "k1 long, k2 long, g int, lo int, hi int, c1 long, c2 long, r1 long, r2 long"


def _beside_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` ``(k1, k2, x, y, z)`` dealt out with the texts they belong to: each text's row comes first, then its own rows by x and y.

    No list of a text's rows is ever built, so a task holds one text at a time.
    """
    head = texts.select(*KEY, *[F.lit(-1).alias(c) for c in "xyz"], "t")
    return head.unionByName(rows.select(*KEY, *"xyz", F.lit(None).cast("string").alias("t"))).repartition(*KEY).sortWithinPartitions(*KEY, "x", "y")


def _by_text(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bytes | None, np.ndarray]]:
    """(k1, k2, bytes, rows x, y, z) of runs of rows that stand with one text; the bytes are None where a run goes on."""
    for pdf in frames:
        heads = pdf["t"].notna().to_numpy()
        edges = np.unique(np.concatenate(([0], np.flatnonzero(heads), [len(pdf)])))
        k1, k2, xyz, t = pdf["k1"].to_numpy(), pdf["k2"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(np.int64), pdf["t"]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            raw = t.iloc[a].encode() if heads[a] else None
            yield int(k1[a]), int(k2[a]), raw, xyz[a + (raw is not None) : b]


def _blocks_of(length: int, width: int, whole: int):
    """Blocks of ``width`` offsets of each given block (g, lo, hi): the names of their surroundings and of their cores.

    An offset is a sample's place less a string's start; blocks are aligned to it, so equal strings fall
    into equal blocks even where a text's end cuts one short. ``whole`` is the number of offsets there are.
    """
    names = ["k1", "k2", "g", "lo", "hi", "c1", "c2", "r1", "r2"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, raw = [], b""
        for k1, k2, text, xyz in _by_text(frames):
            raw = raw if text is None else text
            for g, lo, hi in xyz.tolist():
                for q in range(lo // width, hi // width + 1):
                    x, y = max(lo, q * width), min(hi, (q + 1) * width - 1)
                    top = min((q + 1) * width, whole) - 1
                    ctx = _digest(raw[g - y : g - x + length], b"%d:%d" % (x, y))
                    core = _digest(raw[g - q * width : g - top + length], b"%d" % q) if width > 1 else ctx
                    rows.append((k1, k2, g, x, y, *ctx, *core))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _kept_of(length: int):
    """What is left of each text without the strings that start in its rows (first, last, -)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, now = [], None

        def end() -> None:
            k1, k2, raw, spans = now
            if not spans:
                return
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((k1, k2, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))

        for k1, k2, text, xyz in _by_text(frames):
            if text is not None:
                if now:
                    end()
                now = (k1, k2, text, [])
            spans = now[3]
            for a, b, _ in xyz.tolist():
                b = min(b + length, len(now[2]))
                if spans and a <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(spans[-1][1], b)
                else:
                    spans.append((a, b))
            if len(rows) > 5_000:
                yield pd.DataFrame(rows, columns=["k1", "k2", "removed", "n_spans", "kept", "spans"])
                rows.clear()
        if now:
            end()
        if rows:
            yield pd.DataFrame(rows, columns=["k1", "k2", "removed", "n_spans", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, the same
    text included; ``spans`` lists the removed runs' ends (byte offsets of the UTF-8 text). Null texts count as empty. Repeated
    rows are copies of one text, so each loses all its strings. The id and text columns alone are read.
    """
    gram = gram or max(1, length * GRAM // LENGTH)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t")).select(
        "doc_id", "t", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2")
    )
    long_enough = rows.where(F.octet_length("t") >= length)

    # 1: a sampled gram that stands in one place only names no repeat
    distinct = cut(long_enough.groupBy(*KEY).agg(F.first("t").alias("t"), F.count("*").alias("copies")), "repeats")
    sampled = cut(distinct.select(*KEY, "t").mapInPandas(_samples_of(length, gram), "k1 long, k2 long, h long, g int, first int, last int"), "repeats")
    met = cut(sampled.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    todo = cut(semi_join(sampled, met, ["h"]).select(*KEY, "g", (F.col("g") - F.col("last")).alias("lo"), (F.col("g") - F.col("first")).alias("hi")), "repeats")
    free(sampled)
    own = todo.select(*KEY).distinct().withColumn("met", F.lit(True))
    texts = cut(distinct.join(own, KEY, "left").where("met or copies > 1").select(*KEY, "t", "copies"), "repeats")
    free(distinct)

    # 2 and 3: names of ever smaller blocks of strings; the widest block's core is the gram
    whole, found = length - gram + 1, []
    for width in (whole, *(w for w in BLOCKS if w < whole)):
        blocks = todo.select(*KEY, F.col("g").alias("x"), F.col("lo").alias("y"), F.col("hi").alias("z"))
        named = cut(_beside_texts(texts, blocks).mapInPandas(_blocks_of(length, width, whole), _BLOCK), "repeats")
        names = cut(
            named.groupBy("r1", "r2", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "g", "lo", "hi")).alias("one")), "repeats"
        )
        equal = semi_join(named, names.where("n > 1"), ["r1", "r2", "c1", "c2"])
        found.append(cut(equal.select(*KEY, (F.col("g") - F.col("hi")).alias("x"), (F.col("g") - F.col("lo")).alias("y")), "repeats"))
        free(named)
        if width > 1:
            mixed = cut(names.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
            todo = cut(semi_join(names.select("r1", "r2", "one"), mixed, ["r1", "r2"]).select("one.*"), "repeats")
        free(names)

    copied = texts.where("copies > 1").select(*KEY, F.lit(0).alias("x"), (F.octet_length("t") - length).alias("y"))
    marks = reduce(DataFrame.unionByName, found, copied).withColumn("z", F.lit(0))
    kept = cut(_beside_texts(texts, marks).mapInPandas(_kept_of(length), "k1 long, k2 long, removed long, n_spans long, kept string, spans array<long>"), "repeats")
    free(texts)
    light = rows.select("doc_id", *KEY, F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    return light.join(kept, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
    )
