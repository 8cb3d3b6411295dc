"""SimHash near-duplicate detection with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Each segment is decoded with the
perfect binary Golay code [23,12,7]: its keys are the codeword indices of the segment itself and of its
23 one-bit neighbours, one or six indices in all. Two segments that differ in at most two bits share a
key, as some word is within one bit of both. At most four differing bits fall on three segments, so
either no segment has more than two (they share a key in all three) or one segment has three or more
and the other two have one at most between them (one is equal, and the other shares a key). Pairs that
share such a combined key are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut, shuffle_parts

SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 4
_POLY = 0b101011100011


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included: of all its words if it has fewer, none if it has no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= n_words:
        return np.array([h(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - n_words + 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[n_words - 1 :].tolist())), "<u8", n)


def fingerprint(text: str | None, n_words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    return majority(shingle_hashes(text, n_words))


def majority(got: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes; 0 of none."""
    if not len(got):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(got), 1 << 14):
        block = got[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(got), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4) -> DataFrame:
    """``(doc_id, x, fp)`` per row: a hash of the text, and the 64 bits in a signed long. Null and empty texts get 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = np.fromiter((fingerprint(t, n_words) for t in pdf["t"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": pdf["x"], "fp": fps.view(np.int64)})

    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    return picked.mapInPandas(run, "doc_id long, x long, fp long")


@lru_cache(1)
def _decoder() -> np.ndarray:
    """Index of the nearest codeword for each 23-bit word."""
    data = np.arange(4096, dtype=np.int64)
    rest = data << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (_POLY << (bit - 11)), rest)
    words = (data << 11) | rest
    one = 1 << np.arange(23, dtype=np.int64)
    two = np.array([a | b for i, a in enumerate(one) for b in one[:i]])
    three = np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]])
    out = np.empty(1 << 23, np.uint16)
    for err in np.concatenate(([0], one, two, three)):
        out[words ^ err] = data
    return out


def _segment_keys(seg: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) codeword indices; -1 where a segment has fewer."""
    dec = _decoder()
    near = np.concatenate((dec[seg][:, None], dec[seg[:, None] ^ (1 << np.arange(23, dtype=np.int64))]), axis=1).astype(np.int64)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = 1 << 20
    near.sort(axis=1)
    keys = near[:, :6]
    return np.where(keys < 1 << 20, keys, -1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and combined keys of an array of 64-bit fingerprints."""
    u = fps.astype(np.uint64, copy=False)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [_segment_keys(s, w) for s, (_, w) in zip(seg, SEGMENTS)]
    rows, keys = [], []
    n = np.arange(len(u))

    def add(tag: int, parts: list[np.ndarray], bits: list[int]) -> None:
        key, good = np.full((len(u), 1), tag, np.int64), np.ones((len(u), 1), bool)
        for p, b in zip(parts, bits):
            key = ((key[:, :, None] << b) | (p[:, None, :] & ((1 << b) - 1))).reshape(len(u), -1)
            good = (good[:, :, None] & (p[:, None, :] >= 0)).reshape(len(u), -1)
        rows.append(np.broadcast_to(n[:, None], key.shape)[good])
        keys.append(key[good])

    add(1, near, [12, 12, 12])
    for k, (x, y) in enumerate([(1, 2), (2, 1), (0, 2), (2, 0), (0, 1), (1, 0)]):
        add(2 + k, [seg[x][:, None], near[y]], [SEGMENTS[x][1], 12])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning edges of the link graph of one bucket's distinct fingerprints.

    Each fingerprint reached is compared with those not reached yet alone, so a tight group takes few passes.
    """
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= max_bits
            hit = left[near].tolist()
            out += [(i, j) for j in hit]
            queue += hit
            left = left[~near]
    return out


def _bucket_links(max_bits: int):
    def links(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        out = []
        two = starts[sizes == 2]
        if len(two):
            a, b = fp[two], fp[two + 1]
            ok = np.bitwise_count(a ^ b) <= max_bits
            out.append(np.stack((a[ok], b[ok]), 1))
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            part = fp[s : s + n]
            if e := _forest(part, max_bits):
                i = np.array(e)
                out.append(part[i])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        seen: set[tuple[int, int]] = set()

        def emit(parts: list[np.ndarray]) -> pd.DataFrame:
            pairs = np.concatenate(parts)
            pairs.sort(axis=1)
            new = [p for p in map(tuple, np.unique(pairs, axis=0).tolist()) if p not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            got = np.array(new, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

        for pdf in frames:
            key = np.concatenate((held_k, pdf["key"].to_numpy(np.int64)))
            fp = np.concatenate((held_f, pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            held_k, held_f = key[last:], fp[last:]
            if last and (parts := links(key[:last], fp[:last])):
                yield emit(parts)
        if len(held_k) and (parts := links(held_k, held_f)):
            yield emit(parts)

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that connect what links of at most ``max_bits`` bits connect; ``distinct`` has ``fp``.

    Each bucket of a combined key gives a spanning forest of its verified links, not all its pairs, so
    a large group of near copies costs edges in proportion to its distinct fingerprints.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find links of up to {MAX_BITS} bits")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 1024):
                rows, keys = golay_keys(fps[at : at + 1024].view(np.uint64))
                yield pd.DataFrame({"key": keys, "fp": fps[at : at + 1024][rows]})

    spark = distinct.sparkSession
    n = shuffle_parts(spark)
    # a small table in few files makes hundreds of rows of keys for each of its own: deal it out first
    keys = distinct.select("fp").repartition(2 * n, "fp").mapInPandas(keyed, "key long, fp long")
    return (
        keys.repartition(4 * n, "key")
        .sortWithinPartitions("key", "fp")
        .mapInPandas(_bucket_links(max_bits), "a long, b long")
        .distinct()
    )


def fingerprint_roots(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, root)`` of all distinct fingerprints, root the component's smallest fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.count("*").alias("n")), "simhash").select("fp")
    comp = components(fingerprint_links(distinct, max_bits)).withColumnRenamed("node", "fp")
    return distinct.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per input row, components of links of at most ``max_bits`` bits.

    Null and empty texts have fingerprint 0 and link like any other. A null id keeps its row; it never
    names a component unless its component has no other id. Repeated rows stay repeated. Only the id and text
    columns are read, so other columns can't clash.
    """
    fps = cut(fingerprints(docs, id_col, text_col, n_words).select("doc_id", "fp"), "simhash")
    named = cut(fingerprint_roots(fps, max_bits), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    lowest = first.join(named, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    mapped = cut(named.join(lowest, "root").select("fp", "component_id"), "simhash")
    return fps.join(mapped, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate component: that with the smallest id (nulls last).

    Of rows with equal id and text one stays. All columns are kept; they may have any names but ``__id`` and ``__x``.
    """
    fps = cut(fingerprints(docs, id_col, text_col, n_words), "simhash")
    named = fingerprint_roots(fps, max_bits)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")
    one = fps.groupBy("fp").agg(F.min(least).alias("one")).join(named, "fp").groupBy("root").agg(F.min("one").alias("one"))
    kept = cut(one.select(F.col("one.doc_id").alias("__id"), F.col("one.x").alias("__x")), "simhash")
    rows = docs.withColumn("__x", F.xxhash64(text_col))
    same = rows[id_col].cast("long").eqNullSafe(kept["__id"]) & (rows["__x"] == kept["__x"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__x"]).drop("__x")


def hex_of(fp) -> F.col:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
