"""Near copies by Jaccard similarity of word shingles: SimHashes with Golay keys and MinHash keys find candidates, their sets verify them.

A text's set holds the hashes of its runs of ``n_words`` words (of all its words, if it has fewer). Texts of equal sets are one node.
The SimHash of the same hashes, repeats included, is searched by Golay keys (``simhash``): texts that links of at most ``MAX_BITS`` bits
connect are one bucket, so no pair within these bits is missed. Near copies at a similarity of 0.8 differ in some ten of 64 bits, which no
Golay key of a segment reaches; ``BANDS`` keys of ``ROWS`` minima each find those: two sets of similarity s share one with probability
1 - (1 - s**5)**24, which is 0.99993 at 0.8. Candidate pairs become links only once the two sets
themselves have at least the similarity asked for; groups are the components of these links.

A bucket of n nodes has n * n / 2 pairs, most of which say nothing new. Each node is first compared with one pivot
of its buckets, then with the pivots of all its buckets (twice, by other orders). Buckets that still hold several components
are then gone through whole: each is one run of rows (of blocks of ``BLOCK_BYTES``, if its sets are larger, each pair of
blocks one run), and within a run nodes of different components are compared without a row per pair.
So all pairs of a bucket that could join components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut
from .simhash import fingerprint_roots, majority, shingle_hashes

BANDS, ROWS = 24, 5
_RNG = np.random.default_rng(24)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_NODE = "xxhash64(doc_id, x)"
SLICE = 256  # rows whose sets are held at once
BLOCK_BYTES = 4 << 20  # of the sets of a bucket that are compared in one run


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), SLICE):
            yield pdf.iloc[at : at + SLICE]


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; none for a text without a word."""
    return np.unique(shingle_hashes(text, n_words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(found: np.ndarray) -> list[int]:
    """``BANDS`` signed keys of a set; none of an empty one."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        x = found[at : at + 2048] * _MUL[:, None] + _ADD[:, None]
        np.minimum(low, (x ^ x >> np.uint64(29)).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))]


def _keyed(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``(doc_id, x, fp, bits, keys)`` per row: hashes of the text and of its set, its SimHash (null without a word), and the set's keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(frames):
            hashes = [shingle_hashes(t, n_words) for t in pdf["t"]]
            sets = [np.unique(h) for h in hashes]
            bits = pd.array(np.array(list(map(majority, hashes)), np.uint64).view(np.int64), "Int64")
            bits[[not len(h) for h in hashes]] = pd.NA
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": pdf["x"], "fp": fp, "bits": bits, "keys": list(map(band_keys, sets))})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    return picked.mapInPandas(run, "doc_id long, x long, fp long, bits long, keys array<long>")


def golay_buckets(nodes: DataFrame) -> DataFrame:
    """``(key, fp)``: nodes ``(fp, bits)`` whose SimHashes are connected by links of at most ``MAX_BITS`` bits have one key."""
    roots = fingerprint_roots(nodes.select(F.col("bits").alias("fp"))).select(F.col("fp").alias("bits"), "root")
    return nodes.join(roots, "bits").select(F.xxhash64(F.lit("golay"), "root").alias("key"), "fp").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``(fp, s)``: the sets of ``nodes`` ``(node, fp)``, from one row of ``docs`` each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(frames):
            yield pd.DataFrame({"node": pdf["node"], "s": [shingle_set(t, n_words).tobytes() for t in pdf["t"]]})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    picked = picked.select(F.expr(_NODE).alias("node"), "t").join(nodes.select("node"), "node", "left_semi")
    return picked.mapInPandas(run, "node long, s binary").join(nodes, "node").groupBy("fp").agg(F.first("s").alias("s"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets have at least ``least`` similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(frames):
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(pdf["sa"], pdf["sb"])]
            yield pdf.loc[good, ["a", "b"]]

    a, b = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cross_links(fp: np.ndarray, root: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect what all pairs of at least ``least`` similarity and with different roots (and sides, if given) connect.

    Any such pair has an end outside the most frequent root, so the nodes outside are each compared with all others. Sets are not empty.
    """
    label = np.unique(root, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held, out = np.zeros(int(ids.max()) + 1, bool), []
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        other = label != label[i]
        if side is not None:
            other &= side != side[i]
        if not other.any():
            continue
        mine = ids[starts[i] : starts[i] + sizes[i]]
        held[mine] = True
        both = np.add.reduceat(held[ids], starts, dtype=np.int64)
        held[mine] = False
        for j in np.flatnonzero(other & (both / (sizes[i] + sizes - both) >= least)).tolist():
            if label[j] != label[i]:
                out.append((int(fp[i]), int(fp[j])))
                label[label == label[j]] = label[i]
    return out


def _crossed(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified edges ``(a, b)`` between different roots of a bucket ``(key, fp, root)``, enough to connect what all such pairs connect.

    A bucket of k blocks makes k rows of each of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        of = None

        def end() -> pd.DataFrame:
            fp, root, side = np.array([x[:3] for x in held], np.int64).T
            sets = [np.frombuffer(x[3], np.uint64) for x in held]
            return pd.DataFrame(cross_links(fp, root, side if of[1] < of[2] else None, sets, least), columns=["a", "b"], dtype="int64")

        for pdf in frames:
            for key, i, j, *row in pdf[["key", "i", "j", "fp", "root", "side", "s"]].itertuples(index=False, name=None):
                if of != (key, i, j):
                    if held:
                        yield end()
                    held, of = [], (key, i, j)
                held.append(tuple(row))
        if held:
            yield end()

    sized = rows.join(sets.select("fp", F.octet_length("s").alias("n")), "fp")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_BYTES).cast("int").alias("k"))
    dealt = rows.join(blocks, "key").select("key", "fp", "root", F.expr("cast(pmod(xxhash64(fp), k) as int)").alias("own"), F.explode(F.expr("sequence(0, k - 1)")).alias("beside"))
    dealt = dealt.select("key", F.least("own", "beside").alias("i"), F.greatest("own", "beside").alias("j"), "fp", "root", F.expr("int(own > beside)").alias("side"))
    dealt = dealt.join(sets, "fp").select("key", "i", "j", "fp", "root", "side", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def links(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified edges ``(a, b)`` that connect what all verified pairs of a bucket ``(key, fp)`` connect."""
    return _grown(buckets, sets, least)[0]


def _grown(buckets: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``links``, and fewer edges that connect the same: from nodes to the roots of earlier components, and the last links."""
    low = buckets.groupBy("key").agg(F.min("fp").alias("p"))
    one = buckets.join(low, "key").groupBy("fp").agg(F.min("p").alias("p"))
    edges = stars = cut(_verified(_ordered(one.select(F.col("fp").alias("a"), F.col("p").alias("b"))), sets, least), "jaccard")
    for step in (1, 2, None):
        roots = cut(components(stars), "jaccard")
        now = buckets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
        # buckets that lie in one component have nothing to add
        open_ = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("fp", F.lit(step or 0)).alias("h"), "fp", "root")).alias("p"))
        open_ = open_.where("lo <> hi").select("key", F.col("p.fp").alias("q"), F.col("p.root").alias("q_root"))
        if step:
            pairs = now.join(open_, "key").where("root <> q_root").select(F.col("fp").alias("a"), F.col("q").alias("b"))
            more = _verified(_ordered(pairs), sets, least)
        else:
            more = _crossed(cut(now.join(open_, "key", "left_semi"), "jaccard"), sets, least)
        more = cut(more, "jaccard")
        edges, stars = edges.unionByName(more), roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return edges, stars


def keep_one(docs: DataFrame, least: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component of pairs of at least ``least`` similarity: that with the smallest id (nulls last).

    Texts without a word are equal. Of rows with equal id and text one stays. All columns are kept; they may
    have any names but ``__id`` and ``__x``.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(_keyed(docs, id_col, text_col, n_words), "jaccard")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("one")
    distinct = cut(rows.groupBy("fp").agg(first, F.min(F.expr(_NODE)).alias("node")), "jaccard")
    named = rows.select(F.expr(_NODE).alias("node"), "fp", F.explode("keys").alias("key"))
    buckets = named.join(distinct.select("node", "fp"), ["node", "fp"], "left_semi").select("key", "fp").distinct()
    buckets = cut(buckets.unionByName(golay_buckets(cut(rows.where("bits is not null").select("fp", "bits").distinct(), "jaccard"))), "jaccard")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = cut(buckets.join(shared, "key", "left_semi"), "jaccard")
    nodes = distinct.select("node", "fp").join(buckets.select("fp").distinct(), "fp", "left_semi")
    sets = cut(_sets(docs, nodes, id_col, text_col, n_words), "jaccard")
    roots = components(_grown(buckets, sets, least)[1]).withColumnRenamed("node", "fp")
    one = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("one").alias("one"))
    kept = cut(one.select(F.col("one.doc_id").alias("__id"), F.col("one.x").alias("__x")), "jaccard")
    out = docs.withColumn("__x", F.xxhash64(text_col))
    same = out[id_col].cast("long").eqNullSafe(kept["__id"]) & (out["__x"] == kept["__x"])
    return out.join(kept, same, "left_semi").dropDuplicates([id_col, "__x"]).drop("__x")
