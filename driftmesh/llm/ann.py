"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, and every vector is filed under one leaf. A query walks the tree with a
priority queue of branches by distance to their centres; the number of leaves it opens is widened
on sampled queries, scored against brute force over the sample, until the wanted recall is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 20_000
BRANCH = 8
LEAF = 160  # sampled vectors a leaf, at most
TARGET = 0.94
CALIBRATE = 200
BLOCK_ROWS = 20_000
GROUPS = 24


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: of the commonest length, finite and not zero."""
    v = F.col(vec_col).cast("array<double>")
    got = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    size = got.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return got.where(F.size("v") == (size.n if size else -1))


class Tree:
    """Nodes in arrays: children of node k are ``first[k] .. first[k] + n[k]``; leaves have number >= 0."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.centre, self.child, self.leaf = [x.mean(axis=0)], [[]], [-1]
        self.members: list[np.ndarray] = []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(x, rows) if len(rows) > LEAF else [rows]
            if len(parts) < 2:
                self.leaf[node] = len(self.members)
                self.members.append(rows)
                continue
            for part in parts:
                self.centre.append(x[part].mean(axis=0))
                self.child.append([])
                self.leaf.append(-1)
                self.child[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, part))
        self.centre = np.array(self.centre)
        self.n_leaves = len(self.members)

    def _split(self, x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        y = x[rows]
        c = y[self.rng.choice(len(y), min(BRANCH, len(y)), replace=False)]
        for _ in range(6):
            near = ((c**2).sum(axis=1)[None] - 2 * y @ c.T).argmin(axis=1)
            used = np.unique(near)
            c = np.array([y[near == k].mean(axis=0) for k in used])
        near = ((c**2).sum(axis=1)[None] - 2 * y @ c.T).argmin(axis=1)
        return [rows[near == k] for k in np.unique(near)]

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by its nearest centre at each level."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.child[node]
            c = self.centre[kids]
            near = ((c**2).sum(axis=1)[None] - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def search(self, q: np.ndarray, n_leaves: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that best-bin-first traversal opens: ``n_leaves``, and more until they hold ``least`` vectors by ``counts``."""
        dist = ((self.centre - q) ** 2).sum(axis=1)
        queue, out, held = [(dist[0], 0)], [], 0
        while queue and (len(out) < n_leaves or (counts is not None and held < least)):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = sorted(self.child[node], key=dist.__getitem__)
                for kid in kids[1:]:
                    heapq.heappush(queue, (dist[kid], kid))
                node = kids[0]
            out.append(self.leaf[node])
            held += int(counts[out[-1]]) if counts is not None else 0
        return out

    def calibrate(self, x: np.ndarray, k: int, target: float) -> int:
        """Leaves to open so that sampled queries find ``target`` of their ``k`` nearest sampled vectors."""
        rows = self.rng.choice(len(x), min(CALIBRATE, len(x)), replace=False)
        at = np.empty(len(x), np.int64)
        for leaf, members in enumerate(self.members):
            at[members] = leaf
        found = np.zeros(self.n_leaves + 1)
        total = 0
        for r in rows:
            s = x @ x[r]
            s[r] = -np.inf
            n = min(k, len(x) - 1)
            best = np.argpartition(-s, n - 1)[:n] if n else np.empty(0, int)
            when = {leaf: i for i, leaf in enumerate(self.search(x[r], self.n_leaves))}
            np.add.at(found, [when[leaf] + 1 for leaf in at[best]], 1)
            total += n
        return int(np.searchsorted(np.cumsum(found), target * total - 1e-9)) if total else 1


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products by one summation order, whatever stands beside a vector."""
    return (v * q).sum(axis=1)


def _top(q: np.ndarray, v: np.ndarray, names: np.ndarray, own: int, k: int, approx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows' names and scores: largest first, ties to the smaller name."""
    s = np.where(names == own, -np.inf, approx)
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        rows = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else np.isfinite(s))
    else:
        rows = np.flatnonzero(np.isfinite(s))
    exact = _exact(q, v[rows])
    order = np.lexsort((names[rows], -exact))[:k]
    return names[rows][order], exact[order]


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is the largest inner product in double precision, ties to the smaller id; a query's own id is no
    candidate. Vectors that are null, zero, of another length than the commonest, or with null or non-finite
    components take no part; nor do null ids. Rows with one id are candidates each, and queries that share one id are one query
    with the candidates of all. Leaves are dealt in groups, and a group with many vectors in several blocks, so a leaf that a
    third of all vectors share splits. Each query opens leaves until they hold ``k`` vectors besides its own, so none has
    fewer than there are. Only the id and vector columns are read.
    """
    spark = vectors.sparkSession
    v = cut(usable(vectors, id_col, vec_col), "ann")
    picked = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    schema = "query_id long, vec_id long, score double"
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.stack(picked["v"].to_numpy()).astype(float)
    tree = Tree(np.unique(x, axis=0))
    n_open = tree.calibrate(np.unique(x, axis=0), k, target)
    tree.members = []
    n_groups = min(GROUPS, tree.n_leaves)
    shared = spark.sparkContext.broadcast(tree)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            leaf = shared.value.file(np.stack(pdf["v"].to_numpy())) if len(pdf) else []
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "leaf": leaf, "v": pdf["v"]})

    filed = cut(v.mapInPandas(file, "vec_id long, leaf int, v array<double>"), "ann")
    count = np.zeros(tree.n_leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():
        count[r.leaf] = r["count"]
    group = np.arange(tree.n_leaves) * n_groups // tree.n_leaves
    blocks = [max(1, int(-(-count[group == g].sum() // BLOCK_ROWS))) for g in range(n_groups)]

    # a query's own rows are no candidates; a table where an id repeats thousands of times just opens that many more
    least = k + max((r["count"] for r in v.where(F.col("vec_id") % every == 0).groupBy("vec_id").count().orderBy(F.desc("count")).limit(1).collect()), default=0)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, q in zip(pdf["vec_id"].tolist(), pdf["v"]):
                leaves = np.array(shared.value.search(np.asarray(q), n_open, count, least))
                for g in np.unique(group[leaves]):
                    rows += [(int(g), b, 1, name, q, leaves[group[leaves] == g]) for b in range(blocks[g])]
            yield pd.DataFrame(rows, columns=["g", "b", "kind", "vec_id", "v", "leaves"])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.array(blocks)
        for pdf in frames:
            g = group[pdf["leaf"].to_numpy()]
            mixed = (pdf["vec_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            b = (mixed % n[g].astype(np.uint64)).astype(np.int32)
            yield pd.DataFrame({"g": g, "b": b, "kind": 0, "vec_id": pdf["vec_id"], "v": pdf["v"], "leaves": [[x] for x in pdf["leaf"].tolist()]})

    row = "g int, b int, kind int, vec_id long, v array<double>, leaves array<int>"
    asked = v.where(F.col("vec_id") % every == 0).mapInPandas(ask, row)
    dealt = filed.mapInPandas(deal, row)

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors of a block come first and are kept; its queries then pass by in batches, however many there are."""
        now, parts, held = None, [], None
        for pdf in frames:
            key = pdf[["g", "b", "kind"]].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                part, place = pdf.iloc[a:z], tuple(key[a, :2])
                if place != now:
                    now, parts, held = place, [], None
                if key[a, 2] == 0:
                    parts.append((part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), np.array([x[0] for x in part["leaves"]])))
                    continue
                if not parts:
                    continue
                if held is None:
                    names, vs, leaf = (np.concatenate(x) for x in zip(*parts))
                    by = np.lexsort((names, leaf))
                    held = names[by], vs[by], leaf[by]
                names, vs, leaf = held
                for lo in range(0, len(part), 256):
                    some, out = part.iloc[lo : lo + 256], []
                    approx = np.stack(some["v"].to_numpy()) @ vs.T
                    for scores, own, q, leaves in zip(approx, some["vec_id"].tolist(), some["v"], some["leaves"]):
                        got, score = _top(np.asarray(q), vs, names, own, k, np.where(np.isin(leaf, leaves), scores, -np.inf))
                        out.append(pd.DataFrame({"query_id": own, "vec_id": got, "score": score}))
                    yield pd.concat(out)

    found = asked.unionByName(dealt).repartition("g", "b").sortWithinPartitions("g", "b", "kind").mapInPandas(block, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
