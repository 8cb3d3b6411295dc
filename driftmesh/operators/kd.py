"""Nearest targets of many places in the plane: cells of about equal numbers of targets, and a k-d tree in each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.storage import materialize

#: Targets of a cell, about; targets of a leaf; sampled targets a cell; places that pass a cell at once; distances computed at once.
CELL, LEAF, SAMPLED, PASSING, AT_ONCE = 30_000, 32, 64, 100_000, 1 << 18


class Cells:
    """The plane cut at medians of sampled places, across the wider side, until a cell holds ``most`` of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int):
        xy = np.stack([x, y], axis=1)
        self.axis, self.cut, self.kids, self.n = [], [], [], 0
        stack = [(np.arange(len(xy)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            if parent >= 0:
                self.kids[parent][side] = len(self.axis)
            axis, cut = self._cut(xy[rows], most)
            self.axis.append(axis)
            self.cut.append(cut)
            self.kids.append([self.n, self.n])
            if axis < 0:
                self.n += 1
                continue
            low = xy[rows, axis] < cut
            stack += [(rows[~low], len(self.axis) - 1, 1), (rows[low], len(self.axis) - 1, 0)]
        self.axis, self.cut, self.kids = np.array(self.axis), np.array(self.cut), np.array(self.kids)

    @staticmethod
    def _cut(xy: np.ndarray, most: int) -> tuple[int, float]:
        """Axis and place of a cut with rows on both its sides; -1 if there are few rows or all lie in one place."""
        if len(xy) > most:
            with np.errstate(over="ignore"):
                axes = np.argsort(xy.min(axis=0) - xy.max(axis=0), kind="stable")
            for axis in axes:
                v = np.sort(xy[:, axis])
                if v[0] < v[-1]:
                    at = v[len(v) // 2]
                    return int(axis), float(at if at > v[0] else v[np.searchsorted(v, at, "right")])
        return -1, 0.0

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            open_ = open_[self.axis[node[open_]] >= 0]
            if not len(open_):
                return self.kids[node, 0].astype(np.int32)
            at = node[open_]
            v = np.where(self.axis[at] == 0, x[open_], y[open_])
            node[open_] = self.kids[at, (v >= self.cut[at]).astype(np.int64)]


class Tree:
    """Boxes in a binary tree; each node knows the box of all below it. Points are boxes without extent.

    Squared distances to boxes come by the operations that give those to points. These round monotonically, so no box is
    farther than a point in it, to the last bit, and leaving out boxes beyond the best so far is exact, ties included.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, leaf: int):
        middle = lo / 2 + hi / 2
        self.rows, self.box, self.kids = [], [], []
        stack = [(np.arange(len(lo)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            if parent >= 0:
                self.kids[parent][side] = len(self.box)
            self.box.append((*lo[rows].min(axis=0), *hi[rows].max(axis=0)))
            self.kids.append([-1, -1])
            self.rows.append(np.sort(rows) if len(rows) <= leaf else None)
            if len(rows) > leaf:
                m = middle[rows]
                with np.errstate(over="ignore"):
                    axis = int(np.argmax(m.max(axis=0) - m.min(axis=0)))
                half = np.argpartition(m[:, axis], len(rows) // 2)
                stack += [(rows[half[len(rows) // 2 :]], len(self.box) - 1, 1), (rows[half[: len(rows) // 2]], len(self.box) - 1, 0)]

    def apart(self, node: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.box[node]
        dx, dy = np.maximum(np.maximum(x0 - px, px - x1), 0.0), np.maximum(np.maximum(y0 - py, py - y1), 0.0)
        return dx * dx + dy * dy

    def descend(self, px: np.ndarray, py: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves as (rows, places): each place goes down to one, by the nearer box."""
        stack = [(0, np.arange(len(px)))]
        while stack:
            node, places = stack.pop()
            if not len(places):
                continue
            if self.rows[node] is not None:
                yield self.rows[node], places
                continue
            a, b = self.kids[node]
            near = self.apart(a, px[places], py[places]) <= self.apart(b, px[places], py[places])
            stack += [(b, places[~near]), (a, places[near])]

    def visit(self, px: np.ndarray, py: np.ndarray, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves as (rows, places): each place goes to all whose boxes lie no farther than its ``best``, which may shrink meanwhile."""
        stack = [(0, np.arange(len(px)))]
        while stack:
            node, places = stack.pop()
            places = places[self.apart(node, px[places], py[places]) <= best[places]]
            if not len(places):
                continue
            if self.rows[node] is not None:
                yield self.rows[node], places
            else:
                stack += [(k, places) for k in reversed(self.kids[node])]


def nearest_of(tree: Tree, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of ``x, y`` no farther than ``best``: the first of several, -1 if none."""
    found, best = np.full(len(px), -1), best.copy()
    with np.errstate(over="ignore"):
        for rows, places in chain(tree.descend(px, py), tree.visit(px, py, best)):
            for at in range(0, len(places), AT_ONCE // LEAF):
                p = places[at : at + AT_ONCE // LEAF]
                dx, dy = x[rows] - px[p, None], y[rows] - py[p, None]
                d2 = dx * dx + dy * dy
                k = d2.argmin(axis=1)
                d2, k = d2[np.arange(len(p)), k], rows[k]
                better = (d2 < best[p]) | (d2 == best[p]) & ((found[p] < 0) | (k < found[p]))
                best[p[better]], found[p[better]] = d2[better], k[better]
    return found, best


def _search(targets: DataFrame, asked: DataFrame) -> DataFrame:
    """``(cell, px, py, d2, vid)``: the best target of the cells that ``asked (cell, px, py, d2)`` names, if none is farther than ``d2``.

    A task holds the targets of one cell, and the places stream past. A cell that many places ask is there several times.
    """
    copies = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / PASSING).cast("int").alias("k")))
    kind = targets.schema["vid"].dataType
    held = targets.join(copies, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    held = held.select("cell", "copy", F.lit(0).alias("kind"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(0.0).alias("d2"), "vid")
    places = asked.join(copies, "cell").withColumn("copy", F.pmod(F.xxhash64("px", "py"), F.col("k")).cast("int"))
    places = places.withColumns({"kind": F.lit(1), "vid": F.lit(None).cast(kind)}).select(*held.columns)
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(places).repartition(n, "cell", "copy").sortWithinPartitions("cell", "copy", "kind")
    names = ["cell", "px", "py", "d2", "vid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, tree, waiting, n_waiting = None, [], None, [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, kept, waiting, n_waiting
            if waiting and kept:
                if tree is None:
                    t = pa.Table.from_batches(kept)
                    t = t.take(pc.sort_indices(t["vid"])).combine_chunks()
                    xy = np.stack([t["px"].to_numpy(), t["py"].to_numpy()], axis=1)
                    tree = (Tree(xy, xy, LEAF), xy[:, 0].copy(), xy[:, 1].copy(), t["vid"].combine_chunks())
                q = pa.Table.from_batches(waiting)
                px, py = q["px"].to_numpy(), q["py"].to_numpy()
                found, d2 = nearest_of(*tree[:3], px, py, q["d2"].to_numpy())
                hit = found >= 0
                vid = tree[3].take(pa.array(found[hit]))
                vid = vid.combine_chunks() if isinstance(vid, pa.ChunkedArray) else vid
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), now[0], np.int32)), pa.array(px[hit]), pa.array(py[hit]), pa.array(d2[hit]), vid], names)
            waiting, n_waiting = [], 0

        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                if tuple(key[a, :2]) != now:
                    yield from answer()
                    now, kept, tree = tuple(key[a, :2]), [], None
                if key[a, 2] == 0:
                    kept.append(b.slice(a, z - a))
                    continue
                waiting.append(b.slice(a, z - a))
                n_waiting += z - a
                if n_waiting >= PASSING:
                    yield from answer()
        yield from answer()

    return rows.mapInArrow(run, StructType([StructField("cell", IntegerType()), *[StructField(c, DoubleType()) for c in names[1:4]], StructField("vid", kind)]))


def nearest_to_places(places: DataFrame, targets: DataFrame, cell: int = CELL) -> DataFrame:
    """``(px, py, d2, vid)``: of each distinct place the nearest of ``targets (vid, x, y)``, ties to the smaller id; coordinates are finite doubles.

    Targets are dealt into cells of about ``cell`` by cuts fitted on a sample; every target is filed. Each place is searched for in the
    cell whose box is nearest, then in all others whose boxes lie no farther than what it found there.
    """
    t = materialize(targets.groupBy("x", "y").agg(F.min("vid").alias("vid")).select("vid", "x", "y"), "nearest")
    n = t.count()
    places = places.select("px", "py").distinct()
    if not n:
        return places.where("false").select("px", "py", F.lit(0.0).alias("d2"), F.lit(None).cast(t.schema["vid"].dataType).alias("vid"))
    n_cells = -(-n // cell)
    share = int((1 << 30) * min(1.0, SAMPLED * n_cells / n)) if n_cells > 1 else 0
    picked = t.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < share).select("x", "y").toArrow()
    cells = Cells(picked["x"].to_numpy(), picked["y"].to_numpy(), SAMPLED)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells.of(b.column(1).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    filed = materialize(t.mapInArrow(file, StructType([*t.schema.fields, StructField("cell", IntegerType())])), "nearest")
    box = filed.groupBy("cell").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toArrow()
    own, *box = [c.to_numpy() for c in box.columns]
    tree = Tree(np.stack(box[:2], axis=1), np.stack(box[2:], axis=1), 1)
    asked, columns = "cell int, px double, py double, d2 double", ["cell", "px", "py", "d2"]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px, py, at = b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, np.int32)
            with np.errstate(over="ignore"):
                for rows, ask in tree.descend(px, py):
                    at[ask] = own[rows[0]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, px, py, np.full(len(px), np.inf))], columns)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, px, py, d2 = (b.column(k).to_numpy() for k in range(4))
            with np.errstate(over="ignore"):
                for rows, ask in tree.visit(px, py, d2):
                    ask = ask[at[ask] != own[rows[0]]]
                    if len(ask):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(ask), own[rows[0]], np.int32), px[ask], py[ask], d2[ask])], columns)

    found = materialize(_search(filed, materialize(places.mapInArrow(home, asked), "nearest")), "nearest")
    best = found.select("px", "py", "d2", "vid")
    if len(own) > 1:
        more = _search(filed, materialize(found.select(*columns).mapInArrow(others, asked), "nearest"))
        best = best.unionByName(more.select("px", "py", "d2", "vid"))
    return best.groupBy("px", "py").agg(F.min(F.struct("d2", "vid")).alias("s")).select("px", "py", "s.*")
