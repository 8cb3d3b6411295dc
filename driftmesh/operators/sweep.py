"""The sweep: every simplex of the space-time mesh is tested once, tile by tile.

A point is sent to the tile of its own corner cell and to those of the lower neighbours whose cells it
closes, so a tile holds a core and a one-point halo, and cells never meet in a join. Each
tile is a task's unit: it becomes dense arrays, and a predicate runs over all its cells of a type at once.
The tiles of one step pair are as many as the domain has; hits are far fewer than cells.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mesh import Lattice, is_ordinal, unit_simplices
from .fields import axes_of

TILE = 64
POINT = "tag long, kind int, timestep long, ordinal boolean"

#: values (n, k+1, c), vertex coordinates (n, k+1, d), vertex ids (n, k+1) -> (kept rows, columns of the hits)
Predicate = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]


def tiled(df: DataFrame, cols: list[str], tile: int = TILE, t_tile: int = 4) -> DataFrame:
    """Points with the tiles that need them: ``a0 .. `` are tile numbers along i, j[, k], t."""
    axes = [*axes_of(df), "t"]
    out = df.select(*[F.col(a).cast("long").alias(a) for a in axes], *[F.col(c).cast("double").alias(c) for c in cols])
    for n, a in enumerate(axes):
        size = t_tile if a == "t" else tile
        own, low = F.floor(F.col(a) / size), F.floor((F.col(a) - 1) / size)
        out = out.withColumn(f"a{n}", F.explode(F.array_distinct(F.array(own, low))))
    return out


def sweep(
    df: DataFrame, cols: list[str], lattice: Lattice, k: int, predicate: Predicate, schema: str, tile: int = TILE, t_tile: int = 4, scope: str = "all"
) -> DataFrame:
    """Hits of a predicate among the k-simplices inside ``lattice`` (time last).

    ``df`` has ``t``, lattice coordinates and the value columns. Cells with a missing, null or non-finite vertex value
    are no hits. ``scope`` is all, ordinal (one time) or interval. The result has ``tag, kind, timestep, ordinal``
    and the predicate's own columns.
    """
    axes = [*axes_of(df), "t"]
    d = len(axes)
    types = unit_simplices(d, k)
    want = {"all": (True, False), "ordinal": (True,), "interval": (False,)}[scope]
    groups = [f"a{n}" for n in range(d)]
    names = [s.split()[0] for s in (POINT + ", " + schema).split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = np.array([int(pdf[g].iloc[0]) * (t_tile if a == "t" else tile) for g, a in zip(groups, axes)])
        size = np.array([(t_tile if a == "t" else tile) + 1 for a in axes])
        at = tuple(pdf[a].to_numpy() - b for a, b in zip(axes, base))
        field = np.full((*size, len(cols)), np.nan)
        field[at] = pdf[cols].to_numpy(float)
        lo = np.maximum(base, lattice.starts)
        hi = np.minimum(base + size - 1, np.array(lattice.starts) + np.array(lattice.sizes))  # corners below
        if (hi <= lo).any():
            return pd.DataFrame({n: [] for n in names})
        corner = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(a, b) for a, b in zip(lo, hi)], indexing="ij")], axis=1)
        end = np.array(lattice.starts) + np.array(lattice.sizes)
        out = []
        for kind, simplex in enumerate(types):
            if is_ordinal(simplex) not in want:
                continue
            off = np.array(simplex)
            c = corner[(corner + off.max(axis=0) < end).all(axis=1)]
            if not len(c):
                continue
            x = c[:, None, :] + off[None]
            v = field[tuple(np.moveaxis(x - base, 2, 0))]
            ok = np.isfinite(v).all(axis=(1, 2))
            c, x, v = c[ok], x[ok], v[ok]
            if not len(c):
                continue
            ids = lattice.linear(np.moveaxis(x, 2, 0))
            rows, got = predicate(v, x.astype(float), ids)
            if not len(rows):
                continue
            tag = lattice.linear(c[rows].T) * len(types) + kind
            out.append(pd.DataFrame({"tag": tag, "kind": kind, "timestep": c[rows, -1], "ordinal": is_ordinal(simplex)} | got))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    return tiled(df, cols, tile, t_tile).groupBy(*groups).applyInPandas(run, f"{POINT}, {schema}")


def cells(spark, lattice: Lattice, k: int) -> DataFrame:
    """All k-simplices inside a lattice as rows ``tag, kind, ordinal, c0 .. `` (corner)."""
    types = unit_simplices(lattice.nd, k)
    table = spark.createDataFrame(
        [(n, is_ordinal(s), *[max(v[a] for v in s) for a in range(lattice.nd)]) for n, s in enumerate(types)],
        "kind int, ordinal boolean, " + ", ".join(f"m{a} int" for a in range(lattice.nd)),
    )
    total = int(np.prod(lattice.sizes))
    rest, cols = F.col("id"), []
    for a, (s, n) in enumerate(zip(lattice.starts, lattice.sizes)):
        cols.append((rest % n + s).alias(f"c{a}"))
        rest = F.floor(rest / n)
    out = spark.range(total).select("id", *cols).crossJoin(F.broadcast(table))
    for a, (s, n) in enumerate(zip(lattice.starts, lattice.sizes)):
        out = out.where(F.col(f"c{a}") + F.col(f"m{a}") < s + n)
    return out.select((F.col("id") * len(types) + F.col("kind")).alias("tag"), "kind", "ordinal", *[f"c{a}" for a in range(lattice.nd)])


def offsets_table(table: tuple[tuple[tuple[int, tuple[int, ...]], ...], ...]) -> list[tuple]:
    """Rows (kind, other kind, corner offset ...) of a sides or cofaces table for each kind."""
    return [(n, other, *off) for n, row in enumerate(table) for other, off in row]


def all_offsets(d: int) -> list[tuple[int, ...]]:
    return list(product((0, 1), repeat=d))
