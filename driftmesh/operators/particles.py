"""Particle tracing: seeds, and Runge-Kutta steps through interpolated velocity snapshots.

Particles are the large side and stay partitioned; a step pair of snapshots is the small one. Its size
is checked before it is broadcast; a larger field is dealt in spatial tiles with a halo, and
particles are dealt anew after each step, so no task holds the whole field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import multilinear, rk4, spherical_rk4
from ..sources.storage import materialize
from .fields import axes_of

BROADCAST_VALUES = 20_000_000


def seed_grid(spark: SparkSession, shape: tuple[int, ...], strides: tuple[int, ...] | None = None, margin: int = 0) -> DataFrame:
    """One particle at every lattice point (every ``strides`` one along each axis)."""
    strides = strides or (1,) * len(shape)
    sizes = [max(0, -(-(n - 2 * margin) // s)) for n, s in zip(shape, strides)]
    rest, cols = F.col("id"), []
    for a, n, s in zip("xyz", sizes, strides):
        cols.append((rest % n * s + margin).cast("double").alias(a))
        rest = F.floor(rest / n)
    return spark.range(int(np.prod(sizes))).select("id", *cols, F.lit(0.0).alias("t"))


def seed_points(spark: SparkSession, points: list[tuple[float, ...]]) -> DataFrame:
    axes = "xyz"[: len(points[0])]
    return spark.createDataFrame([(n, *map(float, p), 0.0) for n, p in enumerate(points)], "id long, " + ", ".join(f"{a} double" for a in axes) + ", t double")


def seed_lat_lon(
    spark: SparkSession, lat: tuple[int, float, float], lon: tuple[int, float, float], depth: tuple[int, float, float], radius: float = 6371229.0
) -> DataFrame:
    """Particles on a latitude, longitude, depth box (count, first, last of each), in Cartesian coordinates."""
    (na, a0, a1), (no, o0, o1), (nz, z0, z1) = lat, lon, depth

    def at(k, n, lo, hi):
        return F.lit(lo) + k * ((hi - lo) / max(1, n - 1))

    n = F.col("id")
    la, lo = F.radians(at(n % na, na, a0, a1)), F.radians(at(F.floor(n / na) % no, no, o0, o1))
    r = at(F.floor(n / (na * no)), nz, z0, z1) + radius
    return spark.range(na * no * nz).select(
        "id", (r * F.cos(la) * F.cos(lo)).alias("x"), (r * F.cos(la) * F.sin(lo)).alias("y"), (r * F.sin(la)).alias("z"), F.lit(0.0).alias("t")
    )


def _snapshot(pdf: pd.DataFrame, axes: list[str], cols: list[str], shape: tuple[int, ...]) -> np.ndarray:
    out = np.full((*shape, len(cols)), np.nan)
    out[tuple(pdf[a].to_numpy() for a in axes)] = pdf[cols].to_numpy(float)
    return out


def trace_particles(
    field: DataFrame, seeds: DataFrame, shape: tuple[int, ...], steps: int, per_step: int = 16, checkpoint: int | None = None, cols: tuple[str, ...] = ("u", "v", "w")
) -> DataFrame:
    """``(id, seq, t, x, y[, z])``: particle positions at every ``checkpoint`` substeps through all step pairs.

    Velocities are multilinear in space and linear in time; a particle ends where it leaves the domain, and what it
    has passed stays. Fields of over ``BROADCAST_VALUES`` values a step pair are refused here: cut them in tiles first.
    """
    axes, d = axes_of(field), len(shape)
    cols = list(cols[:d])
    if 2 * int(np.prod(shape)) * d > BROADCAST_VALUES:
        raise ValueError("a pair of snapshots is too large to be sent whole; trace by tiles (trace_particles_tiled)")
    spark = field.sparkSession
    names = list("xyz"[:d])
    every = checkpoint or per_step
    now = materialize(seeds.select("id", F.lit(0).alias("seq"), F.col("t"), *names), "particles")
    out = [now]
    for k in range(steps - 1):
        pair = [_snapshot(field.where(F.col("t") == k + s).select(*axes, *cols).toPandas(), axes, cols, shape) for s in (0, 1)]
        shared = spark.sparkContext.broadcast(pair)

        def move(frames: Iterator[pd.DataFrame], k=k, shared=shared) -> Iterator[pd.DataFrame]:
            a, b = shared.value

            def f(p: np.ndarray) -> np.ndarray:
                w = (p[:, d] - k)[:, None]
                v = (1 - w) * multilinear(a, p[:, :d]) + w * multilinear(b, p[:, :d])
                return np.concatenate((v, np.ones((len(p), 1))), axis=1)

            for pdf in frames:
                p = pdf[[*names, "t"]].to_numpy(float)
                ids, seq = pdf["id"].to_numpy(), pdf["seq"].to_numpy()
                rows = []
                for n in range(per_step):
                    p = rk4(f, p, 1.0 / per_step)
                    ok = np.isfinite(p).all(axis=1)
                    p, ids, seq = p[ok], ids[ok], seq[ok]
                    if (n + 1) % every == 0 or n + 1 == per_step:
                        seq = seq + 1
                        rows.append(pd.DataFrame({"id": ids, "seq": seq, "t": p[:, d]} | {a: p[:, m] for m, a in enumerate(names)} | {"last": n + 1 == per_step}))
                yield pd.concat(rows)

        schema = "id long, seq int, t double, " + ", ".join(f"{a} double" for a in names) + ", last boolean"
        step = materialize(now.mapInPandas(move, schema), "particles")
        out.append(step.drop("last"))
        now = step.where("last").drop("last")
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def trace_particles_tiled(field: DataFrame, seeds: DataFrame, shape: tuple[int, ...], steps: int, per_step: int = 16, tile: int = 64, halo: int = 4, cols: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """As ``trace_particles`` for fields of any size: particles meet the tile that they are in, and its ``halo`` of points around.

    A particle that leaves its tile's halo within a step waits at its last substep and is dealt to the next tile in another round. One
    that can't make a single substep from its own tile ends there: it has left the domain (or moves by more than the halo at once).
    """
    axes, d = axes_of(field), len(shape)
    cols, names = list(cols[:d]), list("xyz"[:d])
    now = materialize(seeds.select("id", F.lit(0).alias("seq"), "t", *names), "particles")
    out, keys = [now], [f"a{n}" for n in range(d)]
    schema = "id long, seq int, n int, t double, " + ", ".join(f"{a} double" for a in names)

    def mover(k: int):
        def move(p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            want = ["id", "seq", "n", "t", *names]
            if not len(p) or not len(g):
                return pd.DataFrame({c: [] for c in want})
            low = g[axes].min().to_numpy()
            size = tuple(g[axes].max().to_numpy() - low + 1)
            a, b = (_snapshot(g[g["s"] == s].assign(**{x: g[x] - o for x, o in zip(axes, low)}), axes, cols, size) for s in (0, 1))

            def f(q: np.ndarray) -> np.ndarray:
                w = (q[:, d] - k)[:, None]
                v = (1 - w) * multilinear(a, q[:, :d] - low) + w * multilinear(b, q[:, :d] - low)
                return np.concatenate((v, np.ones((len(q), 1))), axis=1)

            q, n, first = p[[*names, "t"]].to_numpy(float), p["n"].to_numpy().copy(), p["n"].to_numpy()
            live = np.flatnonzero(n < per_step)
            while len(live):
                new = rk4(f, q[live], 1.0 / per_step)
                ok = np.isfinite(new).all(axis=1)
                live, new = live[ok], new[ok]
                q[live] = new
                n[live] += 1
                live = live[n[live] < per_step]
            on = n > first
            return pd.DataFrame({"id": p["id"].to_numpy()[on], "seq": p["seq"].to_numpy()[on], "n": n[on], "t": q[on, d]} | {c: q[on, m] for m, c in enumerate(names)})

        return move

    for k in range(steps - 1):
        part = field.where(F.col("t").isin(k, k + 1)).select((F.col("t") - k).cast("int").alias("s"), *axes, *cols)
        for m, a in enumerate(axes):
            lo, hi = F.floor((F.col(a) - halo - 1) / tile), F.floor((F.col(a) + halo) / tile)
            part = part.withColumn(f"a{m}", F.explode(F.sequence(lo, hi)))
        part = materialize(part, "tiles")
        waiting, ended = now.select("id", "seq", F.lit(0).alias("n"), "t", *names), None
        while True:
            at = waiting.withColumns({f"a{m}": F.floor(F.col(c) / tile) for m, c in enumerate(names)})
            moved = materialize(at.groupBy(*keys).cogroup(part.groupBy(*keys)).applyInPandas(mover(k), schema), "particles")
            done = moved.where(F.col("n") == per_step)
            ended = done if ended is None else ended.unionByName(done)
            waiting = moved.where(F.col("n") < per_step)
            if waiting.isEmpty():
                break
        now = materialize(ended.select("id", (F.col("seq") + 1).alias("seq"), "t", *names), "particles")
        out.append(now)
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def trace_on_sphere(seeds: DataFrame, velocity, steps: int, h: float) -> DataFrame:
    """Particles on a sphere through a velocity function of (n, 3) points, which may give a vertical fourth component."""

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p, rows = pdf[["x", "y", "z"]].to_numpy(float), []
            for n in range(steps + 1):
                rows.append(pd.DataFrame({"id": pdf["id"].to_numpy(), "seq": n, "t": n * h, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
                p = spherical_rk4(velocity, p, h)
            yield pd.concat(rows)

    return seeds.select("id", "x", "y", "z").mapInPandas(move, "id long, seq int, t double, x double, y double, z double")


def poincare(seeds: DataFrame, field_line, turns: int, per_turn: int = 64) -> DataFrame:
    """``(id, turn, r, z)``: punctures of field lines dr/dphi, dz/dphi = field_line(r, z, phi) through the plane phi = 0."""
    h = 2 * np.pi / per_turn

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(p: np.ndarray) -> np.ndarray:
            dr, dz = field_line(p[:, 0], p[:, 1], p[:, 2])
            return np.stack((dr, dz, np.ones(len(p))), axis=1)

        for pdf in frames:
            p = np.concatenate((pdf[["r", "z"]].to_numpy(float), np.zeros((len(pdf), 1))), axis=1)
            rows = []
            for turn in range(turns + 1):
                rows.append(pd.DataFrame({"id": pdf["id"].to_numpy(), "turn": turn, "r": p[:, 0], "z": p[:, 1]}))
                for _ in range(per_turn):
                    p = rk4(f, p, h)
            yield pd.concat(rows)

    return seeds.select("id", "r", "z").mapInPandas(move, "id long, turn int, r double, z double")
