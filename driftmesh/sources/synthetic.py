"""Synthetic fields as DataFrames: a lattice from ``spark.range`` and Column mathematics, nothing on the driver.

Grids have columns ``t, [k,] j, i`` (i varies fastest) and ``f`` or ``u, v[, w]``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, shape: tuple[int, ...], steps: int = 1) -> DataFrame:
    """Lattice points: ``shape`` is (W, H[, D]); the linear id gives the coordinates."""
    names = ["i", "j", "k"][: len(shape)]
    n = math.prod(shape)
    df, rest = spark.range(n * steps), F.col("id")
    cols = []
    for name, size in zip(names, shape):
        cols.append((rest % size).cast("int").alias(name))
        rest = F.floor(rest / size)
    return df.select(rest.cast("long").alias("t"), *reversed(cols))


def _unit(x: Column, n: int) -> Column:
    return x / F.lit(float(max(n - 1, 1)))


# closed forms as Columns
def woven(x: Column, y: Column, t: Column) -> Column:
    return F.cos(x * F.cos(t) - y * F.sin(t)) * F.sin(x * F.sin(t) + y * F.cos(t))


def woven_dx(x: Column, y: Column, t: Column) -> Column:
    a, b = x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)
    return F.cos(a) * F.cos(b) * F.sin(t) - F.sin(a) * F.sin(b) * F.cos(t)


def woven_dy(x: Column, y: Column, t: Column) -> Column:
    a, b = x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)
    return F.cos(a) * F.cos(b) * F.cos(t) + F.sin(a) * F.sin(b) * F.sin(t)


def gyre(x: Column, y: Column, t: Column, amp: float, omega: float, eps: float) -> tuple[Column, Column]:
    a = eps * F.sin(omega * t)
    f = a * x * x + (1 - 2 * a) * x
    df = 2 * a * x + 1 - 2 * a
    u = -math.pi * amp * F.sin(math.pi * f) * F.cos(math.pi * y)
    return u, math.pi * amp * F.cos(math.pi * f) * F.sin(math.pi * y) * df


def merger(x: Column, y: Column, t: Column) -> Column:
    """Larger of two Gaussians that turn about the origin as they drift together and apart."""
    s, c = F.sin(t), F.cos(t)
    x1, y1 = x * c - y * s, x * s + y * c
    mid = 1e-4
    gap = F.cos(t)

    def bump(cx: Column) -> Column:
        return F.exp(-((x1 - cx) * (x1 - cx) + (y1 - mid) * (y1 - mid)))

    return F.greatest(bump(gap), bump(-gap))


def woven_grid(spark: SparkSession, w: int = 32, h: int = 32, steps: int = 32, scale: float = 15.0, offset: float = 0.0, fixed_t: float | None = None) -> DataFrame:
    """Spiral woven scalar; time runs from 0 to 1 (plus ``offset``), or stays at ``fixed_t``."""
    g = grid(spark, (w, h), steps)
    t = F.lit(fixed_t) if fixed_t is not None else F.col("t") / F.lit(float(max(steps - 1, 1))) + offset
    x, y = ((_unit(F.col("i"), w) - 0.5) * scale), ((_unit(F.col("j"), h) - 0.5) * scale)
    return g.withColumn("f", woven(x, y, t))


def woven_part(spark: SparkSession, w: int, h: int, i0: int, i1: int, j0: int, j1: int, steps: int = 1) -> DataFrame:
    """A block of the woven grid; the filter prunes points before any value is computed."""
    return woven_grid(spark, w, h, steps).where(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))


def capped_woven_gradient(spark: SparkSession, w: int, h: int, t: float = 1e-4, cap: float = 10.0, scale: float = 15.0) -> DataFrame:
    g = grid(spark, (w, h))
    x, y, tt = (_unit(F.col("i"), w) - 0.5) * scale, (_unit(F.col("j"), h) - 0.5) * scale, F.lit(t)
    f = woven(x, y, tt)
    keep = f < cap
    return g.select(
        "*", F.when(keep, woven_dx(x, y, tt)).otherwise(0.0).alias("u"), F.when(keep, woven_dy(x, y, tt)).otherwise(0.0).alias("v"), F.lit(0.0).alias("w")
    )


def woven_on(vertices: DataFrame, times: list[float], centre: tuple[float, float] = (0.5, 0.5), scale: float = 10.0) -> DataFrame:
    ts = vertices.sparkSession.createDataFrame(list(enumerate(times)), "t long, tt double")
    return vertices.crossJoin(F.broadcast(ts)).select("t", "vid", woven((F.col("x") - centre[0]) * scale, (F.col("y") - centre[1]) * scale, F.col("tt")).alias("f"))


def double_gyre(
    spark: SparkSession, w: int = 64, h: int = 32, steps: int = 50, time_scale: float = 0.1, start: float = 0.0, amp: float = 0.1, omega: float = 2 * math.pi, eps: float = 0.25
) -> DataFrame:
    """Double gyre velocities on [0,2] x [0,1]; 2 pi is the stream's frequency, 0.2 pi the plain generator's."""
    g = grid(spark, (w, h), steps)
    x, y = _unit(F.col("i"), w) * 2.0, _unit(F.col("j"), h)
    u, v = gyre(x, y, F.col("t") * time_scale + start, amp, omega, eps)
    return g.withColumns({"u": u, "v": v})


def double_gyre_on(vertices: DataFrame, times: list[float], amp: float = 0.1, omega: float = 0.2 * math.pi, eps: float = 0.25) -> DataFrame:
    ts = vertices.sparkSession.createDataFrame(list(enumerate(times)), "t long, tt double")
    u, v = gyre(F.col("x"), F.col("y"), F.col("tt"), amp, omega, eps)
    return vertices.crossJoin(F.broadcast(ts)).select("t", "vid", u.alias("u"), v.alias("v"))


def abc_flow(spark: SparkSession, w: int, h: int, d: int, a: float = math.sqrt(3), b: float = math.sqrt(2), c: float = 1.0) -> DataFrame:
    g = grid(spark, (w, h, d))
    x, y, z = (_unit(F.col(n), s) * 2 * math.pi for n, s in (("i", w), ("j", h), ("k", d)))
    return g.withColumns({"u": a * F.sin(z) + c * F.cos(y), "v": b * F.sin(x) + a * F.cos(z), "w": c * F.sin(y) + b * F.cos(x)})


def merger_grid(spark: SparkSession, w: int = 32, h: int = 32, steps: int = 100, dt: float = 0.1) -> DataFrame:
    g = grid(spark, (w, h), steps)
    x, y = _unit(F.col("i"), w) * 4.0 - 2.0, _unit(F.col("j"), h) * 4.0 - 2.0
    return g.withColumn("f", merger(x, y, F.col("t") * dt))


def moving_ramp(spark: SparkSession, shape: tuple[int, ...] = (21, 21, 21), steps: int = 32, x0: float = 10.0, rate: float = 0.1) -> DataFrame:
    return grid(spark, shape, steps).withColumn("f", F.col("i") - (x0 + rate * F.col("t")))


def moving_dual_ramp(spark: SparkSession, shape: tuple[int, ...] = (21, 21, 21), steps: int = 32, x0: float = 10.0, rate: float = 0.7, offset: float = 2.0) -> DataFrame:
    return grid(spark, shape, steps).withColumn("f", F.abs(F.col("i") - x0) - rate * (F.col("t") + offset))


def moving_extremum(
    spark: SparkSession, shape: tuple[int, ...] = (21, 21), steps: int = 32, x0: tuple[float, ...] | None = None, direction: tuple[float, ...] | None = None
) -> DataFrame:
    """Squared distance to a centre that moves evenly; 2 or 3 dimensions."""
    x0 = x0 or (10.0,) * len(shape)
    direction = direction or (0.1, 0.1, 0.1)[: len(shape)]
    f = sum((F.col(n) - c - d * F.col("t")) ** 2 for n, c, d in zip("ijk", x0, direction))
    return grid(spark, shape, steps).withColumn("f", f)


def moving_extremum_on(vertices: DataFrame, x0: tuple[float, ...], direction: tuple[float, ...], steps: int, gradient: bool = False) -> DataFrame:
    """Moving extremum on mesh vertices; ``gradient`` gives the negated gradient's direction instead."""
    axes = ["x", "y", "z"][: len(x0)]
    ts = vertices.sparkSession.range(steps).withColumnRenamed("id", "t")
    off = {a: F.col(a) - c - d * F.col("t") for a, c, d in zip(axes, x0, direction)}
    out = vertices.crossJoin(F.broadcast(ts))
    if gradient:
        return out.select("t", "vid", *[(-2.0 * off[a]).alias(n) for a, n in zip(axes, "uvw")])
    return out.select("t", "vid", sum(v * v for v in off.values()).alias("f"))


def volcano(spark: SparkSession, shape: tuple[int, ...] = (21, 21), steps: int = 32, x0: tuple[float, ...] | None = None, radius: float = 3.0) -> DataFrame:
    x0 = x0 or (10.0,) * len(shape)
    d = F.sqrt(sum((F.col(n) - c) ** 2 for n, c in zip("ijk", x0)))
    return grid(spark, shape, steps).withColumn("f", F.exp(-((d - (radius + F.col("t"))) ** 2)))


def tornado(spark: SparkSession, n: tuple[int, int, int] = (32, 32, 32), steps: int = 1) -> DataFrame:
    """A tornado-like vector field around a moving, twisting axis."""
    g = grid(spark, n, steps)
    x, y, z = (_unit(F.col(a), s) for a, s in zip("ijk", n))
    t = F.col("t").cast("double")
    xc = 0.5 + 0.1 * F.sin(0.04 * t + 10.0 * z)
    yc = 0.5 + 0.1 * F.cos(0.03 * t + 3.0 * z)
    r = 0.1 + 0.4 * z * z + 0.1 * z * F.sin(8.0 * z)
    r2 = 0.2 + 0.1 * z
    far = F.sqrt((y - yc) ** 2 + (x - xc) ** 2)
    scale = F.abs(r - far)
    scale = F.when(scale > r2, 0.8 - scale).otherwise(1.0)
    z0 = F.greatest(F.lit(0.0), 0.1 * (0.1 - far * z))
    up = F.sqrt(far * far + z0 * z0)
    scale = (r + r2 - up) * scale / (up + 1e-11)
    scale = scale / (1 + z)
    return g.withColumns({"u": scale * (y - yc) + 0.1 * (x - xc), "v": -scale * (x - xc) + 0.1 * (y - yc), "w": scale * z0})


SOURCES = {
    "woven": woven_grid,
    "double_gyre": double_gyre,
    "merger_2d": merger_grid,
    "moving_extremum_2d": moving_extremum,
    "moving_extremum_3d": lambda spark, **kw: moving_extremum(spark, **({"shape": (21, 21, 21), "direction": (0.1, 0.11, 0.1)} | kw)),
    "moving_ramp_3d": moving_ramp,
    "moving_dual_ramp_3d": moving_dual_ramp,
    "volcano_2d": volcano,
    "tornado": tornado,
    "abc": abc_flow,
}


def synthetic(spark: SparkSession, name: str, **options) -> DataFrame:
    """Any synthetic source by its name."""
    if name not in SOURCES:
        raise ValueError(f"no synthetic source {name!r}; there are {', '.join(SOURCES)}")
    return SOURCES[name](spark, **options)
