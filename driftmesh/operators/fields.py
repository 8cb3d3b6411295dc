"""Field operators: projections, per-point transforms, aggregates and stencils on lattice DataFrames.

A field has ``t``, lattice coordinates (``i`` fastest, then ``j``, ``k``) and value columns. Stencils are
window functions along one axis, so each axis costs one shuffle by line and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import gaussian_kernel

AXES = ("i", "j", "k")


def axes_of(df: DataFrame) -> list[str]:
    return [a for a in AXES if a in df.columns]


# projections and filters
def components(df: DataFrame, *names: str, out: str = "v") -> DataFrame:
    """Value columns as one array column."""
    return df.select(*[c for c in df.columns if c not in names], F.array(*names).alias(out))


def stack(frames: list[DataFrame]) -> DataFrame:
    """Fields of one step each as one field, ``t`` numbering them."""
    out = None
    for t, df in enumerate(frames):
        part = df.drop("t").withColumn("t", F.lit(t).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def slice_box(df: DataFrame, starts: dict[str, int], sizes: dict[str, int], reorigin: bool = False) -> DataFrame:
    """Points in a box; with ``reorigin`` its corner becomes the origin."""
    for a, s in starts.items():
        df = df.where(F.col(a).between(s, s + sizes[a] - 1))
    return df.withColumns({a: (F.col(a) - s).cast("int") for a, s in starts.items()}) if reorigin else df


def slice_time(df: DataFrame, t: int) -> DataFrame:
    return df.where(F.col("t") == t)


def transpose(df: DataFrame) -> DataFrame:
    """Axes in reverse order."""
    axes = axes_of(df)
    return df.withColumns({a: F.col(b) for a, b in zip(axes, reversed(axes))})


def reshape(df: DataFrame, old: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """New lattice coordinates for the same linear ids."""
    axes = axes_of(df)
    linear, step = F.lit(0).cast("long"), 1
    for a, n in zip(axes, old):
        linear = linear + F.col(a) * step
        step *= n
    out, rest = {}, linear
    for a, n in zip(AXES, new):
        out[a] = (rest % n).cast("int")
        rest = F.floor(rest / n)
    keep = [c for c in df.columns if c not in AXES]
    return df.select(*[v.alias(a) for a, v in out.items()], *keep)


def clamp(df: DataFrame, low: float, high: float, col: str = "f") -> DataFrame:
    return df.withColumn(col, F.least(F.greatest(F.col(col), F.lit(low)), F.lit(high)))


def perturb(df: DataFrame, sigma: float, col: str = "f", seed: int = 0) -> DataFrame:
    """Gaussian noise that depends on the seed and the point alone, not on the partitioning."""
    key = [F.col(c) for c in ("t", *axes_of(df)) if c in df.columns]
    u1 = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    u2 = F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(1 << 40)) / float(1 << 40)
    return df.withColumn(col, F.col(col) + sigma * F.sqrt(-2 * F.log(u1)) * F.cos(6.283185307179586 * u2))


def elementwise(a: DataFrame, b: DataFrame, op: str, col: str = "f") -> DataFrame:
    """``+ - * /`` of two fields, point by point."""
    key = ["t", *reversed(axes_of(a))]
    x, y = F.col(col), F.col("__y")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return a.join(b.select(*key, F.col(col).alias("__y")), key).withColumn(col, value).drop("__y")


def quantize(df: DataFrame, scale: float, col: str = "f") -> DataFrame:
    return df.withColumn(col, (F.col(col) * scale).cast("long"))


def threshold(df: DataFrame, level: float, mode: str = "ge", col: str = "f") -> DataFrame:
    """``mask`` 1 where the comparison holds; modes ge, gt, le, lt."""
    c = F.col(col)
    hold = {"ge": c >= level, "gt": c > level, "le": c <= level, "lt": c < level}[mode]
    return df.withColumn("mask", F.when(hold, 1).otherwise(0))


# aggregates
def min_max(df: DataFrame, col: str = "f", by: tuple[str, ...] = ("t",)) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def max_abs(df: DataFrame, col: str = "f", by: tuple[str, ...] = ("t",)) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.abs(col)).alias("maxabs"))


def resolution(df: DataFrame, *cols: str, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Smallest nonzero magnitude."""
    each = [F.when(F.col(c) != 0, F.abs(F.col(c).cast("double"))) for c in cols or ("f",)]
    return df.groupBy(*by).agg(F.min(F.least(*each) if len(each) > 1 else each[0]).alias("resolution"))


def scaling_factor(df: DataFrame, *cols: str, least: int = 8, most: int = 21) -> DataFrame:
    """``(t, factor)``: 2 to the bits that resolve the smallest magnitude seen up to step t."""
    run = F.min("resolution").over(Window.orderBy("t"))
    bits = F.least(F.greatest(F.ceil(F.log2(1.0 / F.coalesce(run, F.lit(1.0)))), F.lit(least)), F.lit(most))
    return resolution(df, *cols).select("t", F.pow(F.lit(2.0), bits).cast("long").alias("factor"))


def roi_threshold(df: DataFrame, sigma: float, roi: Column, col: str = "f") -> DataFrame:
    """``(t, threshold)``: ``sigma`` standard deviations of the points in a region."""
    return df.where(roi).groupBy("t").agg((sigma * F.stddev_pop(col)).alias("threshold"))


# stencils
def _line(df: DataFrame, axis: str) -> Window:
    return Window.partitionBy("t", *[a for a in axes_of(df) if a != axis]).orderBy(axis)


def neighbour(df: DataFrame, col: str, axis: str, step: int, edge: str = "clamp") -> Column:
    """A value ``step`` points along an axis; at the edge the last one (``clamp``) or null."""
    w = _line(df, axis)
    got = F.lead(col, step).over(w) if step > 0 else F.lag(col, -step).over(w)
    return F.coalesce(got, F.col(col)) if edge == "clamp" else got


def difference(df: DataFrame, col: str, axis: str, scale: float = 1.0, edge: str = "clamp") -> Column:
    return (neighbour(df, col, axis, 1, edge) - neighbour(df, col, axis, -1, edge)) * F.lit(scale)


def gradient2d(df: DataFrame, w: int, h: int, col: str = "f", halved: bool = False) -> DataFrame:
    """``u, v``: central differences over the unit square. Edges repeat.

    ``halved`` gives the true derivative; without it the factor 1/2 is left out, which changes no zero and no sign.
    """
    k = 0.5 if halved else 1
    return df.withColumn("u", difference(df, col, "i", k * (w - 1))).withColumn("v", difference(df, col, "j", k * (h - 1)))


def gradient2dt(df: DataFrame, w: int, h: int, col: str = "f") -> DataFrame:
    """True derivatives on interior points, zero on the border."""
    u, v = (difference(df, col, a, 0.5 * (n - 1), "null") for a, n in (("i", w), ("j", h)))
    out = df.withColumn("u", u).withColumn("v", v)
    whole = F.col("u").isNotNull() & F.col("v").isNotNull()
    return out.withColumns({c: F.when(whole, F.col(c)).otherwise(0.0) for c in ("u", "v")})


def jacobian2d(df: DataFrame, w: int, h: int, symmetric: bool = False, compat: bool = False, u: str = "u", v: str = "v") -> DataFrame:
    """``j00 j01 j10 j11`` of a vector field, edges repeated; ``symmetric`` averages the mixed terms.

    ``compat`` scales the lower neighbour alone (f(+1) - f(-1) (n - 1)), as some published counts need.
    """

    def diff(c: str, a: str, n: int) -> Column:
        if compat:
            return neighbour(df, c, a, 1) - neighbour(df, c, a, -1) * (n - 1)
        return difference(df, c, a, n - 1)

    out = df.withColumn("j00", diff(u, "i", w)).withColumn("j10", diff(v, "i", w)).withColumn("j01", diff(u, "j", h)).withColumn("j11", diff(v, "j", h))
    if symmetric:
        mean = (F.col("j01") + F.col("j10")) * 0.5
        out = out.withColumn("__m", mean).withColumns({"j01": F.col("__m"), "j10": F.col("__m")}).drop("__m")
    return out


def _interior(df: DataFrame, cols: dict[str, Column], test: str) -> DataFrame:
    for name, c in cols.items():
        df = df.withColumn(name, c)
    whole = F.lit(True)
    for name in cols:
        whole = whole & F.col(name).isNotNull()
    return df.withColumns({name: F.when(whole, F.col(name)).otherwise(0.0) for name in cols})


def gradient3d(df: DataFrame, col: str = "f", scale: float = 0.5) -> DataFrame:
    """``u, v, w``: central differences with unit spacing, interior points only (zero elsewhere)."""
    return _interior(df, {n: difference(df, col, a, scale, "null") for n, a in zip("uvw", AXES)}, "u")


def jacobian3d(df: DataFrame, scale: float = 0.5) -> DataFrame:
    """``j00 .. j22`` of ``u, v, w``; interior points only."""
    cols = {f"j{r}{c}": difference(df, n, a, scale, "null") for c, a in enumerate(AXES) for r, n in enumerate("uvw")}
    return _interior(df, cols, "j00")


def vorticity3d(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """``wx, wy, wz``: the curl, by differences that ``scale`` multiplies."""
    j = jacobian3d(df, scale)
    return j.select(
        *df.columns,
        (F.col("j21") - F.col("j12")).alias("wx"),
        (F.col("j02") - F.col("j20")).alias("wy"),
        (F.col("j10") - F.col("j01")).alias("wz"),
    )


def cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> list[Column]:
    a, b = [F.col(c) for c in a], [F.col(c) for c in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def acceleration(df: DataFrame, transposed: bool = False, scale: float = 0.5) -> DataFrame:
    """``ax, ay, az``: the Jacobian (or its transpose) times the velocity."""
    j = jacobian3d(df, scale)
    names = "uvw"
    for r, out in enumerate(("ax", "ay", "az")):
        j = j.withColumn(out, sum(F.col(f"j{c}{r}" if transposed else f"j{r}{c}") * F.col(names[c]) for c in range(3)))
    return j


def convolve(df: DataFrame, kernel, col: str = "f", mean: bool = False) -> DataFrame:
    """Zero-padded convolution with a small kernel, one value a point.

    Each point is sent to the points that it adds to and summed there; the sum is partial before the shuffle.
    ``mean`` divides by the number of kernel entries too.
    """
    axes = axes_of(df)
    import numpy as np

    k = np.asarray(kernel, float)
    items = [(tuple(int(x) - n // 2 for x, n in zip(at, k.shape)), float(v)) for at, v in np.ndenumerate(k)]
    parts = F.explode(
        F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(axes, off)], F.lit(v).alias("w")) for off, v in items])
    )
    spread = df.select("t", *axes, F.col(col).cast("double").alias("__f"), parts.alias("__p")).select(
        "t", *[(F.col(a) - F.col(f"__p.d{a}")).cast("int").alias(a) for a in axes], (F.col("__f") * F.col("__p.w")).alias("__v")
    )
    total = spread.groupBy("t", *axes).agg(F.sum("__v").alias("__s"))
    n = k.size if mean else 1
    key = ["t", *reversed(axes)]
    return df.join(total, ["t", *axes]).withColumn(col, F.col("__s") / n).select(*key, *[c for c in df.columns if c not in key])


def smooth(df: DataFrame, sigma: float, size: int = 5, col: str = "f") -> DataFrame:
    """Gaussian smoothing, axis by axis: a weighted window sum along each, as the kernel is a product."""
    k = gaussian_kernel(sigma, size)
    for a in axes_of(df):
        w = _line(df, a)
        terms = []
        for n, weight in enumerate(k):
            d = n - size // 2
            v = F.col(col) if d == 0 else (F.lead(col, d).over(w) if d > 0 else F.lag(col, -d).over(w))
            terms.append(F.coalesce(v, F.lit(0.0)) * float(weight))
        df = df.withColumn(col, sum(terms))
    return df


def smooth_time(df: DataFrame, sigma: float, half: int = 2, col: str = "f", key: tuple[str, ...] | None = None) -> DataFrame:
    """Temporal FIR smoothing of each point's series, the first and last values repeated beyond its ends."""
    key = key or tuple(axes_of(df))
    w = Window.partitionBy(*key).orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = gaussian_kernel(sigma, 2 * half + 1)
    terms = []
    for n, weight in enumerate(k):
        d = n - half
        if d < 0:
            v = F.coalesce(F.lag(col, -d).over(w), F.first(col).over(whole))
        elif d > 0:
            v = F.coalesce(F.lead(col, d).over(w), F.last(col).over(whole))
        else:
            v = F.col(col)
        terms.append(v * float(weight))
    return df.withColumn(col, sum(terms))
