"""Feature extraction: critical points, contours, critical lines, phase vortices, over the sweep."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.mesh import Lattice
from ..functions.robust import fixed_point, orientation, point_in_simplex, scaling_bits
from .fields import acceleration, axes_of, cross, gradient2d, gradient3d, jacobian2d, jacobian3d, resolution, vorticity3d
from .sweep import sweep

CONTOUR_BITS = 21


def domain(shape: tuple[int, ...], steps: int, margin: int) -> Lattice:
    """Lattice of the cells that a tracker visits: a margin on each spatial border; (start, size) as 2, W - 3 for 2."""
    return Lattice((*[margin] * len(shape), 0), (*[n - 2 * margin + (margin == 2) for n in shape], steps))


def _lerp(values: np.ndarray, mu: np.ndarray) -> np.ndarray:
    return np.einsum("nv,nv...->n...", mu, values)


def _bits(df: DataFrame, cols: list[str]) -> int:
    got = df.agg(F.min(F.least(*[F.when(F.col(c) != 0, F.abs(F.col(c).cast("double"))) for c in cols])).alias("r")).first().r
    return scaling_bits(got if got is not None else math.inf)


def critical_points_2d(
    df: DataFrame,
    shape: tuple[int, int],
    steps: int,
    kind: str = "scalar",
    compat: bool = True,
    degrees: bool = False,
    bits: int | None = None,
    types: int | None = None,
    tile: int = 64,
) -> DataFrame:
    """Critical points on all space-time triangles of a 2D field.

    ``kind`` scalar takes ``f`` and derives gradient and symmetric Jacobian; vector takes ``u, v`` and derives the Jacobian.
    The zero test is exact on fixed-point vectors with perturbed ties. Columns: ``tag, kind, timestep,
    ordinal, x, y, t, scalar, type``. ``degrees`` gives the index (1 positive, 2 negative) of ordinal cells in place of types;
    ``types`` is a bitmask of types to keep.
    """
    w, h = shape
    scalar = kind == "scalar"
    if scalar:
        df = gradient2d(df, w, h)
    df = jacobian2d(df, w, h, symmetric=scalar, compat=compat)
    jac = ["j00", "j01", "j10", "j11"]
    cols = ["u", "v", *jac, *(["f"] if scalar else [])]
    n_bits = bits if bits is not None else _bits(df, ["u", "v"])

    def test(v: np.ndarray, x: np.ndarray, ids: np.ndarray):
        vf = fixed_point(v[:, :, :2], n_bits)
        rows = np.flatnonzero(point_in_simplex(vf, ids))
        if not len(rows):
            return rows, {}
        mu = N.zero_weights(v[rows, :, :2])
        pos, j = _lerp(x[rows], mu), _lerp(v[rows, :, 2:6], mu).reshape(-1, 2, 2)
        j[:, 0, 1] = j[:, 1, 0] = (j[:, 0, 1] + j[:, 1, 0]) / 2
        if degrees:
            flat = (x[rows, :, 2] == x[rows, :1, 2]).all(axis=1)
            turn = N.det2(np.stack((x[rows, 1, :2] - x[rows, 0, :2], x[rows, 2, :2] - x[rows, 0, :2]), axis=1))
            deg = orientation(vf[rows], ids[rows]) * np.sign(turn).astype(int)
            kinds = np.where(flat, np.where(deg > 0, 1, 2), 0)
        else:
            kinds = N.type_2d(j, scalar)
        value = _lerp(v[rows, :, 6], mu) if scalar else np.zeros(len(rows))
        return rows, {"x": pos[:, 0], "y": pos[:, 1], "t": pos[:, 2], "scalar": value, "type": kinds}

    out = sweep(df, cols, domain(shape, steps, 2 if scalar else 1), 2, test, "x double, y double, t double, scalar double, type int", tile)
    return out.where(F.col("type").bitwiseAND(types) != 0) if types is not None else out


def critical_points_3d(
    df: DataFrame, shape: tuple[int, int, int], steps: int, kind: str = "scalar", robust: bool = True, bits: int | None = None, types: int | None = None
) -> DataFrame:
    """Critical points on all space-time tetrahedra of a 3D field; as in 2D, and without ``robust`` by weights alone."""
    scalar = kind == "scalar"
    if scalar:
        df = gradient3d(df)
    df = jacobian3d(df)
    jac = [f"j{r}{c}" for r in range(3) for c in range(3)]
    cols = ["u", "v", "w", *jac, *(["f"] if scalar else [])]
    n_bits = bits if bits is not None else _bits(df, ["u", "v", "w"])

    def test(v: np.ndarray, x: np.ndarray, ids: np.ndarray):
        vec = v[:, :, :3]
        near = ((vec.min(axis=1) <= 0) & (vec.max(axis=1) >= 0)).all(axis=1)
        rows = np.flatnonzero(near)
        if robust and len(rows):
            rows = rows[point_in_simplex(fixed_point(vec[rows], n_bits), ids[rows])]
        if len(rows) and not robust:
            rows = rows[N.inverse_lerp(vec[rows])[1]]
        if not len(rows):
            return rows, {}
        mu = N.zero_weights(vec[rows])
        pos, j = _lerp(x[rows], mu), _lerp(v[rows, :, 3:12], mu).reshape(-1, 3, 3)
        if scalar:
            j = (j + np.swapaxes(j, 1, 2)) / 2
        value = _lerp(v[rows, :, 12], mu) if scalar else np.zeros(len(rows))
        return rows, {"x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "t": pos[:, 3], "scalar": value, "type": N.type_3d(j, scalar)}

    schema = "x double, y double, z double, t double, scalar double, type int"
    out = sweep(df, cols, domain(shape, steps, 2 if scalar else 1), 3, test, schema, tile=16)
    return out.where(F.col("type").bitwiseAND(types) != 0) if types is not None else out


def contour_points(df: DataFrame, shape: tuple[int, ...], steps: int, level: float, tile: int = 64) -> DataFrame:
    """Points where a 2D or 3D scalar crosses ``level`` on space-time edges; 3D points carry gradients too."""
    d = len(shape)
    cols = ["f"]
    if d == 3:
        df = gradient3d(df)
        cols += ["u", "v", "w"]

    def test(v: np.ndarray, x: np.ndarray, ids: np.ndarray):
        fx = fixed_point(v[:, :, :1] - level, CONTOUR_BITS)
        rows = np.flatnonzero(point_in_simplex(fx, ids))
        if not len(rows):
            return rows, {}
        mu = N.zero_weights(v[rows, :, :1] - level)
        pos = _lerp(x[rows], mu)
        out = {n: pos[:, a] for a, n in enumerate("xyz"[:d])} | {"t": pos[:, d]}
        if d == 3:
            g = _lerp(v[rows, :, 1:], mu)
            out |= {"scalar": np.full(len(rows), level), "vx": g[:, 0], "vy": g[:, 1], "vz": g[:, 2]}
        return rows, out

    schema = ", ".join(f"{n} double" for n in [*"xyz"[:d], "t", *(["scalar", "vx", "vy", "vz"] if d == 3 else [])])
    return sweep(df, cols, Lattice((*[0] * d, 0), (*shape, steps)), 1, test, schema, tile if d == 2 else 16)


def critical_lines(df: DataFrame, shape: tuple[int, int, int], steps: int, cols: tuple[str, str] = ("u", "v"), extra: tuple[str, ...] = ()) -> DataFrame:
    """Points on space-time triangles of a 3D field where two components vanish; ``extra`` columns are interpolated."""

    def test(v: np.ndarray, x: np.ndarray, ids: np.ndarray):
        rows = np.flatnonzero(point_in_simplex(fixed_point(v[:, :, :2], CONTOUR_BITS), ids))
        if not len(rows):
            return rows, {}
        mu = N.zero_weights(v[rows, :, :2])
        pos, more = _lerp(x[rows], mu), _lerp(v[rows, :, 2:], mu)
        return rows, {"x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "t": pos[:, 3]} | {e: more[:, n] for n, e in enumerate(extra)}

    schema = ", ".join(f"{n} double" for n in ["x", "y", "z", "t", *extra])
    return sweep(df, [*cols, *extra], Lattice((0, 0, 0, 0), (*shape, steps)), 2, test, schema, tile=16)


def _cross_lines(df: DataFrame, shape, steps, a: tuple, b: tuple, extra: tuple[str, ...]) -> DataFrame:
    """Lines where two vectors are parallel: two components of their cross product vanish; ``residue`` is the third."""
    for n, c in zip(("p0", "p1", "residue"), cross(a, b)):
        df = df.withColumn(n, c)
    return critical_lines(df, shape, steps, ("p0", "p1"), ("residue", *extra))


def sujudi_haimes(df: DataFrame, shape, steps: int) -> DataFrame:
    """Vortex cores by v x (J v) = 0, with ``residue`` and the discriminant of J (negative: swirling)."""
    a = acceleration(df)
    j = [[F.col(f"j{r}{c}") for c in range(3)] for r in range(3)]
    tr = j[0][0] + j[1][1] + j[2][2]
    minors = sum(j[p][p] * j[q][q] - j[p][q] * j[q][p] for p, q in ((0, 1), (0, 2), (1, 2)))
    det = sum(j[0][c] * (j[1][(c + 1) % 3] * j[2][(c + 2) % 3] - j[1][(c + 2) % 3] * j[2][(c + 1) % 3]) for c in range(3))
    b, c, d = -tr, minors, -det
    a = a.withColumn("disc", b * b * c * c - 4 * c * c * c - 4 * b * b * b * d - 27 * d * d + 18 * b * c * d)
    return _cross_lines(a, shape, steps, ("u", "v", "w"), ("ax", "ay", "az"), ("disc",))


def levy_degani_seginer(df: DataFrame, shape, steps: int) -> DataFrame:
    """Vortex cores by v x curl v = 0, with ``residue`` and the vorticity's magnitude."""
    o = vorticity3d(df).withColumn("vorticity", F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2))
    return _cross_lines(o, shape, steps, ("u", "v", "w"), ("wx", "wy", "wz"), ("vorticity",))


def ridge_valley(df: DataFrame, shape, steps: int) -> DataFrame:
    """Ridge and valley lines of a scalar by grad f x (H grad f) = 0, with ``residue`` and the scalar."""
    a = acceleration(gradient3d(df))
    return _cross_lines(a, shape, steps, ("u", "v", "w"), ("ax", "ay", "az"), ("f",))


def magnetic_potential(x: np.ndarray, b: tuple[float, float, float], kex: float) -> np.ndarray:
    """Vector potential at points (n, 3) in the gauge that suits the field's axis."""
    bx, by, bz = b
    zero = np.zeros(len(x))
    if by > 0:
        return np.stack((zero - kex, x[:, 0] * bz, -x[:, 0] * by), axis=1)
    return np.stack((-x[:, 1] * bz - kex, zero, x[:, 1] * bx), axis=1)


def line_integral(x0: np.ndarray, x1: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Trapezoid rule for a potential along edges."""
    return ((x1 - x0) * (a0 + a1)).sum(axis=1) / 2


def phase_vortices(
    df: DataFrame,
    shape: tuple[int, int, int],
    steps: int,
    field: tuple[float, float, float] = (0.0, 0.0, 0.0),
    kex: float = 0.0,
    cell: tuple[float, float, float] = (1.0, 1.0, 1.0),
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0),
) -> DataFrame:
    """Vortices of a complex field ``re, im``: triangles around which the gauge-corrected phase winds once.

    ``winding`` is the signed turn number; positions are those of the interpolated zero.
    """
    scale, shift = np.array(cell), np.array(origin)

    def test(v: np.ndarray, x: np.ndarray, ids: np.ndarray):
        phase = np.arctan2(v[:, :, 1], v[:, :, 0])
        p = x[:, :, :3] * scale + shift
        turn = np.zeros(len(v))
        for a, b in ((0, 1), (1, 2), (2, 0)):
            gauge = line_integral(p[:, a], p[:, b], magnetic_potential(p[:, a], field, kex), magnetic_potential(p[:, b], field, kex))
            step = phase[:, b] - phase[:, a] - gauge
            turn += (step + math.pi) % (2 * math.pi) - math.pi + gauge
        turn = -turn / (2 * math.pi)
        rows = np.flatnonzero(np.abs(turn) >= 0.5)
        if not len(rows):
            return rows, {}
        pos = _lerp(x[rows], N.zero_weights(v[rows, :, :2]))
        return rows, {"x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "t": pos[:, 3], "winding": np.sign(turn[rows])}

    if "re" not in df.columns:
        df = df.withColumns({"re": F.col("rho") * F.cos("phi"), "im": F.col("rho") * F.sin("phi")})
    schema = "x double, y double, z double, t double, winding double"
    return sweep(df, ["re", "im"], Lattice((0, 0, 0, 0), (*shape, steps)), 2, test, schema, tile=16)


def extract(df: DataFrame, shape: tuple[int, ...], steps: int, **options) -> DataFrame:
    """Critical points of a 2D or 3D field by its dimension."""
    return (critical_points_2d if len(axes_of(df)) == 2 else critical_points_3d)(df, shape, steps, **options)
