"""Unstructured meshes as tables: adjacency, extrusion in time, kernels, gradients, location and extraction.

``vertices (vid, x, y[, z])``; ``triangles (tid, v0, v1, v2)`` and ``tets (cid, v0 .. v3)`` with ascending
vertices. Incidence is found by joins on sorted vertex tuples, not by case analysis.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.robust import fixed_point, point_in_simplex
from ..sources.storage import materialize
from .graph import components
from .kd import CELL, nearest_to_places
from .order import numbered_by


def structured_triangles(spark: SparkSession, w: int, h: int, wrap: bool = False) -> tuple[DataFrame, DataFrame]:
    """A triangulated w x h grid on the unit square (joined left to right with ``wrap``)."""
    n, v = F.col("id"), spark.range(w * h)
    vertices = v.select(n.alias("vid"), (n % w / float(w if wrap else w - 1)).alias("x"), (F.floor(n / w) / float(h - 1)).alias("y"))
    m = w if wrap else w - 1
    q = spark.range(m * (h - 1)).select((n % m).alias("i"), F.floor(n / m).alias("j"), "id")
    i1 = (F.col("i") + 1) % w
    a, b = F.col("j") * w + F.col("i"), F.col("j") * w + i1
    c, d = a + w, b + w
    both = F.array(F.array(a, b, d), F.array(a, c, d))
    cells = q.select("id", F.posexplode(both).alias("n", "v")).select((F.col("id") * 2 + F.col("n")).alias("tid"), F.sort_array("v").alias("v"))
    return vertices, cells.select("tid", *[F.col("v")[k].alias(f"v{k}") for k in range(3)])


def _corners(cells: DataFrame) -> list[str]:
    return sorted(c for c in cells.columns if c[0] == "v" and c[1:].isdigit())


def faces(cells: DataFrame, size: int) -> DataFrame:
    """Distinct sides of ``size`` vertices: edges of triangles or tetrahedra, triangles of tetrahedra."""
    names = _corners(cells)
    each = F.array(*[F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(pick)]) for pick in combinations(names, size)])
    return cells.select(F.explode(each).alias("s")).select("s.*").distinct()


def numbered(cells: DataFrame, name: str) -> DataFrame:
    """Dense ids in the order of the vertices."""
    return numbered_by(cells, *_corners(cells), name=name)


def incidence(cells: DataFrame, sides: DataFrame, cell: str, side: str) -> DataFrame:
    """``(cell, side)`` pairs: which numbered sides each cell has, by an equi-join on the vertex tuple."""
    names, inner = _corners(cells), _corners(sides)
    each = F.array(*[F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(pick)]) for pick in combinations(names, len(inner))])
    return cells.select(cell, F.explode(each).alias("s")).select(cell, "s.*").join(sides, inner).select(cell, side)


def find_simplex(sides: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(sides, _corners(sides))


def vertex_neighbours(cells: DataFrame) -> DataFrame:
    e = faces(cells, 2)
    return e.select(F.col("v0").alias("vid"), F.col("v1").alias("nbr")).unionByName(e.select(F.col("v1").alias("vid"), F.col("v0").alias("nbr")))


def extrude(cells: DataFrame, n_vertices: int, steps: int) -> DataFrame:
    """Space-time simplices of each prism over a cell: d + 1 of them, vertices v + n t ascending; with their step ``t``."""
    names = _corners(cells)
    k = len(names)
    low, high = [F.col(c) for c in names], [F.col(c) + n_vertices for c in names]
    each = F.array(*[F.struct(*[v.alias(f"v{m}") for m, v in enumerate(low[: s + 1] + high[s:])]) for s in range(k)])
    shift = F.col("t") * n_vertices
    out = cells.crossJoin(F.broadcast(cells.sparkSession.range(steps - 1).withColumnRenamed("id", "t"))).select("t", F.explode(each).alias("s"))
    return out.select("t", *[(F.col(f"s.v{m}") + shift).alias(f"v{m}") for m in range(k + 1)])


def space_time_faces(cells: DataFrame, n_vertices: int, steps: int) -> DataFrame:
    """Distinct faces of the extruded mesh, of as many vertices as a cell; ``ordinal`` if all at one step."""
    k = len(_corners(cells))
    f = faces(extrude(cells, n_vertices, steps), k)
    first, last = F.floor(F.col("v0") / n_vertices), F.floor(F.col(f"v{k - 1}") / n_vertices)
    return f.withColumn("timestep", first).withColumn("ordinal", first == last).withColumn("tag", F.xxhash64(*[f"v{m}" for m in range(k)]))


def torus_extrude(triangles: DataFrame, n_nodes: int, n_planes: int) -> DataFrame:
    """Tetrahedra between toroidal planes; the last plane joins the first, vertices modulo all nodes."""
    total = n_nodes * n_planes
    tets = extrude(triangles, n_nodes, n_planes + 1)
    return tets.select(F.col("t").alias("plane"), *[F.pmod(F.col(f"v{m}"), F.lit(total)).alias(f"v{m}") for m in range(4)])


def with_values(cells: DataFrame, field: DataFrame, n_vertices: int, cols: list[str]) -> DataFrame:
    """Values at each vertex of space-time simplices as arrays ``p0 ..``: one explode, one equi-join, one grouping."""
    names = _corners(cells)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("g")) for k, c in enumerate(names)])
    keep = [c for c in cells.columns if c not in names]
    f = field.select((F.col("vid") + F.col("t") * n_vertices).alias("g"), F.array(*[F.col(c).cast("double") for c in cols]).alias("val"))
    got = cells.select("*", F.explode(each).alias("e")).select(*cells.columns, "e.k", "e.g").join(f, "g")
    full = got.groupBy(*cells.columns).agg(F.sort_array(F.collect_list(F.struct("k", "g", "val"))).alias("p")).where(F.size("p") == len(names))
    return full.select(*keep, F.col("p.g").alias("ids"), F.col("p.val").alias("vals"))


def critical_points(cells: DataFrame, field: DataFrame, n_vertices: int, steps: int, vec: tuple[str, ...], coords: tuple[str, ...], jac: tuple[str, ...] = (), bits: int = 21, symmetric: bool = True) -> DataFrame:
    """Zeros of a vector field on the space-time faces of triangles (2D) or tetrahedra (3D).

    ``field`` has ``t, vid``, the vector, the coordinates and maybe Jacobian columns; ties go by vertex number.
    """
    d = len(vec)
    cols = [*vec, *coords, *jac]
    table = with_values(space_time_faces(cells, n_vertices, steps), field, n_vertices, cols)

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            v = np.array([[list(x) for x in p] for p in pdf["vals"]], float)
            ids = np.array([list(x) for x in pdf["ids"]], np.int64)
            ok = np.flatnonzero(np.isfinite(v).all(axis=(1, 2)))
            rows = ok[point_in_simplex(fixed_point(v[ok, :, :d], bits), ids[ok])] if len(ok) else ok
            mu = N.zero_weights(v[rows, :, :d]) if len(rows) else np.zeros((0, d + 1))
            pos = np.einsum("nv,nvc->nc", mu, v[rows])
            time = (mu * (ids[rows] // n_vertices)).sum(axis=1)
            out = pd.DataFrame({"tag": pdf["tag"].to_numpy()[rows], "timestep": pdf["timestep"].to_numpy()[rows], "ordinal": pdf["ordinal"].to_numpy()[rows], "t": time})
            for k, c in enumerate(coords):
                out[c] = pos[:, d + k]
            kinds = np.zeros(len(rows), int)
            if jac and len(rows):
                j = pos[:, d + len(coords) :].reshape(-1, d, d)
                kinds = N.type_2d(j, symmetric) if d == 2 else N.type_3d(j, symmetric)
            out["type"] = kinds
            yield out

    schema = "tag long, timestep long, ordinal boolean, t double, " + ", ".join(f"{c} double" for c in coords) + ", type int"
    return table.mapInPandas(run, schema)


def track(points: DataFrame, cells: DataFrame, n_vertices: int, steps: int) -> DataFrame:
    """``(tag, root)``: components of punctured faces that share a space-time simplex."""
    k = len(_corners(cells))
    up = extrude(cells, n_vertices, steps)
    names = _corners(up)
    cell = F.xxhash64(*names)
    each = F.array(*[F.xxhash64(*pick) for pick in combinations(names, k)])
    inc = up.select(cell.alias("cell"), F.explode(each).alias("tag")).join(points.select("tag"), "tag", "left_semi")
    a, b = inc.select("cell", F.col("tag").alias("a")), inc.select("cell", F.col("tag").alias("b"))
    edges = a.join(b, "cell").where("a < b").select("a", "b").distinct()
    return components(edges, points.select(F.col("tag").alias("node"))).select(F.col("node").alias("tag"), "root")


# kernels and gradients
def smoothing_kernel(vertices: DataFrame, sigma: float, normalised: bool = False) -> DataFrame:
    """``(vid, nbr, w)``: Gaussian weights to all vertices within three sigma, by a bucketed range join.

    Weights are not normalised unless asked; a mesh whose neighbourhoods aren't convex may reach across gaps.
    """
    axes = [a for a in "xyz" if a in vertices.columns]
    reach = 3.0 * sigma
    left = vertices.select("vid", *axes, *[F.floor(F.col(a) / reach).alias(f"b{a}") for a in axes])
    right = vertices.select(F.col("vid").alias("nbr"), *[F.col(a).alias(f"n{a}") for a in axes], *[F.floor(F.col(a) / reach).alias(f"b{a}") for a in axes])
    for a in axes:
        right = right.withColumn(f"b{a}", F.explode(F.array(*[F.col(f"b{a}") + d for d in (-1, 0, 1)])))
    d2 = sum((F.col(a) - F.col(f"n{a}")) ** 2 for a in axes)
    out = left.join(right, [f"b{a}" for a in axes]).where(d2 <= reach * reach)
    out = out.select("vid", "nbr", (F.exp(-d2 / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)).alias("w"), *[(F.col(f"n{a}") - F.col(a)).alias(f"d{a}") for a in axes])
    if normalised:
        out = out.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("vid")))
    return out


def smooth(field: DataFrame, kernel: DataFrame, col: str = "f") -> DataFrame:
    """``(t, vid, col)``: a sparse matrix-vector product as join and sum."""
    f = field.select("t", F.col("vid").alias("nbr"), F.col(col).alias("__f"))
    return kernel.join(f, "nbr").groupBy("t", "vid").agg(F.sum(F.col("w") * F.col("__f")).alias(col))


def smooth_with_derivatives(field: DataFrame, kernel: DataFrame, sigma: float, col: str = "f") -> DataFrame:
    """Smoothed scalar, gradient and Hessian of a 2D mesh field from the kernel's own derivatives: six sums of one join."""
    f = field.select("t", F.col("vid").alias("nbr"), F.col(col).alias("__f"))
    s2 = sigma * sigma
    g = F.col("w") * F.col("__f")
    dx, dy = F.col("dx"), F.col("dy")
    terms = {
        col: g, "u": g * dx / s2, "v": g * dy / s2, "j00": g * (dx * dx / s2 - 1) / s2, "j01": g * dx * dy / (s2 * s2), "j11": g * (dy * dy / s2 - 1) / s2,
    }
    return kernel.join(f, "nbr").groupBy("t", "vid").agg(*[F.sum(e).alias(n) for n, e in terms.items()]).withColumn("j10", F.col("j01"))


def gradient(vertices: DataFrame, triangles: DataFrame, field: DataFrame, col: str = "f") -> DataFrame:
    """``(t, vid, gx, gy)``: mean over a vertex's triangles of their constant gradients."""
    p = vertices.join(field.select("t", "vid", F.col(col).alias("__f")), "vid")
    long = triangles.select("tid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid")).join(p, "vid")
    tri = long.groupBy("t", "tid").agg(F.sort_array(F.collect_list(F.struct("k", "vid", "x", "y", F.col("__f").alias("f")))).alias("p"))
    q = F.col("p")
    x1, y1, f1 = (q[1][c] - q[0][c] for c in ("x", "y", "f"))
    x2, y2, f2 = (q[2][c] - q[0][c] for c in ("x", "y", "f"))
    det = x1 * y2 - x2 * y1
    g = tri.select("t", F.try_divide(f1 * y2 - f2 * y1, det).alias("gx"), F.try_divide(x1 * f2 - x2 * f1, det).alias("gy"), F.explode("p.vid").alias("vid"))
    return g.groupBy("t", "vid").agg(F.avg("gx").alias("gx"), F.avg("gy").alias("gy"))


def vector_gradient(vertices: DataFrame, triangles: DataFrame, field: DataFrame) -> DataFrame:
    """``(t, vid, j00, j01, j10, j11)`` of a vector field ``u, v``."""
    a = gradient(vertices, triangles, field, "u").withColumnsRenamed({"gx": "j00", "gy": "j01"})
    return a.join(gradient(vertices, triangles, field, "v").withColumnsRenamed({"gx": "j10", "gy": "j11"}), ["t", "vid"])


# location and lookups
def locate(points: DataFrame, vertices: DataFrame, triangles: DataFrame, bucket: float) -> DataFrame:
    """``(pid, tid, m0, m1, m2)``: the triangle that holds each point ``(pid, px, py)`` and its weights.

    Triangles stand in the buckets that their boxes touch; points on a shared edge take the smallest triangle.
    """
    v = [vertices.select(F.col("vid").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in range(3)]
    t = triangles.join(v[0], "v0").join(v[1], "v1").join(v[2], "v2")
    for a in "xy":
        lo, hi = F.least(*[f"{a}{k}" for k in range(3)]), F.greatest(*[f"{a}{k}" for k in range(3)])
        t = t.withColumn(f"b{a}", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    p = points.withColumns({"bx": F.floor(F.col("px") / bucket), "by": F.floor(F.col("py") / bucket)})
    c = F.col
    det = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
    m0 = F.try_divide((c("y1") - c("y2")) * (c("px") - c("x2")) + (c("x2") - c("x1")) * (c("py") - c("y2")), det)
    m1 = F.try_divide((c("y2") - c("y0")) * (c("px") - c("x2")) + (c("x0") - c("x2")) * (c("py") - c("y2")), det)
    got = p.join(t, ["bx", "by"]).select("pid", "tid", m0.alias("m0"), m1.alias("m1"), (1 - m0 - m1).alias("m2"))
    got = got.where(F.least("m0", "m1", "m2") >= -1e-12)
    return got.groupBy("pid").agg(F.min(F.struct("tid", "m0", "m1", "m2")).alias("s")).select("pid", "s.*")


def evaluate(located: DataFrame, triangles: DataFrame, field: DataFrame, col: str = "f") -> DataFrame:
    """``(t, pid, col)``: a mesh field at located points."""
    long = located.join(triangles, "tid").select("pid", F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), F.col(f"m{k}").alias("m")) for k in range(3)])).alias("e"))
    return long.select("pid", "e.*").join(field, "vid").groupBy("t", "pid").agg(F.sum(F.col("m") * F.col(col)).alias(col))


def nearest(points: DataFrame, targets: DataFrame, bucket: float | None = None, cell: int = CELL) -> DataFrame:
    """``(pid, vid, d2)``: the nearest of ``targets (vid, x, y)`` to ``points (pid, px, py)``, ties to the smaller id.

    One row a ``pid``; rows that share one count as one point with the nearest of all. Targets are dealt into cells of about ``cell``
    targets wherever they lie, each with a k-d tree, so neither crowded nor far points meet more than a few leaves. ``bucket``, the side
    of a fixed grid's cells, is no longer used. Rows with a null or non-finite coordinate, and targets without an id, take no part;
    without targets nothing is found.
    """

    def usable(df: DataFrame, *cols: str) -> DataFrame:
        df = df.withColumns({c: F.col(c).cast("double") for c in cols})
        return df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in cols))

    p = usable(points.select("pid", "px", "py"), "px", "py")
    best = nearest_to_places(p, usable(targets.select("vid", "x", "y").where("vid is not null"), "x", "y"), cell)
    return p.join(best, ["px", "py"]).groupBy("pid").agg(F.min(F.struct("d2", "vid")).alias("s")).select("pid", "s.vid", "s.d2")


def lerp_lookup(keys: DataFrame, table: DataFrame) -> DataFrame:
    """``(key, xi, yi)``: a piecewise-linear table ``(x, y)`` at ``keys (key, xi)``. Outside it the end values hold; null keys give null.

    An as-of join: keys and knots are dealt into ranges of x by the knots' quantiles, and in each range one sort carries
    the last knot forward. One row a range says which knots lie before and after it. Of knots at one x the largest y counts.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    knots = table.where("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("x")).agg(F.max(F.col("y").cast("double")).alias("y"))
    cuts = sorted(set(knots.approxQuantile("x", [k / n for k in range(1, n)], 0.5 / n))) if n > 1 else []
    if knots.isEmpty():
        return keys.select("key", "xi", F.lit(None).cast("double").alias("yi"))

    def part(c: str):
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda cut: cut <= F.col(c)))

    knots = materialize(knots.withColumn("part", part("x")), "knots")
    own = knots.groupBy("part").agg(F.min(F.struct("x", "y")).alias("low"), F.max(F.struct("x", "y")).alias("high"))
    every = keys.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("part")).join(F.broadcast(own), "part", "left")
    order = Window.orderBy("part")
    ends = every.select(
        "part",
        F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("first"),
        F.first("low", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("beyond"),
    )
    ends = F.broadcast(materialize(ends, "knots"))
    follows = F.lead(F.struct("x", "y")).over(Window.partitionBy("part").orderBy("x"))
    spans = knots.withColumn("next", follows).join(ends, "part").select("part", "x", F.struct("x", "y", F.coalesce("next", "beyond").alias("next")).alias("knot"))
    both = spans.select("part", "x", "knot", F.lit(None).cast(keys.schema["key"].dataType).alias("key"), F.lit(0).alias("of_key"))
    asked = keys.select(part("xi").alias("part"), F.col("xi").cast("double").alias("x"), F.lit(None).cast(spans.schema["knot"].dataType).alias("knot"), "key", F.lit(1).alias("of_key"))
    line = Window.partitionBy("part").orderBy("x", "of_key").rowsBetween(Window.unboundedPreceding, 0)
    got = both.unionByName(asked.where("x is not null")).withColumn("at", F.last("knot", True).over(line)).where("of_key = 1").join(ends, "part")
    at = F.coalesce("at", F.when(F.col("before").isNotNull(), F.struct(F.col("before.x").alias("x"), F.col("before.y").alias("y"), F.col("first").alias("next"))))
    w = F.try_divide(F.col("x") - F.col("on.x"), F.col("on.next.x") - F.col("on.x"))
    inside = F.col("on.y") + w * (F.col("on.next.y") - F.col("on.y"))
    y = F.when(F.col("on").isNull(), F.col("first.y")).when(F.col("on.next").isNull(), F.col("on.y")).otherwise(inside)
    out = got.withColumn("on", at).select("key", F.col("x").alias("xi"), y.alias("yi"))
    return out.unionByName(keys.where("xi is null").select("key", F.col("xi").cast("double"), F.lit(None).cast("double").alias("yi")))


def temporal_lerp(queries: DataFrame, field: DataFrame, col: str = "f") -> DataFrame:
    """``(key, tq, value)``: a series at fractional times: equi-joins with the steps below and above."""
    a = field.select("key", F.col("t").alias("t0"), F.col(col).alias("f0"))
    b = field.select("key", F.col("t").alias("t1"), F.col(col).alias("f1"))
    q = queries.withColumn("t0", F.floor("tq").cast("long")).withColumn("t1", F.col("t0") + 1)
    w = F.col("tq") - F.col("t0")
    got = q.join(a, ["key", "t0"]).join(b, ["key", "t1"], "left")
    return got.select("key", "tq", F.when(w == 0, F.col("f0")).otherwise((1 - w) * F.col("f0") + w * F.col("f1")).alias("value"))


# ocean and torus meshes
def cells_to_vertices(weights: DataFrame, field: DataFrame, col: str = "f", fill: float = -1e33) -> DataFrame:
    """``(t, vertex, col)``: cell values at vertices by weights ``(vertex, cell, w)``; fill values give null, boundary vertices 0."""
    f = field.withColumn("__ok", F.col(col) >= fill)
    got = weights.join(f, "cell").groupBy("t", "vertex").agg(F.count("*").alias("n"), F.min("__ok").alias("ok"), F.sum(F.col("w") * F.col(col)).alias("s"))
    return got.select("t", "vertex", F.when(F.col("n") < 3, 0.0).when(F.col("ok"), F.col("s")).alias(col))


def layer_join(points: DataFrame, layers: DataFrame) -> DataFrame:
    """``(pid, layer)``: the layer with bottom < z <= top in each point's column ``(cell, layer, top)``."""
    w = Window.partitionBy("cell").orderBy("layer")
    spans = layers.withColumn("bottom", F.lead("top").over(w))
    return points.join(spans, "cell").where((F.col("z") <= F.col("top")) & (F.col("z") > F.col("bottom"))).select("pid", "layer")


def turbulence(df: DataFrame, temperature: DataFrame) -> DataFrame:
    """``(t, plane, node, value)``: potential less its toroidal mean, over the electron temperature of its flux surface.

    ``df (t, plane, node, psi, dpot)``; ``temperature (x, y)`` is piecewise linear in psi.
    """
    mean = F.avg("dpot").over(Window.partitionBy("t", "node"))
    nodes = df.select(F.col("node").alias("key"), F.col("psi").alias("xi")).distinct()
    te = lerp_lookup(nodes, temperature).select(F.col("key").alias("node"), F.col("yi").alias("te"))
    return df.withColumn("__d", F.col("dpot") - mean).join(te, "node").select("t", "plane", "node", F.try_divide(F.col("__d"), F.col("te")).alias("value"))


def field_line_interpolants(weights: DataFrame, field: DataFrame, col: str = "f") -> DataFrame:
    """Values on virtual planes: ``weights (vplane, node, plane, src, w)`` joined with plane values and summed."""
    got = weights.join(field.select("t", "plane", F.col("node").alias("src"), F.col(col).alias("__f")), ["plane", "src"])
    return got.groupBy("t", "vplane", "node").agg(F.sum(F.col("w") * F.col("__f")).alias(col))


def blob_components(df: DataFrame, neighbours: DataFrame, n_nodes: int, level: float, col: str = "f") -> DataFrame:
    """``(t, node, root)``: components in space-time of mesh nodes with values of ``level`` at least."""
    on = df.where(F.col(col) >= level).select("t", "node", (F.col("t") * n_nodes + F.col("node")).alias("g"))
    g = on.select(F.col("g").alias("b"))
    across = on.join(neighbours.withColumnRenamed("vid", "node"), "node").select(F.col("g").alias("a"), (F.col("t") * n_nodes + F.col("nbr")).alias("b"))
    later = on.select(F.col("g").alias("a"), (F.col("g") + n_nodes).alias("b"))
    edges = across.unionByName(later).join(g, "b", "left_semi")
    roots = components(edges, on.select(F.col("g").alias("node")))
    return on.withColumnRenamed("node", "n").join(roots, on.g == roots.node).select("t", F.col("n").alias("node"), "root")
