"""Registered queries of the tracking operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mesh import Lattice
from ..operators import curves as C
from ..operators import features as X
from ..operators import fields as D
from ..operators import graph as G
from ..operators import particles as P
from ..operators import tracking as K
from ..operators import unstructured as U
from ..operators.sweep import cells
from ..sources import synthetic as S
from ..sources.views import H, T, W, field2dt, trajectories
from . import oracle as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHAPE = (W, H)
DOMAIN = X.domain(SHAPE, T, 2)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


# sources
@query("field_densify", O.field("SELECT t, j, i, f FROM field"))
def field_densify(spark: SparkSession, d: str) -> DataFrame:
    return field2dt(spark, d)


def _synth(name: str, sql: str, make) -> None:
    query(name, sql)(lambda spark, d: make(spark))


_GRID = "SELECT CAST(a.range AS BIGINT) AS t, CAST(b.range AS INTEGER) AS j, CAST(c.range AS INTEGER) AS i FROM range({t}) a, range({h}) b, range({w}) c"
_synth(
    "synth_woven",
    f"SELECT t, j, i, ROUND(cos(x * cos(s) - y * sin(s)) * sin(x * sin(s) + y * cos(s)), 6) AS f FROM (SELECT *, (i / 31.0 - 0.5) * 15 AS x, (j / 31.0 - 0.5) * 15 AS y, t / 7.0 AS s FROM ({_GRID.format(t=8, h=32, w=32)}))",
    lambda s: S.woven_grid(s, 32, 32, 8).withColumn("f", _r("f")),
)
_synth(
    "synth_double_gyre",
    f"""SELECT t, j, i, ROUND(-pi() * 0.1 * sin(pi() * g) * cos(pi() * y), 6) AS u, ROUND(pi() * 0.1 * cos(pi() * g) * sin(pi() * y) * (2 * a * x + 1 - 2 * a), 6) AS v
    FROM (SELECT *, a * x * x + (1 - 2 * a) * x AS g FROM (SELECT *, i / 63.0 * 2 AS x, j / 31.0 AS y, 0.25 * sin(2 * pi() * t * 0.1) AS a FROM ({_GRID.format(t=5, h=32, w=64)})))""",
    lambda s: S.double_gyre(s, 64, 32, 5).withColumns({"u": _r("u"), "v": _r("v")}),
)
_synth(
    "synth_merger",
    f"""SELECT t, j, i, ROUND(greatest(exp(-((p - cos(s)) ** 2 + (q - 1e-4) ** 2)), exp(-((p + cos(s)) ** 2 + (q - 1e-4) ** 2))), 6) AS f
    FROM (SELECT *, x * cos(s) - y * sin(s) AS p, x * sin(s) + y * cos(s) AS q FROM (SELECT *, i / 31.0 * 4 - 2 AS x, j / 31.0 * 4 - 2 AS y, t * 0.1 AS s FROM ({_GRID.format(t=10, h=32, w=32)})))""",
    lambda s: S.merger_grid(s, 32, 32, 10).withColumn("f", _r("f")),
)
_synth(
    "synth_moving_extremum",
    f"SELECT t, j, i, ROUND((i - 10 - 0.1 * t) ** 2 + (j - 10 - 0.1 * t) ** 2, 6) AS f FROM ({_GRID.format(t=32, h=21, w=21)})",
    lambda s: S.moving_extremum(s).withColumn("f", _r("f")),
)
_synth(
    "synth_volcano",
    f"SELECT t, j, i, ROUND(exp(-((sqrt((i - 10) ** 2 + (j - 10) ** 2) - (3 + t)) ** 2)), 6) AS f FROM ({_GRID.format(t=32, h=21, w=21)})",
    lambda s: S.volcano(s).withColumn("f", _r("f")),
)
_GRID3 = "SELECT CAST(a.range AS BIGINT) AS t, CAST(z.range AS INTEGER) AS k, CAST(b.range AS INTEGER) AS j, CAST(c.range AS INTEGER) AS i FROM range({t}) a, range({d}) z, range({h}) b, range({w}) c"
_synth("synth_ramp", f"SELECT t, k, j, i, ROUND(i - (10 + 0.1 * t), 6) AS f FROM ({_GRID3.format(t=4, d=8, h=9, w=10)})", lambda s: S.moving_ramp(s, (10, 9, 8), 4).withColumn("f", _r("f")))
_synth(
    "synth_dual_ramp",
    f"SELECT t, k, j, i, ROUND(abs(i - 10) - 0.7 * (t + 2), 6) AS f FROM ({_GRID3.format(t=4, d=8, h=9, w=10)})",
    lambda s: S.moving_dual_ramp(s, (10, 9, 8), 4).withColumn("f", _r("f")),
)
_synth(
    "synth_abc_flow",
    f"""SELECT t, k, j, i, ROUND(sqrt(3) * sin(z) + cos(y), 6) AS u, ROUND(sqrt(2) * sin(x) + sqrt(3) * cos(z), 6) AS v, ROUND(sin(y) + sqrt(2) * cos(x), 6) AS w
    FROM (SELECT *, i / 9.0 * 2 * pi() AS x, j / 8.0 * 2 * pi() AS y, k / 7.0 * 2 * pi() AS z FROM ({_GRID3.format(t=1, d=8, h=9, w=10)}))""",
    lambda s: S.abc_flow(s, 10, 9, 8).withColumns({c: _r(c) for c in "uvw"}),
)
_synth("synth_tornado", None, lambda s: S.tornado(s, (16, 16, 16), 2).withColumns({c: _r(c) for c in "uvw"}))


# projections and transforms
def _field_query(name: str, body: str, make, *ctes: str) -> None:
    query(name, O.field(body, *ctes))(lambda spark, d: make(field2dt(spark, d)))


_field_query("field_slice_time", "SELECT t, j, i, f FROM field WHERE t = 7", lambda f: D.slice_time(f, 7))
_field_query(
    "field_subarray",
    "SELECT t, j - 1 AS j, i - 3 AS i, f FROM field WHERE i BETWEEN 3 AND 8 AND j BETWEEN 1 AND 4",
    lambda f: D.slice_box(f, {"i": 3, "j": 1}, {"i": 6, "j": 4}, reorigin=True),
)
_field_query("field_clamp", "SELECT t, j, i, CAST(least(greatest(f, 10), 20) AS BIGINT) AS f FROM field", lambda f: D.clamp(f, 10, 20).withColumn("f", F.col("f").cast("long")))
_field_query("field_transpose", "SELECT t, i AS j, j AS i, f FROM field", lambda f: D.transpose(f).select("t", "j", "i", "f"))
_field_query(
    "field_reshape",
    "SELECT t, (j * 16 + i) % 32 AS i, (j * 16 + i) // 32 AS j, f FROM field",
    lambda f: D.reshape(f, (16, 8), (32, 4)),
)
_field_query("field_quantize", "SELECT t, j, i, CAST(trunc(f * 0.75) AS BIGINT) AS f FROM field", lambda f: D.quantize(f, 0.75))
_field_query(
    "field_elementwise",
    "SELECT a.t, a.j, a.i, a.f * b.g AS f FROM field a JOIN (SELECT t, j, i, f + 1 AS g FROM field) b USING (t, j, i)",
    lambda f: D.elementwise(f, f.withColumn("f", F.col("f") + 1), "*").select("t", "j", "i", "f"),
)
_field_query("field_components", "SELECT t, j, i, f AS u, f * 2 AS v FROM field", lambda f: D.components(f.withColumn("g", F.col("f") * 2), "f", "g").select("t", "j", "i", F.col("v")[0].alias("u"), F.col("v")[1].alias("v")))
_field_query("field_stack", "SELECT t - 3 AS t, j, i, f FROM field WHERE t IN (3, 4)", lambda f: D.stack([D.slice_time(f, 3), D.slice_time(f, 4)]).select("t", "j", "i", "f"))
_field_query("field_min_max", "SELECT t, MIN(f) AS lo, MAX(f) AS hi FROM field GROUP BY t", D.min_max)
_field_query("field_maxabs", "SELECT t, MAX(abs(f)) AS maxabs FROM field GROUP BY t", D.max_abs)
_field_query("field_resolution", "SELECT t, CAST(MIN(CASE WHEN f <> 0 THEN abs(f) END) AS DOUBLE) AS resolution FROM field GROUP BY t", D.resolution)
_field_query(
    "scaling_factor",
    "SELECT t, CAST(2 ** least(greatest(ceil(log2(1.0 / MIN(r) OVER (ORDER BY t))), 8), 21) AS BIGINT) AS factor FROM (SELECT t, MIN(CASE WHEN f <> 0 THEN f / 1000.0 END) AS r FROM field GROUP BY t)",
    lambda f: D.scaling_factor(f.withColumn("f", F.col("f") / 1000.0)),
)
_field_query("threshold_mask", f"SELECT t, j, i, f, CASE WHEN f >= {O.LEVEL} THEN 1 ELSE 0 END AS mask FROM field", lambda f: D.threshold(f, O.LEVEL))
_field_query("roi_threshold", "SELECT t, ROUND(2 * stddev_pop(f), 6) AS threshold FROM field WHERE i BETWEEN 4 AND 11 GROUP BY t", lambda f: D.roi_threshold(f, 2.0, F.col("i").between(4, 11)).withColumn("threshold", _r("threshold")))
query("field_perturb")(lambda spark, d: D.perturb(field2dt(spark, d), 0.5, seed=3))


# stencils
_field_query("gradient2d", "SELECT t, j, i, f, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM grad", lambda f: D.gradient2d(f, W, H).withColumns({c: F.col(c).cast("long") for c in "uv"}), O.GRAD)
_IN = f"i > 0 AND i < {W - 1} AND j > 0 AND j < {H - 1}"
_field_query(
    "gradient2dt",
    f"SELECT t, j, i, f, CASE WHEN {_IN} THEN u * 0.5 ELSE 0.0 END::DOUBLE AS u, CASE WHEN {_IN} THEN v * 0.5 ELSE 0.0 END::DOUBLE AS v FROM grad",
    lambda f: D.gradient2dt(f, W, H),
    O.GRAD,
)


def _hess(scale: bool) -> str:
    def diff(c: str, a: str, n: int) -> str:
        if scale:
            return f"{O.near(c, a, 1)} - {O.near(c, a, -1)} * {n}"
        return f"({O.near(c, a, 1)} - {O.near(c, a, -1)}) * {n}"

    return f"""SELECT t, j, i, CAST(a AS BIGINT) AS j00, CAST((b + c) * 0.5 AS DOUBLE) AS j01, CAST(d AS BIGINT) AS j11
    FROM (SELECT t, j, i, {diff('u', 'i', W - 1)} AS a, {diff('u', 'j', H - 1)} AS b, {diff('v', 'i', W - 1)} AS c, {diff('v', 'j', H - 1)} AS d FROM grad)"""


def _hessian(compat: bool):
    def run(f: DataFrame) -> DataFrame:
        j = D.jacobian2d(D.gradient2d(f, W, H), W, H, symmetric=True, compat=compat)
        return j.select("t", "j", "i", F.col("j00").cast("long"), F.col("j01").cast("double"), F.col("j11").cast("long"))

    return run


_field_query("hessian2d", _hess(False), _hessian(False), O.GRAD)
_field_query("hessian2d_compat", _hess(True), _hessian(True), O.GRAD)
_field_query(
    "conv2d_box",
    "SELECT a.t, a.j, a.i, CAST(SUM(b.f) AS BIGINT) AS f FROM field a JOIN field b ON a.t = b.t AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.t, a.j, a.i",
    lambda f: D.convolve(f, [[1, 1, 1]] * 3).withColumn("f", F.col("f").cast("long")),
)
_KS = "SELECT * FROM (VALUES " + ", ".join(f"({n}, {float(k)!r})" for n, k in zip((-2, -1, 0, 1, 2), D.gaussian_kernel(1.0, 5))) + ") g(d, w)"
_field_query(
    "conv2d_gauss",
    f"SELECT a.t, a.j, a.i, ROUND(SUM(b.f * x.w * y.w), 6) AS f FROM field a JOIN field b ON a.t = b.t JOIN ({_KS}) x ON b.i - a.i = x.d JOIN ({_KS}) y ON b.j - a.j = y.d GROUP BY a.t, a.j, a.i",
    lambda f: D.smooth(f, 1.0, 5).withColumn("f", _r("f")),
)
_field_query(
    "temporal_fir",
    f"SELECT a.t, a.j, a.i, ROUND(SUM(b.f * x.w), 6) AS f FROM field a CROSS JOIN ({_KS}) x JOIN field b ON a.i = b.i AND a.j = b.j AND b.t = least(greatest(a.t + x.d, 0), {T - 1}) GROUP BY a.t, a.j, a.i",
    lambda f: D.smooth_time(f, 1.0, 2).withColumn("f", _r("f")),
)


def _solid(f: DataFrame) -> DataFrame:
    """The field's steps as a third axis, with three components."""
    return f.select(F.lit(0).cast("long").alias("t"), F.col("t").cast("int").alias("k"), "j", "i", F.col("f").alias("u"), (F.col("f") * F.col("i")).alias("v"), (F.col("f") * F.col("j")).alias("w"))


_VORT = ", ".join(
    f"lead({c}) OVER (PARTITION BY {', '.join(x for x in 'kji' if x != a)} ORDER BY {a}) - lag({c}) OVER (PARTITION BY {', '.join(x for x in 'kji' if x != a)} ORDER BY {a}) AS d{c}{a}"
    for c in "uvw"
    for a in "ijk"
)
_ALL = " + ".join(f"d{c}{a}" for c in "uvw" for a in "ijk")
_field_query(
    "vorticity3d",
    f"""SELECT k, j, i, CAST(CASE WHEN {_ALL} IS NULL THEN 0 ELSE dwj - dvk END AS BIGINT) AS wx, CAST(CASE WHEN {_ALL} IS NULL THEN 0 ELSE duk - dwi END AS BIGINT) AS wy,
    CAST(CASE WHEN {_ALL} IS NULL THEN 0 ELSE dvi - duj END AS BIGINT) AS wz FROM (SELECT *, {_VORT} FROM (SELECT t AS k, j, i, f AS u, f * i AS v, f * j AS w FROM field))""",
    lambda f: D.vorticity3d(_solid(f)).select("k", "j", "i", *[F.col(c).cast("long").alias(c) for c in ("wx", "wy", "wz")]),
)
_field_query(
    "cross_product3d",
    "SELECT t, j, i, f * j * 3 - f * 2 * (f - 1) AS cx, f * 2 - i * f * 3 AS cy, i * (f - 1) - j AS cz FROM field",
    lambda f: f.withColumns({"one": F.lit(1).cast("long"), "fm": F.col("f") - 1, "f2": F.col("f") * 2, "f3": F.col("f") * 3}).select("t", "j", "i", *[c.alias(n) for n, c in zip(("cx", "cy", "cz"), D.cross(("i", "j", "f2"), ("one", "fm", "f3")))]),
)



# mesh
@query(
    "element_ids",
    f"SELECT (i + j * 6 + t * 30) * 12 + s.kind AS tag, CAST(s.kind AS INTEGER) AS kind, s.ord = 1 AS ordinal FROM (SELECT a.range AS i, b.range AS j, c.range AS t FROM range(6) a, range(5) b, range(4) c) g, {O.values(O._faces())} s(kind, ord, {', '.join(O._OFF)}, mx, my, mz) WHERE i + mx < 6 AND j + my < 5 AND t + mz < 4",
)
def element_ids(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, Lattice((0, 0, 0), (6, 5, 4)), 2).select("tag", "kind", "ordinal")


# extraction
def _hits(spark: SparkSession, d: str) -> DataFrame:
    return X.critical_points_2d(field2dt(spark, d), SHAPE, T, bits=0)


@query("cp2d_hits", O.field("SELECT tag, CAST(kind AS INTEGER) AS kind, timestep, ordinal FROM hits", O.GRAD, O.HITS))
def cp2d_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("tag", "kind", "timestep", "ordinal")


@query("cp2d_points")
def cp2d_points(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("tag", "timestep", _r("x").alias("x"), _r("y").alias("y"), _r("t").alias("t"), "type")


@query("cp2d_incidence", O.field("SELECT tag, tet AS other FROM inc", O.GRAD, O.HITS, O.INC))
def cp2d_incidence(spark: SparkSession, d: str) -> DataFrame:
    return G.incident(_hits(spark, d), DOMAIN, 2, up=True)


@query("cp2d_links", O.field("SELECT DISTINCT a.tag AS a, b.tag AS b FROM inc a JOIN inc b ON a.tet = b.tet AND a.tag < b.tag", O.GRAD, O.HITS, O.INC))
def cp2d_links(spark: SparkSession, d: str) -> DataFrame:
    return G.point_graph(_hits(spark, d), DOMAIN, 2)


@query("cp2d_curves")
def cp2d_curves(spark: SparkSession, d: str) -> DataFrame:
    return G.trace(_hits(spark, d), DOMAIN, 2).select("tag", "root", "piece", "seq", "loop")


@query("cp2d_post_processed")
def cp2d_post_processed(spark: SparkSession, d: str) -> DataFrame:
    out = C.post_process(G.trace(_hits(spark, d), DOMAIN, 2), compat=True)
    return C.statistics(out, ("x", "y", "scalar"))


@query("woven_curves")
def woven_curves(spark: SparkSession, d: str) -> DataFrame:
    f = S.woven_grid(spark, 31, 37, 32)
    return C.statistics(G.trace(X.critical_points_2d(f, (31, 37), 32), X.domain((31, 37), 32, 2), 2), ("x", "y", "scalar"))


@query("contour_points", O.field("SELECT tag, timestep, ordinal, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(t, 6) AS t FROM pts", O.EDGES))
def contour_points(spark: SparkSession, d: str) -> DataFrame:
    p = X.contour_points(field2dt(spark, d), SHAPE, T, O.CONTOUR)
    return p.select("tag", "timestep", "ordinal", _r("x").alias("x"), _r("y").alias("y"), _r("t").alias("t"))


def _ring(spark: SparkSession) -> tuple[DataFrame, Lattice]:
    return X.contour_points(S.moving_extremum(spark, (16, 16), 6, (7.0, 7.0)), (16, 16), 6, 12.3), Lattice((0, 0, 0), (16, 16, 6))


@query("contour_surface")
def contour_surface(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of a level set in space-time: its edge points meet in the tetrahedra that they bound."""
    return G.level_triangles(*_ring(spark))


@query("contour_slice")
def contour_slice(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = _ring(spark)
    return G.slice_surface(hits, contour_surface(spark, d), 3)


@query("contour_volume")
def contour_volume(spark: SparkSession, d: str) -> DataFrame:
    f = S.moving_extremum(spark, (8, 8, 8), 3, (3.4, 3.4, 3.4))
    return G.volumes(X.contour_points(f, (8, 8, 8), 3, 4.3), Lattice((0, 0, 0, 0), (8, 8, 8, 3)))


@query("cp3d_hits")
def cp3d_hits(spark: SparkSession, d: str) -> DataFrame:
    return X.critical_points_3d(S.moving_extremum(spark, (12, 12, 12), 4, (5.2, 5.3, 5.4)), (12, 12, 12), 4)


def _abc(spark: SparkSession) -> DataFrame:
    return S.abc_flow(spark, 10, 10, 10).withColumn("t", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))




@query("phase_vortices")
def phase_vortices(spark: SparkSession, d: str) -> DataFrame:
    f = S.grid(spark, (10, 10, 6), 2).withColumns({"re": F.col("i") - 4.3 - 0.2 * F.col("t"), "im": F.col("j") - 4.6})
    return X.phase_vortices(f, (10, 10, 6), 2)


# components, graph and events
def _labels(spark: SparkSession, d: str) -> DataFrame:
    return K.label_components(field2dt(spark, d), SHAPE, O.LEVEL)


@query("threshold_labels", O.field("SELECT t, j, i, label FROM labels", O.LABELS, recursive=True))
def threshold_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


@query("threshold_numbers", O.field("SELECT t, j, i, CAST(dense_rank() OVER (PARTITION BY t ORDER BY label) AS BIGINT) AS label FROM labels", O.LABELS, recursive=True))
def threshold_numbers(spark: SparkSession, d: str) -> DataFrame:
    return K.label_components(field2dt(spark, d), SHAPE, O.LEVEL, numbered=True)


@query("overlap_edges", O.field("SELECT t0, l0, t1, l1 FROM overlap", O.LABELS, O.OVERLAP, recursive=True))
def overlap_edges(spark: SparkSession, d: str) -> DataFrame:
    return K.overlap(_labels(spark, d))


@query(
    "global_labels",
    O.field('SELECT n.t, n.label, MIN(c.seen) AS "global" FROM nodes n JOIN chain c ON n.label = c.node GROUP BY ALL', O.LABELS, O.OVERLAP, O.NODES, O.CHAINS, recursive=True),
)
def global_labels(spark: SparkSession, d: str) -> DataFrame:
    lab = G.materialize(_labels(spark, d), "labels")
    return K.global_labels(K.overlap(lab), lab.select("t", "label").distinct())


@query(
    "events",
    O.field(f"SELECT t0, t1, n_left, n_right, left_sum::BIGINT AS left_sum, right_sum::BIGINT AS right_sum, {O.EVENT_TYPE} AS type FROM grouped WHERE NOT (n_left = 1 AND n_right = 1)", O.LABELS, O.OVERLAP, O.NODES, O.EVENTS, recursive=True),
)
def tracking_events(spark: SparkSession, d: str) -> DataFrame:
    lab = G.materialize(_labels(spark, d), "labels")
    e = K.events(K.overlap(lab), lab.select("t", "label").distinct())
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("t0", "t1", F.size("lhs").cast("long").alias("n_left"), F.size("rhs").cast("long").alias("n_right"), total("lhs").alias("left_sum"), total("rhs").alias("right_sum"), "type")


# trajectories
def _traj_query(name: str, body: str | None, make, *ctes: str) -> None:
    query(name, O.traj(body, *ctes) if body else None)(lambda spark, d: make(trajectories(spark, d)))


_traj_query(
    "curve_stats",
    "SELECT id, COUNT(*) AS n, ROUND(MIN(t), 6) AS tmin, ROUND(MAX(t), 6) AS tmax, ROUND(MIN(x), 6) AS min_x, ROUND(MAX(x), 6) AS max_x, ROUND(MAX(x) - MIN(x), 6) AS persistence_x, CASE WHEN MIN(type) = MAX(type) THEN MIN(type) ELSE 0 END AS consistent_type FROM traj GROUP BY id",
    lambda t: C.statistics(t).select("id", "n", _r("tmin").alias("tmin"), _r("tmax").alias("tmax"), *[_r(c).alias(c) for c in ("min_x", "max_x", "persistence_x")], "consistent_type"),
)
_traj_query(
    "curve_velocity",
    "SELECT id, seq, ROUND((COALESCE(lead(x) OVER w, x) - COALESCE(lag(x) OVER w, x)) * CASE WHEN lead(seq) OVER w IS NOT NULL AND lag(seq) OVER w IS NOT NULL THEN 0.5 ELSE 1 END, 6) AS vx FROM traj WINDOW w AS (PARTITION BY id ORDER BY seq)",
    lambda t: C.velocity(t, "x").select("id", "seq", _r("vx").alias("vx")),
)
_traj_query(
    "curve_split",
    "SELECT id, seq, CAST(SUM(CASE WHEN type <> p THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS sub FROM (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY seq) AS p FROM traj)",
    lambda t: C.split(t).select("id", "seq", "sub"),
)
_traj_query("curve_intercept", "SELECT id, seq FROM traj WHERE t BETWEEN 432000 AND 864000", lambda t: C.intercept(t, 432000, 864000).select("id", "seq"))
_traj_query("curve_discard_interval", "SELECT id, seq FROM traj WHERE ordinal", lambda t: C.discard_interval_points(t).select("id", "seq"))
_traj_query("curve_discard_degenerate", "SELECT id, seq FROM traj WHERE type NOT IN (0, 1)", lambda t: C.discard_degenerate_points(t).select("id", "seq"))
_traj_query(
    "curve_select",
    "SELECT id, seq FROM traj WHERE id IN (SELECT id FROM traj GROUP BY id HAVING COUNT(*) >= 60)",
    lambda t: C.select_curves(t, F.col("n") >= 60).select("id", "seq"),
)
_traj_query(
    "curve_prune_short",
    "SELECT id, seq FROM traj WHERE id IN (SELECT id FROM traj GROUP BY id HAVING MAX(t) - MIN(t) >= 2400000)",
    lambda t: C.prune_short(t, 2400000.0).select("id", "seq"),
)
_traj_query(
    "smooth_ordinal_types",
    """SELECT id, seq, CASE WHEN a <> 0 AND a = b AND a = c AND a = d THEN a ELSE type END AS type FROM (
      SELECT id, seq, type, lag(type, 1) OVER w AS a, lag(type, 2) OVER w AS b, lead(type, 1) OVER w AS c, lead(type, 2) OVER w AS d FROM traj WHERE ordinal WINDOW w AS (PARTITION BY id ORDER BY seq))
    UNION ALL SELECT id, seq, type FROM traj WHERE NOT ordinal""",
    lambda t: C.smooth_ordinal_types(t).select("id", "seq", "type"),
)
_traj_query(
    "smooth_interval_types",
    """SELECT id, seq, CASE WHEN a IS NULL AND b IS NULL THEN type WHEN a IS NULL THEN b
      WHEN b IS NULL OR MAX(CASE WHEN type <> a THEN 1 ELSE 0 END) OVER (PARTITION BY id, g ORDER BY seq) = 0 THEN a ELSE b END AS type FROM (
      SELECT id, seq, type, SUM(ordinal::INT) OVER w AS g, last_value(CASE WHEN ordinal THEN type END IGNORE NULLS) OVER w AS a,
        first_value(CASE WHEN ordinal THEN type END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
      FROM traj WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    lambda t: C.smooth_interval_types(t).select("id", "seq", "type"),
)
_traj_query(
    "curve_reorder",
    "SELECT id, MAX(seq) OVER (PARTITION BY id) - seq AS seq, ROUND(-t, 6) AS t FROM traj",
    lambda t: C.reorder(t.withColumn("t", -F.col("t")).withColumn("timestep", F.floor("t"))).select("id", "seq", _r("t").alias("t")),
)
_traj_query(
    "curve_unwrap",
    "SELECT id, seq, ROUND(x + 100 * SUM(CASE WHEN x - p >= 50 THEN -1 WHEN x - p <= -50 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq), 6) AS x FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY seq) AS p FROM (SELECT id, seq, x % 100 AS x FROM traj))",
    lambda t: C.unwrap(t.withColumn("x", F.col("x") % 100), "x", 100.0).select("id", "seq", _r("x").alias("x")),
)
_traj_query(
    "split_geo",
    "SELECT id, seq, CAST(SUM(CASE WHEN abs(x - p) > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS sub FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY seq) AS p FROM (SELECT id, seq, (x * 37) % 360 - 180 AS x FROM traj))",
    lambda t: C.split_geo(t.withColumn("lon", (F.col("x") * 37) % 360 - 180)).select("id", "seq", "sub"),
)
_traj_query(
    "to_geo",
    "SELECT id, seq, ROUND(degrees(atan2(b, a)), 6) AS lon, ROUND(degrees(asin(c / sqrt(a * a + b * b + c * c))), 6) AS lat FROM (SELECT id, seq, x + 1 AS a, t / 1e5 - 10 AS b, seq + 1.0 AS c FROM traj)",
    lambda t: C.to_geo(t.select("id", "seq", (F.col("x") + 1).alias("x"), (F.col("t") / 1e5 - 10).alias("y"), (F.col("seq") + 1.0).alias("z"))).select("id", "seq", _r("lon").alias("lon"), _r("lat").alias("lat")),
)
_traj_query(
    "adjust_time",
    """SELECT id, seq, ROUND(CASE WHEN ordinal THEN y ELSE MIN(y) OVER (PARTITION BY id, g2 ORDER BY seq DESC) END, 3) AS t FROM (
      SELECT *, SUM(ordinal::INT) OVER (PARTITION BY id ORDER BY seq DESC) AS g2 FROM (
        SELECT *, CASE WHEN ordinal THEN t ELSE MAX(t) OVER (PARTITION BY id, g ORDER BY seq) END AS y FROM (
          SELECT id, seq, x AS t, ordinal, SUM(ordinal::INT) OVER (PARTITION BY id ORDER BY seq) AS g FROM traj)))""",
    lambda t: C.adjust_time(t.withColumn("t", F.col("x"))).select("id", "seq", _r("t", 3).alias("t")),
)
_traj_query("curve_relabel", "SELECT dense_rank() OVER (ORDER BY id) - 1 AS id, seq FROM traj", lambda t: C.relabel(t).select("id", "seq"))


# lookups
@query(
    "nearest_neighbor",
    "SELECT pid, arg_min(vid, (d2, vid)) AS vid, ROUND(MIN(d2), 4) AS d2 FROM (SELECT s_suppkey AS pid, c_custkey AS vid, (s_acctbal - c_acctbal) ** 2 + (s_nationkey * 100 - c_nationkey * 100) ** 2 AS d2 FROM supplier, customer) GROUP BY pid",
)
def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("pid"), F.col("s_acctbal").alias("px"), (F.col("s_nationkey") * 100.0).alias("py"))
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("vid"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return U.nearest(p, t, 100.0).withColumn("d2", _r("d2", 4))


@query(
    "piecewise_lerp",
    """WITH knots AS (SELECT n_nationkey * 400.0 - 1000 AS x, n_nationkey * n_nationkey * 1.5 AS y FROM nation), w AS (SELECT *, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM knots)
    SELECT c_custkey AS key, ROUND(CASE WHEN c_acctbal < (SELECT MIN(x) FROM knots) THEN (SELECT arg_min(y, x) FROM knots) WHEN nx IS NULL THEN y ELSE y + (c_acctbal - x) / (nx - x) * (ny - y) END, 8) AS yi
    FROM customer LEFT JOIN w ON c_acctbal >= x AND (c_acctbal < nx OR nx IS NULL)""",
)
def piecewise_lerp(spark: SparkSession, d: str) -> DataFrame:
    knots = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 400.0 - 1000).alias("x"), (F.col("n_nationkey") * F.col("n_nationkey") * 1.5).alias("y"))
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("xi"))
    return U.lerp_lookup(keys, knots).select("key", _r("yi", 8).alias("yi"))


@query(
    "temporal_lerp",
    O.field("SELECT a.j * 16 + a.i AS key, a.t + 0.25 AS tq, ROUND(0.75 * a.f + 0.25 * b.f, 6) AS value FROM field a JOIN field b ON a.i = b.i AND a.j = b.j AND b.t = a.t + 1"),
)
def temporal_lerp(spark: SparkSession, d: str) -> DataFrame:
    f = field2dt(spark, d).select((F.col("j") * 16 + F.col("i")).cast("long").alias("key"), "t", "f")
    q = f.where("t < 27").select("key", (F.col("t") + 0.25).alias("tq"))
    return U.temporal_lerp(q, f).withColumn("value", _r("value"))


# unstructured meshes
@query("mesh_edges", "SELECT DISTINCT a AS v0, b AS v1 FROM (SELECT j * 9 + i AS a, j * 9 + i + 1 AS b FROM (SELECT x.range AS i, y.range AS j FROM range(8) x, range(7) y) UNION ALL SELECT j * 9 + i, (j + 1) * 9 + i FROM (SELECT x.range AS i, y.range AS j FROM range(9) x, range(6) y) UNION ALL SELECT j * 9 + i, (j + 1) * 9 + i + 1 FROM (SELECT x.range AS i, y.range AS j FROM range(8) x, range(6) y))")
def mesh_edges(spark: SparkSession, d: str) -> DataFrame:
    return U.faces(U.structured_triangles(spark, 9, 7)[1], 2)


def _mesh_points(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    v, t = U.structured_triangles(spark, 12, 12)
    f = S.moving_extremum_on(v, (0.41, 0.43), (0.02, 0.02), 5, gradient=True).join(v, "vid")
    return U.critical_points(t, f, 144, 5, ("u", "v"), ("x", "y")), t


query("mesh_critical_points")(lambda spark, d: _mesh_points(spark)[0])


@query("mesh_curves")
def mesh_curves(spark: SparkSession, d: str) -> DataFrame:
    p, t = _mesh_points(spark)
    return U.track(G.materialize(p, "points"), t, 144, 5)


# particles
@query("particles_double_gyre")
def particles_double_gyre(spark: SparkSession, d: str) -> DataFrame:
    f = S.double_gyre(spark, 64, 32, 6).withColumns({"u": F.col("u") * 31.5 * 0.1, "v": F.col("v") * 31.0 * 0.1})
    return P.trace_particles(f, P.seed_grid(spark, (64, 32), (8, 8), 4), (64, 32), 6)


def ENTRY(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    """The flagship: field view, gradient, critical points, components, curves with statistics."""
    return C.statistics(G.trace(_hits(spark, d), DOMAIN, 2), ("x", "y", "scalar"))


from . import more as _more  # noqa: E402, F401  (registers further queries)

ORACLES.update(O.LATER)
