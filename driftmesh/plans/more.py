"""More registered queries: sources, stencils, meshes, graphs, curves and seeds, each with SQL of its own derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import features as X
from ..operators import fields as D
from ..operators import graph as G
from ..operators import particles as P
from ..operators import tracking as K
from ..operators import unstructured as U
from ..sources import synthetic as S
from ..sources.views import H, W, field2dt, trajectories
from . import oracle as O
from .queries import _GRID, _GRID3, _r, _solid, query

PI = "pi()"


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: _r(c, digits) for c in cols})


def _add(name: str, sql: str | None, make) -> None:
    query(name, sql)(lambda spark, d: make(spark))


def _of_field(name: str, body: str, make, *ctes: str) -> None:
    query(name, O.field(body, *ctes))(lambda spark, d: make(field2dt(spark, d)))


# sources
_AB = "x * cos(s) - y * sin(s) AS a, x * sin(s) + y * cos(s) AS b"
_DX, _DY = "cos(a) * cos(b) * sin(s) - sin(a) * sin(b) * cos(s)", "cos(a) * cos(b) * cos(s) + sin(a) * sin(b) * sin(s)"


def _xy(w: int, h: int) -> str:
    return f"(i / {w - 1}.0 - 0.5) * 15 AS x, (j / {h - 1}.0 - 0.5) * 15 AS y"


def _woven_gradient(spark: SparkSession) -> DataFrame:
    x, y, t = (F.col("i") / 15.0 - 0.5) * 15, (F.col("j") / 11.0 - 0.5) * 15, F.col("t") / 4.0
    return _rounded(S.grid(spark, (16, 12), 5).withColumns({"u": S.woven_dx(x, y, t), "v": S.woven_dy(x, y, t)}), "u", "v")


_add("synth_woven_gradient", f"SELECT t, j, i, ROUND({_DX}, 6) AS u, ROUND({_DY}, 6) AS v FROM (SELECT *, {_AB} FROM (SELECT *, {_xy(16, 12)}, t / 4.0 AS s FROM ({_GRID.format(t=5, h=12, w=16)})))", _woven_gradient)
_add(
    "synth_woven_capped",
    f"SELECT t, j, i, ROUND(CASE WHEN cos(a) * sin(b) < 0.5 THEN {_DX} ELSE 0 END, 6) AS u, ROUND(CASE WHEN cos(a) * sin(b) < 0.5 THEN {_DY} ELSE 0 END, 6) AS v, CAST(0 AS DOUBLE) AS w FROM (SELECT *, {_AB} FROM (SELECT *, {_xy(20, 18)}, 1e-4 AS s FROM ({_GRID.format(t=1, h=18, w=20)})))",
    lambda s: _rounded(S.capped_woven_gradient(s, 20, 18, cap=0.5), "u", "v"),
)
_add(
    "synth_woven_part",
    f"SELECT t, j, i, ROUND(cos(a) * sin(b), 6) AS f FROM (SELECT *, {_AB} FROM (SELECT *, {_xy(32, 32)}, t / 3.0 AS s FROM ({_GRID.format(t=4, h=32, w=32)}))) WHERE i BETWEEN 4 AND 10 AND j BETWEEN 20 AND 30",
    lambda s: _rounded(S.woven_part(s, 32, 32, 4, 11, 20, 31, 4), "f"),
)
_add(
    "synth_woven_spacetime",
    f"SELECT t, j, i, ROUND(cos(a) * sin(b), 6) AS f FROM (SELECT *, {_AB} FROM (SELECT *, {_xy(10, 10)}, t / 19.0 + 1e-4 AS s FROM ({_GRID.format(t=20, h=10, w=10)})))",
    lambda s: _rounded(S.woven_grid(s, 10, 10, 20, offset=1e-4), "f"),
)
_add("synth_dispatch", f"SELECT t, k, j, i, ROUND((i - 10 - 0.1 * t) ** 2 + (j - 10 - 0.11 * t) ** 2 + (k - 10 - 0.1 * t) ** 2, 6) AS f FROM ({_GRID3.format(t=3, d=9, h=8, w=7)})", lambda s: _rounded(S.synthetic(s, "moving_extremum_3d", shape=(7, 8, 9), steps=3), "f"))


def _verts(w: int, h: int) -> str:
    return f"verts AS (SELECT range AS vid, (range % {w}) / {w - 1}.0 AS x, (range // {w}) / {h - 1}.0 AS y FROM range({w * h}))"


def _tris(w: int, h: int) -> str:
    return (
        f"tris AS (SELECT (j * {w - 1} + i) * 2 + k AS tid, j * {w} + i AS v0, j * {w} + i + CASE WHEN k = 0 THEN 1 ELSE {w} END AS v1, j * {w} + i + {w + 1} AS v2 "
        f"FROM (SELECT a.range AS i, b.range AS j, c.range AS k FROM range({w - 1}) a, range({h - 1}) b, range(2) c))"
    )


def _mesh(body: str, *ctes: str, w: int = 12, h: int = 12, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join([_verts(w, h), _tris(w, h), *ctes]) + " " + body


_TIMES = "(VALUES (0, 0.1), (1, 0.2)) q(t, s)"
_WOVEN_ON = f"field AS (SELECT CAST(t AS BIGINT) AS t, vid, cos(a) * sin(b) AS f FROM (SELECT *, {_AB} FROM (SELECT q.t, q.s, vid, (x - 0.5) * 10 AS x, (y - 0.5) * 10 AS y FROM verts, {_TIMES})))"
_add("synth_woven_mesh", _mesh("SELECT t, vid, ROUND(f, 6) AS f FROM field", _WOVEN_ON), lambda s: _rounded(S.woven_on(U.structured_triangles(s, 12, 12)[0], [0.1, 0.2]), "f"))
_GYRE_ON = f"""gyre AS (SELECT t, vid, -{PI} * 0.1 * sin({PI} * g) * cos({PI} * y) AS u, {PI} * 0.1 * cos({PI} * g) * sin({PI} * y) * (2 * a * x + 1 - 2 * a) AS v
  FROM (SELECT *, a * x * x + (1 - 2 * a) * x AS g FROM (SELECT CAST(q.range AS BIGINT) AS t, vid, x, y, 0.25 * sin(0.2 * {PI} * q.range) AS a FROM verts, range(4) q)))"""
_add("synth_gyre_mesh", _mesh("SELECT t, vid, ROUND(u, 6) AS u, ROUND(v, 6) AS v FROM gyre", _GYRE_ON), lambda s: _rounded(S.double_gyre_on(U.structured_triangles(s, 12, 12)[0], [0.0, 1.0, 2.0, 3.0]), "u", "v"))
_EXTREMUM_ON = "SELECT CAST(q.range AS BIGINT) AS t, vid, x - 0.5 - 0.02 * q.range AS a, y - 0.5 - 0.02 * q.range AS b FROM verts, range(4) q"
_add("synth_extremum_mesh", _mesh(f"SELECT t, vid, ROUND(a * a + b * b, 6) AS f FROM ({_EXTREMUM_ON})"), lambda s: _rounded(S.moving_extremum_on(U.structured_triangles(s, 12, 12)[0], (0.5, 0.5), (0.02, 0.02), 4), "f"))
_add(
    "synth_extremum_gradient_mesh",
    _mesh(f"SELECT t, vid, ROUND(-2 * a, 6) AS u, ROUND(-2 * b, 6) AS v FROM ({_EXTREMUM_ON})"),
    lambda s: _rounded(S.moving_extremum_on(U.structured_triangles(s, 12, 12)[0], (0.5, 0.5), (0.02, 0.02), 4, gradient=True), "u", "v"),
)

# stencils in three dimensions, on the steps of the field as a third axis
_SOLID = "solid AS (SELECT t AS k, j, i, f AS u, f * i AS v, f * j AS w FROM field)"


def _step(c: str, a: str) -> str:
    win = f"(PARTITION BY {', '.join(x for x in 'kji' if x != a)} ORDER BY {a})"
    return f"(lead({c}) OVER {win} - lag({c}) OVER {win})"


def _whole(names: list[str]) -> str:
    return " + ".join(names) + " IS NULL"


_GR = {n: _step("u", a) for n, a in zip("uvw", "ijk")}
_of_field(
    "gradient3d",
    f"SELECT k, j, i, {', '.join(f'CAST(CASE WHEN {_whole(['gu', 'gv', 'gw'])} THEN 0 ELSE 0.5 * g{n} END AS DOUBLE) AS {n}' for n in 'uvw')} FROM (SELECT k, j, i, {', '.join(f'{e} AS g{n}' for n, e in _GR.items())} FROM solid)",
    lambda f: D.gradient3d(_solid(f).select("t", "k", "j", "i", F.col("u").alias("f"))).select("k", "j", "i", "u", "v", "w"),
    _SOLID,
)
_JN = {f"j{r}{c}": _step(n, a) for c, a in enumerate("ijk") for r, n in enumerate("uvw")}
_JAC = f"jac AS (SELECT k, j, i, u, v, w, {', '.join(f'CASE WHEN {_whole([f"d{m}" for m in _JN])} THEN 0.0 ELSE 0.5 * d{n} END AS {n}' for n in _JN)} FROM (SELECT *, {', '.join(f'{e} AS d{n}' for n, e in _JN.items())} FROM solid))"
_of_field("jacobian3d", f"SELECT k, j, i, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _JN)} FROM jac", lambda f: D.jacobian3d(_solid(f)).select("k", "j", "i", *_JN), _SOLID, _JAC)


def _product(transposed: bool) -> str:
    rows = [" + ".join(f"j{c}{r} * {n}" if transposed else f"j{r}{c} * {n}" for c, n in enumerate("uvw")) for r in range(3)]
    return "SELECT k, j, i, " + ", ".join(f"CAST({e} AS DOUBLE) AS {a}" for e, a in zip(rows, ("ax", "ay", "az"))) + " FROM jac"


for _name, _t in (("acceleration3d", False), ("jacobian_transposed3d", True)):
    _of_field(_name, _product(_t), lambda f, t=_t: D.acceleration(_solid(f), transposed=t).select("k", "j", "i", "ax", "ay", "az"), _SOLID, _JAC)


def _box(f: DataFrame) -> DataFrame:
    return _solid(f).select("t", "k", "j", "i", F.col("u").alias("f"))


_of_field(
    "conv3d_box",
    "SELECT a.k, a.j, a.i, CAST(SUM(b.u) AS BIGINT) AS f FROM solid a JOIN solid b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL",
    lambda f: D.convolve(_box(f), [[[1, 1, 1]] * 3] * 3).select("k", "j", "i", F.col("f").cast("long").alias("f")),
    _SOLID,
)
_W3 = [float(x) for x in D.gaussian_kernel(0.8, 3)]
_G3 = f"[{_W3[0]!r}e0, {_W3[1]!r}e0, {_W3[2]!r}e0]"
_of_field(
    "conv3d_gauss",
    f"SELECT a.k, a.j, a.i, ROUND(SUM(b.u * {_G3}[b.i - a.i + 2] * {_G3}[b.j - a.j + 2] * {_G3}[b.k - a.k + 2]), 6) AS f FROM solid a JOIN solid b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL",
    lambda f: _rounded(D.smooth(_box(f), 0.8, 3).select("k", "j", "i", "f"), "f"),
    _SOLID,
)
_of_field(
    "conv2d_mean",
    "SELECT a.t, a.j, a.i, ROUND(SUM(b.f * (b.i - a.i + 2) * (b.j - a.j + 3)) / 9.0, 6) AS f FROM field a JOIN field b ON a.t = b.t AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL",
    lambda f: _rounded(D.convolve(f, [[(i + 2) * (j + 3) for j in (-1, 0, 1)] for i in (-1, 0, 1)], mean=True).select("t", "j", "i", "f"), "f"),
)


# simplex tables, by chains of growing sets of axes: vertex v of a cell's corner simplex is the set of axes along which it lies one step on
def _chains(n: int, k: int) -> str:
    return f"chain{k}(m, last, verts) AS (SELECT 0, 0, [0] UNION ALL SELECT m + 1, b.range, list_append(verts, b.range) FROM chain{k}, range({2**n}) b WHERE m < {k} AND b.range > last AND (b.range & last) = last), types{k} AS (SELECT CAST(row_number() OVER (ORDER BY verts) - 1 AS INTEGER) AS kind, verts FROM chain{k} WHERE m = {k})"


def _axes(n: int, value: str, sign: str = "") -> str:
    """Coordinates of a vertex: the first axis is the highest bit, so numbers sort as coordinate lists do; time is the lowest."""
    return ", ".join(f"CAST({sign}(({value} >> {n - 1 - a}) & 1) AS INTEGER) AS {'xyzt'[a] if a < n - 1 else 't'}" for a in range(n))


def simplex_sql(n: int, k: int) -> str:
    return f"WITH RECURSIVE {_chains(n, k)} SELECT kind, CAST(p - 1 AS INTEGER) AS vertex, CAST(verts[-1] & 1 = 0 AS INTEGER) AS ordinal, {_axes(n, 'verts[p]')} FROM types{k}, range(1, {k + 2}) r(p)"


def _incident_types(n: int, k: int) -> str:
    """(big, small, corner): the sides of k-simplices, each moved to its own corner."""
    return f"inc AS (SELECT DISTINCT b.kind AS big, s.kind AS small, rest[1] AS corner FROM (SELECT kind, [v for v in verts if v <> verts[p]] AS rest FROM types{k}, range(1, {k + 2}) r(p)) b JOIN types{k - 1} s ON s.verts = [v - rest[1] for v in rest])"


def sides_sql(n: int, k: int) -> str:
    return f"WITH RECURSIVE {_chains(n, k)}, {_chains(n, k - 1)}, {_incident_types(n, k)} SELECT big AS kind, small AS side, {_axes(n, 'corner')} FROM inc"


def cofaces_sql(n: int, k: int) -> str:
    return f"WITH RECURSIVE {_chains(n, k + 1)}, {_chains(n, k)}, {_incident_types(n, k + 1)} SELECT small AS kind, big AS coface, {_axes(n, 'corner', '-')} FROM inc"


def _constants(name: str, rows: list[tuple], cols: str, sql: str) -> None:
    query(name, sql)(lambda spark, d: spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols.split())))


for _n, _k in ((2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4)):
    _axis_names = " ".join(["x", "y", "z"][: _n - 1] + ["t"])
    _constants(f"simplex_vertices_{_n}_{_k}", O.simplex_rows(_n, _k), f"kind vertex ordinal {_axis_names}", simplex_sql(_n, _k))
for _n, _k in ((3, 2), (3, 3), (4, 2), (4, 3), (4, 4)):
    _axis_names = " ".join(["x", "y", "z"][: _n - 1] + ["t"])
    _constants(f"simplex_sides_{_n}" if _n == _k else f"simplex_sides_{_n}_{_k}", O.side_rows(_n, _k), f"kind side {_axis_names}", sides_sql(_n, _k))
for _n, _k in ((3, 1), (3, 2), (4, 1), (4, 2), (4, 3)):
    _axis_names = " ".join(["x", "y", "z"][: _n - 1] + ["t"])
    _constants(f"simplex_cofaces_{_n}_{_k}", O.coface_rows(_n, _k), f"kind coface {_axis_names}", cofaces_sql(_n, _k))

query("cp2d_sides", O.field(f"SELECT tag, other FROM inc", O.GRAD, O.HITS, O.INC_DOWN))(lambda spark, d: G.incident(_hits(spark, d), O_DOMAIN, 2, up=False))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return X.critical_points_2d(field2dt(spark, d), (W, H), O.T, bits=0)


O_DOMAIN = X.domain((W, H), O.T, 2)

query("cp2d_positions", O.field("SELECT tag, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(t, 6) AS t FROM placed", O.GRAD, O.HITS, O.PLACED))(
    lambda spark, d: _rounded(_hits(spark, d).select("tag", "x", "y", "t"), "x", "y", "t")
)
query("cp2d_roots", O.field("SELECT node AS tag, MIN(seen) AS root FROM reach GROUP BY node", O.GRAD, O.HITS, O.INC, O.REACH, recursive=True))(
    lambda spark, d: G.trace(_hits(spark, d), O_DOMAIN, 2).select("tag", "root")
)

# unstructured meshes
_add("mesh_extruded", _mesh(
    "SELECT CAST(q.range AS BIGINT) AS t, q.range * 63 + a[1] AS v0, q.range * 63 + a[2] AS v1, q.range * 63 + a[3] AS v2, q.range * 63 + a[4] AS v3 FROM (SELECT unnest([[v0, v0 + 63, v1 + 63, v2 + 63], [v0, v1, v1 + 63, v2 + 63], [v0, v1, v2, v2 + 63]]) AS a FROM tris), range(3) q", w=9, h=7),
    lambda s: U.extrude(U.structured_triangles(s, 9, 7)[1], 63, 4),
)
_FACES = "SELECT unnest([[v0, v1], [v0, v2], [v1, v2]]) AS e, tid FROM tris"
_EDGES = f"edges AS (SELECT DISTINCT e[1] AS v0, e[2] AS v1, row_number() OVER (ORDER BY e[1], e[2]) - 1 AS eid FROM (SELECT DISTINCT e FROM ({_FACES})))"
_add("mesh_edge_numbers", _mesh("SELECT v0, v1, eid FROM edges", _EDGES), lambda s: U.numbered(U.faces(U.structured_triangles(s, 12, 12)[1], 2), "eid"))


def _mesh_incidence(spark: SparkSession) -> DataFrame:
    t = U.structured_triangles(spark, 12, 12)[1]
    return U.incidence(t, U.numbered(U.faces(t, 2), "eid"), "tid", "eid")


_add("mesh_incidence", _mesh(f"SELECT tid, eid FROM ({_FACES}) f JOIN edges ON f.e[1] = v0 AND f.e[2] = v1", _EDGES), _mesh_incidence)


def _mesh_found(spark: SparkSession) -> DataFrame:
    edges = U.numbered(U.faces(U.structured_triangles(spark, 12, 12)[1], 2), "eid")
    return U.find_simplex(edges, spark.range(144).select(F.col("id").alias("v0"), (F.col("id") + 13).alias("v1"))).select("v0", "v1", "eid")


_add("mesh_find_edge", _mesh("SELECT v0, v1, eid FROM edges WHERE v1 - v0 = 13", _EDGES), _mesh_found)
_NBR = "nbrs AS (SELECT DISTINCT unnest([e[1], e[2]]) AS vid, unnest([e[2], e[1]]) AS nbr FROM (SELECT unnest([[v0, v1], [v0, v2], [v1, v2]]) AS e FROM tris))"
_add("mesh_neighbours", _mesh("SELECT vid, nbr FROM nbrs", _NBR), lambda s: U.vertex_neighbours(U.structured_triangles(s, 12, 12)[1]))
_TETS = "tets AS (SELECT b AS tid, unnest([[v0, v0 + 20, v1 + 20, v2 + 20], [v0, v1, v1 + 20, v2 + 20], [v0, v1, v2, v2 + 20]]) AS a FROM (SELECT tid AS b, v0, v1, v2 FROM tris))"


def _tets(spark: SparkSession) -> DataFrame:
    """A prism layer of tetrahedra over a triangulated 5 x 4 grid."""
    return U.extrude(U.structured_triangles(spark, 5, 4)[1], 20, 2).drop("t")


_add("tet_faces", _mesh("SELECT DISTINCT f[1] AS v0, f[2] AS v1, f[3] AS v2 FROM (SELECT unnest([[a[1], a[2], a[3]], [a[1], a[2], a[4]], [a[1], a[3], a[4]], [a[2], a[3], a[4]]]) AS f FROM tets)", _TETS, w=5, h=4), lambda s: U.faces(_tets(s), 3))
_add(
    "tet_extruded",
    _mesh("SELECT CAST(q.range AS BIGINT) AS t, " + ", ".join(f"q.range * 40 + p[{k + 1}] AS v{k}" for k in range(5)) + " FROM (SELECT unnest([[a[1], a[1] + 40, a[2] + 40, a[3] + 40, a[4] + 40], [a[1], a[2], a[2] + 40, a[3] + 40, a[4] + 40], [a[1], a[2], a[3], a[3] + 40, a[4] + 40], [a[1], a[2], a[3], a[4], a[4] + 40]]) AS p FROM tets), range(2) q", _TETS, w=5, h=4),
    lambda s: U.extrude(_tets(s), 40, 3),
)
_PRISM = "prism AS (SELECT tid, unnest([[v0, v0 + {n}, v1 + {n}, v2 + {n}], [v0, v1, v1 + {n}, v2 + {n}], [v0, v1, v2, v2 + {n}]]) AS a FROM tris)"
_add(
    "mesh_space_time_faces",
    _mesh(
        "SELECT f[1] AS v0, f[2] AS v1, f[3] AS v2, f[1] // 20 AS timestep, f[1] // 20 = f[3] // 20 AS ordinal FROM (SELECT DISTINCT unnest([[a[1], a[2], a[3]], [a[1], a[2], a[4]], [a[1], a[3], a[4]], [a[2], a[3], a[4]]]) AS f FROM (SELECT [v + q.range * 20 for v in a] AS a FROM prism, range(3) q))",
        _PRISM.format(n=20), w=5, h=4,
    ),
    lambda s: U.space_time_faces(U.structured_triangles(s, 5, 4)[1], 20, 4).drop("tag"),
)
_add(
    "torus_extruded",
    _mesh("SELECT CAST(q.range AS BIGINT) AS plane, " + ", ".join(f"(q.range * 20 + a[{k + 1}]) % 60 AS v{k}" for k in range(4)) + " FROM prism, range(3) q", _PRISM.format(n=20), w=5, h=4),
    lambda s: U.torus_extrude(U.structured_triangles(s, 5, 4)[1], 20, 3),
)
_KER = "ker AS (SELECT a.vid, b.vid AS nbr, b.x - a.x AS dx, b.y - a.y AS dy, exp(-((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 0.02) / (sqrt(2 * pi()) * 0.1) AS w FROM verts a JOIN verts b ON (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= 0.3 * 0.3)"


def _woven_mesh(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, t = U.structured_triangles(spark, 13, 12)
    return v, t, S.woven_on(v, [0.1, 0.2])


_add("mesh_smoothing", _mesh("SELECT t, k.vid, ROUND(SUM(w * f), 6) AS f FROM ker k JOIN field g ON k.nbr = g.vid GROUP BY t, k.vid", _WOVEN_ON, _KER, w=13), lambda s: (lambda v, t, f: _rounded(U.smooth(f, U.smoothing_kernel(v, 0.1)), "f"))(*_woven_mesh(s)))
_add(
    "mesh_smoothing_normalised",
    _mesh("SELECT t, k.vid, ROUND(SUM(w * f) / SUM(w), 6) AS f FROM ker k JOIN field g ON k.nbr = g.vid GROUP BY t, k.vid", _WOVEN_ON, _KER, w=13),
    lambda s: (lambda v, t, f: _rounded(U.smooth(f, U.smoothing_kernel(v, 0.1, normalised=True)), "f"))(*_woven_mesh(s)),
)
_S2 = 0.1 * 0.1
_add(
    "mesh_smooth_derivatives",
    _mesh(
        f"SELECT t, k.vid, ROUND(SUM(w * f), 4) AS f, ROUND(SUM(w * f * dx / {_S2!r}), 4) AS u, ROUND(SUM(w * f * dy / {_S2!r}), 4) AS v, ROUND(SUM(w * f * (dx * dx / {_S2!r} - 1) / {_S2!r}), 3) AS j00, ROUND(SUM(w * f * dx * dy / {_S2 * _S2!r}), 3) AS j01, ROUND(SUM(w * f * (dy * dy / {_S2!r} - 1) / {_S2!r}), 3) AS j11 FROM ker k JOIN field g ON k.nbr = g.vid GROUP BY t, k.vid",
        _WOVEN_ON, _KER, w=13,
    ),
    lambda s: (lambda v, t, f: _rounded(_rounded(U.smooth_with_derivatives(f, U.smoothing_kernel(v, 0.1), 0.1).drop("j10"), "f", "u", "v", digits=4), "j00", "j01", "j11", digits=3))(*_woven_mesh(s)),
)


def _tri_gradient(col: str, src: str) -> str:
    return f"""SELECT t, vid, AVG(gx) AS gx, AVG(gy) AS gy FROM (SELECT t, unnest([v0, v1, v2]) AS vid, (f1 * y2 - f2 * y1) / (x1 * y2 - x2 * y1) AS gx, (x1 * f2 - x2 * f1) / (x1 * y2 - x2 * y1) AS gy FROM (
      SELECT p.t, v0, v1, v2, b.x - a.x AS x1, b.y - a.y AS y1, c.x - a.x AS x2, c.y - a.y AS y2, q.{col} - p.{col} AS f1, r.{col} - p.{col} AS f2
      FROM tris JOIN verts a ON v0 = a.vid JOIN verts b ON v1 = b.vid JOIN verts c ON v2 = c.vid JOIN {src} p ON p.vid = v0 JOIN {src} q ON q.vid = v1 AND q.t = p.t JOIN {src} r ON r.vid = v2 AND r.t = p.t)) GROUP BY t, vid"""


_add("mesh_gradient", _mesh(f"SELECT t, vid, ROUND(gx, 6) AS gx, ROUND(gy, 6) AS gy FROM ({_tri_gradient('f', 'field')})", _WOVEN_ON, w=13), lambda s: (lambda v, t, f: _rounded(U.gradient(v, t, f), "gx", "gy"))(*_woven_mesh(s)))
_add(
    "mesh_vector_gradient",
    _mesh(f"SELECT t, vid, ROUND(a.gx, 6) AS j00, ROUND(a.gy, 6) AS j01, ROUND(b.gx, 6) AS j10, ROUND(b.gy, 6) AS j11 FROM ({_tri_gradient('u', 'gyre')}) a JOIN ({_tri_gradient('v', 'gyre')}) b USING (t, vid)", _GYRE_ON),
    lambda s: (lambda v, t: _rounded(U.vector_gradient(v, t, S.double_gyre_on(v, [0.0, 1.0, 2.0, 3.0])), "j00", "j01", "j10", "j11"))(*U.structured_triangles(s, 12, 12)),
)
_PTS = "pts AS (SELECT range AS pid, ((range * 37) % 199) / 199.0 AS px, ((range * 91) % 197) / 197.0 AS py FROM range(200))"
_HELD = """held AS (SELECT pid, MIN(struct_pack(tid := tid, m0 := m0, m1 := m1, m2 := 1 - m0 - m1)) AS s FROM (
  SELECT pid, tid, ((b.y - c.y) * (px - c.x) + (c.x - b.x) * (py - c.y)) / d AS m0, ((c.y - a.y) * (px - c.x) + (a.x - c.x) * (py - c.y)) / d AS m1 FROM (
    SELECT tid, a, b, c, (b.y - c.y) * (a.x - c.x) + (c.x - b.x) * (a.y - c.y) AS d FROM tris JOIN verts a ON v0 = a.vid JOIN verts b ON v1 = b.vid JOIN verts c ON v2 = c.vid), pts)
  WHERE least(m0, m1, 1 - m0 - m1) >= -1e-12 GROUP BY pid)"""


def _located(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, t = U.structured_triangles(spark, 12, 12)
    p = spark.range(200).select(F.col("id").alias("pid"), ((F.col("id") * 37 % 199) / 199.0).alias("px"), ((F.col("id") * 91 % 197) / 197.0).alias("py"))
    return v, t, U.locate(p, v, t, 0.1)


_add("mesh_location", _mesh("SELECT pid, s.tid AS tid, ROUND(s.m0, 6) AS m0, ROUND(s.m1, 6) AS m1, ROUND(s.m2, 6) AS m2 FROM held", _PTS, _HELD), lambda s: _rounded(_located(s)[2], "m0", "m1", "m2"))
_add(
    "mesh_evaluation",
    _mesh("SELECT a.t, pid, ROUND(s.m0 * a.f + s.m1 * b.f + s.m2 * c.f, 6) AS f FROM held JOIN tris ON s.tid = tid JOIN field a ON v0 = a.vid JOIN field b ON v1 = b.vid AND a.t = b.t JOIN field c ON v2 = c.vid AND a.t = c.t", _PTS, _HELD, _WOVEN_ON),
    lambda s: (lambda v, t, at: _rounded(U.evaluate(at, t, S.woven_on(v, [0.1, 0.2])), "f"))(*_located(s)),
)


# lookups and the torus and ocean meshes, on the business tables
def _nearest_far(spark: SparkSession, d: str) -> DataFrame:
    """Points far beyond all targets' buckets, some of them."""
    p = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("pid"), (F.col("s_acctbal") * F.when(F.col("s_suppkey") % 7 == 0, 1000).otherwise(1)).alias("px"), (F.col("s_nationkey") * 100.0).alias("py"))
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("vid"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return U.nearest(p, t, 20.0).select("pid", "vid")


query("nearest_far", "SELECT pid, arg_min(vid, (d2, vid)) AS vid FROM (SELECT s_suppkey AS pid, c_custkey AS vid, (s_acctbal * CASE WHEN s_suppkey % 7 = 0 THEN 1000 ELSE 1 END - c_acctbal) ** 2 + (s_nationkey * 100.0 - c_nationkey * 100.0) ** 2 AS d2 FROM supplier, customer) GROUP BY pid")(_nearest_far)


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the price layers of their status, as points in columns of cells."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pid"), F.ascii("o_orderstatus").alias("cell"), F.col("o_totalprice").alias("z"))
    top = spark.range(12).select(F.explode(F.array(*[F.lit(ord(c)) for c in "FOP"])).alias("cell"), F.col("id").cast("int").alias("layer"), (450000.0 - F.col("id") * 40000.0).alias("top"))
    return U.layer_join(o, top)


query("layer_join", "SELECT pid, layer FROM (SELECT o_orderkey AS pid, CAST(floor((450000.0 - o_totalprice) / 40000.0) AS INTEGER) AS layer FROM orders) WHERE layer BETWEEN 0 AND 10")(_layers)


def _cells_to_vertices(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    w = li.groupBy(F.col("l_orderkey").alias("vertex"), F.col("l_suppkey").alias("cell")).agg((F.sum("l_quantity") / 100).alias("w"))
    f = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit(0).cast("long").alias("t"), F.col("s_suppkey").alias("cell"), F.when(F.col("s_suppkey") % 9 == 0, -1e34).otherwise(F.col("s_acctbal")).alias("f"))
    return _rounded(U.cells_to_vertices(w, f), "f")


query(
    "cells_to_vertices",
    "SELECT CAST(0 AS BIGINT) AS t, vertex, ROUND(CASE WHEN COUNT(*) < 3 THEN 0 WHEN MIN(f) >= -1e33 THEN SUM(w * f) END, 6) AS f FROM (SELECT l_orderkey AS vertex, l_suppkey AS cell, SUM(l_quantity) / 100 AS w FROM lineitem GROUP BY ALL) JOIN (SELECT s_suppkey AS cell, CASE WHEN s_suppkey % 9 = 0 THEN -1e34 ELSE s_acctbal END AS f FROM supplier) USING (cell) GROUP BY vertex",
)(_cells_to_vertices)


def _turbulence(spark: SparkSession, d: str) -> DataFrame:
    f = field2dt(spark, d).select("t", F.col("j").cast("long").alias("plane"), F.col("i").cast("long").alias("node"), (F.col("i") / 15.0).alias("psi"), F.col("f").cast("double").alias("dpot"))
    te = spark.createDataFrame([(0.1, 50.0), (0.5, 30.0), (0.9, 10.0)], "x double, y double")
    return _rounded(U.turbulence(f, te), "value")


query(
    "turbulence",
    O.field("SELECT t, plane, node, ROUND((f - AVG(f) OVER (PARTITION BY t, node)) / CASE WHEN p < 0.1 THEN 50 WHEN p >= 0.9 THEN 10 ELSE 50 - (p - 0.1) * 50 END, 6) AS value FROM (SELECT t, CAST(j AS BIGINT) AS plane, CAST(i AS BIGINT) AS node, i / 15.0 AS p, f FROM field)"),
)(_turbulence)


def _virtual_planes(spark: SparkSession, d: str) -> DataFrame:
    f = field2dt(spark, d).select("t", F.col("j").alias("plane"), F.col("i").alias("node"), "f")
    n = F.col("id")
    w = spark.range(16 * 14 * 2).select((n % 14).cast("int").alias("vplane"), (F.floor(n / 14) % 16).cast("int").alias("node"), F.floor(n / 224).cast("int").alias("side"))
    w = w.select("vplane", "node", (F.floor(F.col("vplane") / 2) + F.col("side")).cast("int").alias("plane"), ((F.col("node") + F.col("side")) % 16).alias("src"), F.when(F.col("side") == 0, 1 - (F.col("vplane") % 2) * 0.5).otherwise((F.col("vplane") % 2) * 0.5).alias("w"))
    return _rounded(U.field_line_interpolants(w, f), "f")


query(
    "virtual_planes",
    O.field("SELECT a.t, v.vplane, a.i AS node, ROUND(a.f * (1 - (v.vplane % 2) * 0.5) + b.f * (v.vplane % 2) * 0.5, 6) AS f FROM (SELECT CAST(range AS INTEGER) AS vplane FROM range(14)) v JOIN field a ON a.j = v.vplane // 2 JOIN field b ON b.j = v.vplane // 2 + 1 AND b.i = (a.i + 1) % 16 AND b.t = a.t"),
)(_virtual_planes)


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    f = field2dt(spark, d).select("t", (F.col("j") * 16 + F.col("i")).cast("long").alias("node"), "f")
    nbr = U.vertex_neighbours(U.structured_triangles(spark, 16, 8)[1])
    return U.blob_components(f, nbr, 128, O.LEVEL)


query(
    "blob_components",
    f"WITH RECURSIVE field AS ({O.FIELD_SQL}), " + ", ".join([_tris(16, 8), _NBR]) + f", hot AS (SELECT t, j * 16 + i AS node, t * 128 + j * 16 + i AS g FROM field WHERE f >= {O.LEVEL}), links AS (SELECT a.g AS a, b.g AS b FROM hot a JOIN nbrs n ON a.node = n.vid JOIN hot b ON b.node = n.nbr AND a.t = b.t UNION SELECT a.g, b.g FROM hot a JOIN hot b ON abs(a.g - b.g) = 128), reach(node, seen) AS (SELECT g, g FROM hot UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a) SELECT h.t, CAST(h.node AS BIGINT) AS node, MIN(seen) AS root FROM reach r JOIN hot h ON r.node = h.g GROUP BY ALL",
)(_blobs)


# graphs
def _grid_edges(spark: SparkSession) -> DataFrame:
    return U.faces(U.structured_triangles(spark, 9, 7)[1], 2).select(F.col("v0").alias("a"), F.col("v1").alias("b"))


_GE = "ge AS (SELECT DISTINCT unnest([e[1], e[2]]) AS a, unnest([e[2], e[1]]) AS b FROM (SELECT unnest([[v0, v1], [v0, v2], [v1, v2]]) AS e FROM tris))"
_add(
    "graph_bfs",
    _mesh("SELECT node, CAST(MIN(depth) AS INTEGER) AS depth FROM walk GROUP BY node", _GE, "walk(node, depth) AS (SELECT x, 0 FROM (VALUES (3), (40)) s(x) UNION SELECT b, depth + 1 FROM walk JOIN ge ON node = a WHERE depth < 16)", w=9, h=7, recursive=True),
    lambda s: G.bfs(_grid_edges(s), s.createDataFrame([(3,), (40,)], "node long")),
)
_add(
    "graph_bfs_bounded",
    _mesh("SELECT node, CAST(MIN(depth) AS INTEGER) AS depth FROM walk GROUP BY node", _GE, "walk(node, depth) AS (SELECT 3, 0 UNION SELECT b, depth + 1 FROM walk JOIN ge ON node = a WHERE depth < 2)", w=9, h=7, recursive=True),
    lambda s: G.bfs(_grid_edges(s), s.createDataFrame([(3,)], "node long"), max_depth=2),
)
# weights are whole numbers of at most 5, so a shortest path over at most 14 edges has a length that the walk's bound holds
_add(
    "graph_shortest_paths",
    _mesh("SELECT node, CAST(MIN(dist) AS DOUBLE) AS dist FROM walk GROUP BY node", _GE, "walk(node, dist) AS (SELECT 0, 0 UNION SELECT b, dist + 1 + (a + b) % 5 FROM walk JOIN ge ON node = a WHERE dist < 45)", w=9, h=7, recursive=True),
    lambda s: G.shortest_paths(_grid_edges(s).withColumn("w", (1 + (F.col("a") + F.col("b")) % 5).cast("double")), 0),
)
_COMMUNITY = "SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_quantity = 50"


def _order_components(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts that large lines join."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity = 50")
    return G.components(li.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


query("graph_components", f"WITH RECURSIVE e AS (SELECT a, b FROM ({_COMMUNITY}) UNION SELECT b, a FROM ({_COMMUNITY})), reach(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a) SELECT node, MIN(seen) AS root FROM reach GROUP BY node")(_order_components)

# level sets of a moving extremum: edges that cross, triangles and tetrahedra of crossings in each cell
_LW, _LT, _LEVEL = 16, 6, 12.3


def _ring(spark: SparkSession):
    from .queries import _ring as ring

    return ring(spark)


def _cell_edges(n: int) -> str:
    """(cell kind, edge kind, corner of the edge): each n-simplex's edges, from the chains of axes."""
    return f"ce AS (SELECT c.kind, e.kind AS edge, c.verts[a] AS corner, c.verts[a] AS v0, c.verts[b] AS v1 FROM types{n} c, range(1, {n + 1}) p(a), range(2, {n + 2}) q(b), types1 e WHERE a < b AND e.verts = [0, c.verts[b] - c.verts[a]])"


def _bits(v: str, n: int) -> list[str]:
    return [f"(({v} >> {n - 1 - a}) & 1)" for a in range(n)]


def _level_cells(n: int, sizes: list[int], value: str) -> str:
    """(cell, hits): the sorted edge tags that a level crosses in each n-simplex of a lattice; ``value`` of coordinates ``c0 ..`` less the level."""
    names = [f"x{a}" for a in range(n)]
    grid = ", ".join(f"g{a}.range AS {names[a]}" for a in range(n))
    tables = ", ".join(f"range({s - 1}) g{a}" for a, s in enumerate(sizes))
    steps = [1]
    for s in sizes[:-1]:
        steps.append(steps[-1] * s)

    def at(v: str) -> list[str]:
        return [f"({x} + {b})" for x, b in zip(names, _bits(v, n))]

    def val(v: str) -> str:
        got = value
        for a, e in enumerate(at(v)):
            got = got.replace(f"c{a}", e)
        return got

    corner = " + ".join(f"{e} * {s}" for e, s in zip(at("corner"), steps))
    cell = " + ".join(f"{x} * {s}" for x, s in zip(names, steps))
    n_edges, n_cells = 2**n - 1, f"(SELECT COUNT(*) FROM types{n})"
    return f"cells AS (SELECT ({cell}) * {n_cells} + kind AS cell, list(({corner}) * {n_edges} + edge ORDER BY ({corner}) * {n_edges} + edge) AS p FROM (SELECT {grid} FROM {tables}) g, ce WHERE ({val('v0')} > 0) <> ({val('v1')} > 0) GROUP BY 1)"


_RING = _level_cells(3, [_LW, _LW, _LT], f"((c0 - 7.0 - 0.1 * c2) ** 2 + (c1 - 7.0 - 0.1 * c2) ** 2 - {_LEVEL})")
_RING_CTES = f"{_chains(3, 3)}, {_chains(3, 1)}, {_cell_edges(3)}, {_RING}"
_TRIANGLES = "tri AS (SELECT cell, unnest(CASE WHEN len(p) = 3 THEN [[p[1], p[2], p[3]]] ELSE [[p[1], p[2], p[3]], [p[2], p[3], p[4]]] END) AS x FROM cells)"
_CONTOUR_SURFACE = f"WITH RECURSIVE {_RING_CTES}, {_TRIANGLES} SELECT cell, x[1] AS p0, x[2] AS p1, x[3] AS p2 FROM tri"
_SLICE = f"""WITH RECURSIVE {_RING_CTES}, {_TRIANGLES}, e AS (SELECT DISTINCT unnest([[x[1], x[2]], [x[1], x[3]], [x[2], x[3]]]) AS e FROM tri),
  flat AS (SELECT kind, verts[2] & 1 = 0 AS ordinal FROM types1), here AS (SELECT CAST(g.range AS BIGINT) AS tag FROM range({_LW * _LW * _LT * 7}) g JOIN flat ON g.range % 7 = kind WHERE ordinal AND g.range // {7 * _LW * _LW} = 3)
  SELECT e[1] AS a, e[2] AS b FROM e WHERE e[1] IN (SELECT tag FROM here) AND e[2] IN (SELECT tag FROM here)"""
_TOP = 4.3
_BALL = _level_cells(4, [8, 8, 8, 3], f"((c0 - 3.4 - 0.1 * c3) ** 2 + (c1 - 3.4 - 0.1 * c3) ** 2 + (c2 - 3.4 - 0.1 * c3) ** 2 - {_TOP})")
_VOLUME_CELLS = f"WITH RECURSIVE {_chains(4, 4)}, {_chains(4, 1)}, {_cell_edges(4)}, {_BALL} SELECT cell, CASE WHEN len(p) = 4 THEN 1 ELSE 3 END AS tets, list_sum(p)::BIGINT AS tags FROM cells"


def _volume_cells(spark: SparkSession) -> DataFrame:
    """How many tetrahedra each cell has, and the sum of their points' tags: the whole set of crossings, however a prism is cut."""
    from .queries import QUERIES

    tets = QUERIES["contour_volume"](spark, "")
    points = tets.select("cell", F.explode(F.array("p0", "p1", "p2", "p3")).alias("p")).distinct().groupBy("cell").agg(F.sum("p").alias("tags"))
    return tets.groupBy("cell").agg(F.count("*").cast("int").alias("tets")).join(points, "cell")


O.LATER |= {"contour_surface": _CONTOUR_SURFACE, "contour_slice": _SLICE}
_add("contour_volume_cells", _VOLUME_CELLS, _volume_cells)


def _surface_labels(spark: SparkSession) -> DataFrame:
    """Components of the level sets of two extrema that move apart in space-time."""
    from .queries import QUERIES

    return G.relabel_cells(QUERIES["contour_surface"](spark, ""), ["p0", "p1", "p2"])


_add(
    "surface_labels",
    f"WITH RECURSIVE {_RING_CTES}, {_TRIANGLES}, e AS MATERIALIZED (SELECT DISTINCT unnest([x[1], x[2], x[2], x[3]]) AS a, unnest([x[2], x[1], x[3], x[2]]) AS b FROM tri) SELECT a AS point, (SELECT MIN(a) FROM e) AS label FROM e GROUP BY a",
    _surface_labels,
)


def _volume_slice(spark: SparkSession) -> DataFrame:
    from .queries import QUERIES

    hits = X.contour_points(S.moving_extremum(spark, (8, 8, 8), 3, (3.4, 3.4, 3.4)), (8, 8, 8), 3, _TOP)
    return G.slice_volume(hits, QUERIES["contour_volume"](spark, ""), F.col("ordinal") & (F.col("timestep") == 1)).select(F.greatest("p0", "p1", "p2").alias("top"), "p0", "p1", "p2").drop("top")


# the slice of the volume at a step is the level set of that step: one triangle for 3 crossings in a tetrahedron, two for 4
_add(
    "volume_slice_points",
    f"WITH RECURSIVE {_chains(4, 1)} SELECT (x0 + x1 * 8 + x2 * 64 + 512) * 15 + kind AS p FROM (SELECT a.range AS x0, b.range AS x1, c.range AS x2 FROM range(8) a, range(8) b, range(8) c) g, types1 e WHERE verts[2] & 1 = 0"
    f" AND x0 + (verts[2] >> 3) < 8 AND x1 + ((verts[2] >> 2) & 1) < 8 AND x2 + ((verts[2] >> 1) & 1) < 8"
    f" AND ((x0 - 3.5) ** 2 + (x1 - 3.5) ** 2 + (x2 - 3.5) ** 2 > {_TOP}) <> ((x0 + (verts[2] >> 3) - 3.5) ** 2 + (x1 + ((verts[2] >> 2) & 1) - 3.5) ** 2 + (x2 + ((verts[2] >> 1) & 1) - 3.5) ** 2 > {_TOP})",
    lambda s: _volume_slice(s).select(F.explode(F.array("p0", "p1", "p2")).alias("p")).distinct(),
)


# trajectories
def _of_traj(name: str, body: str, make, *ctes: str, recursive: bool = False) -> None:
    sql = O.traj(body, *ctes)
    query(name, sql.replace("WITH traj", "WITH RECURSIVE traj", 1) if recursive else sql)(lambda spark, d: make(trajectories(spark, d)))


_of_traj("curve_slices", "SELECT id, seq, CAST(floor(t / 86400) AS BIGINT) AS slice FROM traj WHERE ordinal", lambda t: C.slices(t.withColumn("timestep", F.floor(F.col("t") / 86400))).select("id", "seq", "slice"))
_of_traj("curve_discard", "SELECT id, seq FROM traj WHERE NOT (x > 50 AND type = 1)", lambda t: C.discard(t, (F.col("x") > 50) & (F.col("type") == 1)).select("id", "seq"))
# a run's first point opens a new part and is left out; the next point of the curve gives the part's type
_of_traj(
    "curve_split_compat",
    "SELECT id, seq, sub FROM walk WHERE kept",
    lambda t: C.split(t, compat=True).select("id", "seq", "sub"),
    "walk AS (SELECT id, seq, type, CAST(0 AS BIGINT) AS sub, type AS now, true AS kept FROM traj WHERE seq = 0 UNION ALL SELECT t.id, t.seq, t.type, w.sub + CASE WHEN w.now IS NULL OR t.type = w.now THEN 0 ELSE 1 END, CASE WHEN w.now IS NULL OR t.type = w.now THEN t.type END, w.now IS NULL OR t.type = w.now FROM walk w JOIN traj t ON t.id = w.id AND t.seq = w.seq + 1)",
    recursive=True,
)
_of_traj(
    "curve_rotate",
    "SELECT id, (r - CASE WHEN h = l AND c IS NOT NULL THEN c ELSE 0 END + n) % n AS seq, type FROM (SELECT *, MIN(CASE WHEN type <> h THEN r END) OVER (PARTITION BY id) AS c FROM (SELECT id, type, seq AS r, first(type) OVER w AS h, last(type) OVER w AS l, COUNT(*) OVER (PARTITION BY id) AS n FROM traj WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))",
    lambda t: C.rotate(t.withColumn("loop", F.lit(True))).select("id", "seq", "type"),
)
_of_traj(
    "curve_new_ids",
    "SELECT id, seq FROM traj UNION ALL SELECT id - (SELECT MIN(id) FROM traj) + (SELECT MAX(id) FROM traj) + 1, seq FROM traj",
    lambda t: C.assign_new_id(t.select("id", "seq"), t.select("id", "seq")),
)
_of_traj(
    "curve_post_processed",
    "SELECT id, seq, CAST(SUM(CASE WHEN type <> p THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS sub FROM (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY seq) AS p FROM traj WHERE id IN (SELECT id FROM traj WHERE ordinal AND type <> 0 GROUP BY id HAVING MAX(t) - MIN(t) >= 2000000) AND ordinal AND type <> 0)",
    lambda t: C.post_process(t.where("type <> 0"), "discard_interval_points, split", duration=2000000.0).select("id", "seq", "sub"),
)
_of_traj(
    "curve_speed_stats",
    "SELECT id, COUNT(*) AS n, ROUND(MIN(abs(v)), 6) AS min_speed, ROUND(MAX(abs(v)), 6) AS max_speed FROM (SELECT id, (COALESCE(lead(x) OVER w, x) - COALESCE(lag(x) OVER w, x)) * CASE WHEN lead(seq) OVER w IS NOT NULL AND lag(seq) OVER w IS NOT NULL THEN 0.5 ELSE 1 END AS v FROM traj WINDOW w AS (PARTITION BY id ORDER BY seq)) GROUP BY id",
    lambda t: _rounded(C.statistics(C.velocity(t, "x").withColumn("speed", F.abs("vx")), speed="speed").select("id", "n", "min_speed", "max_speed"), "min_speed", "max_speed"),
)


# the tracking graph
def _label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers as sets of the parts and orders of their nation."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("component"), (F.col("s_nationkey") * 7 % 25).alias("member"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("component"), F.col("c_nationkey").alias("member"))
    return K.set_overlap(s, c)


query("set_overlap", "SELECT DISTINCT s_suppkey AS ca, c_custkey AS cb FROM supplier JOIN customer ON s_nationkey * 7 % 25 = c_nationkey")(_label_sets)


def _tracked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lab = G.materialize(K.label_components(field2dt(spark, d), (W, H), O.LEVEL), "labels")
    return lab, G.materialize(K.overlap(lab), "overlap")


def _graph_lookups(spark: SparkSession, d: str) -> DataFrame:
    lab, edges = _tracked(spark, d)
    more = K.add_edges(edges, edges.where("t0 % 2 = 0"))
    wanted = edges.select("t0", F.when(F.col("l0") % 3 == 0, -1).otherwise(F.col("l0")).alias("l0"), "t1", "l1")
    edge = K.has_edge(more, wanted).select(F.col("t0").alias("t"), F.col("l0").alias("label"), F.lit("edge").alias("kind"))
    node = K.has_node(more, lab.select("t", "label").distinct()).select("t", "label", F.lit("node").alias("kind"))
    return edge.unionByName(node)


query(
    "graph_lookups",
    O.field("SELECT t0 AS t, l0 AS label, 'edge' AS kind FROM overlap WHERE l0 % 3 <> 0 UNION ALL SELECT t, label, 'node' FROM nodes WHERE label IN (SELECT l0 FROM overlap UNION SELECT l1 FROM overlap)", O.LABELS, O.OVERLAP, O.NODES, recursive=True),
)(_graph_lookups)


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    lab, edges = _tracked(spark, d)
    return K.event_json(K.events(edges, lab.select("t", "label").distinct())).select("value")


query(
    "event_json",
    O.field(
        f"""SELECT '{{"if_current":' || t0 || ',"if_next":' || t1 || ',"type":"' || {O.EVENT_TYPE} || '","lhs":[' || lhs || '],"rhs":[' || rhs || ']}}' AS value FROM (SELECT t AS t0, t + 1 AS t1, COUNT(*) FILTER (is_right = 0) AS n_left, COUNT(*) FILTER (is_right = 1) AS n_right,
        COALESCE(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (is_right = 0), '') AS lhs, COALESCE(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (is_right = 1), '') AS rhs FROM sides GROUP BY t, root) WHERE NOT (n_left = 1 AND n_right = 1)""",
        O.LABELS, O.OVERLAP, O.NODES, O.EVENTS, recursive=True,
    ),
)(_event_lines)
query(
    "tracking_dot",
    O.field(
        """SELECT 'digraph g {' AS value UNION ALL SELECT '  rankdir=LR;' UNION ALL SELECT '}' UNION ALL SELECT '  n' || t0 || '_' || l0 || ' -> n' || t1 || '_' || l1 || ';' FROM overlap
        UNION ALL SELECT '  n' || n.t || '_' || n.label || ' [label="' || n.label || '", color="' || printf('%.3f', (g * 0.618e0) % 1) || ' 0.8 0.8"];' FROM nodes n JOIN (SELECT node, MIN(seen) AS g FROM chain GROUP BY node) c ON n.label = c.node""",
        O.LABELS, O.OVERLAP, O.NODES, O.CHAINS, recursive=True,
    ),
)(lambda spark, d: (lambda lab, e: K.dot(e, K.global_labels(e, lab.select("t", "label").distinct())))(*_tracked(spark, d)))

# particles
_add("seed_grid", "SELECT j * 15 + i AS id, CAST(i * 4 + 2 AS DOUBLE) AS x, CAST(j * 3 + 2 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS t FROM (SELECT a.range AS i, b.range AS j FROM range(15) a, range(10) b)", lambda s: P.seed_grid(s, (64, 32), (4, 3), 2))
_add(
    "seed_lat_lon",
    "SELECT id, ROUND(r * cos(la) * cos(lo), 4) AS x, ROUND(r * cos(la) * sin(lo), 4) AS y, ROUND(r * sin(la), 4) AS z, CAST(0 AS DOUBLE) AS t FROM (SELECT a.range + b.range * 5 + c.range * 35 AS id, radians(10 + a.range * 5) AS la, radians(-30 + b.range * 10) AS lo, 6371229.0 - c.range * 100 AS r FROM range(5) a, range(7) b, range(3) c)",
    lambda s: _rounded(P.seed_lat_lon(s, (5, 10.0, 30.0), (7, -30.0, 30.0), (3, 0.0, -200.0)), "x", "y", "z", digits=4),
)
# in a field that turns like a disc, linear in space and steady, interpolation is exact and a step is one matrix
_STEP = "0.3 / 16.0"
_C = f"(1 - ({_STEP}) ** 2 / 2 + ({_STEP}) ** 4 / 24)"
_SN = f"(({_STEP}) - ({_STEP}) ** 3 / 6)"
_DISC_PATHS = f"WITH RECURSIVE walk(id, n, x, y) AS (SELECT id, 0, x, y FROM (VALUES (0, 4.0::DOUBLE, 0.0::DOUBLE), (1, 0.0::DOUBLE, -4.0::DOUBLE)) s(id, x, y) UNION ALL SELECT id, n + 1, x * {_C} - y * {_SN}, x * {_SN} + y * {_C} FROM walk WHERE n < 32) SELECT CAST(id AS BIGINT) AS id, CAST(n // 16 AS INTEGER) AS seq, CAST(n / 16 AS DOUBLE) AS t, ROUND(x + 10, 6) AS x, ROUND(y + 10, 6) AS y FROM walk WHERE n % 16 = 0"
query("particles", _DISC_PATHS)(lambda spark, d: _rounded(_turning(spark, P.trace_particles), "x", "y", "t"))
_add("particles_tiled", None, lambda s: _rounded(_turning(s, P.trace_particles_tiled, tile=4, halo=1), "x", "y", "t"))


def _turning(spark: SparkSession, trace, **options) -> DataFrame:
    f = S.grid(spark, (21, 21), 3).withColumns({"u": -(F.col("j") - 10.0) * 0.3, "v": (F.col("i") - 10.0) * 0.3})
    return trace(f, P.seed_points(spark, [(14.0, 10.0), (10.0, 6.0)]), (21, 21), 3, **options)


# zeros of two components on triangles of a 3D+t mesh
def _types_values(n: int, k: int) -> str:
    """Rows (kind, ordinal, vertex coordinates in the order of vertex ids, reach) of the k-simplex types."""
    rows = []
    for kind, simplex in enumerate(O.unit_simplices(n, k)):
        by_id = sorted(simplex, key=lambda v: v[::-1])
        rows.append((kind, int(O.is_ordinal(simplex)), *[x for v in by_id for x in v], *[max(v[a] for v in simplex) for a in range(n)]))
    return O.values(rows)


_AX4 = ("i", "j", "k", "t")
_FACE_COLS = ", ".join(["kind", "ord"] + [f"{a}{v}" for v in range(3) for a in _AX4] + [f"r{a}" for a in _AX4])


def _lines(field: str, sizes: tuple[int, int, int, int], extra: tuple[str, ...] = ()) -> str:
    """CTEs down to ``placed``: faces of a lattice on which (p, q) of ``vf (i, j, k, t, p, q, ..)`` vanish, and where."""
    w, h, d, steps = sizes
    cap = {"i": w, "j": h, "k": d, "t": steps}
    inside = " AND ".join(f"c.{a} + s.r{a} < {cap[a]}" for a in _AX4)
    at = [f"(c.i + s.i{v}) + (c.j + s.j{v}) * 100 + (c.k + s.k{v}) * 10000 + (c.t + s.t{v}) * 1000000" for v in range(3)]
    fixed = "CAST(trunc({} * 2097152) AS HUGEINT)"
    more = "".join(f", {x}" for x in extra)
    sign = O._sign_det
    mu = "SELECT *, CASE WHEN det = 0 THEN 1 / 3.0 ELSE (dq * (bp - dp) - dp * (bq - dq)) / det END AS w0, CASE WHEN det = 0 THEN 1 / 3.0 ELSE (dp * (aq - dq) - dq * (ap - dp)) / det END AS w1 FROM (SELECT *, (ap - dp) * (bq - dq) - (bp - dp) * (aq - dq) AS det FROM hits)"
    coords = {a: " + ".join(f"m{v} * ((p{v} // {10 ** (2 * e)}) % 100)" for v in range(3)) for e, a in enumerate(("x", "y", "z", "t"))}
    extras = "".join(f", m0 * a{x} + m1 * b{x} + m2 * d{x} AS {x}" for x in extra)
    return f"""vf AS MATERIALIZED ({field}),
  gv AS MATERIALIZED (SELECT i + j * 100 + k * 10000 + t * 1000000 AS g, {fixed.format('p')} AS u, {fixed.format('q')} AS v, p, q{more} FROM vf),
  faces AS MATERIALIZED (SELECT (c.i + c.j * {w} + c.k * {w * h} + c.t * {w * h * d}) * {len(O.unit_simplices(4, 2))} + s.kind AS tag, c.t AS timestep, s.ord = 1 AS ordinal, {at[0]} AS p0, {at[1]} AS p1, {at[2]} AS p2
    FROM vf c, {_types_values(4, 2)} s({_FACE_COLS}) WHERE {inside}),
  hits AS MATERIALIZED (SELECT c.*, a.p AS ap, a.q AS aq, b.p AS bp, b.q AS bq, d.p AS dp, d.q AS dq{"".join(f", a.{x} AS a{x}, b.{x} AS b{x}, d.{x} AS d{x}" for x in extra)}
    FROM faces c JOIN gv a ON a.g = c.p0 JOIN gv b ON b.g = c.p1 JOIN gv d ON d.g = c.p2
    WHERE {sign("a", "b", "d")} = {sign("o", "b", "d")} AND {sign("a", "b", "d")} = -({sign("o", "a", "d")}) AND {sign("a", "b", "d")} = {sign("o", "a", "b")}),
  weighed AS ({mu}),
  clipped AS (SELECT *, least(greatest(w0, 0), 1) AS c0, least(greatest(w1, 0), 1) AS c1, least(greatest(1 - w0 - w1, 0), 1) AS c2 FROM weighed),
  placed AS (SELECT tag, timestep, ordinal, {', '.join(f'{e} AS {a}' for a, e in coords.items())}{extras} FROM (SELECT *, c0 / (c0 + c1 + c2) AS m0, c1 / (c0 + c1 + c2) AS m1, c2 / (c0 + c1 + c2) AS m2 FROM clipped))"""


def _placed(extra: tuple[str, ...] = (), digits: int = 4) -> str:
    return "SELECT tag, timestep, ordinal, " + ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in ("x", "y", "z", "t", *extra)) + " FROM placed"


_ABC2 = "SELECT i, j, k, q.range AS t, sqrt(3) * sin(z) + cos(y) AS p, sqrt(2) * sin(x) + sqrt(3) * cos(z) AS q FROM (SELECT *, i / 9.0 * 2 * pi() AS x, j / 9.0 * 2 * pi() AS y, k / 9.0 * 2 * pi() AS z FROM (SELECT a.range AS i, b.range AS j, c.range AS k FROM range(10) a, range(10) b, range(10) c)), range(2) q"


def _abc_lines(spark: SparkSession) -> DataFrame:
    from .queries import _abc

    return _rounded(X.critical_lines(_abc(spark), (10, 10, 10), 2).select("tag", "timestep", "ordinal", "x", "y", "z", "t"), "x", "y", "z", "t", digits=4)


_add("critical_lines", f"WITH {_lines(_ABC2, (10, 10, 10, 2))} {_placed()}", _abc_lines)


def _business_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two components made of the counts of the field, on its steps as a third axis and two times."""
    f = _solid(field2dt(spark, d)).where("k < 10 and i < 12").withColumn("t", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    f = f.select("t", "k", "j", "i", ((F.col("u") * 7 + F.col("i") * 3 + F.col("t") * 2) % 23 - 11.5).alias("u"), ((F.col("u") * 5 + F.col("j") * 11 + F.col("k")) % 19 - 9.25).alias("v"), F.col("u").cast("double").alias("f"))
    got = X.critical_lines(f, (12, 8, 10), 2, extra=("f",)).select("tag", "timestep", "ordinal", "x", "y", "z", "t", "f")
    return _rounded(got, "x", "y", "z", "t", "f", digits=8)


_BUSINESS = "SELECT i, j, b.t AS k, q.range AS t, (b.f * 7 + i * 3 + q.range * 2) % 23 - 11.5e0 AS p, (b.f * 5 + j * 11 + b.t) % 19 - 9.25e0 AS q, CAST(b.f AS DOUBLE) AS f FROM field b, range(2) q WHERE b.t < 10 AND i < 12"
query("critical_lines_of_counts", O.field(_placed(("f",), 8), _lines(_BUSINESS, (12, 8, 10, 2), ("f",))))(_business_lines)


def _line_cells(spark: SparkSession) -> DataFrame:
    from .queries import _abc

    hits = X.critical_lines(_abc(spark), (10, 10, 10), 2)
    return G.line_surfaces(hits, G.Lattice((0, 0, 0, 0), (10, 10, 10, 2)))


_PENTA = "penta AS (SELECT c.kind AS cell, t.kind AS face, c.va AS corner FROM (SELECT kind, verts, a, b, c, verts[a] AS va, verts[b] AS vb, verts[c] AS vc FROM types4, range(1, 6) x(a), range(1, 6) y(b), range(1, 6) z(c) WHERE a < b AND b < c) c JOIN types2 t ON t.verts = [0, c.vb - c.va, c.vc - c.va])"
_add(
    "critical_line_surfaces",
    f"""WITH RECURSIVE {_chains(4, 4)}, {_chains(4, 2)}, {_PENTA}, {_lines(_ABC2, (10, 10, 10, 2))},
    reach AS (SELECT tag, cell, (tag // 50) % 10 - (corner >> 3) AS i, (tag // 500) % 10 - ((corner >> 2) & 1) AS j, (tag // 5000) % 10 - ((corner >> 1) & 1) AS k, tag // 50000 - (corner & 1) AS t FROM placed JOIN penta ON tag % 50 = face),
    cells AS (SELECT (i + j * 10 + k * 100 + t * 1000) * 24 + cell AS cell, list(tag ORDER BY tag) AS p FROM reach WHERE i >= 0 AND j >= 0 AND k >= 0 AND t = 0 AND i < 9 AND j < 9 AND k < 9 GROUP BY 1),
    tri AS (SELECT cell, p, unnest(CASE len(p) WHEN 3 THEN [[1, 2, 3]] WHEN 4 THEN [[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]] ELSE [[1, 2, 3], [1, 2, 4], [1, 2, 5], [1, 3, 4], [1, 3, 5], [1, 4, 5], [2, 3, 4], [2, 3, 5], [3, 4, 5]] END) AS x FROM cells WHERE len(p) BETWEEN 3 AND 5)
    SELECT cell, p[x[1]] AS p0, p[x[2]] AS p1, p[x[3]] AS p2 FROM tri""",
    _line_cells,
)


# the tornado, and lines where two vectors of a field are parallel
def _tornado_sql(n: int, steps: int) -> str:
    return f"""SELECT t, k, j, i, s * (y - yc) + 0.1 * (x - xc) AS u, -s * (x - xc) + 0.1 * (y - yc) AS v, s * z0 AS w FROM (
      SELECT *, (r + r2 - sqrt(far * far + z0 * z0)) * s0 / (sqrt(far * far + z0 * z0) + 1e-11) / (1 + z) AS s FROM (
        SELECT *, CASE WHEN abs(r - far) > r2 THEN 0.8 - abs(r - far) ELSE 1.0 END AS s0, greatest(0.0, 0.1 * (0.1 - far * z)) AS z0 FROM (
          SELECT *, sqrt((y - yc) ** 2 + (x - xc) ** 2) AS far FROM (
            SELECT *, 0.5 + 0.1 * sin(0.04 * t + 10.0 * z) AS xc, 0.5 + 0.1 * cos(0.03 * t + 3.0 * z) AS yc, 0.1 + 0.4 * z * z + 0.1 * z * sin(8.0 * z) AS r, 0.2 + 0.1 * z AS r2 FROM (
              SELECT *, CAST(i AS DOUBLE) / {n - 1} AS x, CAST(j AS DOUBLE) / {n - 1} AS y, CAST(k AS DOUBLE) / {n - 1} AS z FROM ({_GRID3.format(t=steps, d=n, h=n, w=n)}))))))"""


O.LATER["synth_tornado"] = f"SELECT t, k, j, i, ROUND(u, 6) AS u, ROUND(v, 6) AS v, ROUND(w, 6) AS w FROM ({_tornado_sql(16, 2)})"
O.LATER["particles_tiled"] = _DISC_PATHS


def _near3(c: str, a: str) -> str:
    win = f"(PARTITION BY t, {', '.join(x for x in 'kji' if x != a)} ORDER BY {a})"
    return f"(lead({c}) OVER {win} - lag({c}) OVER {win})"


def _slopes(source: str, scale: str) -> str:
    """The Jacobian of ``u, v, w``, zero where a neighbour is missing."""
    names = {f"j{r}{c}": _near3(n, a) for c, a in enumerate("ijk") for r, n in enumerate("uvw")}
    none = " + ".join(f"d{m}" for m in names) + " IS NULL"
    return f"SELECT * EXCLUDE ({', '.join(f'd{m}' for m in names)}), {', '.join(f'CASE WHEN {none} THEN 0.0 ELSE d{m} * {scale} END AS {m}' for m in names)} FROM (SELECT *, {', '.join(f'{e} AS d{m}' for m, e in names.items())} FROM ({source}))"


def _parallel(vectors: str, extra: str) -> str:
    """p, q and the residue of u, v, w crossed with ax, ay, az."""
    return f"SELECT i, j, k, t, v * az - w * ay AS p, w * ax - u * az AS q, u * ay - v * ax AS residue, {extra} FROM ({vectors})"


_ACC = ", ".join(f"j{r}0 * u + j{r}1 * v + j{r}2 * w AS {a}" for r, a in enumerate(("ax", "ay", "az")))
_ABC3 = "SELECT i, j, k, q.range AS t, sqrt(3) * sin(z) + cos(y) AS u, sqrt(2) * sin(x) + sqrt(3) * cos(z) AS v, sin(y) + sqrt(2) * cos(x) AS w FROM (SELECT *, i / 9.0 * 2 * pi() AS x, j / 9.0 * 2 * pi() AS y, k / 9.0 * 2 * pi() AS z FROM (SELECT a.range AS i, b.range AS j, c.range AS k FROM range(10) a, range(10) b, range(10) c)), range(2) q"
_DISC = "(j00 + j11 + j22) AS tr, (j00 * j11 - j01 * j10 + j00 * j22 - j02 * j20 + j11 * j22 - j12 * j21) AS mn, (j00 * (j11 * j22 - j12 * j21) + j01 * (j12 * j20 - j10 * j22) + j02 * (j10 * j21 - j11 * j20)) AS dt"
_SH = _parallel(f"SELECT *, tr * tr * mn * mn - 4 * mn * mn * mn - 4 * tr * tr * tr * dt - 27 * dt * dt + 18 * tr * mn * dt AS disc FROM (SELECT *, {_ACC}, {_DISC} FROM ({_slopes(_ABC3, '0.5')}))", "disc")


def _vortex_cores(spark: SparkSession) -> DataFrame:
    from .queries import _abc

    got = X.sujudi_haimes(_abc(spark), (10, 10, 10), 2).select("tag", "timestep", "ordinal", "x", "y", "z", "t", "residue", "disc")
    return _rounded(got, "x", "y", "z", "t", "residue", "disc", digits=3)


_add("sujudi_haimes", f"WITH {_lines(_SH, (10, 10, 10, 2), ('residue', 'disc'))} {_placed(('residue', 'disc'), 3)}", _vortex_cores)
_LDS = _parallel(f"SELECT *, j21 - j12 AS ax, j02 - j20 AS ay, j10 - j01 AS az, sqrt((j21 - j12) ** 2 + (j02 - j20) ** 2 + (j10 - j01) ** 2) AS vorticity FROM ({_slopes(_tornado_sql(12, 2), '1.0')})", "vorticity")
_add(
    "levy_degani_seginer",
    f"WITH {_lines(_LDS, (12, 12, 12, 2), ('residue', 'vorticity'))} {_placed(('residue', 'vorticity'), 3)}",
    lambda s: _rounded(X.levy_degani_seginer(S.tornado(s, (12, 12, 12), 2), (12, 12, 12), 2).select("tag", "timestep", "ordinal", "x", "y", "z", "t", "residue", "vorticity"), "x", "y", "z", "t", "residue", "vorticity", digits=3),
)


def _extremum3(n: int, steps: int, x0: tuple[float, float, float]) -> str:
    f = " + ".join(f"({a} - {c!r}e0 - 0.1e0 * t) ** 2" for a, c in zip("ijk", x0))
    return f"SELECT i, j, k, t, {f} AS f FROM ({_GRID3.format(t=steps, d=n, h=n, w=n)})"


def _gradient3(source: str) -> str:
    return f"SELECT i, j, k, t, f, {', '.join(f'CASE WHEN gu + gv + gw IS NULL THEN 0.0 ELSE g{n} * 0.5 END AS {n}' for n in 'uvw')} FROM (SELECT *, {', '.join(f'{_near3("f", a)} AS g{n}' for n, a in zip('uvw', 'ijk'))} FROM ({source}))"


_RV = _parallel(f"SELECT *, {_ACC} FROM ({_slopes(_gradient3(_extremum3(10, 2, (4.3, 4.4, 4.6))), '0.5')})", "f")
_add(
    "ridge_valley",
    f"WITH {_lines(_RV, (10, 10, 10, 2), ('residue', 'f'))} {_placed(('residue', 'f'), 3)}",
    lambda s: _rounded(X.ridge_valley(S.moving_extremum(s, (10, 10, 10), 2, (4.3, 4.4, 4.6)), (10, 10, 10), 2).select("tag", "timestep", "ordinal", "x", "y", "z", "t", "residue", "f"), "x", "y", "z", "t", "residue", "f", digits=3),
)


def _rows_in_type_order(n: int, k: int) -> str:
    return O.values([(kind, int(O.is_ordinal(s)), *[x for v in s for x in v], *[max(v[a] for v in s) for a in range(n)]) for kind, s in enumerate(O.unit_simplices(n, k))])


def _wrap(x: str) -> str:
    return f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


_PHASE = "SELECT i, j, k, t, i - 4.3 - 0.2 * t AS p, j - 4.6e0 AS q FROM (" + _GRID3.format(t=2, d=6, h=10, w=10) + ")"
_VORTEX_AT = [f"(c.i + s.i{v}) + (c.j + s.j{v}) * 100 + (c.k + s.k{v}) * 10000 + (c.t + s.t{v}) * 1000000" for v in range(3)]


def _vortices(spark: SparkSession) -> DataFrame:
    from .queries import QUERIES

    return _rounded(QUERIES["phase_vortices"](spark, "").select("tag", "timestep", "ordinal", "x", "y", "z", "t", "winding"), "x", "y", "z", "t", digits=4)


_add(
    "phase_vortex_positions",
    f"""WITH gv AS MATERIALIZED (SELECT i + j * 100 + k * 10000 + t * 1000000 AS g, CAST(p AS DOUBLE) AS p, q, atan2(q, p) AS a FROM ({_PHASE})),
    faces AS (SELECT (c.i + c.j * 10 + c.k * 100 + c.t * 600) * 50 + s.kind AS tag, c.t AS timestep, s.ord = 1 AS ordinal, {', '.join(f'{e} AS p{v}' for v, e in enumerate(_VORTEX_AT))}
      FROM ({_GRID3.format(t=2, d=6, h=10, w=10)}) c, {_rows_in_type_order(4, 2)} s({_FACE_COLS}) WHERE c.i + s.ri < 10 AND c.j + s.rj < 10 AND c.k + s.rk < 6 AND c.t + s.rt < 2),
    turned AS (SELECT f.*, a.p AS ap, a.q AS aq, b.p AS bp, b.q AS bq, d.p AS dp, d.q AS dq, -({_wrap('b.a - a.a')} + {_wrap('d.a - b.a')} + {_wrap('a.a - d.a')}) / (2 * pi()) AS turn FROM faces f JOIN gv a ON a.g = p0 JOIN gv b ON b.g = p1 JOIN gv d ON d.g = p2),
    hits AS (SELECT * FROM turned WHERE abs(turn) >= 0.5),
    weighed AS (SELECT *, (dq * (bp - dp) - dp * (bq - dq)) / det AS m0, (dp * (aq - dq) - dq * (ap - dp)) / det AS m1 FROM (SELECT *, (ap - dp) * (bq - dq) - (bp - dp) * (aq - dq) AS det FROM hits)),
    w AS (SELECT *, 1 - m0 - m1 AS m2 FROM weighed)
    SELECT tag, timestep, ordinal, {', '.join(f"ROUND(m0 * ((p0 // {10 ** (2 * e)}) % 100) + m1 * ((p1 // {10 ** (2 * e)}) % 100) + m2 * ((p2 // {10 ** (2 * e)}) % 100), 4) AS {a}" for e, a in enumerate(('x', 'y', 'z', 't')))}, CAST(sign(turn) AS DOUBLE) AS winding FROM w""",
    _vortices,
)

# zeros of a gradient on tetrahedra of a 3D+t mesh: weights by Cramer's rule
_TET_COLS = ", ".join(["kind", "ord"] + [f"{a}{v}" for v in range(4) for a in _AX4] + [f"r{a}" for a in _AX4])
_TET_AT = [f"(c.i + s.i{v}) + (c.j + s.j{v}) * 100 + (c.k + s.k{v}) * 10000 + (c.t + s.t{v}) * 1000000" for v in range(4)]


def _det3(x: str, y: str, z: str) -> str:
    def c(n: str, a: str) -> str:
        return f"({n}{a} - e{a})" if n != "o" else f"(-e{a})"

    return f"({c(x, 'u')} * ({c(y, 'v')} * {c(z, 'w')} - {c(z, 'v')} * {c(y, 'w')}) - {c(y, 'u')} * ({c(x, 'v')} * {c(z, 'w')} - {c(z, 'v')} * {c(x, 'w')}) + {c(z, 'u')} * ({c(x, 'v')} * {c(y, 'w')} - {c(y, 'v')} * {c(x, 'w')}))"


def _extrema3(spark: SparkSession) -> DataFrame:
    from .queries import QUERIES

    return _rounded(QUERIES["cp3d_hits"](spark, "").select("tag", "timestep", "ordinal", "x", "y", "z", "t", "type"), "x", "y", "z", "t", digits=4)


_add(
    "cp3d_positions",
    f"""WITH gv AS MATERIALIZED (SELECT i + j * 100 + k * 10000 + t * 1000000 AS g, u, v, w FROM ({_gradient3(_extremum3(12, 4, (5.2, 5.3, 5.4)))})),
    cells AS (SELECT ((c.i - 2) + (c.j - 2) * 9 + (c.k - 2) * 81 + c.t * 729) * 60 + s.kind AS tag, c.t AS timestep, s.ord = 1 AS ordinal, {', '.join(f'{e} AS p{v}' for v, e in enumerate(_TET_AT))}
      FROM ({_GRID3.format(t=4, d=12, h=12, w=12)}) c, {_rows_in_type_order(4, 3)} s({_TET_COLS}) WHERE c.i >= 2 AND c.j >= 2 AND c.k >= 2 AND c.i + s.ri < 11 AND c.j + s.rj < 11 AND c.k + s.rk < 11 AND c.t + s.rt < 4),
    v AS (SELECT c.*, {', '.join(f'{n}.{x} AS {n}{x}' for n in 'abde' for x in 'uvw')} FROM cells c JOIN gv a ON a.g = p0 JOIN gv b ON b.g = p1 JOIN gv d ON d.g = p2 JOIN gv e ON e.g = p3),
    m AS (SELECT *, {_det3('o', 'b', 'd')} / det AS m0, {_det3('a', 'o', 'd')} / det AS m1, {_det3('a', 'b', 'o')} / det AS m2 FROM (SELECT *, {_det3('a', 'b', 'd')} AS det FROM v) WHERE abs(det) > 1e-9),
    w AS (SELECT *, 1 - m0 - m1 - m2 AS m3 FROM m)
    SELECT tag, timestep, ordinal, {', '.join("ROUND(" + " + ".join(f"m{v} * ((p{v} // {10 ** (2 * e)}) % 100)" for v in range(4)) + f", 4) AS {a}" for e, a in enumerate(('x', 'y', 'z', 't')))}, CAST(2 AS INTEGER) AS type FROM w WHERE least(m0, m1, m2, m3) > 0""",
    _extrema3,
)

# zeros on the faces of an extruded triangle mesh
_ON_MESH = "SELECT q.range * 144 + vid AS g, x, y, q.range AS t, -2 * (x - 0.41e0 - 0.02e0 * q.range) AS p, -2 * (y - 0.43e0 - 0.02e0 * q.range) AS q FROM verts, range(5) q"
_MESH_HITS = f"""mv AS MATERIALIZED (SELECT *, CAST(trunc(p * 2097152) AS HUGEINT) AS u, CAST(trunc(q * 2097152) AS HUGEINT) AS v FROM ({_ON_MESH})),
  {_PRISM.format(n=144)}, f AS (SELECT DISTINCT unnest([[a[1], a[2], a[3]], [a[1], a[2], a[4]], [a[1], a[3], a[4]], [a[2], a[3], a[4]]]) AS f FROM (SELECT [v + q.range * 144 for v in a] AS a FROM prism, range(4) q)),
  mh AS MATERIALIZED (SELECT f, f[1] // 144 AS timestep, f[1] // 144 = f[3] // 144 AS ordinal, a.p AS ap, a.q AS aq, b.p AS bp, b.q AS bq, d.p AS dp, d.q AS dq, a.x AS ax, a.y AS ay, a.t AS at_, b.x AS bx, b.y AS by_, b.t AS bt, d.x AS dx, d.y AS dy, d.t AS dt
    FROM f JOIN mv a ON a.g = f[1] JOIN mv b ON b.g = f[2] JOIN mv d ON d.g = f[3]
    WHERE {O._sign_det("a", "b", "d")} = {O._sign_det("o", "b", "d")} AND {O._sign_det("a", "b", "d")} = -({O._sign_det("o", "a", "d")}) AND {O._sign_det("a", "b", "d")} = {O._sign_det("o", "a", "b")})"""


def _mesh_zeros(spark: SparkSession) -> DataFrame:
    from .queries import _mesh_points

    return _rounded(_mesh_points(spark)[0].select("timestep", "ordinal", "x", "y", "t"), "x", "y", "t")


_add(
    "mesh_critical_positions",
    _mesh("SELECT timestep, ordinal, ROUND(m0 * ax + m1 * bx + (1 - m0 - m1) * dx, 6) AS x, ROUND(m0 * ay + m1 * by_ + (1 - m0 - m1) * dy, 6) AS y, ROUND(m0 * at_ + m1 * bt + (1 - m0 - m1) * dt, 6) AS t FROM (SELECT *, (dq * (bp - dp) - dp * (bq - dq)) / det AS m0, (dp * (aq - dq) - dq * (ap - dp)) / det AS m1 FROM (SELECT *, (ap - dp) * (bq - dq) - (bp - dp) * (aq - dq) AS det FROM mh))", _MESH_HITS),
    _mesh_zeros,
)


def _mesh_curve_sizes(spark: SparkSession) -> DataFrame:
    from .queries import QUERIES

    return QUERIES["mesh_curves"](spark, "").groupBy("root").agg(F.count("*").alias("points")).select("points")


_add("mesh_curve_sizes", _mesh("SELECT COUNT(*) AS points FROM mh", _MESH_HITS), _mesh_curve_sizes)
