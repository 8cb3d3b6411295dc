"""SQL texts of the tracking queries for DuckDB, built from the same constant tables as the Spark plans."""

from __future__ import annotations

from ..functions.mesh import cofaces, is_ordinal, sides, unit_simplices
from ..sources.views import FIELD_SQL, H, T, TRAJ_SQL, W

I0, NI, J0, NJ = 2, W - 3, 2, H - 3  # domain of the scalar critical point tracker
LEVEL, CONTOUR = 22, 20.5
LATER: dict[str, str] = {}  # SQL of queries that are registered before it is built


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows) + ")"


def field(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} field AS ({FIELD_SQL})" + "".join(f", {c}" for c in ctes) + " " + body


def traj(body: str, *ctes: str) -> str:
    return f"WITH traj AS ({TRAJ_SQL})" + "".join(f", {c}" for c in ctes) + " " + body


def near(col: str, axis: str, step: int, table_key: str = "t, j, i") -> str:
    other = "j" if axis == "i" else "i"
    fn = "lead" if step > 0 else "lag"
    return f"COALESCE({fn}({col}, {abs(step)}) OVER (PARTITION BY t, {other} ORDER BY {axis}), {col})"


GRAD = f"grad AS MATERIALIZED (SELECT t * 1000 + j * 20 + i AS p, t, j, i, f, ({near('f', 'i', 1)} - {near('f', 'i', -1)}) * {W - 1} AS u, ({near('f', 'j', 1)} - {near('f', 'j', -1)}) * {H - 1} AS v FROM field)"


def _sign_det(p: str, q: str, r: str) -> str:
    """Perturbed orientation of three vectors; ``o`` is the zero vector with the least id."""

    def c(name: str, axis: str) -> str:
        return "0" if name == "o" else f"{name}.{axis}"

    det = f"({c(p, 'u')} * ({c(q, 'v')} - {c(r, 'v')}) - {c(p, 'v')} * ({c(q, 'u')} - {c(r, 'u')}) + {c(q, 'u')} * {c(r, 'v')} - {c(q, 'v')} * {c(r, 'u')})"
    steps = [(det, ""), (f"({c(q, 'u')} - {c(r, 'u')})", "-"), (f"({c(q, 'v')} - {c(r, 'v')})", ""), (f"({c(p, 'u')} - {c(r, 'u')})", "")]
    return "CASE " + " ".join(f"WHEN {x} <> 0 THEN {s}sign({x})" for x, s in steps) + " ELSE 1 END"


def _faces() -> list[tuple]:
    rows = []
    for n, s in enumerate(unit_simplices(3, 2)):
        by_id = sorted(s, key=lambda v: v[::-1])
        reach = [max(v[a] for v in s) for a in range(3)]
        rows.append((n, int(is_ordinal(s)), *[x for v in by_id for x in v], *reach))
    return rows


_OFF = [f"{a}{k}" for k in range(3) for a in "xyz"]


def _corner(k: int) -> str:
    return f"(c.t + s.z{k}) * 1000 + (c.j + s.y{k}) * 20 + c.i + s.x{k}"


# places are packed into one number, so that each corner of a face is an equi-join
HITS = f"""faces AS MATERIALIZED (
  SELECT ((c.i - {I0}) + (c.j - {J0}) * {NI} + c.t * {NI * NJ}) * 12 + s.kind AS tag, s.kind, c.t AS timestep, s.ord = 1 AS ordinal,
    {_corner(0)} AS p0, {_corner(1)} AS p1, {_corner(2)} AS p2
  FROM grad c, {values(_faces())} s(kind, ord, {", ".join(_OFF)}, mx, my, mz)
  WHERE c.i >= {I0} AND c.j >= {J0} AND c.i + s.mx < {I0 + NI} AND c.j + s.my < {J0 + NJ} AND c.t + s.mz < {T}),
hits AS MATERIALIZED (
  SELECT c.tag, c.kind, c.timestep, c.ordinal, c.p0, c.p1, c.p2, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, d.u AS du, d.v AS dv
  FROM faces c JOIN grad a ON a.p = c.p0 JOIN grad b ON b.p = c.p1 JOIN grad d ON d.p = c.p2
  WHERE {_sign_det("a", "b", "d")} = {_sign_det("o", "b", "d")}
    AND {_sign_det("a", "b", "d")} = -({_sign_det("o", "a", "d")})
    AND {_sign_det("a", "b", "d")} = {_sign_det("o", "a", "b")})"""

_THIRD = "1 / 3.0"
PLACED = f"""weighed AS (SELECT tag, p0, p1, p2, CASE WHEN det = 0 THEN {_THIRD} ELSE (dv * (bu - du) - du * (bv - dv)) / det END AS m0,
    CASE WHEN det = 0 THEN {_THIRD} ELSE (du * (av - dv) - dv * (au - du)) / det END AS m1
  FROM (SELECT *, CAST((au - du) * (bv - dv) - (bu - du) * (av - dv) AS DOUBLE) AS det FROM hits)),
placed AS (SELECT tag, m0 * (p0 % 20) + m1 * (p1 % 20) + m2 * (p2 % 20) AS x, m0 * ((p0 // 20) % 50) + m1 * ((p1 // 20) % 50) + m2 * ((p2 // 20) % 50) AS y,
    m0 * (p0 // 1000) + m1 * (p1 // 1000) + m2 * (p2 // 1000) AS t FROM (SELECT *, 1 - m0 - m1 AS m2 FROM weighed))"""
REACH = """links AS MATERIALIZED (SELECT DISTINCT a.tag AS a, b.tag AS b FROM inc a JOIN inc b ON a.tet = b.tet AND a.tag <> b.tag),
  reach(node, seen) AS (SELECT tag, tag FROM hits UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)"""


def _cofaces() -> list[tuple]:
    tets = unit_simplices(3, 3)
    rows = []
    for n in range(12):
        for o, off in cofaces(3, 2, n):
            reach = [max(v[a] for v in tets[o]) for a in range(3)]
            rows.append((n, o, *off, *[off[a] + reach[a] for a in range(3)]))
    return rows


INC = f"""inc AS (
  SELECT h.tag, ((h.i + s.ox) + (h.j + s.oy) * {NI} + (h.t + s.oz) * {NI * NJ}) * 6 + s.other AS tet
  FROM (SELECT tag, tag % 12 AS kind, (tag // 12) % {NI} AS i, (tag // {12 * NI}) % {NJ} AS j, tag // {12 * NI * NJ} AS t FROM hits) h
  JOIN {values(_cofaces())} s(kind, other, ox, oy, oz, ex, ey, ez) ON h.kind = s.kind
  WHERE h.i + s.ox >= 0 AND h.i + s.ex < {NI} AND h.j + s.oy >= 0 AND h.j + s.ey < {NJ} AND h.t + s.oz >= 0 AND h.t + s.ez < {T})"""


def _sides() -> list[tuple]:
    edges = unit_simplices(3, 1)
    rows = []
    for n in range(12):
        for o, off in sides(3, 2, n):
            rows.append((n, o, *off, *[off[a] + max(v[a] for v in edges[o]) for a in range(3)]))
    return rows


INC_DOWN = f"""inc AS (
  SELECT h.tag, ((h.i + s.ox) + (h.j + s.oy) * {NI} + (h.t + s.oz) * {NI * NJ}) * 7 + s.other AS other
  FROM (SELECT tag, tag % 12 AS kind, (tag // 12) % {NI} AS i, (tag // {12 * NI}) % {NJ} AS j, tag // {12 * NI * NJ} AS t FROM hits) h
  JOIN {values(_sides())} s(kind, other, ox, oy, oz, ex, ey, ez) ON h.kind = s.kind
  WHERE h.i + s.ox >= 0 AND h.i + s.ex < {NI} AND h.j + s.oy >= 0 AND h.j + s.ey < {NJ} AND h.t + s.oz >= 0 AND h.t + s.ez < {T})"""


def _edges() -> list[tuple]:
    rows = []
    for n, s in enumerate(unit_simplices(3, 1)):
        rows.append((n, int(is_ordinal(s)), *s[0], *s[1], *[max(v[a] for v in s) for a in range(3)]))
    return rows


EDGES = f"""pts AS (
  SELECT (c.i + c.j * {W} + c.t * {W * H}) * 7 + s.kind AS tag, c.t AS timestep, s.ord = 1 AS ordinal,
    (a.i * (b.f - {CONTOUR}) - b.i * (a.f - {CONTOUR})) / (b.f - a.f) AS x,
    (a.j * (b.f - {CONTOUR}) - b.j * (a.f - {CONTOUR})) / (b.f - a.f) AS y,
    (a.t * (b.f - {CONTOUR}) - b.t * (a.f - {CONTOUR})) / (b.f - a.f) AS t
  FROM field c, {values(_edges())} s(kind, ord, x0, y0, z0, x1, y1, z1, mx, my, mz), field a, field b
  WHERE c.i + s.mx < {W} AND c.j + s.my < {H} AND c.t + s.mz < {T}
    AND a.i = c.i + s.x0 AND a.j = c.j + s.y0 AND a.t = c.t + s.z0 AND b.i = c.i + s.x1 AND b.j = c.j + s.y1 AND b.t = c.t + s.z1
    AND (a.f > {CONTOUR}) <> (b.f > {CONTOUR}))"""

LABELS = f"""cells AS (SELECT t, j, i, t * {W * H} + j * {W} + i AS cell FROM field WHERE f >= {LEVEL}),
  links AS (SELECT a.cell AS a, b.cell AS b FROM cells a JOIN cells b ON a.t = b.t AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
  reach(node, seen) AS (SELECT cell, cell FROM cells UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
  labels AS (SELECT c.t, c.j, c.i, m.label FROM cells c JOIN (SELECT node, MIN(seen) AS label FROM reach GROUP BY node) m ON c.cell = m.node)"""
OVERLAP = "overlap AS (SELECT DISTINCT a.t AS t0, a.label AS l0, b.t AS t1, b.label AS l1 FROM labels a JOIN labels b ON b.t = a.t + 1 AND a.i = b.i AND a.j = b.j)"
NODES = "nodes AS (SELECT DISTINCT t, label FROM labels)"
CHAINS = """simple AS (SELECT o.* FROM overlap o JOIN (SELECT t0, l0 FROM overlap GROUP BY ALL HAVING COUNT(*) = 1) p USING (t0, l0)
    JOIN (SELECT t1, l1 FROM overlap GROUP BY ALL HAVING COUNT(*) = 1) q USING (t1, l1)),
  chain(node, seen) AS (SELECT label, label FROM nodes UNION SELECT c.node, s.l0 FROM chain c JOIN simple s ON c.seen = s.l1)"""
EVENTS = f"""ends AS (SELECT DISTINCT t, label * 2 AS node FROM nodes WHERE t < (SELECT MAX(t) FROM nodes)
    UNION SELECT DISTINCT t - 1, label * 2 + 1 FROM nodes WHERE t > (SELECT MIN(t) FROM nodes)),
  pairs AS (SELECT l0 * 2 AS a, l1 * 2 + 1 AS b FROM overlap UNION SELECT l1 * 2 + 1, l0 * 2 FROM overlap),
  span(node, seen) AS (SELECT node, node FROM ends UNION SELECT s.node, p.b FROM span s JOIN pairs p ON s.seen = p.a),
  sides AS (SELECT e.t, m.root, e.node % 2 AS is_right, e.node // 2 AS label FROM ends e JOIN (SELECT node, MIN(seen) AS root FROM span GROUP BY node) m USING (node)),
  grouped AS (SELECT t AS t0, t + 1 AS t1, COUNT(*) FILTER (is_right = 0) AS n_left, COUNT(*) FILTER (is_right = 1) AS n_right,
    COALESCE(SUM(label) FILTER (is_right = 0), 0) AS left_sum, COALESCE(SUM(label) FILTER (is_right = 1), 0) AS right_sum FROM sides GROUP BY t, root)"""
EVENT_TYPE = """CASE WHEN n_left = 0 AND n_right = 1 THEN 'birth' WHEN n_left = 1 AND n_right = 0 THEN 'death' WHEN n_left = 1 AND n_right = 1 THEN 'none'
  WHEN n_left = 1 AND n_right > 1 THEN 'split' WHEN n_left > 1 AND n_right = 1 THEN 'merge' WHEN n_left = 2 AND n_right = 2 THEN 'recombination' ELSE 'compound' END"""


def simplex_rows(n: int, k: int) -> list[tuple]:
    return [(kind, v, int(is_ordinal(s)), *s[v]) for kind, s in enumerate(unit_simplices(n, k)) for v in range(k + 1)]


def side_rows(n: int, k: int) -> list[tuple]:
    return [(kind, other, *off) for kind in range(len(unit_simplices(n, k))) for other, off in sides(n, k, kind)]


def coface_rows(n: int, k: int) -> list[tuple]:
    return [(kind, other, *off) for kind in range(len(unit_simplices(n, k))) for other, off in cofaces(n, k, kind)]
