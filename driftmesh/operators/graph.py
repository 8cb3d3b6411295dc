"""Graph operators: components, traversals, curves from point graphs, surfaces and volumes from cells."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations, count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mesh import Lattice, cofaces, sides, unit_simplices
from ..sources.storage import materialize
from .order import numbered_by


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, root)``: root is the smallest node of each connected component of ``edges (a, b)``.

    Large-star and small-star rounds over edge tables in the shared folder; the driver sees one
    aggregate row a round. ``nodes (node)`` adds isolated ones.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "components")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = materialize(large.join(low, large.a == low.k).select(F.explode(pair).alias("x")).select("x.*").where("a <> b").distinct(), "components")
        new = _state(e)
        if new == state:
            break
        state = new
    out = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    out = out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` reached from ``seeds (node)`` over undirected ``edges (a, b)``: one frontier join a level.

    Levels end when a frontier is empty, or at ``max_depth`` where that is wanted.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = materialize(seeds.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    front = found
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        nxt = both.join(front, both.a == front.node).select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        front = materialize(nxt.withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """``(node, dist)`` from one node over weighted undirected ``edges (a, b, w)``, by rounds of relaxation until nothing changes.

    A path has no more edges than there are nodes, so with weights of zero or more the rounds end; negative ones are refused.
    """
    if not edges.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    spark = edges.sparkSession
    dist = materialize(spark.createDataFrame([(source, 0.0)], "node long, dist double"), "paths")
    last = None
    while True:
        step = both.join(dist, both.a == dist.node).select(F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        dist = materialize(dist.unionByName(step).groupBy("node").agg(F.min("dist").alias("dist")), "paths")
        state = tuple(dist.agg(F.count("*"), F.sum("dist")).first())
        if state == last:
            break
        last = state
    return dist


def _table(spark: SparkSession, rows: list[tuple], d: int) -> DataFrame:
    return spark.createDataFrame(rows, "kind int, other int, " + ", ".join(f"o{a} int" for a in range(d)))


def incident(hits: DataFrame, lattice: Lattice, k: int, up: bool) -> DataFrame:
    """``(tag, other)``: the cofaces (``up``) or sides of the k-simplices ``hits (tag)`` that lie inside the lattice.

    Joins the small constant incidence table of the mesh; ids are arithmetic.
    """
    d, n = lattice.nd, len(unit_simplices(lattice.nd, k))
    k2 = k + 1 if up else k - 1
    kinds = unit_simplices(d, k2)
    rows = [(s, o, *off) for s in range(n) for o, off in (cofaces(d, k, s) if up else sides(d, k, s))]
    table = F.broadcast(_table(hits.sparkSession, rows, d))
    out = hits.select("tag", (F.col("tag") % n).cast("int").alias("kind"), F.floor(F.col("tag") / n).alias("__at")).join(table, "kind")
    rest, at, inside = F.col("__at"), F.lit(0).cast("long"), F.lit(True)
    reach = [[max(v[a] for v in s) for s in kinds] for a in range(d)]
    step = 1
    for a, size in enumerate(lattice.sizes):
        c = rest % size + F.col(f"o{a}")
        far = F.element_at(F.array(*[F.lit(x) for x in reach[a]]), F.col("other") + 1)
        inside = inside & (c >= 0) & (c + far < size)
        at = at + c * step
        rest = F.floor(rest / size)
        step *= size
    return out.where(inside).select("tag", (at * len(kinds) + F.col("other")).alias("other"))


def point_graph(hits: DataFrame, lattice: Lattice, k: int) -> DataFrame:
    """Edges ``(a, b)`` between hits that are sides of one coface; a coface has at most k + 2 sides."""
    inc = incident(hits, lattice, k, up=True)
    x, y = inc.select(F.col("tag").alias("a"), "other"), inc.select(F.col("tag").alias("b"), "other")
    return x.join(y, "other").where("a < b").select("a", "b").distinct()


def linear_pieces(nodes: list[int], near: dict[int, set[int]]) -> list[tuple[list[int], bool]]:
    """A component without its nodes of degree above two, as ordered paths; True for closed ones."""
    inner = {n for n in nodes if len(near[n]) <= 2}
    out, seen = [], set()
    for seed in sorted(inner):
        if seed in seen:
            continue
        seen.add(seed)
        path = [seed]
        starts = sorted(near[seed] & inner)
        for front, at in enumerate(starts[:1] + starts[-1:] if len(starts) > 1 else starts):
            while at not in seen:
                seen.add(at)
                path.append(at) if not front else path.insert(0, at)
                at = next((m for m in sorted(near[at] & inner) if m not in seen), at)
        out.append((path, len(path) > 1 and path[-1] in near[path[0]]))
    return out


def trace(hits: DataFrame, lattice: Lattice, k: int) -> DataFrame:
    """Curves of hits: ``root, piece, seq, loop`` beside all columns of ``hits (tag, ...)``.

    Components come from distributed rounds; each is ordered in a task of its own, as a walk over its points.
    """
    hits = materialize(hits, "hits")
    graph = materialize(point_graph(hits.select("tag"), lattice, k), "graph")
    roots = materialize(components(graph, hits.select(F.col("tag").alias("node"))), "roots")
    edges = graph.join(roots.select(F.col("node").alias("a"), F.col("root").alias("__root")), "a").select(F.col("__root").alias("r"), "a", "b")

    def order(points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = defaultdict(set)
        for a, b in zip(links["a"].tolist(), links["b"].tolist()):
            near[a].add(b)
            near[b].add(a)
        rows = []
        for piece, (path, loop) in enumerate(linear_pieces(points["node"].tolist(), near)):
            rows += [(n, int(points["root"].iloc[0]), piece, seq, loop) for seq, n in enumerate(path)]
        return pd.DataFrame(rows, columns=["tag", "root", "piece", "seq", "loop"])

    walked = roots.groupBy("root").cogroup(edges.groupBy("r")).applyInPandas(order, "tag long, root long, piece int, seq int, loop boolean")
    walked = materialize(walked, "curves")
    names = numbered_by(walked.where("seq = 0").select("root", "piece"), "root", "piece", name="id")
    return hits.join(walked.join(names, ["root", "piece"]), "tag")


def surfaces(hits: DataFrame, lattice: Lattice, k: int) -> DataFrame:
    """``(cell, p0, p1, p2)``: triangles of the hits in each coface; 3 hits give one triangle, 4 two, more a fan."""
    inc = incident(hits, lattice, k, up=True)
    cells = inc.groupBy("other").agg(F.sort_array(F.collect_list("tag")).alias("p")).where(F.size("p") >= 3)
    p = F.col("p")
    strip = F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda n: F.struct(p[n].alias("p0"), p[n + 1].alias("p1"), p[n + 2].alias("p2")))
    return cells.select(F.col("other").alias("cell"), F.explode(strip).alias("x")).select("cell", "x.*")


#: Triangles of a pentachoron's punctures by their number, as places in tag order: all triples of 3 or 4; of 5 all but one, which must be
#: left out for the known counts.
TRIPLES = {3: [(0, 1, 2)], 4: list(combinations(range(4), 3)), 5: [t for t in combinations(range(5), 3) if t != (1, 3, 4)]}


def line_surfaces(hits: DataFrame, lattice: Lattice) -> DataFrame:
    """``(cell, p0, p1, p2)``: triangles that punctured faces of a 3D+t mesh span in each pentachoron; other numbers than 3 to 5 span none."""
    up = incident(hits, lattice, 2, up=True).select(F.col("tag").alias("hit"), F.col("other").alias("tet"))
    cells = incident(up.select(F.col("tet").alias("tag")).distinct(), lattice, 3, up=True).select(F.col("tag").alias("tet"), F.col("other").alias("cell"))
    p = up.join(cells, "tet").select("cell", "hit").distinct().groupBy("cell").agg(F.sort_array(F.collect_list("hit")).alias("p"))
    tri = F.lit(None)
    for n, triples in TRIPLES.items():
        tri = F.when(F.size("p") == n, F.array(*[F.struct(*[F.col("p")[k].alias(f"p{m}") for m, k in enumerate(t)]) for t in triples])).otherwise(tri)
    return p.where(F.size("p").between(3, 5)).select("cell", F.explode(tri).alias("x")).select("cell", "x.*")


def level_triangles(hits: DataFrame, lattice: Lattice) -> DataFrame:
    """``(cell, p0, p1, p2)``: triangles of a 2D+t level set. 3 hits on a tetrahedron's edges give one triangle, 4 two."""
    up = incident(hits, lattice, 1, up=True).select(F.col("tag").alias("hit"), F.col("other").alias("tag"))
    tets = incident(up.select("tag").distinct(), lattice, 2, up=True)
    p = up.join(tets, "tag").select("hit", F.col("other").alias("cell")).distinct().groupBy("cell").agg(F.sort_array(F.collect_list("hit")).alias("p"))
    first, second = (F.struct(*[F.col("p")[k].alias(f"p{n}") for n, k in enumerate(pick)]) for pick in ((0, 1, 2), (1, 2, 3)))
    tri = F.when(F.size("p") == 3, F.array(first)).otherwise(F.array(first, second))
    return p.where(F.size("p") >= 3).select("cell", F.explode(tri).alias("x")).select("cell", "x.*")


def volumes(hits: DataFrame, lattice: Lattice) -> DataFrame:
    """``(cell, p0 .. p3)``: tetrahedra of a 3D+t contour: 4 hits on a pentachoron's edges give one, 6 a prism of three.

    The prism is cut by a staircase over its two triangles of hits.
    """
    d = lattice.nd
    edge_types = unit_simplices(d, 1)
    up = hits.select("tag")
    for k in range(1, d):
        step = incident(up.select("tag").distinct(), lattice, k, up=True).withColumnRenamed("tag", "low")
        if k == 1:
            reach = step.select(F.col("low").alias("hit"), F.col("other").alias("cell"))
        else:
            reach = reach.join(step, reach.cell == step.low).select("hit", F.col("other").alias("cell")).distinct()
        up = reach.select(F.col("cell").alias("tag"))
    n_edges = len(edge_types)

    def tets(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, got = int(pdf["cell"].iloc[0]), sorted(pdf["hit"].tolist())
        rows = []
        if len(got) == 4:
            rows = [(cell, *got)]
        elif len(got) == 6:
            ends = {}
            for h in got:
                corner = lattice.point(h // n_edges)
                a, b = (tuple(c + o for c, o in zip(corner, v)) for v in edge_types[h % n_edges])
                ends[h] = (lattice.linear(a), lattice.linear(b))
            points = sorted({p for e in ends.values() for p in e})
            pair = next(
                (c for c in ((x, y) for x in points for y in points if x < y) if all((e[0] in c) != (e[1] in c) for e in ends.values())), None
            )
            if pair:
                far = [p for p in points if p not in pair]
                line = {(s, p): h for h, e in ends.items() for s in pair for p in far if set(e) == {s, p}}
                a, b = [line[pair[0], p] for p in far], [line[pair[1], p] for p in far]
                rows = [(cell, a[0], a[1], a[2], b[2]), (cell, a[0], a[1], b[1], b[2]), (cell, a[0], b[0], b[1], b[2])]
        return pd.DataFrame(rows, columns=["cell", "p0", "p1", "p2", "p3"])

    return reach.groupBy("cell").applyInPandas(tets, "cell long, p0 long, p1 long, p2 long, p3 long")


def relabel_cells(cells: DataFrame, corners: list[str]) -> DataFrame:
    """``(point, label)``: components of points that share a triangle or tetrahedron."""
    edges = None
    for a, b in zip(corners, corners[1:]):
        part = cells.select(F.col(a).alias("a"), F.col(b).alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    return components(edges).select(F.col("node").alias("point"), F.col("root").alias("label"))


def slice_surface(points: DataFrame, triangles: DataFrame, t: int) -> DataFrame:
    """Segments ``(a, b)`` of a space-time surface at an integer time: triangle edges with both ends there."""
    at = points.where((F.col("ordinal")) & (F.col("timestep") == t)).select(F.col("tag").alias("p"))
    edges = triangles.select(
        F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("p0", "p1"), ("p0", "p2"), ("p1", "p2"))])).alias("e")
    ).select("e.*")
    a, b = at.withColumnRenamed("p", "a"), at.withColumnRenamed("p", "b")
    return edges.join(a, "a", "left_semi").join(b, "b", "left_semi").select("a", "b").distinct()


def slice_volume(points: DataFrame, tets: DataFrame, keep) -> DataFrame:
    """Triangles ``(p0, p1, p2)`` of a space-time volume whose points satisfy a predicate on the point table.

    A tetrahedron gives each of its faces with three such corners: one face where one corner is out, all four where none is.
    """
    at = points.where(keep).select(F.col("tag").alias("p"))
    corners = ["p0", "p1", "p2", "p3"]
    long = tets.select(*corners, F.explode(F.array_distinct(F.array(*corners))).alias("p"))
    got = long.join(at, "p", "left_semi").groupBy(*corners).agg(F.sort_array(F.collect_set("p")).alias("p")).where(F.size("p") >= 3)
    face = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda out: F.filter("p", lambda x, k: k != out))
    faces = F.when(F.size("p") == 3, F.array("p")).otherwise(face)
    return got.select(F.explode(faces).alias("f")).select(*[F.col("f")[k].alias(f"p{k}") for k in range(3)]).distinct()


def contract(points: DataFrame, triangles: DataFrame, drop) -> DataFrame:
    """Triangles left when the points that satisfy ``drop`` are merged into their nearest neighbours.

    A dropped point takes the nearest kept point that shares a triangle with it; triangles with a dropped point
    that has none, or with two equal corners, go.
    """
    kept, gone = points.where(~drop), points.where(drop)
    edges = triangles.select(
        F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a in ("p0", "p1", "p2") for b in ("p0", "p1", "p2") if a != b])).alias("e")
    ).select("e.*").distinct()
    xyz = [c for c in ("x", "y", "z", "t") if c in points.columns]
    g = gone.select(F.col("tag").alias("a"), *[F.col(c).alias(f"g{c}") for c in xyz])
    k = kept.select(F.col("tag").alias("b"), *xyz)
    dist = sum((F.col(c) - F.col(f"g{c}")) ** 2 for c in xyz)
    to = edges.join(g, "a").join(k, "b").groupBy("a").agg(F.min_by("b", F.struct(dist, "b")).alias("to"))
    names = to.unionByName(kept.select(F.col("tag").alias("a"), F.col("tag").alias("to")))
    out = triangles
    for p in ("p0", "p1", "p2"):
        out = out.join(names.select(F.col("a").alias(p), F.col("to").alias(f"n{p}")), p)
    out = out.select(*[F.col(f"n{p}").alias(p) for p in ("p0", "p1", "p2")])
    return out.where("p0 <> p1 and p0 <> p2 and p1 <> p2").distinct()


def merge_tree(values: pd.DataFrame, edges: list[tuple[int, int]], join: bool = True) -> list[tuple[int, int]]:
    """Arcs (from, to) of the join (from the top) or split (from the bottom) tree of one small graph."""
    order = sorted(zip(values["f"].tolist(), values["node"].tolist()), reverse=join)
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    root, tip, arcs = {}, {}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, n in order:
        root[n] = n
        tip[n] = n
        for m in near[n]:
            if m in root and find(m) != find(n):
                arcs.append((tip[find(m)], n))
                root[find(m)] = find(n)
                tip[find(n)] = n
    return arcs


def contour_tree(values: pd.DataFrame, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Arcs (upper, lower) of the contour tree: leaves of the join and split trees are peeled off in turn."""
    up, down = merge_tree(values, edges, True), merge_tree(values, edges, False)
    f = dict(zip(values["node"], zip(values["f"], values["node"])))

    def tree(arcs):
        parent, kids = {}, defaultdict(set)
        for a, b in arcs:
            parent[a] = b
            kids[b].add(a)
        return parent, kids

    (jp, jk), (sp, sk) = tree(up), tree(down)

    def remove(parent, kids, n):
        p = parent.pop(n, None)
        if p is not None:
            kids[p].discard(n)
        for c in kids.pop(n, set()):
            if p is None:
                parent.pop(c, None)
            else:
                parent[c] = p
                kids[p].add(c)

    left, arcs = set(f), []
    while len(left) > 1:
        leaf = next(n for n in sorted(left, key=f.__getitem__) if len(jk[n]) + len(sk[n]) == 1)
        other = jp.get(leaf) if not jk[leaf] else sp.get(leaf)
        arcs.append((max(leaf, other, key=f.__getitem__), min(leaf, other, key=f.__getitem__)))
        remove(jp, jk, leaf)
        remove(sp, sk, leaf)
        left.discard(leaf)
    return arcs


def contour_trees(df: DataFrame, edges: DataFrame) -> DataFrame:
    """``(t, upper, lower)`` of each step's graph, one task a step: values ``(t, node, f)``, edges ``(t, a, b)``."""

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        arcs = contour_tree(v, list(zip(e["a"].tolist(), e["b"].tolist())))
        return pd.DataFrame([(int(v["t"].iloc[0]), a, b) for a, b in arcs], columns=["t", "upper", "lower"])

    return df.groupBy("t").cogroup(edges.groupBy("t")).applyInPandas(run, "t long, upper long, lower long")
