"""Component tracking: masks, labels, overlaps between steps, the tracking graph and its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .fields import axes_of, threshold
from .graph import components


def _cell(df: DataFrame, shape: tuple[int, ...]) -> Column:
    at, step = F.lit(0).cast("long"), 1
    for a, n in zip(axes_of(df), shape):
        at = at + F.col(a) * step
        step *= n
    return F.col("t") * step + at


def label_components(df: DataFrame, shape: tuple[int, ...], level: float, mode: str = "ge", across_time: bool = False, numbered: bool = False) -> DataFrame:
    """``(t, [k,] j, i, label)`` of the points beyond a level: components of lattice neighbours in each step.

    Labels are the smallest cell id; ``numbered`` makes them 1, 2, .. by their first cell in each step. ``across_time``
    joins equal places of consecutive steps too.
    """
    axes = axes_of(df)
    on = threshold(df, level, mode).where("mask = 1").select("t", *reversed(axes), _cell(df, shape).alias("cell"))
    on = materialize(on, "mask")
    edges, step = None, 1
    moves = [(a, n) for a, n in zip(axes, shape)] + ([("t", None)] if across_time else [])
    for a, n in moves:
        low = on if n is None else on.where(F.col(a) < n - 1)
        part = low.select(F.col("cell").alias("a"), (F.col("cell") + step).alias("b"))
        edges = part if edges is None else edges.unionByName(part)
        step *= n or 1
    edges = edges.join(on.select(F.col("cell").alias("b")), "b", "left_semi")
    roots = components(edges, on.select(F.col("cell").alias("node")))
    out = on.join(roots, on.cell == roots.node).select("t", *reversed(axes), F.col("root").alias("label"))
    if numbered:
        out = out.withColumn("label", F.dense_rank().over(Window.partitionBy("t").orderBy("label")).cast("long"))
    return out


def overlap(labels: DataFrame, differ: bool = False) -> DataFrame:
    """``(t0, l0, t1, l1)``: labels that share a place in consecutive steps; ``differ`` leaves out equal ones."""
    axes = axes_of(labels)
    nxt = labels.select((F.col("t") - 1).alias("t"), *axes, F.col("label").alias("l1"))
    out = labels.join(nxt, ["t", *axes]).select(F.col("t").alias("t0"), F.col("label").alias("l0"), (F.col("t") + 1).alias("t1"), "l1").distinct()
    return out.where("l0 <> l1") if differ else out


#: Sets of either side in a block of pairs, about; copies of rows that a task deals out; pairs and number of tasks that make them.
BLOCK, TASK_ROWS, TASK_PAIRS, MOST_TASKS = 4096, 1 << 20, 1 << 26, 20_000


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(ca, cb)`` of sets ``(component, member)`` that have a member in common, each pair once.

    A pair with a set of one member comes from that member alone, so only pairs of larger sets are shuffled to tell repeated ones.
    There are as many rows as pairs, up to the product of both tables.
    """
    x, y = _members(a, "ca"), _members(b, "cb")
    out, more = _pairs(x.where("one"), y), x.where("not one")
    if more.isEmpty():
        return out
    return out.unionByName(_pairs(more, y.where("one"))).unionByName(_pairs(more, y.where("not one")).distinct())


def _members(sets: DataFrame, name: str) -> DataFrame:
    """``(name, member, one)``, each once; ``one``: the set has no other member."""
    rows = sets.where("member is not null").select(F.col("component").alias(name), "member").distinct()
    return materialize(rows.withColumn("one", F.count("*").over(Window.partitionBy(name)) == 1), "sets")


def _pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(ca, cb)`` for each member that both have. A member of many sets has its pairs dealt out in blocks of some ``BLOCK`` by ``BLOCK``."""
    nx, ny = (t.groupBy("member").agg(F.count("*").alias(n)) for t, n in ((x, "nx"), (y, "ny")))
    both = materialize(nx.join(ny, "member"), "sets")
    n_pairs = both.agg(F.sum(F.col("nx").cast("double") * F.col("ny"))).first()[0] or 0
    least = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, n_dealing = (max(least, min(int(tasks) + 1, MOST_TASKS)) for tasks in (n_pairs / TASK_PAIRS, n_pairs / BLOCK / TASK_ROWS))
    cuts = [F.ceil(F.col(c) / BLOCK).cast("int").alias(f"k{c[1]}") for c in ("nx", "ny")]
    many = F.broadcast(both.where((F.col("nx") > BLOCK) | (F.col("ny") > BLOCK)).select("member", *cuts))  # fewer than a row for each BLOCK rows of x and y

    def dealt(t: DataFrame, name: str, own: str, other: str) -> DataFrame:
        block = F.coalesce(F.pmod(F.xxhash64(name), F.col(f"k{own}")).cast("int"), F.lit(0))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"k{other}", F.lit(1)) - 1))
        t = t.repartition(n_dealing, name, "member").join(many, "member", "left")
        return t.select(name, "member", block.alias(f"b{own}"), copies.alias(f"b{other}")).repartition(n, "member", "bx", "by")

    return dealt(x, "ca", "x", "y").hint("merge").join(dealt(y, "cb", "y", "x"), ["member", "bx", "by"]).select("ca", "cb")


def has_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``nodes (t, label)`` that a tracking graph has."""
    ends = edges.select(F.col("t0").alias("t"), F.col("l0").alias("label")).unionByName(edges.select(F.col("t1").alias("t"), F.col("l1").alias("label")))
    return nodes.join(ends.distinct(), ["t", "label"], "left_semi")


def has_edge(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(edges, ["t0", "l0", "t1", "l1"], "left_semi")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def _named(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    ends = edges.select(F.col("t0").alias("t"), F.col("l0").alias("label")).unionByName(edges.select(F.col("t1").alias("t"), F.col("l1").alias("label")))
    return (ends if nodes is None else ends.unionByName(nodes.select("t", "label"))).distinct()


def global_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(t, label, global)``: one name along simple links, that is where a label has one successor and that has one predecessor.

    The name is the smallest label of the chain, as labels are unique over the steps (cell ids).
    """
    out_ = edges.groupBy("t0", "l0").agg(F.count("*").alias("no"))
    in_ = edges.groupBy("t1", "l1").agg(F.count("*").alias("ni"))
    simple = edges.join(out_.where("no = 1"), ["t0", "l0"], "left_semi").join(in_.where("ni = 1"), ["t1", "l1"], "left_semi")
    all_nodes = materialize(_named(edges, nodes), "labels")
    roots = components(simple.select(F.col("l0").alias("a"), F.col("l1").alias("b")), all_nodes.select(F.col("label").alias("node")))
    return all_nodes.join(roots, all_nodes.label == roots.node).select("t", "label", F.col("root").alias("global"))


def event_type(left: Column, right: Column) -> Column:
    """none, birth, death, split, merge, recombination or compound, by the sizes of both sides."""
    return (
        F.when((left == 0) & (right == 1), "birth")
        .when((left == 1) & (right == 0), "death")
        .when((left == 1) & (right == 1), "none")
        .when((left == 1) & (right > 1), "split")
        .when((left > 1) & (right == 1), "merge")
        .when((left == 2) & (right == 2), "recombination")
        .otherwise("compound")
    )


def events(edges: DataFrame, nodes: DataFrame | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """``(t0, t1, lhs, rhs, type)``: components of the links between consecutive steps, but for plain continuations.

    Births and deaths appear where ``nodes (t, label)`` names labels without a link. ``t0`` and ``t1`` bound the interval.
    """
    if t0 is not None:
        edges = edges.where((F.col("t0") >= t0) & (F.col("t1") <= t1))
    # a label plays two parts: right side of one interval, left side of the next
    left, right = F.col("l0") * 2, F.col("l1") * 2 + 1
    ends = edges.select(F.col("t0").alias("t"), left.alias("node")).unionByName(edges.select(F.col("t0").alias("t"), right.alias("node")))
    if nodes is not None:
        span = nodes.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        ends = ends.unionByName(nodes.where(F.col("t") < span.hi).select("t", (F.col("label") * 2).alias("node")))
        ends = ends.unionByName(nodes.where(F.col("t") > span.lo).select((F.col("t") - 1).alias("t"), (F.col("label") * 2 + 1).alias("node")))
    ends = materialize(ends.distinct(), "events")
    roots = components(edges.select(left.alias("a"), right.alias("b")), ends.select("node"))
    side = ends.join(roots, "node").select("t", "root", (F.col("node") % 2 == 0).alias("is_left"), F.floor(F.col("node") / 2).alias("label"))
    got = side.groupBy("t", "root").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_left"), F.col("label")))).alias("lhs"),
        F.sort_array(F.collect_list(F.when(~F.col("is_left"), F.col("label")))).alias("rhs"),
    )
    kind = event_type(F.size("lhs"), F.size("rhs"))
    plain = (F.size("lhs") == 1) & (F.size("rhs") == 1)
    return got.where(~plain).select(F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), "lhs", "rhs", kind.alias("type"))


def event_json(events: DataFrame) -> DataFrame:
    """One JSON line ``value`` an event: the steps it lies between, its type, and the labels on both sides."""
    side = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
    line = F.format_string('{"if_current":%s,"if_next":%s,"type":"%s","lhs":%s,"rhs":%s}', F.col("t0").cast("string"), F.col("t1").cast("string"), "type", side("lhs"), side("rhs"))
    return events.select("t0", line.alias("value"))


def dot(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The tracking graph as lines of DOT text, ready for ``write.text``: nodes in ranks by step, coloured by global label."""
    node = F.format_string("  n%d_%d [label=\"%d\", color=\"%.3f 0.8 0.8\"];", "t", "label", "label", F.pmod(F.col("global") * 0.618, F.lit(1.0)))
    edge = F.format_string("  n%d_%d -> n%d_%d;", "t0", "l0", "t1", "l1")
    spark = edges.sparkSession
    head = spark.createDataFrame([("digraph g {",), ("  rankdir=LR;",)], "value string")
    return head.unionByName(labels.select(node.alias("value"))).unionByName(edges.select(edge.alias("value"))).unionByName(spark.createDataFrame([("}",)], "value string"))
