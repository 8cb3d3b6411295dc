"""Trajectory operators on point tables ``(id, seq, t, type, ordinal, timestep, ...)``, as window functions.

A curve is keyed by ``id`` (and ``sub`` once split). Only operators that carry state along a curve in both
directions run a curve in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered_by

EARTH_RADIUS = 6371229.0


def _key(df: DataFrame) -> list[str]:
    return ["id", "sub"] if "sub" in df.columns else ["id"]


def _w(df: DataFrame) -> Window:
    return Window.partitionBy(*_key(df)).orderBy("seq")


def _all(df: DataFrame) -> Window:
    return Window.partitionBy(*_key(df))


def statistics(df: DataFrame, scalars: tuple[str, ...] = ("x",), speed: str | None = None) -> DataFrame:
    """One row a curve: points, time range, range and persistence of each column, and its type if it has one only."""
    aggs = [F.count("*").alias("n"), F.min("t").alias("tmin"), F.max("t").alias("tmax")]
    for c in scalars:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), (F.max(c) - F.min(c)).alias(f"persistence_{c}")]
    if speed:
        aggs += [F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed")]
    one = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise(0)
    return df.groupBy(*_key(df)).agg(*aggs, one.alias("consistent_type"))


def _islands(df: DataFrame, new: Column) -> DataFrame:
    """``sub``: how many breaks a curve has had up to each point."""
    return df.withColumn("sub", F.sum(new.cast("int")).over(_w(df).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def split(df: DataFrame, compat: bool = False) -> DataFrame:
    """Cut curves where the type changes; ``sub`` numbers the parts and the id stays.

    ``compat`` leaves out the first point of each new run, so that runs of a single point vanish; then the
    next point of the curve starts a part whatever its type.
    """
    if not compat:
        lagged = df.withColumn("__p", F.lag("type").over(_w(df)))
        return _islands(lagged, F.coalesce(F.col("type") != F.col("__p"), F.lit(False))).drop("__p")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        sub, now, keep = 0, None, []
        for kind in pdf["type"].tolist():
            if now is None or kind == now:
                now = kind
                keep.append(sub)
            else:
                keep.append(-1)
                sub, now = sub + 1, None
        return pdf.assign(sub=keep)[[s >= 0 for s in keep]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sub long"
    return df.groupBy(*_key(df)).applyInPandas(cut, schema)


def intercept(df: DataFrame, t0: float, t1: float) -> DataFrame:
    """The parts of curves within a time interval; curves that miss it have none."""
    return df.where(F.col("t").between(t0, t1))


def slices(df: DataFrame) -> DataFrame:
    """Points at integer times, as one table to be read by timestep."""
    return df.where("ordinal").withColumn("slice", F.col("timestep"))


def velocity(df: DataFrame, *axes: str) -> DataFrame:
    """``v<axis>``: central differences from point to point along a curve, one-sided at its ends, zero for single points."""
    w = _w(df)
    inner = F.lead("seq").over(w).isNotNull() & F.lag("seq").over(w).isNotNull()
    for a in axes or ("x",):
        d = F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a))
        df = df.withColumn(f"v{a}", F.when(inner, d * 0.5).otherwise(d))
    return df


def smooth_ordinal_types(df: DataFrame, half: int = 2) -> DataFrame:
    """An ordinal point takes the type of its ``half`` ordinal neighbours on each side where those agree (and are known)."""
    key = _key(df)
    w = Window.partitionBy(*key).orderBy("seq")
    near = [F.lag("type", d).over(w) for d in range(1, half + 1)] + [F.lead("type", d).over(w) for d in range(1, half + 1)]
    same = F.lit(True)
    for n in near:
        same = same & F.coalesce(n == near[0], F.lit(False))
    fixed = df.where("ordinal").withColumn("__n", F.when(same & (near[0] != 0), near[0]).otherwise(F.col("type")))
    rest = df.where(~F.col("ordinal")).withColumn("__n", F.col("type"))
    return fixed.unionByName(rest).withColumn("type", F.col("__n")).drop("__n")


def smooth_interval_types(df: DataFrame) -> DataFrame:
    """Types change once at most between ordinal points: from the first point that leaves the left one's type, all take the right one's.

    Before the first and after the last ordinal point they take its type. Curves without an ordinal point stay.
    """
    w = _w(df)
    kind, n = F.when(F.col("ordinal"), F.col("type")), F.col("ordinal").cast("int")
    got = (
        df.withColumn("__g", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__a", F.last(kind, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__b", F.first(kind, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    )
    a, b = F.col("__a"), F.col("__b")
    run = Window.partitionBy(*_key(df), "__g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("__left", F.max((F.col("type") != a).cast("int")).over(run))
    new = F.when(a.isNull() & b.isNull(), F.col("type")).when(a.isNull(), b).when(b.isNull() | (F.col("__left") == 0), a).otherwise(b)
    return got.withColumn("type", new).drop("__g", "__a", "__b", "__left")


def reorder(df: DataFrame) -> DataFrame:
    """Open curves in ascending time: reversed where the last point lies before the first."""
    w = _all(df)
    key = F.struct(F.col("timestep"), F.col("t"))
    first, last = F.min_by(key, "seq").over(w), F.max_by(key, "seq").over(w)
    flip = (first > last) & ~F.col("loop") if "loop" in df.columns else first > last
    new = F.when(flip, F.max("seq").over(w) - F.col("seq")).otherwise(F.col("seq") - F.min("seq").over(w))
    return df.withColumn("__s", new).withColumn("seq", F.col("__s").cast(df.schema["seq"].dataType)).drop("__s")


def rotate(df: DataFrame) -> DataFrame:
    """Loops that begin and end with one type start at their first change of type instead."""
    w = _all(df)
    head, tail = F.min_by("type", "seq").over(w), F.max_by("type", "seq").over(w)
    marked = df.withColumn("__h", head).withColumn("__t", tail).withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(_w(df)) - 1)
    marked = marked.withColumn("__c", F.min(F.when(F.col("type") != F.col("__h"), F.col("__r"))).over(w))
    turn = F.when(F.col("loop") & (F.col("__h") == F.col("__t")) & F.col("__c").isNotNull(), F.col("__c")).otherwise(0)
    new = F.pmod(F.col("__r") - turn, F.col("__n")).cast(df.schema["seq"].dataType)
    return marked.withColumn("seq", new).drop("__h", "__t", "__n", "__r", "__c")


def adjust_time(df: DataFrame) -> DataFrame:
    """Times that never fall along a curve: a forward running maximum, then a backward running minimum.

    Both start anew at each ordinal point, whose time is exact, so they are windows over the runs between those.
    """
    w = _w(df)
    n = F.col("ordinal").cast("int")
    up = df.withColumn("__g", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*_key(df), "__g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    up = up.withColumn("t", F.when(F.col("ordinal"), F.col("t")).otherwise(F.max("t").over(run)))
    down = up.withColumn("__g", F.sum(n).over(w.rowsBetween(0, Window.unboundedFollowing)))
    run = Window.partitionBy(*_key(df), "__g").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return down.withColumn("t", F.when(F.col("ordinal"), F.col("t")).otherwise(F.min("t").over(run))).drop("__g")


def discard_interval_points(df: DataFrame) -> DataFrame:
    return df.where("ordinal")


def discard_degenerate_points(df: DataFrame) -> DataFrame:
    return df.where(~F.col("type").isin(0, 1))


def discard(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~condition)


def select_curves(df: DataFrame, condition: Column, **stats) -> DataFrame:
    """Points of the curves whose row of ``statistics`` satisfies a condition."""
    keys = statistics(df, **stats).where(condition).select(*_key(df))
    return df.join(keys, _key(df), "left_semi")


def prune_short(df: DataFrame, duration: float) -> DataFrame:
    w = _all(df)
    return df.withColumn("__d", F.max("t").over(w) - F.min("t").over(w)).where(F.col("__d") >= duration).drop("__d")


def unwrap(df: DataFrame, axis: str, period: float) -> DataFrame:
    """A periodic coordinate made continuous: jumps of over half a period are taken back."""
    w = _w(df)
    d = F.col(axis) - F.lag(axis).over(w)
    df = df.withColumn("__k", F.when(d >= period / 2, -1).when(d <= -period / 2, 1).otherwise(0))
    turns = F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(axis, F.col(axis) + turns * period).drop("__k")


def to_geo(df: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """``lon, lat`` in degrees and ``depth`` beyond a radius, from Cartesian coordinates."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return df.withColumns({"lon": F.degrees(F.atan2("y", "x")), "lat": F.degrees(F.asin(F.col("z") / r)), "depth": r - radius})


def split_geo(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Cut curves where the longitude jumps across the date line."""
    lagged = df.withColumn("__p", F.lag(lon).over(_w(df)))
    return _islands(lagged, F.coalesce(F.abs(F.col(lon) - F.col("__p")) > 180, F.lit(False))).drop("__p")


def relabel(df: DataFrame) -> DataFrame:
    """Dense new ids in the order of the old keys; sorts one row a curve, not the points."""
    named = numbered_by(df.select(*_key(df)).distinct(), *_key(df), name="__new")
    return df.join(named, _key(df)).withColumn("id", F.col("__new")).drop("__new", "sub")


def assign_new_id(df: DataFrame, more: DataFrame) -> DataFrame:
    """The curves of ``df`` and of ``more``, whose ids are moved past the largest id that is there."""
    top = df.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).cast("long").alias("__top"))
    low = more.agg(F.coalesce(F.min("id"), F.lit(0)).alias("__low"))
    moved = more.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low)).withColumn("id", F.col("id") - F.col("__low") + F.col("__top"))
    return df.unionByName(moved.select(*df.columns))


POST: dict[str, Callable[[DataFrame], DataFrame]] = {
    "smooth_types": lambda df: smooth_interval_types(smooth_ordinal_types(df)),
    "rotate": rotate,
    "split": split,
    "discard_interval_points": discard_interval_points,
    "discard_degenerate_points": discard_degenerate_points,
    "reorder": reorder,
    "adjust_time": adjust_time,
    "derive_velocity": lambda df: velocity(df, *[a for a in "xyz" if a in df.columns]),
}


def post_process(df: DataFrame, ops: str = "smooth_types,rotate,split,reorder,adjust_time", duration: float = 0.0, compat: bool = False) -> DataFrame:
    """A chain of named curve operators; an unknown name is an error, and ``duration`` prunes short curves before a split."""
    for name in filter(None, (x.strip() for x in ops.split(","))):
        if name not in POST:
            raise ValueError(f"no curve operator {name!r}; there are {', '.join(POST)}")
        if name == "split":
            if duration > 0:
                df = prune_short(df, duration)
            df = split(df, compat)
        else:
            df = POST[name](df)
    return df
