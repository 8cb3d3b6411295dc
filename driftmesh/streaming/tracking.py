"""Streaming forms: windowed counts as a field, pairs of neighbouring steps, and curves that grow as steps arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mesh import Lattice
from ..operators.features import critical_points_2d
from ..operators.features import domain as critical_domain
from ..operators.graph import components, point_graph
from ..sources.storage import shared_dir


def window_counts(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows in each tumbling window; state of windows older than the watermark is dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


class StepPairs:
    """Hands each step with the one before it to a function, batch by batch.

    Batches hold whole steps in ascending order. The last step of a batch is kept in a table of the shared folder under the batch's
    number; a batch that is tried again reads the same one and overwrites its own results, so each result
    is there once. To go on after the driver was lost, give the same ``base`` (and the stream's checkpoint) again.
    """

    def __init__(self, spark: SparkSession, pair: Callable[[DataFrame], DataFrame], base: str | None = None):
        self.pair, self.base = pair, base or f"{shared_dir(spark)}/driftmesh/steps-{uuid.uuid4().hex}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.agg(F.max("t").alias("t")).first().t
        kept = f"{self.base}/last/batch={number}"
        if last is None:
            rows = batch
            before = spark.read.parquet(f"{self.base}/last/batch={number - 1}") if number else batch
            before.write.mode("overwrite").parquet(kept)
        else:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{self.base}/last/batch={number - 1}")) if number else batch
            batch.where(F.col("t") == last).write.mode("overwrite").parquet(kept)
        self.pair(rows).write.mode("overwrite").parquet(f"{self.base}/out/batch={number}")

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/out").drop("batch")


class OnlineCurves:
    """Trajectories that grow as snapshots arrive: connected components kept from step to step.

    Each call gets the hits that a step pair adds and writes three tables under the batch's number, so a batch that is tried again
    overwrites its own: ``points (tag, timestep, curve)``, ``merges (a, b)`` between curves that have turned out to be
    one, and ``open (tag, curve)``, the points that the next step can still extend. Only open points are looked at again; a curve's
    final name is the smallest one that merges lead to.
    """

    def __init__(self, spark: SparkSession, lattice: Lattice, k: int, base: str | None = None):
        self.lattice, self.k = lattice, k
        self.base = base or f"{shared_dir(spark)}/driftmesh/online-{uuid.uuid4().hex}"

    def _read(self, spark: SparkSession, name: str, number: int | None, schema: str) -> DataFrame:
        if number is not None and number < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.base}/{name}" if number is None else f"{self.base}/{name}/batch={number}")

    def __call__(self, hits: DataFrame, number: int) -> None:
        """``hits (tag, timestep, ...)``: new punctured cells; batches come in ascending time."""
        spark = hits.sparkSession
        old = self._read(spark, "open", number - 1, "tag long, timestep long, curve long")
        new = hits.select("tag", F.col("timestep").cast("long").alias("timestep")).distinct().join(old.select("tag"), "tag", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.base}/new/batch={number}")
        new = self._read(spark, "new", number, "tag long, timestep long")
        near = point_graph(old.select("tag").unionByName(new.select("tag")), self.lattice, self.k)
        # an open point stands for its curve, which is named by a point's tag itself
        named = old.select(F.col("tag").alias("a"), F.col("curve").alias("b"))
        nodes = new.select(F.col("tag").alias("node")).unionByName(old.select(F.col("tag").alias("node")))
        roots = components(near.unionByName(named), nodes.unionByName(old.select(F.col("curve").alias("node"))))
        roots = roots.withColumnRenamed("node", "tag").withColumnRenamed("root", "curve")
        new.join(roots, "tag").write.mode("overwrite").parquet(f"{self.base}/points/batch={number}")
        moved = old.select(F.col("curve").alias("tag")).distinct().join(roots, "tag").where("tag <> curve")
        moved.select(F.col("tag").alias("a"), F.col("curve").alias("b")).write.mode("overwrite").parquet(f"{self.base}/merges/batch={number}")
        every = old.select("tag", "timestep").unionByName(new)
        last = every.agg(F.max("timestep").alias("t")).first().t
        still = every.where(F.col("timestep") >= (last if last is not None else 0) - 1).join(roots, "tag").select("tag", "timestep", "curve")
        still.write.mode("overwrite").parquet(f"{self.base}/open/batch={number}")

    def curves(self, spark: SparkSession) -> DataFrame:
        """``(tag, timestep, root, complete)`` of all points so far; a curve is complete once no later step has extended it."""
        points = self._read(spark, "points", None, "tag long, timestep long, curve long")
        roots = components(self._read(spark, "merges", None, "a long, b long"), points.select(F.col("curve").alias("node")))
        named = points.join(roots.withColumnRenamed("node", "curve"), "curve").select("tag", "timestep", "root")
        last = named.agg(F.max("timestep").alias("now"))
        ends = named.groupBy("root").agg(F.max("timestep").alias("end")).crossJoin(F.broadcast(last)).select("root", (F.col("end") < F.col("now")).alias("complete"))
        return named.join(ends, "root").select("tag", "timestep", "root", "complete")


def track_stream(stream: DataFrame, shape: tuple[int, ...], steps: int, base: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, once: bool = True):
    """Start a query that tracks critical points of a streamed 2D scalar field ``(t, j, i, f)``; its batches hold whole steps in order.

    ``change`` (smoothing, noise, clamping) is applied to each batch's snapshots. Results are those of ``OnlineCurves`` under ``base``,
    slices of each batch's points under ``base/sliced``. Give the same ``base`` and ``checkpoint`` to go on after a stop.
    """
    spark = stream.sparkSession
    lattice = critical_domain(shape, steps, 2)
    curves = OnlineCurves(spark, lattice, 2, base)
    pairs = StepPairs(spark, lambda rows: critical_points_2d(rows, shape, steps, bits=21), f"{base}/pairs")

    def batch(rows: DataFrame, number: int) -> None:
        pairs(change(rows) if change else rows, number)
        hits = spark.read.parquet(f"{base}/pairs/out/batch={number}")
        curves(hits, number)
        new = spark.read.parquet(f"{base}/new/batch={number}").select("tag")  # the kept step's points have been there before
        hits.where("ordinal").join(new, "tag", "left_semi").write.mode("overwrite").partitionBy("timestep").parquet(f"{base}/sliced/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(), curves
