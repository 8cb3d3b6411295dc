"""Shared helpers: tables, materialised cuts in the shared folder, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_DIR = "/tmp/checkpoints/driftmesh"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session whose driver and executors are one process may leave it unset."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/driftmesh/{tag}-{uuid.uuid4().hex}"


BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of at most ``BATCH_ROWS`` rows: Spark's own 10,000 hold tens of megabytes of text several times over.

    A session that asks for fewer keeps its number.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage, and lets later stages start again from the files when an executor is lost. Shuffle
    files of the write are given up at its end, where Spark can do so.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    was = spark.conf.get(CLEAN_UP, None)
    try:
        if was is not None:
            spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path)
    finally:
        if was is not None:
            spark.conf.set(CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` has written, once nothing reads them any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def put_at(x: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``x`` with ``more`` written from ``at`` on, in a larger array if need be."""
    if at + len(more) > len(x):
        x = np.concatenate((x[:at], np.zeros(max(len(x), len(more)) + len(x), x.dtype)))
    x[at : at + len(more)] = more
    return x


def give_back(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage and give back the pages.

    Plans, broadcasts and the like of many short queries outlive the young collections. G1 rather grows the heap to its limit than
    look for them, and only a full collection makes it smaller.
    """
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_join(left: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` (a ``cut`` table) whose keys are in ``counts``, which says in ``n`` how many rows each key has in ``left``.

    A key with more than a thousandth of the rows would fill one task of a shuffle. There are fewer than a thousand such keys,
    so these are broadcast; all others are joined by a shuffle.
    """
    most = max(1000, left.count() // 1000)
    hot = F.broadcast(counts.where(F.col("n") > most).select(*keys))
    rest = left.join(hot, keys, "left_anti").join(counts.where(F.col("n") <= most).select(*keys), keys, "left_semi")
    return left.join(hot, keys, "left_semi").select(*left.columns).unionByName(rest.select(*left.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` as ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds; each round is one query of three shuffles, without joins or broadcasts, whose
    rows go to a table in the shared folder and whose convergence test comes with that write: a driver runs many rounds in
    one session, and each thread, broadcast and plan stays with it for a while. Isolated nodes aren't in the result.
    """
    low = F.min("b").over(Window.partitionBy("a"))
    e, state = _cut_edges(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    give_back(edges.sparkSession)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("m", F.least("a", low))
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
        pairs = large.withColumn("m", low).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        e, new = _cut_edges(pairs.select("x.a", F.col("x.m").alias("b")).where("a <> b"))
        if new == state:
            break
        state = new
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _cut_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, cut, with their number and a hash of them all."""
    seen = Observation()
    e = edges.repartition("a").distinct()
    e = cut(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")), "cc")
    got = seen.get  # without a row Spark may leave out the node that counts
    return e, (got.get("n", 0), got.get("h"))
