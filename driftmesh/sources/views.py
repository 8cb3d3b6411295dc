"""Field views of the business tables: deterministic lattices on which the tracking operators run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W, H, T = 16, 8, 28

FIELD_SQL = f"""
  SELECT g.t, g.j, g.i, CAST(COALESCE(c.f, 0) AS BIGINT) AS f
  FROM (SELECT CAST(a.range AS BIGINT) AS t, CAST(b.range AS INTEGER) AS j, CAST(d.range AS INTEGER) AS i FROM range({T}) a, range({H}) b, range({W}) d) g
  LEFT JOIN (
    SELECT (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS t, l_suppkey % {H} AS j, l_partkey % {W} AS i, COUNT(*) AS f
    FROM lineitem GROUP BY ALL) c ON g.t = c.t AND g.j = c.j AND g.i = c.i"""

TRAJ_SQL = """
  SELECT user_id AS id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         epoch(ts) - 1704067200 AS t, value AS x, ascii(event_type) % 3 AS type, event_id % 4 = 0 AS ordinal
  FROM events"""


def field2dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t, j, i, f)``: orders' lines a quarter on a 16 x 8 lattice of part and supplier, dense over 28 quarters.

    The count is partial before its shuffle, and the dense grid has a fixed size, so only its side is broadcast.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_shipdate")
    counts = lines.groupBy(
        ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("long").alias("t"),
        F.pmod("l_suppkey", F.lit(H)).cast("int").alias("j"),
        F.pmod("l_partkey", F.lit(W)).cast("int").alias("i"),
    ).agg(F.count("*").alias("f"))
    n = F.col("id")
    grid = spark.range(T * W * H).select(
        F.floor(n / (W * H)).cast("long").alias("t"), (F.floor(n / W) % H).cast("int").alias("j"), (n % W).cast("int").alias("i")
    )
    return grid.join(counts, ["t", "j", "i"], "left").select("t", "j", "i", F.coalesce("f", F.lit(0)).cast("long").alias("f"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, seq, t, x, type, ordinal)``: each user's events in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("t"),
        F.col("value").alias("x"),
        (F.ascii("event_type") % 3).alias("type"),
        (F.col("event_id") % 4 == 0).alias("ordinal"),
    )
