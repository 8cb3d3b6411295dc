"""Global numbering without a global window: a range-partitioned sort, row numbers in each part, and the parts' offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize


def numbered_by(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """``df`` with ``name``: 0, 1, .. in the order of ``cols``, which should tell rows apart (equal rows are numbered in any order).

    Each part of a range partitioning is numbered on its own. One row a part says how many come before it; that table has as many
    rows as there are shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *cols).withColumn("__part", F.spark_partition_id()), "order")
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*cols)) - 1
    out = parts.withColumn("__nth", nth).join(F.broadcast(base), "__part")
    return out.withColumn(name, (F.col("__base") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__base")
