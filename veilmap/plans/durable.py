"""Cutting the lineage of iterative plans by checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="veilmap-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no earlier round."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(ordered: DataFrame, column: str, first: int = 1) -> DataFrame:
    """ordered, ranged and sorted within its partitions, with row numbers from ``first`` on in ``column``, without one task that sees all rows.

    Rows are settled with their partition and their place in it. A range partitioning that is worked out for the rows and again for
    their counts samples other bounds, and adaptive plans join other partitions of it, so offsets would not be those of the rows.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    x = settled(ordered.withColumn("part_", F.spark_partition_id()).withColumn("at_", at))
    sizes = x.groupBy("part_").agg((F.max("at_") + 1).alias("n_"))
    base = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return x.join(F.broadcast(base), "part_").withColumn(column, F.col("before_") + F.col("at_") + F.lit(first)).drop("part_", "at_", "before_")
