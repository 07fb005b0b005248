"""Sources and sinks: point tables, member tables, label pairs, JSON and Arrow batches, Parquet and Arrow IPC files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import access


def points(spark: SparkSession, path: str, fields: dict[str, str] | None = None, projection: str = "none") -> DataFrame:
    """A Parquet table of points with x and y, or lon and lat, or morton and residual; fields renames columns (new: old)."""
    df = spark.read.parquet(path)
    df = df.withColumnsRenamed({old: new for new, old in (fields or {}).items()})
    if {"lon", "lat"} <= set(df.columns):
        x, y = spatial.forward(projection, F.col("lon"), F.col("lat"))
        df = df.withColumn("x", x).withColumn("y", y)
    elif {"morton", "residual"} <= set(df.columns):
        code = F.shiftleft(F.col("morton").cast("long"), 32).bitwiseOR(F.col("residual").cast("long"))
        qx, qy = spatial.unmorton(code)
        return df.withColumn("code", code).withColumn("qx", qx).withColumn("qy", qy)
    if not {"x", "y"} <= set(df.columns):
        raise ValueError("a point table has x and y, lon and lat, or morton and residual")
    return df


def members(table: DataFrame, items: DataFrame, on: str, artifact: str = "artifact", lists: str | None = None) -> DataFrame:
    """(artifact, entity) from rows of (artifact, item key), or from a column that lists the members of each artifact."""
    rows = table if lists is None else table.withColumn(on, F.explode(lists))
    if lists is not None and dict(rows.dtypes)[on].startswith("struct"):
        rows = rows.withColumn(on, F.col(f"{on}.{on}"))
    return rows.select(F.col(artifact).alias("artifact"), F.col(on).alias("key_")).join(items.select("entity", F.col(on).alias("key_")), "key_").select("artifact", "entity").distinct()


def pairs(items: DataFrame) -> DataFrame:
    """The exploded relation (entity, key) of items with keys."""
    return access.item_keys(items)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows decoded from a column of JSON text; what can't be read gives null fields."""
    return df.select("*", F.from_json(column, schema).alias("row_")).select(*df.columns, "row_.*")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_ipc(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One Arrow IPC file of a page of at most ``most`` rows; more is refused, and belongs into write_parquet."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"a page holds {most} rows at most")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
