"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A lookup table with at most this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def get_session(app: str = "sparktrace", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution (skew joins, partition coalescing) and a fixed time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; in local mode without one, a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparktrace-")
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written copy.

    Lost executors re-read it, plans stay short, and the optimizer sees its real size.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, table: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join a lookup table of known row count, broadcast only below the size bound."""
    return df.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition into the session's shuffle partition count, which adaptive execution then leaves alone.

    For steps whose work per byte is high: by size alone their partitions would be merged into a few slow tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dense_index(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` in a global order without a single-task window.

    Rows are range-partitioned on the order, numbered inside each partition and written once, so that the numbers stay
    fixed; then they are shifted by the row counts of the partitions before (one row per partition).
    """
    at = F.monotonically_increasing_id()
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at).select(
            "*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__pos")
        )
    )
    before = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("__part", "__before")
    )
    # One row per partition of the range shuffle: bounded by the partition count, not by the data.
    return placed.join(F.broadcast(before), "__part").select(
        *df.columns, (F.col("__before") + F.col("__pos") + F.lit(start)).alias(name)
    )
