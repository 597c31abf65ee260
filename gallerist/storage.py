"""Lineage cuts on storage that driver and executors share, and places in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session that names none gets one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='gallerist-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Removes what written() stored, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def in_order(df: DataFrame, order: list[str | Column], name: str, weight: str | None = None, label: str = "ordered") -> DataFrame:
    """df, a written table, with a column more: how many rows, or how much weight, stand before a row in the order.

    A sort by range and one offset for each partition, so no task sees all rows and the driver one number a partition.
    The partitions are written before they are counted: a second run of the sort could cut them elsewhere.
    """
    part, within = f"{name}_part", f"{name}_within"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    if weight is None:
        placed = placed.withColumn(within, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33))
    placed = written(placed, label)
    total = F.count("*") if weight is None else F.sum(weight)
    before, upto = [], 0
    for r in placed.groupBy(part).agg(total.alias("n")).orderBy(part).collect():
        before.append((r[part], upto))
        upto += r["n"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], f"{part} int, {name} long")
    if weight is not None:
        from pyspark.sql import Window

        so_far = F.sum(weight).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed_path = placed._written_path
        placed = placed.withColumn(within, so_far - F.col(weight))
        placed._written_path = placed_path
    out = placed.join(F.broadcast(offsets), part, "left").withColumn(name, F.col(within) + F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit("a partition without an offset"))))
    out = out.drop(part, within)
    out._written_path = placed._written_path
    return out
