"""A cache of derived files under the hash of their content, in folders by its first two digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_path(root: str, content_hash: str, kind: str = "previews", suffix: str = "png") -> str:
    return f"{root}/{kind}/{content_hash[:2]}/{content_hash}.{suffix}"


class ContentCache:
    """Entries as a table partitioned by prefix: (content_hash, bytes); what is there isn't written again."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "previews"):
        self.spark, self.path = spark, f"{root}/{kind}"

    def read(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)
        schema = "content_hash string, bytes binary, prefix string"
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def missing(self, hashes: DataFrame) -> DataFrame:
        return hashes.join(self.read().select("content_hash"), "content_hash", "left_anti")

    def add(self, entries: DataFrame) -> None:
        fresh = self.missing(entries.dropDuplicates(["content_hash"]).select("content_hash", "bytes"))
        fresh.withColumn("prefix", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(self.path)
