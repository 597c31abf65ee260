"""Incremental ingestion as a stream: new or changed files of a folder become rows of the catalogue, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gallerist.catalog import Catalog
from gallerist.functions import expressions as X
from gallerist.operators import joins
from gallerist.sources.exif import exif_rows
from gallerist.storage import drop_written, written


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """(path, mtime_ns, size_bytes, content) of files as they appear below root."""
    found = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    )
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content")


def take_in(catalog: Catalog, batch: DataFrame, at: int, app: str | None = None, number: int = 0) -> int:
    """Puts files and their metadata in by one commit; batch has a column content, or its files are opened by their paths. Files known with the same time and size are passed over. Returns the number taken in.

    app, number: a stream and its batch. A batch that was committed before is passed over, so one that is repeated after a
    failure counts once.
    """
    if app is not None and catalog.applied(app) >= number:
        return 0
    known = batch.where(X.file_format(F.col("path")).isNotNull())
    fresh = joins.needs_processing(known, catalog["files"])
    rows = written(exif_rows(fresh).join(fresh.select("path", "mtime_ns", "size_bytes"), "path").where("content_hash IS NOT NULL"), "ingest")
    n = rows.count()
    if n:
        with catalog.transaction() as tx:
            tx.upsert("files", rows.select("path", "content_hash", "size_bytes", "mtime_ns", X.file_format(F.col("path")).alias("file_format"), F.lit(False).alias("has_sidecar_jpg"), F.lit(at).alias("last_processed")))
            ids = tx["files"].select(F.col("id").alias("file_id"), "path")
            tx.upsert("exif", rows.join(ids, "path"))
            if app is not None:
                tx.mark(app, number)
    drop_written(rows)
    return n


def run_ingest(catalog: Catalog, root: str, checkpoint: str, at: int, once: bool = True, per_trigger: int = 1000) -> StreamingQuery:
    """Starts the stream; with once it ends when all that is there is taken in. The stream is known by its checkpoint."""
    writer = file_stream(catalog.spark, root, per_trigger).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: take_in(catalog, df, at, checkpoint, i) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()


def capture_rate(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key of a stream of timed rows; rows later than the watermark are left out. An extension."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
