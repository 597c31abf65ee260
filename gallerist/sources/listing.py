"""Listings of photo folders as DataFrames: what there is, what belongs together, what is new."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.storage import written

EXTENSIONS = ("arw", "cr3", "cr2", "nef", "raf", "rw2", "dng", "jpg", "jpeg")
MARKER = ".gallerist-tree"


def _parts(path):
    folder = F.regexp_replace(path, "/[^/]*$", "")
    stem = F.lower(F.regexp_replace(X.basename(path), r"\.[^.]*$", ""))
    return folder, stem


def list_files(spark: SparkSession, root: str, follow_symlinks: bool = True) -> DataFrame:
    """(path, mtime_ns, size_bytes) of all files below root, hidden ones too; no file is opened.

    Folders are listed by tasks, a level of the tree at a time, so root must be on a file system that all executors share.
    Times are cut to milliseconds, as other listings of Spark's are. Without follow_symlinks neither linked files nor what is
    below linked folders is listed; with it a folder that links to one above it is left out.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = []
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            try:
                                if not follow_symlinks and e.is_symlink():
                                    continue
                                at, is_dir = e.stat(), e.is_dir()
                                if is_dir and e.is_symlink() and (folder + "/").startswith(os.path.realpath(e.path) + "/"):
                                    continue
                                found.append((e.path, at.st_mtime_ns // 1_000_000 * 1_000_000, at.st_size, is_dir))
                            except OSError:
                                continue  # gone since, or a link that leads nowhere
                except OSError:
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["path", "mtime_ns", "size_bytes", "is_dir"])

    levels, folders = [], spark.createDataFrame([("/" + root.removeprefix("file:").strip("/"),)], "path string")
    while True:
        level = written(folders.mapInArrow(run, "path string, mtime_ns long, size_bytes long, is_dir boolean"), "listed")
        levels.append(level.where("NOT is_dir"))
        folders = level.where("is_dir").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("path", "mtime_ns", "size_bytes")


def outside_managed(listing: DataFrame, root: str) -> DataFrame:
    """Rows that aren't below a folder, other than root, that holds the marker."""
    marked = listing.where(X.basename(F.col("path")) == MARKER).select(F.regexp_replace("path", "/[^/]*$", "").alias("top")).where(F.col("top") != root.rstrip("/"))
    folders = listing.withColumn("top", F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")))
    below = folders.join(marked, "top", "left_semi").select("path").distinct()
    return listing.join(below, "path", "left_anti")


def ingestable(listing: DataFrame, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Photos to take in, by extension in any case, outside managed trees."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return outside_managed(listing, root).where(ext.isin(*[e.lower() for e in extensions]))


def without_sidecars(listing: DataFrame) -> DataFrame:
    """Rows but for JPEGs that have a raw file of the same folder and stem."""
    folder, stem = _parts(F.col("path"))
    keyed = listing.withColumn("__folder", folder).withColumn("__stem", stem).withColumn("__raw", X.is_raw(X.file_format(F.col("path"))))
    raws = keyed.where("__raw").select("__folder", "__stem").distinct()
    jpegs = keyed.where("NOT __raw").join(raws, ["__folder", "__stem"], "left_anti")
    return keyed.where("__raw").unionByName(jpegs).drop("__folder", "__stem", "__raw")


def with_sidecar_flag(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files and has_sidecar_jpg: whether a raw file has a JPEG of the same folder and stem."""
    folder, stem = _parts(F.col("path"))
    jpegs = listing.where(X.file_format(F.col("path")) == "jpg").select(folder.alias("__folder"), stem.alias("__stem")).distinct().withColumn("__there", F.lit(True))
    keyed = files.withColumn("__folder", folder).withColumn("__stem", stem)
    joined = keyed.join(jpegs, ["__folder", "__stem"], "left")
    return joined.withColumn("has_sidecar_jpg", X.is_raw(X.file_format(F.col("path"))) & F.coalesce("__there", F.lit(False))).drop("__folder", "__stem", "__there")


def folder_summary(listing: DataFrame) -> DataFrame:
    """(folder, photos) of photos right in each folder, in order of name."""
    return listing.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("photos")).orderBy(F.lower("folder"))
