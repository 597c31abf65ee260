"""Pictures of a work list, and of no other file: a folder of links to them is what Spark's image reader is given.

A reader of a folder opens all files in it, and one of many paths holds them all in the driver. Here tasks put a link to
each file of the list into a folder of the shared storage, under its key, and the reader lists that folder. It also reaches
files whose names Spark takes for hidden ones (`_DSC1234.jpg`) or for patterns (`a[1].jpg`). The folder is removed once what
was made of the pictures is written. An empty list opens nothing.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.storage import drop_written, shared_dir, written

#: Folders that links are dealt to.
SPREAD = 512
EMPTY = "file_id long, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def _linked(rows: DataFrame, folder: str) -> int:
    """Makes the links; their number. A file that is gone gets one that leads nowhere, which the reader passes over."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, path in zip(batch["file_id"].to_pylist(), batch["path"].to_pylist(), strict=True):
                at = os.path.join(folder, str(key % SPREAD))
                os.makedirs(at, exist_ok=True)
                link = os.path.join(at, f"{key}")
                if os.path.exists(path) and not os.path.lexists(link):
                    try:
                        os.symlink(path, link)
                    except FileExistsError:
                        pass  # an attempt of this task before
            yield pa.RecordBatch.from_arrays([batch["file_id"]], names=["file_id"])

    made = written(rows.select("file_id", "path").mapInArrow(run, "file_id long"), "linked")
    n = made.count()
    drop_written(made)
    return n


@contextmanager
def pictures(rows: DataFrame) -> Iterator[DataFrame]:
    """(file_id, image) of rows of (file_id, path), while the context lasts; what isn't a picture has a height below 0."""
    spark = rows.sparkSession
    top = shared_dir(spark)
    if not (top.startswith("/") or top.startswith("file:")):
        raise RuntimeError(f"links need a shared folder that is mounted, not {top}")
    folder = os.path.join("/" + top.removeprefix("file:").lstrip("/"), f"links-{uuid.uuid4().hex}")
    try:
        if _linked(rows, folder) and os.path.isdir(folder):
            images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(f"file://{folder}")
            yield images.select(F.regexp_extract("image.origin", r"(\d+)$", 1).cast("long").alias("file_id"), "image")
        else:
            yield spark.createDataFrame([], EMPTY)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
