"""Capture metadata and content hashes as rows, of contents or of files that tasks open themselves."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raw import Ranges, read_headers

FIELDS = "camera_make string, camera_model string, lens_model string, captured_text string, focal_length_mm double, aperture double, iso int, shutter_seconds double, width int, height int, orientation int, error string"
#: Bytes of a file hashed at a time.
STEP = 1 << 22


def read_exif(data: bytes) -> dict:
    """The fields of a photo's directories; empty texts and what is of another type are None. ValueError if there are none."""
    return {k: v for k, v in read_headers(Ranges(data)).items() if not k.startswith("preview_")}


def exif_rows(files: DataFrame) -> DataFrame:
    """(path, xxh3_128 of the content as content_hash, captured_at, and FIELDS) for rows of (path, content) or of (path).

    Without a column content the files are opened by the tasks, so they must be on a file system that all executors share;
    then only one piece of a file is in memory at a time. A file that is gone has an error and no hash.
    """
    from gallerist.functions.expressions import exif_epoch

    by_path = "content" not in files.columns

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            contents = [None] * batch.num_rows if by_path else batch.column("content")
            for path, content in zip(batch.column("path").to_pylist(), contents, strict=True):
                row = dict.fromkeys(names) | {"path": path}
                try:
                    with Ranges(path if by_path else content.as_py() or b"") as source:
                        h = xxhash.xxh3_128()
                        for at in range(0, source.size, STEP):
                            h.update(source.read(at, min(STEP, source.size - at)))
                        row["content_hash"] = h.hexdigest()
                        row |= {k: v for k, v in read_headers(source).items() if k in row}
                except (OSError, ValueError) as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"path string, content_hash string, {FIELDS}"
    shape = files.sparkSession.createDataFrame([], ddl).schema
    names, arrow = shape.names, to_arrow_schema(shape)
    found = files.select("path", *([] if by_path else ["content"])).mapInArrow(run, ddl)
    return found.withColumn("captured_at", exif_epoch(F.col("captured_text"))).drop("captured_text")
