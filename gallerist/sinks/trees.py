"""Output trees of copies: planned as DataFrames, copied task by task, safe against folders that aren't ours."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.operators import output
from gallerist.sources.listing import MARKER, list_files
from gallerist.storage import drop_written, written

README = "README.txt"
OUTCOMES = "rel_path string, outcome string, bytes long"


@dataclass
class CopyReport:
    copied: int = 0
    skipped: int = 0
    removed: int = 0
    bytes: int = 0
    errors: int = 0


def is_managed(root: str) -> bool:
    return os.path.exists(os.path.join(root, MARKER))


def ensure_safe(root: str) -> None:
    """Refuses a folder with content that doesn't bear our marker."""
    if os.path.isdir(root) and os.listdir(root) and not is_managed(root):
        raise PermissionError(f"{root} holds files and no {MARKER}: not touching it")


def remove_managed(root: str) -> None:
    ensure_safe(root)
    shutil.rmtree(root, ignore_errors=True)


def _copied(named: DataFrame, root: str) -> DataFrame:
    """Copies each row's original; needs a root that all executors share."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                dest = os.path.join(root, r["rel_path"])
                try:
                    src = os.stat(r["original"])
                    there = os.stat(dest) if os.path.exists(dest) else None
                    if there and there.st_size == src.st_size and there.st_mtime_ns >= src.st_mtime_ns:
                        rows.append((r["rel_path"], "skipped", 0))
                        continue
                    os.makedirs(os.path.dirname(dest), exist_ok=True)
                    shutil.copyfile(r["original"], dest)
                    rows.append((r["rel_path"], "copied", src.st_size))
                except OSError:
                    rows.append((r["rel_path"], "error", 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["rel_path", "outcome", "bytes"])

    return named.select(F.concat_ws("/", "rel_dir", "name").alias("rel_path"), "original").mapInArrow(run, OUTCOMES)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size_bytes, mtime_ns) of the files below root, without our own two; listed by Spark, no file is opened."""
    top = os.path.realpath(root)
    if not os.path.isdir(top) or not os.listdir(top):
        return spark.createDataFrame([], "rel_path string, size_bytes long, mtime_ns long")
    found = list_files(spark, top).withColumn("rel_path", F.expr(f"substr(path, {len(top) + 2})"))
    return found.where(~F.col("rel_path").isin(MARKER, README)).select("rel_path", "size_bytes", "mtime_ns")


def ensure_ours(root: str, edits: DataFrame) -> bool:
    """Whether root is a tree of ours, which it becomes if it isn't there, is empty, or holds an output that an edit names."""
    if is_managed(root):
        return True
    if os.path.isdir(root) and os.listdir(root):
        claimed = edits.where(F.col("output_path").startswith(root.rstrip("/") + "/")).select(F.expr(f"substr(output_path, {len(root.rstrip('/')) + 2})").alias("rel_path"))
        if not listing(edits.sparkSession, root).join(claimed, "rel_path", "left_semi").limit(1).count():
            return False
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, MARKER), "w") as f:
        f.write("managed tree\n")
    return True


def sweep(expected: DataFrame, root: str) -> int:
    """Removes all files below root that expected (rel_path) doesn't name, and folders that this leaves empty; their number.

    What is there comes from a listing and what is too much from an anti-join; tasks remove their own files and then the
    folders above, which only succeeds for empty ones, whoever comes last. Only a tree that bears our marker is touched.
    """
    if not is_managed(root):
        raise PermissionError(f"{root} has no {MARKER}: not touching it")
    top = os.path.realpath(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            gone = []
            for rel in batch["rel_path"].to_pylist():
                path = os.path.join(top, rel)
                if not path.startswith(top + os.sep) or ".." in rel.split("/"):
                    continue
                try:
                    os.remove(path)
                    gone.append(rel)
                except FileNotFoundError:
                    pass
                except OSError:
                    continue
                folder = os.path.dirname(path)
                while folder != top:
                    try:
                        os.rmdir(folder)
                    except OSError:
                        break
                    folder = os.path.dirname(folder)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], names=["rel_path"])

    stale = output.stale_copies(expected, listing(expected.sparkSession, top))
    done = written(stale.repartition(max(1, stale.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "rel_path string"), "swept")
    n = done.count()
    drop_written(done)
    return n


def materialize(plan: DataFrame, root: str, readme: str, regenerate: bool = False) -> CopyReport:
    """Copies a plan of (rel_dir, original) below root, writes the marker, and removes what the plan doesn't hold."""
    if regenerate:
        remove_managed(root)
    else:
        ensure_safe(root)
    os.makedirs(root, exist_ok=True)
    done = written(_copied(output.unique_names(plan), root), "copied")
    report = CopyReport()
    for r in done.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():  # three outcomes
        setattr(report, {"error": "errors"}.get(r["outcome"], r["outcome"]), r["n"])
        report.bytes += r["bytes"] or 0
    for name, body in ((MARKER, "managed tree\n"), (README, readme)):
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    report.removed = sweep(done.where("outcome <> 'error'"), root)
    drop_written(done)
    return report


def review_readme(where: str = "the catalogue") -> str:
    return f"This folder holds copies of flagged photos. The originals are untouched; {where} is what counts.\nIt is safe to delete and can be built again.\n"
