"""Finishing kept raw files: measure, decide, render, look, guard, encode and record, chunk by chunk and resumable.

What is to be done is planned once, as a join over the catalogue: files whose statistics and output are current are passed
over. The rest is cut into chunks in order of path. A chunk is claimed in the table develop_work, worked on by tasks, and
committed: statistics, edits and the rows' state change together or not at all. So a run that is killed has lost one chunk at
most; run again, the plan leaves out what is recorded, and a row whose claim is neither the run's own nor past its lease is
left to whoever holds it. Two runs that claim the same rows meet at the commit of the claim, and the second looks again.

A row that fails, in the decoder, the renderer or the writing of its output, is recorded with its error and tried again by
the next run, not by this one; its statistics stay if it has any. A look that fails or that the guard turns down leaves the
plain picture and is no failure.

Decoder, renderer, look and scorer are given from outside (models.py). Outputs and their profiles are written by the tasks,
under a name of their own first and then by renaming, below a folder that all executors share.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .catalog import Catalog, ConcurrentWrite, Transaction
from .functions import expressions as X
from .functions import lut
from .functions.jpeg import encode_jpeg
from .functions.kernels import cell_colours, illuminant, sample_stats, stride_samples
from .functions.profile import profile_text
from .operators import develop, output, review
from .sinks import trees
from .sources.config import DevelopConfig
from .storage import drop_written, in_order, written

STATS = ("p1", "p50", "p99", "p999", "clipped_frac", "black_frac", "wb_r", "wb_g", "wb_b", "illum_r", "illum_g", "illum_b")
MEASURED = "file_id long, " + ", ".join(f"{c} double" for c in STATS) + ", measure_error string"
RENDERED = "file_id long, lut_hash string, look_applied boolean, iqa_before double, iqa_after double, output_size_bytes long, render_error string"
CHUNK = 1000
#: Seconds after which the claim of a run that has gone silent doesn't count any more.
LEASE = 6 * 3600


@dataclass
class FinishReport:
    rendered: int = 0
    skipped: int = 0
    skipped_unsupported: int = 0
    errored: int = 0
    left_to_others: int = 0
    pruned: int = 0


def plan(cat: Catalog | Transaction, root: str, renderer: str, look: tuple[str, str] | None, min_samples: int, extension: str = ".jpg", by_month: bool = True, outputs: DataFrame | None = None) -> DataFrame:
    """A row for each kept raw file: where its output goes, what its recipe needs, and whether statistics and output are current.

    Statistics are those of a file's content if its edit or its row of develop_work names that content. outputs: (output_path,
    there), the sizes of files that are there; without it recorded outputs are taken as there.
    """
    kept = written(review.keeper_files(cat).where(X.is_raw(F.col("file_format"))), "kept")
    dest = output.finished_paths(kept, by_month, extension).select("file_id", F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("output_path"))
    edits = cat["edits"].select("file_id", *[F.col(c).alias(f"had_{c}") for c in (*develop.IDENTITY, "output_path", "output_size_bytes")])
    work = cat["develop_work"].select("file_id", F.col("content_hash").alias("measured_hash"))
    stats = cat["raw_stats"].select("file_id", F.struct(*STATS).alias("stats"))
    inputs = develop.develop_inputs(cat, min_samples)
    # merge joins throughout: these tables grow with the library, and their files are far smaller than a broadcast of them
    rows = kept.join(dest.hint("merge"), "file_id")
    for other in (edits, work, stats, inputs):
        rows = rows.join(other.hint("merge"), "file_id", "left")
    known = F.col("had_content_hash").eqNullSafe(F.col("content_hash")) | F.col("measured_hash").eqNullSafe(F.col("content_hash"))
    rows = rows.withColumn("stats", F.when(known, F.col("stats")))
    there = F.lit(True)
    if outputs is not None:
        rows = rows.join(outputs.select(F.col("output_path").alias("had_output_path"), "there").hint("merge"), "had_output_path", "left")
        there = F.col("there").isNotNull() & F.coalesce(F.col("there") == F.col("had_output_size_bytes"), F.lit(True))
    here = F.col("had_output_path").eqNullSafe(F.col("output_path")) & there
    model, version = look or (None, None)
    for c, value in {"content_hash": F.col("content_hash"), "decider_version": F.lit(develop.DECIDER), "renderer": F.lit(renderer), "look_model": F.lit(model).cast("string"), "look_version": F.lit(version).cast("string")}.items():
        here = here & F.col(f"had_{c}").eqNullSafe(value)
    columns = ["file_id", "path", "content_hash", "output_path", "stats", "iso", "lens_model", "s_relative", "had_recipe_hash"]
    return decided(written(rows.select(*columns, here.alias("here")), "planned"))  # cut, as recipes on top of all the joins make a plan of hundreds of MB


def decided(rows: DataFrame) -> DataFrame:
    """Rows of a plan with recipe and recipe_hash, null without statistics, and whether their output is current."""
    s = F.col("stats")
    recipe = F.when(s.isNotNull(), X.decide(s["p50"], s["p99"], s["clipped_frac"], s["black_frac"], F.col("iso"), F.col("lens_model"), F.col("s_relative")))
    rows = rows.drop("recipe", "recipe_hash", "current").withColumn("recipe", recipe)
    rows = rows.withColumn("recipe_hash", F.when(s.isNotNull(), X.recipe_hash(F.col("recipe"))))
    return rows.withColumn("current", F.col("here") & F.coalesce(F.col("recipe_hash") == F.col("had_recipe_hash"), F.lit(False)))


def measured(rows: DataFrame, decoder: models.RawDecoder) -> DataFrame:
    """MEASURED for rows of (file_id, path): statistics of the sensor plane, its white balance and light, or the error."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = dict.fromkeys(names) | {"file_id": r["file_id"]}
                try:
                    raw = decoder.decode(r["path"])
                    plane = raw["plane"]
                    light = illuminant(cell_colours(plane, raw["pattern"], raw["black"], raw["white"])) or [None] * 3
                    row |= sample_stats(stride_samples(plane), raw["black"], raw["white"]) | dict(zip(("illum_r", "illum_g", "illum_b"), light, strict=True))
                    row |= dict(zip(("wb_r", "wb_g", "wb_b"), raw.get("white_balance") or [None] * 3, strict=True))
                except Exception as e:  # one file must not end a run
                    row["measure_error"] = f"{type(e).__name__}: {e}"[:500]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = rows.sparkSession.createDataFrame([], MEASURED).schema
    names, arrow = shape.names, to_arrow_schema(shape)
    return rows.select("file_id", "path").mapInArrow(run, MEASURED)


def _put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def looked(rgb, look: models.LookPredictor | None, scorer: models.Scorer | None, margin: float, luts: str | None):
    """(picture, lut_hash, look_applied, iqa_before, iqa_after): the look put on, unless it fails or costs more than margin in score."""
    if look is None:
        return rgb, None, False, None, None
    try:
        table = look.predict(rgb)
        name = lut.content_hash(table)
        if luts and not os.path.exists(cube := os.path.join(luts, f"{name}.cube")):
            _put(cube, lut.to_cube(table).encode())
        made = lut.apply(table, rgb)
    except Exception:  # the plain picture is still right
        return rgb, None, False, None, None
    before = after = None
    if scorer is not None:
        before, after = float(scorer.score(rgb)), float(scorer.score(made))
        if after < before - margin:
            return rgb, name, False, before, after
    return made, name, True, before, after


def rendered(rows: DataFrame, renderer: models.Renderer, look: models.LookPredictor | None, scorer: models.Scorer | None, margin: float, luts: str | None, encode: Callable[[np.ndarray], bytes] = encode_jpeg) -> DataFrame:
    """RENDERED for rows of (file_id, path, output_path, profile), whose outputs and profiles are written."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                row = dict.fromkeys(names) | {"file_id": r["file_id"]}
                try:
                    rgb = renderer.render(r["path"], r["profile"])
                    rgb, row["lut_hash"], row["look_applied"], row["iqa_before"], row["iqa_after"] = looked(rgb, look, scorer, margin, luts)
                    data = encode(rgb)
                    _put(r["output_path"], data)
                    _put(os.path.splitext(r["output_path"])[0] + ".pp3", r["profile"].encode())
                    row["output_size_bytes"] = len(data)
                except Exception as e:  # one file must not end a run
                    row["render_error"] = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = rows.sparkSession.createDataFrame([], RENDERED).schema
    names, arrow = shape.names, to_arrow_schema(shape)
    return rows.select("file_id", "path", "output_path", "profile").mapInArrow(run, RENDERED)


def claim(catalog: Catalog, rows: DataFrame, run: str, since: int, lease: int = LEASE, now: int | None = None) -> DataFrame:
    """The rows of a chunk that this run holds from now on, written; others are held by another run, or were done by one since."""
    now = int(time.time()) if now is None else now
    while True:
        try:
            with catalog.transaction() as tx:
                work = tx["develop_work"].select("file_id", F.col("run").alias("by"), "state", "at", F.col("content_hash").alias("measured_now"))
                held = (F.col("state") == "claimed") & (F.col("by") != run) & (F.col("at") > now - lease)
                over = F.col("state").isin("done", "error") & ((F.col("by") == run) | ((F.col("state") == "done") & (F.col("at") >= since)))
                mine = rows.join(work.hint("merge"), "file_id", "left").where(~F.coalesce(held | over, F.lit(False)))
                mine = written(mine.drop("by", "state", "at"), "claimed")
                made = mine.select("file_id", F.col("measured_now").alias("content_hash"), F.lit(run).alias("run"), F.lit("claimed").alias("state"), F.lit(now).cast("long").alias("at"))
                tx.upsert("develop_work", made)
            return mine.drop("measured_now")
        except ConcurrentWrite:
            continue


def work_on(catalog: Catalog, rows: DataFrame, run: str, decoder: models.RawDecoder, renderer: models.Renderer, look: models.LookPredictor | None, scorer: models.Scorer | None, cfg: DevelopConfig, luts: str | None, encode) -> tuple[int, int, int]:
    """(rendered, current after all, failed) of claimed rows: measured, rendered and committed."""
    spread = rows.sparkSession.sparkContext.defaultParallelism  # a chunk is a small file, but much work
    fresh = written(measured(rows.where("stats IS NULL").repartition(spread), decoder), "measured")
    both = rows.drop("recipe", "recipe_hash", "current").join(fresh.select("file_id", F.struct(*STATS).alias("new"), "measure_error").hint("merge"), "file_id", "left")
    kind = rows.schema["stats"].dataType
    both = both.withColumn("stats", F.coalesce("stats", F.when(F.col("measure_error").isNull(), F.col("new").cast(kind)))).drop("new")
    both = written(decided(both).withColumn("profile", profile_text(F.col("recipe"))), "decided")
    made = written(rendered(both.where("stats IS NOT NULL AND NOT current").repartition(spread), renderer, look, scorer, cfg.look.guard_margin, luts, encode), "rendered")
    done = both.join(made.hint("merge"), "file_id", "left")
    model, version = (look.name, look.version) if look else (None, None)
    now = int(time.time())
    recipe = [F.col("recipe")[c].alias(c) for c in (*X.RECIPE, "lens_correct")]
    edits = done.where("output_size_bytes IS NOT NULL").select(
        "file_id", "content_hash", *recipe, "recipe_hash", F.lit(develop.DECIDER).alias("decider_version"), F.lit(renderer.name).alias("renderer"), F.lit(model).alias("look_model"), F.lit(version).alias("look_version"),
        "lut_hash", "look_applied", "iqa_before", "iqa_after", "output_path", "output_size_bytes", F.lit(now).alias("rendered_at"),
    )
    error = F.coalesce("measure_error", "render_error")
    state = done.select("file_id", F.when(F.col("stats").isNotNull(), F.col("content_hash")).alias("content_hash"), F.lit(run).alias("run"), F.when(error.isNull(), "done").otherwise("error").alias("state"), error.alias("error"), F.lit(now).alias("at"))
    with catalog.transaction() as tx:
        tx.upsert("raw_stats", fresh.where("measure_error IS NULL").drop("measure_error"))
        tx.upsert("edits", edits)
        tx.upsert("develop_work", state)
    n = done.agg(F.count("output_size_bytes"), F.count(F.when(F.col("current"), 1)), F.count(error)).first()
    for t in (fresh, both, made):
        drop_written(t)
    return tuple(n)


def finish(
    catalog: Catalog, root: str, decoder: models.RawDecoder, renderer: models.Renderer, look: models.LookPredictor | None = None, scorer: models.Scorer | None = None, cfg: DevelopConfig = DevelopConfig(),
    min_samples: int = 30, chunk: int = CHUNK, run: str | None = None, lease: int = LEASE, encode: Callable[[np.ndarray], bytes] | None = None, extension: str = ".jpg", luts: str | None = None, on_step=lambda stage: None,
) -> FinishReport:
    """Finishes every kept raw file into root and removes what is there of others.

    run: the name of a run to go on with. encode: the picture's bytes, by default as JPEG of the configured quality.
    """
    if not trees.ensure_ours(root, catalog["edits"]):
        raise PermissionError(f"{root} holds files, none of which an edit names: not touching it")
    look, scorer = look if cfg.look.enable else None, scorer if cfg.look.guard_iqa else None
    encode = encode or partial(encode_jpeg, quality=cfg.jpeg_quality)
    run, since, report = run or uuid.uuid4().hex, int(time.time()), FinishReport()
    on_step("developing")
    outputs = trees.listing(catalog.spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("output_path"), F.col("size_bytes").alias("there"))
    rows = written(plan(catalog, root, renderer.name, (look.name, look.version) if look else None, min_samples, extension, cfg.output_subdirs == "month", outputs), "plan")
    report.skipped = rows.where("current").count()
    report.skipped_unsupported = review.keeper_files(catalog).where(~X.is_raw(F.col("file_format"))).count()
    todo = in_order(rows.where("NOT current"), ["path", "file_id"], "place", label="todo")
    n = rows.count() - report.skipped
    for first in range(0, n, chunk):
        part = todo.where((F.col("place") >= first) & (F.col("place") < first + chunk)).drop("place")
        mine = claim(catalog, part, run, since, lease)
        held = mine.count()
        report.left_to_others += min(chunk, n - first) - held
        if held:
            made, current, failed = work_on(catalog, mine, run, decoder, renderer, look, scorer, cfg, luts, encode)
            report.rendered, report.skipped, report.errored = report.rendered + made, report.skipped + current, report.errored + failed
        drop_written(mine)
    on_step("pruning")
    report.pruned = prune(catalog, root, rows.select("output_path"))
    drop_written(todo)
    drop_written(rows)
    on_step("done")
    return report


def prune(catalog: Catalog, root: str, expected: DataFrame) -> int:
    """Removes edits of files that aren't kept any more, and all files below root that no expected output accounts for."""
    if not trees.ensure_ours(root, catalog["edits"]):
        return 0
    gone = review.orphaned_edits(catalog["edits"], catalog["decisions"]).select("file_id")
    top = len(root.rstrip("/")) + 2
    rel = expected.select(F.expr(f"substr(output_path, {top})").alias("rel_path"))
    removed = trees.sweep(rel.unionByName(rel.select(F.regexp_replace("rel_path", r"\.[^./]*$", ".pp3").alias("rel_path"))), root)
    with catalog.transaction() as tx:
        gone = written(gone, "gone")
        if gone.limit(1).count():
            tx.delete("edits", gone)
    return removed
