"""Plans for developing kept raw files: what to render, what is current, what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X

from .calibration import bucketed
from .joins import with_baseline
from .review import Catalogue, keeper_files

DECIDER = "decide-3"
IDENTITY = ("content_hash", "recipe_hash", "decider_version", "renderer", "look_model", "look_version")


def develop_inputs(cat: Catalogue, min_samples: int) -> DataFrame:
    """(file_id, iso, lens_model, s_relative) of every file: sharpness as its place in its bucket's range, else in all files'."""
    rows = cat["files"].select(F.col("id").alias("file_id")).join(bucketed(cat["exif"]).hint("merge"), "file_id", "left")
    rows = rows.join(cat["exif"].select("file_id", "iso").hint("merge"), "file_id", "left").join(cat["sharpness"].select("file_id", F.col("s_subject").cast("double").alias("s")).hint("merge"), "file_id", "left")
    rows = with_baseline(rows, cat["sharpness_baseline"], min_samples)
    # without a whole key there is no bucket, but the range of all files still holds
    relative = F.when(F.col("s").isNull() | F.col("span_p10").isNull(), F.lit(X.NEUTRAL_SHARPNESS)).otherwise(X.relative_sharpness(F.col("s"), F.col("span_p10"), F.col("span_p90")))
    return rows.select("file_id", "iso", "lens_model", relative.alias("s_relative"))


def recipes(cat: Catalogue, min_samples: int) -> DataFrame:
    """(file_id, recipe, recipe_hash) of every file with raw statistics."""
    rows = cat["raw_stats"].join(develop_inputs(cat, min_samples), "file_id")
    recipe = X.decide(*[F.col(c) for c in ("p50", "p99", "clipped_frac", "black_frac", "iso", "lens_model", "s_relative")])
    return rows.select("file_id", recipe.alias("recipe")).withColumn("recipe_hash", X.recipe_hash(F.col("recipe")))


def finish_plan(cat: Catalogue, min_samples: int, renderer: str, look: tuple[str, str] | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """(file_id, path, action) of kept files: skip_unsupported, measure (no current statistics), skip (current), render.

    outputs: (output_path, output_size_bytes) of files that are there; without it recorded outputs are taken as there.
    """
    model, version = look or (None, None)
    kept = keeper_files(cat).join(recipes(cat, min_samples), "file_id", "left")
    edits = cat["edits"].select("file_id", *[F.col(c).alias(f"had_{c}") for c in IDENTITY], "output_path", "output_size_bytes")
    rows = kept.join(edits, "file_id", "left")
    wanted = {"content_hash": F.col("content_hash"), "recipe_hash": F.col("recipe_hash"), "decider_version": F.lit(DECIDER), "renderer": F.lit(renderer), "look_model": F.lit(model).cast("string"), "look_version": F.lit(version).cast("string")}
    same = F.col("output_path").isNotNull()
    for c, value in wanted.items():
        same = same & F.col(f"had_{c}").eqNullSafe(value)
    if outputs is not None:
        there = outputs.select("output_path", F.col("output_size_bytes").alias("there"))
        rows = rows.join(there, "output_path", "left")
        same = same & F.col("there").eqNullSafe(F.col("output_size_bytes"))
    stale = F.col("recipe_hash").isNull() | (F.col("had_content_hash").isNotNull() & (F.col("had_content_hash") != F.col("content_hash")))
    action = F.when(~X.is_raw(F.col("file_format")), "skip_unsupported").when(stale, "measure").when(same, "skip").otherwise("render")
    return rows.select("file_id", "path", "year_month", action.alias("action"), "recipe")
