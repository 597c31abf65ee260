"""Baselines of sharpness by camera, lens, focal length and aperture, and the flags that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X

from .aggregates import percentiles, value_counts
from .joins import with_baseline

KEYS = ("camera_model", "lens_model", "focal_bucket", "aperture_index")


def bucketed(exif: DataFrame) -> DataFrame:
    return exif.select("file_id", "camera_model", "lens_model", X.focal_bucket(F.col("focal_length_mm")).alias("focal_bucket"), X.aperture_index(F.col("aperture")).alias("aperture_index"))


def sharpness_baselines(sharpness: DataFrame, exif: DataFrame, min_samples: int) -> DataFrame:
    """Percentiles of each bucket with min_samples files, and of all files in one more row."""
    rows = sharpness.where("s_subject IS NOT NULL").select("file_id", F.col("s_subject").cast("double").alias("s")).join(bucketed(exif).dropna(), "file_id")
    wanted = {"s_subject_p10": 0.1, "s_subject_p50": 0.5, "s_subject_p90": 0.9}
    counts = value_counts(rows, list(KEYS), "s")
    own = percentiles(None, list(KEYS), "s", wanted, counts).where(F.col("n") >= min_samples)
    stars = [F.lit("*").alias("camera_model"), F.lit("*").alias("lens_model"), F.lit(0).alias("focal_bucket"), F.lit(0).alias("aperture_index")]
    everyone = percentiles(None, [], "s", wanted, counts).select(*stars, *wanted, "n")
    return own.unionByName(everyone).select(*KEYS, *wanted, F.col("n").cast("int").alias("n_samples"))


def iqa_p10(iqa: DataFrame) -> DataFrame:
    """One row; null without scores."""
    found = percentiles(iqa.select(F.col("score").cast("double").alias("score")), [], "score", {"iqa_p10": 0.1})
    return found.agg(F.max("iqa_p10").alias("iqa_p10"))


def reflag(sharpness: DataFrame, exif: DataFrame, iqa: DataFrame, baselines: DataFrame, min_samples: int, second_opinion: bool = True) -> DataFrame:
    """(file_id, flag_type, confidence, bumped, reason): blur, back focus and low quality of each file that has a threshold.

    A file without subject sharpness or without any baseline gets no flag at all, low quality included.
    """
    scores = iqa.select("file_id", F.col("score").cast("double").alias("score"))
    rows = sharpness.select("file_id", F.col("s_subject").cast("double").alias("s"), F.col("s_background").cast("double").alias("bg"))
    rows = rows.join(bucketed(exif), "file_id", "left").join(scores, "file_id", "left")
    rows = with_baseline(rows, baselines, min_samples).where("s IS NOT NULL AND p10 IS NOT NULL")
    rows = rows.join(F.broadcast(iqa_p10(iqa)), F.lit(True)) if second_opinion else rows.withColumn("iqa_p10", F.lit(None).cast("double"))
    short = lambda v, p: X.clamp((p - v) / p, 0.01, 1.0)
    s, p10, score, q10 = (F.col(c) for c in ("s", "p10", "score", "iqa_p10"))
    soft = s < p10
    behind = soft & (s > 0) & (F.coalesce("bg", s) > 2 * s)
    poor = F.coalesce(score < q10, F.lit(False))
    both = soft & ~behind & poor
    told = lambda c: F.round(c, 6)  # noqa: E731  noise far behind the digits shown doesn't tell which way a half goes
    # fixed values: the wording of reasons
    subject = F.format_string("subject %.1f < p10 %.1f", told(s), told(p10))
    why = {
        "back_focus": F.concat(subject, F.format_string(", background %.1fx sharper", told(F.coalesce("bg", s) / s))),
        "blur": F.when(both, F.concat(subject, F.lit(" (confirmed by low IQA)"))).otherwise(subject),
        "low_iqa": F.format_string("iqa %.2f < global p10 %.2f", told(score), told(q10)),
    }
    flag = lambda name, test, conf, bumped: F.when(test, F.struct(F.lit(name).alias("flag_type"), conf.alias("confidence"), bumped.alias("bumped"), why[name].alias("reason")))
    flags = F.array_compact(
        F.array(
            flag("back_focus", behind, short(s, p10), F.lit(False)),
            flag("blur", soft & ~behind, F.when(both, F.least(short(s, p10) + 0.2, F.lit(1.0))).otherwise(short(s, p10)), both),
            flag("low_iqa", poor, short(score, q10), F.lit(False)),
        )
    )
    return rows.select("file_id", F.explode(flags).alias("f")).select("file_id", "f.flag_type", "f.confidence", "f.bumped", "f.reason")


def exposure_flags(exposure: DataFrame, highlights: float = 0.05, shadows: float = 0.10) -> DataFrame:
    """(file_id, flag_type, confidence, reason) of files clipped beyond a threshold."""
    hi, lo = F.col("clipped_highlights").cast("double"), F.col("clipped_shadows").cast("double")
    why = lambda c, bound: F.format_string(f"%.1f%% pixels at {bound}", c * 100)
    flag = lambda name, c, at, bound: F.when(c > at, F.struct(F.lit(name).alias("flag_type"), F.least(c / at, F.lit(1.0)).alias("confidence"), why(c, bound).alias("reason")))
    flags = F.array_compact(F.array(flag("overexposed", hi, highlights, "\u2265 0.99"), flag("underexposed", lo, shadows, "\u2264 0.01")))
    return exposure.select("file_id", F.explode(flags).alias("f")).select("file_id", "f.flag_type", "f.confidence", "f.reason")


def calibration_report(flags: DataFrame) -> DataFrame:
    """One row of counts over the flags of reflag()."""
    count = lambda name: F.count_if(F.col("flag_type") == name).alias(f"flagged_{name}")
    return flags.agg(count("blur"), count("back_focus"), count("low_iqa"), F.count_if("bumped").alias("blur_confidence_bumped"))
