"""Formulas of the catalogue as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Focal lengths in millimetres that baselines are kept for.
FOCAL_BUCKETS = (14, 18, 24, 28, 35, 50, 70, 85, 105, 135, 200, 300, 400, 600)
#: ISO and denoise strength, linear in log ISO between the anchors.
DENOISE_ANCHORS = ((100.0, 0.0), (1600.0, 0.3), (6400.0, 0.6), (25600.0, 0.85))
DENOISE_SLOPE_BEYOND, DENOISE_CEILING = 0.05, 0.98
MID_GREY, HIGHLIGHT_TARGET, LOG_FLOOR, MAX_STOPS = 0.18, 0.95, 1e-6, 3.0
EXPOSURE_DEADBAND, SEVERE_CLIPPING = 0.75, 0.05
SHADOW_DEADBAND, SHADOW_RANGE, SHADOW_SHARE = 0.005, 0.045, 0.5
CHROMA_FACTOR, SHARPEN_MAX, NEUTRAL_SHARPNESS = 1.2, 0.8, 0.5
FLOAT_EPSILON = 1.1920929e-07
CONFIDENT = 0.6


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def focal_bucket(mm: Column) -> Column:
    """The nearest bucket; of two as near, the smaller. Null stays null."""
    nearest = F.array_min(F.array(*[F.struct(F.abs(mm.cast("double") - F.lit(float(b))).alias("far"), F.lit(b).alias("mm")) for b in FOCAL_BUCKETS]))
    return F.when(mm.isNotNull(), nearest["mm"])


def aperture_index(f: Column) -> Column:
    """Third stops from f/1, halves away from zero; what is not positive counts as f/1."""
    thirds = F.log2(F.when(f > 0, f).otherwise(F.lit(1.0)).cast("double")) * 3
    return F.when(f.isNotNull(), F.round(thirds).cast("int"))


def aperture_bucket(f: Column) -> Column:
    return F.pow(F.lit(2.0), aperture_index(f) / F.lit(3.0))


def year_month(epoch: Column, pattern: str = "yyyy-MM") -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), pattern), F.lit("unknown-date"))


def quality_score(iqa: Column, blur: Column, back_focus: Column, highlights: Column, shadows: Column) -> Column:
    lost = lambda flag, by: F.when(F.coalesce(flag, F.lit(False)), F.lit(by)).otherwise(F.lit(0.0))
    clipped = F.greatest(F.coalesce(highlights, F.lit(0.0)), F.coalesce(shadows, F.lit(0.0)))
    return F.coalesce(iqa, F.lit(0.0)) - lost(blur, 0.3) - lost(back_focus, 0.2) - clipped * 0.2


def category(flag_type: Column, confidence: Column) -> Column:
    """Where a flagged file goes in the review tree; null for a flag that isn't known."""
    folder = F.when(flag_type == "low_iqa", F.lit("low_quality")).when(flag_type.isin("blur", "back_focus", "overexposed", "underexposed"), flag_type)
    return F.when(folder.isNull(), F.lit(None)).when(confidence >= CONFIDENT, F.concat(F.lit("rejected/"), folder)).otherwise(F.lit("uncertain"))


def deadband(v: Column, width: float) -> Column:
    """v moved towards zero by width, and no further; the sum makes a negative zero positive."""
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(width), F.lit(0.0)) + F.lit(0.0)


def denoise(iso: Column) -> Column:
    iso = iso.cast("double")
    out = F.when(iso <= DENOISE_ANCHORS[0][0], F.lit(DENOISE_ANCHORS[0][1]))
    for (x0, y0), (x1, y1) in zip(DENOISE_ANCHORS, DENOISE_ANCHORS[1:], strict=False):
        share = (F.log2(iso) - F.log2(F.lit(x0))) / (F.log2(F.lit(x1)) - F.log2(F.lit(x0)))
        out = out.when(iso <= x1, F.lit(y0) + share * (y1 - y0))
    x, y = DENOISE_ANCHORS[-1]
    return out.otherwise(clamp(F.lit(y) + (F.log2(iso) - F.log2(F.lit(x))) * DENOISE_SLOPE_BEYOND, 0.0, DENOISE_CEILING))


def relative_sharpness(s: Column, p10: Column, p90: Column) -> Column:
    """Place of s between the percentiles; half where there is no range to compare with."""
    span = p90 - p10
    return F.when((span > FLOAT_EPSILON) & s.isNotNull(), clamp((s - p10) / span)).otherwise(F.lit(NEUTRAL_SHARPNESS))


def decide(p50: Column, p99: Column, clipped: Column, black: Column, iso: Column, lens: Column, sharpness: Column) -> Column:
    """The development recipe as a struct."""
    floor = lambda c: F.greatest(c.cast("double"), F.lit(LOG_FLOOR))
    wanted = F.least(F.log2(F.lit(MID_GREY) / floor(p50)), F.log2(F.lit(HIGHLIGHT_TARGET) / floor(p99)))
    noise = denoise(F.coalesce(iso, F.lit(100)))
    demand = clamp((black.cast("double") - SHADOW_DEADBAND) / SHADOW_RANGE)
    return F.struct(
        deadband(clamp(wanted, -MAX_STOPS, MAX_STOPS), EXPOSURE_DEADBAND).alias("exposure_ev"),
        clamp(clipped.cast("double") / SEVERE_CLIPPING).alias("highlight_recovery"),
        clamp(demand * SHADOW_SHARE * (1 - noise)).alias("shadow_lift"),
        noise.alias("denoise_luma"),
        clamp(noise * CHROMA_FACTOR).alias("denoise_chroma"),
        (clamp(sharpness.cast("double")) * SHARPEN_MAX).alias("sharpen_amount"),
        lens.isNotNull().alias("lens_correct"),
    )


RECIPE = ("exposure_ev", "highlight_recovery", "shadow_lift", "denoise_luma", "denoise_chroma", "sharpen_amount")


def recipe_hash(recipe: Column) -> Column:
    """Sixteen hex digits over the fields in ten thousandths, so that rounding noise doesn't tell recipes apart."""
    parts = [F.round(recipe[n].cast("double") * 10_000).cast("long") for n in RECIPE]
    return F.lower(F.lpad(F.hex(F.xxhash64(*parts, recipe["lens_correct"])), 16, "0"))


def guard_passes(before: Column, after: Column, margin: float) -> Column:
    """A look stays unless it costs more than margin in score; without both scores it stays."""
    return F.coalesce(after >= before - F.lit(margin), F.lit(True))


def humanize_bytes(n: Column) -> Column:
    value, out = n.cast("double"), F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = F.format_string("%.1f " + unit, value / F.lit(1024.0**i))
        out = out.otherwise(scaled) if unit == "TB" else out.when(value < F.lit(1024.0 ** (i + 1)), scaled)
    return out


def file_format(path: Column) -> Column:
    """The format that an extension stands for; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.when(ext == "jpeg", F.lit("jpg")).when(ext.isin("arw", "cr3", "cr2", "nef", "raf", "rw2", "dng", "jpg"), ext)
    return known


def is_raw(fmt: Column) -> Column:
    return fmt.isNotNull() & (fmt != "jpg")


def exif_epoch(text: Column) -> Column:
    """Seconds from a time such as 2023:06:15 12:00:00, separators being any one character; null if it isn't one."""
    number = lambda start, size: F.substring(text, start, size).try_cast("int")
    y, mo, d, h, mi, s = number(1, 4), number(6, 2), number(9, 2), number(12, 2), number(15, 2), number(18, 2)
    valid = (F.length(text) >= 19) & mo.between(1, 12) & d.between(1, 31)
    # a day past the month's end runs on into the next month
    days = F.datediff(F.make_date(F.when(valid, y), F.when(valid, mo), F.lit(1)), F.lit("1970-01-01").cast("date")) + d - 1
    return F.when(valid, days.cast("long") * 86_400 + h * 3600 + mi * 60 + s)


def verdict(c: Column) -> Column:
    """The verdict itself, or an error for a word that isn't one."""
    return F.when(c.isNull() | c.isin("keep", "reject"), c).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), c)))


def shutter(seconds: Column) -> Column:
    """As on a camera: 1/250 s or 2 s."""
    return F.when(seconds <= 0, F.lit(None)).when(seconds < 1, F.concat(F.lit("1/"), F.round(1 / seconds).cast("int").cast("string"), F.lit("s"))).otherwise(F.concat(F.round(seconds, 1).cast("string"), F.lit("s")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def subject_class(coco: Column) -> Column:
    """The class of a detector's category number."""
    return (
        F.when(coco == 0, "person").when(coco.between(1, 8), "vehicle").when(coco.between(9, 13), "object")
        .when(coco.between(14, 23), "animal").when(coco.between(24, 79), "object").otherwise("other")
    )


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def better(mine: Column, theirs: Column) -> Column:
    """1 if the first score is higher, 2 if the second is; null if they are equal or one is missing."""
    return F.when(mine > theirs, 1).when(theirs > mine, 2)


def natural_key(name: Column) -> Column:
    """A key that sorts numbers in names by value: digits padded to twenty, letters in lower case."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"\d*(\d{20})", "$1")


def relative_time(then: Column, now: Column) -> Column:
    """As in 5 minutes ago."""
    s = (now - then).cast("long")
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit}"), F.when(F.floor(n) != 1, "s").otherwise(""), F.lit(" ago"))
    return F.when(then.isNull(), "never").when(s < 60, "just now").when(s < 3600, ago(s / 60, "minute")).when(s < 86_400, ago(s / 3600, "hour")).otherwise(ago(s / 86_400, "day"))


def exif_line(focal: Column, aperture: Column, shutter_seconds: Column, iso: Column) -> Column:
    """Capture settings in one line, missing ones left out."""
    return F.concat_ws(
        " \u00b7 ", F.when(focal.isNotNull(), F.concat(F.round(focal).cast("int").cast("string"), F.lit("mm"))), F.when(aperture.isNotNull(), F.concat(F.lit("f/"), F.round(aperture, 1).cast("string"))),
        F.when(shutter_seconds.isNotNull(), shutter(shutter_seconds)), F.when(iso.isNotNull(), F.concat(F.lit("ISO "), iso.cast("string"))),
    )
