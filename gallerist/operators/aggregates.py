"""Counts over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.storage import in_order, written

from .review import Catalogue


def table_counts(cat: Catalogue) -> DataFrame:
    """One row of the number of rows of each table that is there."""
    names = [n for n in ("files", "sharpness", "embeddings", "iqa", "decisions", "duplicate_groups", "duplicate_members") if n in cat]
    counted = [cat[n].agg(F.count("*").alias(f"{n}_count")) for n in names]
    out = counted[0]
    for df in counted[1:]:
        out = out.crossJoin(df)  # one row each
    return out


def catalogue_stats(cat: Catalogue) -> DataFrame:
    """(files, flagged_files, duplicate_groups, duplicate_members, decided): one row."""
    one = [
        cat["files"].agg(F.count("*").alias("files")),
        cat["defect_flags"].agg(F.countDistinct("file_id").alias("flagged_files")),
        cat["duplicate_members"].agg(F.countDistinct("group_id").alias("duplicate_groups"), F.count("*").alias("duplicate_members")),
        cat["decisions"].agg(F.count("*").alias("decided")),
    ]
    out = one[0]
    for df in one[1:]:
        out = out.crossJoin(df)  # one row each
    return out


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_type").agg(F.count("*").alias("n")).orderBy("flag_type")


def per_camera_counts(exif: DataFrame) -> DataFrame:
    """Files by camera, unknown ones together, most first."""
    return exif.groupBy("camera_model").agg(F.count("*").alias("n")).select(F.coalesce("camera_model", F.lit("(unknown)")).alias("camera"), "n").orderBy(F.desc("n"), "camera")


def per_lens_counts(exif: DataFrame) -> DataFrame:
    named = [F.coalesce(c, F.lit("(unknown)")).alias(a) for c, a in (("camera_model", "camera"), ("lens_model", "lens"))]
    return exif.groupBy("camera_model", "lens_model").agg(F.count("*").alias("n")).select(*named, "n").orderBy(F.desc("n"), "camera", "lens")


def decision_counts(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kept, rejected, undecided); files without a decision are undecided."""
    made = decisions.agg(F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") == "reject").alias("rejected"))
    total = files.agg(F.count("*").alias("total"))
    return made.crossJoin(total).select("kept", "rejected", F.greatest(F.col("total") - F.col("kept") - F.col("rejected"), F.lit(0)).alias("undecided"))


def progress(counts: DataFrame) -> DataFrame:
    """Shares of a decision_counts() row in whole percent."""
    decided = F.col("kept") + F.col("rejected")
    total = F.greatest(decided + F.col("undecided"), F.lit(1)).cast("double")
    percent = lambda c: F.round(c / total * 100).cast("int")
    return counts.select(decided.alias("decided"), percent(F.col("kept")).alias("kept_percent"), percent(F.col("rejected")).alias("rejected_percent"), percent(decided).alias("decided_percent"))


def review_counts(rows: DataFrame) -> DataFrame:
    """Review rows by flag, and how many have any flag, none, or a group."""
    have = F.filter(F.split("flags", ","), lambda f: f != "")
    each = rows.select(F.explode(have).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    totals = rows.agg(F.count_if(F.col("flags") != "").alias("any"), F.count_if(F.col("flags") == "").alias("none"), F.count_if(F.col("group_id").isNotNull()).alias("dup"))
    return each.union(totals.select(F.explode(F.create_map(*[x for n in ("any", "none", "dup") for x in (F.lit(f"({n})"), F.col(n))])).alias("name", "n")))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """(clusters, decided, frames, eligible) over rows of clusters_for_review(): a decided cluster has a keeper, an eligible one a suggestion."""
    groups = clusters.groupBy("group_id").agg(F.max("is_keeper").alias("decided"), F.count("*").alias("frames"), F.max("is_suggested_keeper").alias("suggested"))
    return groups.agg(
        F.count("*").alias("clusters"), F.count_if("decided").alias("decided"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.count_if(F.col("suggested") & ~F.col("decided")).alias("eligible")
    )


def accept_all_totals(clusters: DataFrame) -> DataFrame:
    """(clusters, rejections) that accepting every suggestion of an undecided cluster would make."""
    groups = clusters.groupBy("group_id").agg(F.max("is_keeper").alias("decided"), F.count("*").alias("frames"), F.max("is_suggested_keeper").alias("suggested"))
    return groups.where("suggested AND NOT decided").agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("frames") - 1), F.lit(0)).alias("rejections"))


def finish_estimate(kept: DataFrame) -> DataFrame:
    """(keepers, raw_keepers) over rows with file_format."""
    return kept.agg(F.count("*").alias("keepers"), F.count_if(F.col("file_format") != "jpg").alias("raw_keepers"))


#: Counts of distinct values by group that are told percentiles of by an aggregate; more of them are put in one order.
FEW = 1 << 18


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n): how often each group has each value, written."""
    return written(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n")), "values")


def _ranked(counts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n, before, total) of value_counts(): how many rows of the group stand before, and how many it has.

    Places come from one global order, so a group of any size is spread over tasks; sums by group combine before the shuffle.
    """
    placed = in_order(counts, [*groups, value], "before", "n", "values")
    first = placed.groupBy(*groups).agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    if groups:
        same = [placed[g].eqNullSafe(first[g]) for g in groups]
        test = same[0]
        for t in same[1:]:
            test = test & t
        both = placed.join(first, test).drop(*[first[g] for g in groups])
    else:
        both = placed.join(F.broadcast(first), F.lit(True))  # one row
    return both.select(*groups, value, "n", (F.col("before") - F.col("first")).alias("before"), "total")


def percentiles(df: DataFrame | None, groups: list[str], value: str, quantiles: dict[str, float], counts: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """(groups, a column for each quantile, n): exact percentiles, linear between neighbours. Without groups, one row if there is any value.

    counts: value_counts() of these groups or of more, instead of df. Up to `few` counts, an aggregate holds those of a group;
    beyond it they are ranked in one order over tasks. Both are exact.
    """
    if counts is None:
        counts = value_counts(df, groups, value)
    elif set(counts.columns) != {*groups, value, "n"}:
        counts = written(counts.groupBy(*groups, value).agg(F.sum("n").alias("n")), "values")
    if counts.count() <= few:
        found = counts.groupBy(*groups).agg(F.percentile(value, list(quantiles.values()), F.col("n")).alias("found"), F.sum("n").alias("n")).where("n > 0")
        return found.select(*groups, *[F.col("found")[i].alias(name) for i, name in enumerate(quantiles)], "n")
    ranked = _ranked(counts, groups, value)
    last = F.col("before") + F.col("n")
    at = lambda place: F.min(F.when(last > place, F.col(value)))
    place = {name: (F.col("total") - 1) * F.lit(q) for name, q in quantiles.items()}
    ends = [c for name, x in place.items() for c in (at(F.floor(x)).alias(f"{name}_low"), at(F.ceil(x)).alias(f"{name}_high"))]
    found = ranked.groupBy(*groups).agg(*ends, F.sum("n").alias("n")).where("n > 0")
    between = lambda name, q: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * ((F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)))
    return found.select(*groups, *[between(name, q).alias(name) for name, q in quantiles.items()], "n")


def nearest_rank(df: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, halves away from zero."""
    ranked = _ranked(value_counts(df, [group], value), [group], value)
    index = lambda q: F.round((F.col("total") - 1) * F.lit(q))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("before") + F.col("n") > index(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def histogram_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, clipped_highlights, clipped_shadows, mean_luma, histogram_skew) of 8-bit levels: counts by level, then moments over 256 of them."""
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.round(value).cast("int")))
    bins = df.groupBy(group, level.alias("level")).agg(F.count("*").cast("double").alias("n"))
    x, n = F.col("level").cast("double"), F.col("n")
    sums = bins.groupBy(group).agg(
        F.sum("n").alias("total"), F.sum(F.when(x >= 253, n).otherwise(0.0)).alias("hi"), F.sum(F.when(x <= 2, n).otherwise(0.0)).alias("lo"),
        *[F.sum(n * F.pow(x, F.lit(float(k)))).alias(f"m{k}") for k in (1, 2, 3)],
    )
    t, m1, m2, m3 = F.col("total"), F.col("m1"), F.col("m2"), F.col("m3")
    mean = m1 / t
    variance = F.greatest(m2 / t - mean * mean, F.lit(0.0))
    third = m3 / t - 3 * mean * m2 / t + 2 * mean * mean * mean
    skew = F.when(F.sqrt(variance) > 1e-6, third / F.pow(variance, F.lit(1.5))).otherwise(F.lit(0.0))
    return sums.select(group, (F.col("hi") / t).alias("clipped_highlights"), (F.col("lo") / t).alias("clipped_shadows"), (mean / 255).alias("mean_luma"), skew.alias("histogram_skew"))


def library_totals(files: DataFrame, library: Column) -> DataFrame:
    """(library, photo_count, last_analyzed) of all libraries: library, over the columns of files, tells whose a file is."""
    return files.groupBy(library.alias("library")).agg(F.count("*").alias("photo_count"), F.max("last_processed").alias("last_analyzed"))
