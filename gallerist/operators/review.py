"""Lists, groups and counts that a reviewer looks at.

A catalogue is a mapping of table names to DataFrames with the columns of gallerist.schemas.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.storage import in_order

from .duplicates import places

Catalogue = Mapping[str, DataFrame]


def _by_file(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("file_id").alias("id"), *columns)


def flags_by_file(flags: DataFrame) -> DataFrame:
    """(id, flags sorted, max_confidence), aggregated once for all that need it."""
    return flags.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list("flag_type")).alias("flags"), F.max(F.col("confidence").cast("double")).alias("max_confidence"))


def review_rows(cat: Catalogue, flag_type: str | None = None, decided: bool | None = None) -> DataFrame:
    """One row per file with its month, score, flags, group and decision."""
    files = cat["files"].select("id", "path", "content_hash")
    if flag_type is not None:
        files = files.join(cat["defect_flags"].where(F.col("flag_type") == flag_type).select(F.col("file_id").alias("id")), "id", "left_semi")
    groups = cat["duplicate_members"].groupBy(F.col("file_id").alias("id")).agg(F.min("group_id").alias("group_id"))
    rows = (
        files.join(_by_file(cat["exif"], "captured_at"), "id", "left")
        .join(_by_file(cat["iqa"], F.col("score").cast("double").alias("iqa_score")), "id", "left")
        .join(_by_file(cat["decisions"], "verdict", "is_keeper"), "id", "left")
        .join(flags_by_file(cat["defect_flags"]), "id", "left").join(groups, "id", "left")
    )
    if decided is not None:
        rows = rows.where(F.col("verdict").isNotNull() == F.lit(decided))
    return rows.select(
        F.col("id").alias("file_id"), "path", "content_hash", X.year_month(F.col("captured_at")).alias("year_month"), "iqa_score",
        F.coalesce(F.concat_ws(",", "flags"), F.lit("")).alias("flags"), "max_confidence", "group_id", "verdict", F.coalesce("is_keeper", F.lit(False)).alias("is_keeper"), "captured_at",
    )


def review_list(cat: Catalogue, flag_type: str | None = None, decided: bool | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the review rows: flagged ones first, then by capture time, those without one last, then by id."""
    rows = review_rows(cat, flag_type, decided)
    order = [F.col("max_confidence").isNull(), F.col("captured_at").asc_nulls_last(), F.col("file_id")]
    return rows.orderBy(*order).offset(offset).limit(limit).drop("captured_at")


def review_entries(cat: Catalogue) -> DataFrame:
    """One row per flag: (file_id, path, flag_type, confidence, year_month)."""
    rows = cat["defect_flags"].join(cat["files"].select(F.col("id").alias("file_id"), "path"), "file_id").join(cat["exif"].select("file_id", "captured_at"), "file_id", "left")
    return rows.select("file_id", "path", "flag_type", F.col("confidence").cast("double").alias("confidence"), X.year_month(F.col("captured_at")).alias("year_month"))


def _dated_groups(cat: Catalogue) -> DataFrame:
    """(group_id, keeper_id, group_date) by the capture day of the suggested keeper."""
    keepers = cat["duplicate_members"].where("is_suggested_keeper").groupBy("group_id").agg(F.min("file_id").alias("keeper_id"))
    dated = keepers.join(cat["exif"].select(F.col("file_id").alias("keeper_id"), "captured_at"), "keeper_id", "left")
    return dated.select("group_id", "keeper_id", X.year_month(F.col("captured_at"), "yyyy-MM-dd").alias("group_date"))


def group_members(cat: Catalogue) -> DataFrame:
    """One row per member: (group_id, group_date, path, is_first), is_first for the suggested keeper that names the group's date."""
    members = cat["duplicate_members"].join(cat["files"].select(F.col("id").alias("file_id"), "path"), "file_id").join(_dated_groups(cat), "group_id", "left")
    return members.select("group_id", F.coalesce("group_date", F.lit("unknown-date")).alias("group_date"), "path", F.col("file_id").eqNullSafe(F.col("keeper_id")).alias("is_first"))


def groups_for_review(cat: Catalogue) -> DataFrame:
    """One row per group, to be shown: (group_id, group_date, keeper path, other paths sorted). Plans are made from group_members()."""
    return group_members(cat).groupBy("group_id").agg(
        F.min("group_date").alias("group_date"), F.max(F.when(F.col("is_first"), F.col("path"))).alias("keeper"), F.array_sort(F.collect_list(F.when(~F.col("is_first"), F.col("path")))).alias("others")
    )


def clusters_for_review(cat: Catalogue) -> DataFrame:
    """One row per member with its group's date and its place: suggested keeper first, best score next, then by path."""
    rows = review_rows(cat).drop("group_id")
    members = cat["duplicate_members"].select("group_id", "file_id", "is_suggested_keeper").join(rows, "file_id").join(_dated_groups(cat), "group_id", "left")
    return places(members, "group_id", [F.desc("is_suggested_keeper"), F.col("iqa_score").desc_nulls_last(), F.asc("path")]).select(
        "group_id", F.coalesce("group_date", F.lit("unknown-date")).alias("group_date"), "place", "file_id", "path", "content_hash",
        "year_month", "iqa_score", "flags", "max_confidence", "verdict", "is_keeper", "is_suggested_keeper",
    )


def group_positions(members: DataFrame) -> DataFrame:
    """(group_id, file_id, place, size): i of n in a group, by file id."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size"))
    return places(members.select("group_id", "file_id"), "group_id", [F.asc("file_id")]).join(sizes, "group_id").select("group_id", "file_id", "place", "size")


def score_percentiles(iqa: DataFrame) -> DataFrame:
    """(file_id, score, top_percent): the share of scored files that are at least as good, 1 to 100.

    Ranks over the whole table come from counts of distinct scores, summed by range: the rows themselves stay spread.
    """
    scored = iqa.where("score IS NOT NULL").select("file_id", F.col("score").cast("double").alias("score"))
    ranks = in_order(scored.groupBy("score").agg(F.count("*").alias("n")), [F.desc("score")], "before", "n", "scores")
    ranks = ranks.join(F.broadcast(ranks.agg(F.sum("n").alias("total"))), F.lit(True)).select("score", "total", (F.col("before") + 1).alias("rank"))
    percent = F.round(F.col("rank") / F.col("total") * 100).cast("int")
    return scored.join(ranks, "score").select("file_id", "score", X.clamp(percent, 1, 100).alias("top_percent"))


def decision_of(verdict, is_keeper):
    """keeper before keep before reject before undecided."""
    return F.when(is_keeper, "keeper").otherwise(F.coalesce(verdict, F.lit("undecided")))


def filtered(rows: DataFrame, flags: tuple[str, ...] = (), undecided_only: bool = False, duplicates_only: bool = False, keepers_only: bool = False) -> DataFrame:
    """Review rows by any of some flags; '*' stands for any flag, '!' for none."""
    have = F.when(F.col("flags") == "", F.array().cast("array<string>")).otherwise(F.split("flags", ","))
    tests = {"*": F.size(have) > 0, "!": F.size(have) == 0}
    if flags:
        wanted = [tests[f] for f in flags if f in tests] + [F.arrays_overlap(have, F.array(*[F.lit(f) for f in flags if f not in tests]).cast("array<string>"))]
        any_of = wanted[0]
        for w in wanted[1:]:
            any_of = any_of | w
        rows = rows.where(any_of)
    for on, test in ((undecided_only, F.col("verdict").isNull()), (duplicates_only, F.col("group_id").isNotNull()), (keepers_only, F.col("is_keeper"))):
        if on:
            rows = rows.where(test)
    return rows


def sorted_rows(rows: DataFrame, by: str) -> DataFrame:
    """Review rows by score (best first), name (numbers by value), or flagged (most flags first, then worst score)."""
    flags = F.size(F.filter(F.split("flags", ","), lambda f: f != ""))
    orders = {
        "score": [F.col("iqa_score").desc_nulls_last(), F.col("file_id")],
        "name": [X.natural_key(X.basename(F.col("path"))), F.col("file_id")],
        "flagged": [flags.desc(), F.col("iqa_score").asc_nulls_last(), F.col("file_id")],
    }
    return rows.orderBy(*orders[by])


def keeper_files(cat: Catalogue) -> DataFrame:
    """(file_id, path, content_hash, file_format, year_month) of kept files."""
    kept = cat["decisions"].where("verdict = 'keep'").select("file_id")
    files = cat["files"].select(F.col("id").alias("file_id"), "path", "content_hash", "file_format", "size_bytes")
    # merge joins: decisions are files of a few MB for millions of rows, which a broadcast would put into the driver
    rows = kept.join(files.hint("merge"), "file_id").join(cat["exif"].select("file_id", "captured_at").hint("merge"), "file_id", "left")
    return rows.select("file_id", "path", "content_hash", "file_format", "size_bytes", X.year_month(F.col("captured_at")).alias("year_month"))


def orphaned_edits(edits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edits of files that aren't kept any more: rejected, or without a decision."""
    verdicts = decisions.select("file_id", "verdict")
    return edits.join(verdicts, "file_id", "left").where(~F.col("verdict").eqNullSafe(F.lit("keep"))).drop("verdict")


def exif_by_path(cat: Catalogue, paths: DataFrame) -> DataFrame:
    """Capture metadata of the files at some paths: (path, and the columns of exif)."""
    wanted = cat["files"].join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"), "path")
    return wanted.join(cat["exif"], "file_id")


def lookup(cat: Catalogue, file_ids: DataFrame) -> DataFrame:
    """(id, path, content_hash) of files by id (file_id); ids without a file give no row."""
    return cat["files"].join(file_ids.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").select("id", "path", "content_hash")


def decisions_of(cat: Catalogue, file_ids: DataFrame) -> DataFrame:
    """(file_id, verdict, is_keeper) of the files asked for that have a decision."""
    return cat["decisions"].join(file_ids.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "verdict", "is_keeper")


def file_dump(cat: Catalogue) -> DataFrame:
    """Everything about a file in one row, nested, and as JSON."""
    nest = lambda name: F.struct(*[F.col(c) for c in cat[name].columns if c != "file_id"]).alias(name)
    rows = cat["files"]
    for name in ("exif", "sharpness", "exposure", "iqa", "decisions"):
        rows = rows.join(_by_file(cat[name], nest(name)), "id", "left")
    vectors = _by_file(cat["embeddings"], F.struct(*[c for c in ("model",) if c in cat["embeddings"].columns], F.size("vector").alias("dim")).alias("embedding"))
    flags = cat["defect_flags"].groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("flag_type", "confidence"))).alias("flags"))
    groups = cat["duplicate_members"].groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list("group_id")).alias("group_ids"))
    rows = rows.join(vectors, "id", "left").join(flags, "id", "left").join(groups, "id", "left")
    return rows.withColumn("dump", F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
