"""Groups of duplicates, their quality, and the election of a keeper."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.storage import in_order

from .graph import connected_components
from .vectors import normalize, similarity_edges

METHOD = "time+embed"


@dataclass(frozen=True)
class DedupeConfig:
    enable: bool = True
    time_window_seconds: int = 60
    cosine_within_window: float = 0.92
    cosine_global: float = 0.97
    k_neighbors: int = 10
    min_group_size: int = 2
    #: Neighbours by hyperplane cells instead of all pairs: much less work on many vectors, and some links are missed.
    approximate: bool = False


def quality_inputs(files: DataFrame, iqa: DataFrame, exposure: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, iqa_score, clipped_highlights, clipped_shadows, has_blur, has_back_focus) for every file."""
    has = lambda name: F.max(F.col("flag_type") == name)
    flagged = flags.groupBy(F.col("file_id").alias("id")).agg(has("blur").alias("b"), has("back_focus").alias("f"))
    return (
        files.select("id").join(iqa.select(F.col("file_id").alias("id"), F.col("score").cast("double").alias("iqa_score")), "id", "left")
        .join(exposure.select(F.col("file_id").alias("id"), F.col("clipped_highlights").cast("double").alias("hi"), F.col("clipped_shadows").cast("double").alias("lo")), "id", "left")
        .join(flagged, "id", "left")
        .select("id", "iqa_score", F.coalesce("hi", F.lit(0.0)).alias("clipped_highlights"), F.coalesce("lo", F.lit(0.0)).alias("clipped_shadows"), F.coalesce("b", F.lit(False)).alias("has_blur"), F.coalesce("f", F.lit(False)).alias("has_back_focus"))
    )


def quality_scores(inputs: DataFrame) -> DataFrame:
    return inputs.select("id", X.quality_score(*[F.col(c) for c in ("iqa_score", "has_blur", "has_back_focus", "clipped_highlights", "clipped_shadows")]).alias("quality_score"))


def elect(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(component, id, quality_score, is_suggested_keeper, place): best quality first, then the smaller id."""
    scored = members.select("component", "id").join(scores, "id", "left").withColumn("quality_score", F.coalesce("quality_score", F.lit(0.0)))
    return places(scored, "component", [F.desc("quality_score"), F.asc("id")]).withColumn("is_suggested_keeper", F.col("place") == 1)


def places(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with their place in their group, from 1: from one order over all groups, so that no task sees a whole group."""
    placed = in_order(rows, [F.asc(group), *order], "before", label="places")
    first = placed.groupBy(group).agg(F.min("before").alias("first"))
    return placed.join(first, group).withColumn("place", (F.col("before") - F.col("first") + 1).cast("int")).select(*rows.columns, "place")


def exact_groups(files: DataFrame, min_size: int = 2) -> DataFrame:
    """(component, id): files with equal content, named after the smallest id."""
    groups = files.groupBy("content_hash").agg(F.min("id").alias("component"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    return files.select("id", "content_hash").join(groups.select("content_hash", "component"), "content_hash").select("component", "id")


def similar_groups(embeddings: DataFrame, exif: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DataFrame:
    """(component, id): files joined by likeness, in groups of min_group_size or more."""
    vectors = embeddings.select(F.col("file_id").alias("id"), normalize(F.col("vector")).alias("vector"))
    times = exif.select(F.col("file_id").alias("id"), "captured_at")
    edges = similarity_edges(vectors, times, cfg.time_window_seconds, cfg.cosine_within_window, cfg.cosine_global, cfg.k_neighbors, not cfg.approximate)
    found = connected_components(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.min_group_size)
    return found.join(sizes.select("component"), "component").select("component", "id")


def numbered(elected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_id by component, members): groups numbered from 1 in order of their smallest id.

    Numbers come from a sort by range and an offset for each partition, so no task sees all groups.
    """
    ids = in_order(elected.select("component").distinct(), ["component"], "before", label="groups").select("component", (F.col("before") + 1).alias("group_id"))
    members = elected.join(ids, "component").select("group_id", F.col("id").alias("file_id"), "is_suggested_keeper", "quality_score")
    return ids, members


def run_dedupe(files: DataFrame, embeddings: DataFrame, exif: DataFrame, scores: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DataFrame:
    """Members of all groups of similar files; empty if switched off or if there are too few vectors."""
    empty = "group_id long, file_id long, is_suggested_keeper boolean, quality_score double"
    if not cfg.enable or embeddings.limit(cfg.min_group_size).count() < cfg.min_group_size:
        return files.sparkSession.createDataFrame([], empty)
    return numbered(elect(similar_groups(embeddings, exif, cfg), scores))[1]
