"""Decisions on files as operations on whole tables: each returns the new decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.schemas import VERDICTS


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """existing with the rows of new put in by key; update: the columns that an existing row takes over, all by default."""
    columns = existing.columns
    if update is None:
        return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*columns))
    theirs = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns if c not in keys], F.lit(True).alias("__new"))
    joined = existing.withColumn("__old", F.lit(True)).join(theirs, keys, "full")
    took = lambda c: F.when(F.col("__old").isNull() | (F.col("__new") & F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c in keys else took(c) for c in columns])


#: What a change of keepers takes over in a file that was decided on before; its note stays.
KEEPER_COLUMNS = ["verdict", "is_keeper", "decided_at"]


def decision_row(spark: SparkSession, file_id: int, verdict: str, at: int, note: str | None = None) -> DataFrame:
    """A verdict for one file, as a row to put in by key; the file is no keeper after that."""
    if verdict not in VERDICTS:
        raise ValueError(f"unknown verdict {verdict!r}")
    return spark.createDataFrame([(file_id, verdict, False, note, at)], "file_id long, verdict string, is_keeper boolean, note string, decided_at long").coalesce(1)


def set_decision(decisions: DataFrame, file_id: int, verdict: str, at: int, note: str | None = None) -> DataFrame:
    """The decisions after decision_row()."""
    return upsert(decisions, decision_row(decisions.sparkSession, file_id, verdict, at, note).select(*decisions.columns), ["file_id"])


def clear_decision(decisions: DataFrame, *file_ids: int) -> DataFrame:
    return decisions.where(~F.col("file_id").isin(*file_ids))


def keeper_rows(members: DataFrame, keepers: DataFrame, at: int) -> DataFrame:
    """Files of keepers (file_id) are kept as keepers; every other member of a group they are in is rejected.

    Set-wise: one call takes any number of keepers. A file that is itself a keeper isn't rejected.
    """
    chosen = keepers.select("file_id").distinct()
    groups = members.join(chosen, "file_id", "left_semi").select("group_id").distinct()
    others = members.join(groups, "group_id", "left_semi").select("file_id").distinct().join(chosen, "file_id", "left_anti")
    made = chosen.select("file_id", F.lit("keep").alias("verdict"), F.lit(True).alias("is_keeper")).union(others.select("file_id", F.lit("reject"), F.lit(False)))
    return made.withColumn("note", F.lit(None).cast("string")).withColumn("decided_at", F.lit(at).cast("long"))


def pick_keepers(decisions: DataFrame, members: DataFrame, keepers: DataFrame, at: int) -> DataFrame:
    """The decisions after keeper_rows()."""
    return upsert(decisions, keeper_rows(members, keepers, at), ["file_id"], KEEPER_COLUMNS)
