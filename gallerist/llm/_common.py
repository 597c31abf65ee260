"""What the operators of this subpackage share: tables, split folds, and unclaimed column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.storage import drop_written, written

__all__ = ["documents", "drop_written", "fresh", "id_fold", "join_counted", "text_or_empty", "WORD_GAP", "written"]

#: A word: characters outside blank and the controls tab to carriage return.
WORD_GAP = "[ \\t-\\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with a number, such that no column begins with it in any case."""
    taken = [c.lower() for c in columns]
    return next(x for x in (name, *(f"{name}_{i}_" for i in range(1, 1_000_000))) if not any(c.startswith(x) for c in taken))


#: Keys that hold more than this share of all rows are joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 1 / 4096


def join_counted(rows: DataFrame, by_key: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with by_key, a table of one row for each key whose column n is the number of rows it has.

    Keys with more than HOT_SHARE of all rows, at most 4096 of them, are broadcast, so that their rows stay where they
    are; the others are joined by key. rows should be a written table, as it is counted and read twice.
    """
    most = max(1000, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(by_key.where(F.col("n") > most))
    usual = rows.join(hot.select(*keys), keys, "left_anti").join(by_key.where(F.col("n") <= most), keys)
    return rows.join(hot, keys).unionByName(usual)


def id_fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
