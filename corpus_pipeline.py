"""A corpus pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. A document goes if the quality rules reject it, if line dedup or passage removal leaves nothing of
it, or if it is a near copy of one with a smaller id; n_chars follows the text that is left.

Null and empty texts fail the quality rules, so they go with the first stage. Rows that repeat an id and a text are one
document to the stages that compare documents and stay together or go together; ids must name one text each. A row without
id passes the stages that compare documents as it is. Nulls in other columns and columns of further names pass through all
stages but the last. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.llm import line_dedup, near_dedup, quality_rules, suffix_dedup
from gallerist.llm import queries as thin
from gallerist.llm._common import documents, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.drop_repeated_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.strip_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return thin.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("suffix_dedup", passages),
    ("best_fit_packing", pack),
]

#: Tokens cannot be counted in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
