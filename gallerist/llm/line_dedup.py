"""Removal of repeated runs of lines: a suffix array over line numbers by prefix doubling, in DataFrame operations only.

A line's number is a 128-bit name of its content. The array holds the suffixes of the documents' sequences of lines that
share their first min_lines lines with another suffix; the others share too little with any to matter, and go at once.
Suffixes are ordered by their blocks of min_lines lines, a block by the order of its name: a rank is the place of a group
of suffixes with a common prefix, from one sort by range over the groups. Each round orders by twice the prefix: the rank
of a suffix, then the rank of the suffix that many lines further on. A suffix that shares that much with no other is a
leaf and leaves; rounds end when no rank is shared any more, so their number is the logarithm of the longest repeat.

Suffixes of one rank are an interval whose longest common prefix is the prefix of that round at least. The first round's
are all intervals of at least min_lines common lines, the later ones lie within them and delete nothing more: the first
of an interval in order of (id, line) stays, the lines of every other are marked, and marked lines that touch are one
maximal repeated run. The later rounds give `shared_lines`: how much a suffix of the document has in common with another.

A null text counts as empty; an empty text is one empty line. Rows that repeat an id and a text are one document, whose
lines coincide and stay; rows of one id with different texts are documents of their own, in the order of a hash of the
text. Rows with a null id stay whole and count nowhere. An empty table gives an empty result. Other columns pass through
strip_repeated_lines() untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.storage import in_order

from ._common import drop_written, fresh, join_counted, text_or_empty, written

MIN_LINES = 3


def _lines(text: str) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def _key(id_col: str, text: str) -> Column:
    """A document: rows of one id are the same one only if their texts are."""
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_or_empty(text)).alias("text"))


def _blocks(docs: DataFrame, id_col: str, text: str, min_lines: int) -> DataFrame:
    """(id, at, r1, r2): the name of each min_lines lines in a row."""
    names = F.transform(_lines(text), lambda line: F.struct(F.xxhash64(line), F.xxhash64(F.lit(7), line)))

    def named(block: Column) -> Column:
        return F.struct(F.xxhash64(block).alias("r1"), F.xxhash64(F.lit(min_lines), block).alias("r2"))

    def blocks(names: Column) -> Column:
        return F.when(F.size(names) >= min_lines, F.transform(F.sequence(F.lit(1), F.size(names) - (min_lines - 1)), lambda i: named(F.slice(names, i, min_lines))))

    # bound as a variable, so that lines are named once
    each = F.posexplode(F.transform(F.array(names), blocks)[0]).alias("at", "block")
    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(_key(id_col, text).alias("id"), each).select("id", "at", "block.r1", "block.r2")


def _ranked(rows: DataFrame, key: list[str], twice: bool = False) -> DataFrame:
    """(id, at, rank) of the rows whose key another row has, rank the key's place among them; rows: a written table.

    twice: a document's rows may be there more than once.
    """
    placed = in_order(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key, "place", label="placed")
    shared = join_counted(rows, placed, key).select("id", "at", F.col("place").alias("rank"))
    out = written(shared.dropDuplicates(["id", "at"]) if twice else shared, "ranks")
    drop_written(placed)
    return out


def _further(rows: DataFrame, step: int) -> DataFrame:
    """(id, at, rank, ahead): ranks with those step lines further on."""
    return rows.join(rows.select("id", (F.col("at") - step).alias("at"), F.col("rank").alias("ahead")), ["id", "at"])


def suffix_intervals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """(lines in common, (id, at, rank)) of each round: its suffixes by document and line, those of one rank an interval.

    Ranks are in the order of suffixes. The tables are written; drop_written() removes them.
    """
    blocks = written(_blocks(docs, id_col, text, min_lines), "lines")
    rounds, size = [], min_lines
    rows = _ranked(blocks, ["r1", "r2"], twice=True)
    drop_written(blocks)
    while not rows.isEmpty():
        rounds.append((size, rows))
        longer = written(_further(rows, size), "longer")
        rows = _ranked(longer, ["rank", "ahead"])
        drop_written(longer)
        size *= 2
    drop_written(rows)
    return rounds


def _runs(rows: DataFrame, min_lines: int) -> DataFrame:
    """(id, first, last): the maximal runs of lines that the suffixes behind the first of an interval cover."""
    first = written(rows.groupBy("rank").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")), "first")
    copies = join_counted(rows, first, ["rank"]).where(F.struct("id", "at") != F.col("first")).select("id", "at")
    starts = copies.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    # starts at most min_lines apart touch: they belong to one run
    gaps = F.filter(
        F.arrays_zip(F.col("starts").alias("a"), F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))).alias("b")),
        lambda z: z["b"].isNull() | (z["b"] - z["a"] > min_lines),
    )
    runs = starts.select("id", "starts", gaps.alias("gaps")).select(
        "id",
        F.explode(
            F.arrays_zip(
                F.concat(F.slice("starts", 1, 1), F.filter(F.transform("gaps", lambda z: z["b"]), lambda b: b.isNotNull())).alias("first"),
                F.transform("gaps", lambda z: z["a"] + (min_lines - 1)).alias("last"),
            )
        ).alias("run"),
    )
    return runs.select("id", "run.first", "run.last")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(id, runs, shared_lines) of documents that have a repeat: runs (first, last) of lines from 0 that repeat earlier ones."""
    rounds = suffix_intervals(docs, id_col, text, min_lines)
    if not rounds:
        id_type = docs.select(_key(id_col, text).alias("id")).schema["id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"id {id_type}, runs array<struct<first:int,last:int>>, shared_lines int")
    run = F.struct("first", "last")
    none = F.lit(None).cast("struct<first:int,last:int>")
    parts = [_runs(rounds[0][1], min_lines).select("id", run.alias("run"), F.lit(0).alias("shared"))]
    parts += [rows.groupBy("id").agg(F.lit(size).alias("shared")).select("id", none.alias("run"), "shared") for size, rows in rounds]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    out = written(both.groupBy("id").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.max("shared").alias("shared_lines")), "repeats")
    for _, rows in rounds:
        drop_written(rows)
    return out


def strip_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> tuple[DataFrame, str]:
    """(docs with its text stripped and one struct column more, that column's name).

    The struct has n_lines, n_removed, n_runs, longest_run and shared_lines: what a suffix of the document has in common
    with another, in doublings of min_lines, 0 if less than that. A text of which nothing is removed stays as it is.
    """
    name = fresh("line_dedup", docs.columns)
    found = repeats(docs, id_col, text, min_lines).select(F.col("id").alias(f"{name}_id"), F.col("runs").alias(f"{name}_runs"), F.col("shared_lines").alias(f"{name}_shared"))
    same = (F.col(f"`{id_col}`") == F.col(f"{name}_id.id")) & (F.xxhash64(text_or_empty(text)) == F.col(f"{name}_id.text"))
    joined = docs.join(found.hint("merge"), same, "left")  # one way at every size: the table of repeats grows with docs
    runs_col = F.col(f"{name}_runs")
    lines = F.col(f"{name}_lines")

    # the stretches between the runs, from 1, with their lengths
    befores = F.concat(F.array(F.lit(-1)), F.transform(runs_col, lambda r: r["last"]))
    afters = F.concat(F.transform(runs_col, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(befores.alias("b"), afters.alias("a")), lambda z: F.slice(lines, z["b"] + 2, z["a"] - z["b"] - 1)))
    lengths = F.transform(runs_col, lambda r: r["last"] - r["first"] + 1)
    stats = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(lengths, F.lit(0), lambda s, n: s + n), F.lit(0)).cast("long").alias("n_removed"),
        F.greatest(F.size(runs_col), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce(F.col(f"{name}_shared"), F.lit(0)).cast("long").alias("shared_lines"),
    )
    stripped = F.when(F.size(runs_col) > 0, F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    full = joined.withColumn(f"{name}_lines", _lines(text)).withColumn(name, stats)
    columns = [stripped.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return full.select(*columns, name), name


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with its text stripped; documents of which no line is left are dropped."""
    out, name = strip_repeated_lines(docs, id_col, text, min_lines)
    return out.where(F.col(name)["n_removed"] < F.col(name)["n_lines"]).drop(name)
