"""Plans of output trees: where each file goes, names without collisions, what to copy and what to remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.storage import in_order, written


def review_tree_plan(entries: DataFrame, members: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """(rel_dir, original): flagged files by category and month, and groups with their keeper apart.

    entries as of review_entries(), members as of group_members(); include: top folders to build, all if empty.
    """
    kind = X.category(F.col("flag_type"), F.col("confidence"))
    flagged = entries.select(F.concat_ws("/", kind, F.col("year_month")).alias("rel_dir"), F.col("path").alias("original"), kind.alias("kind")).where("kind IS NOT NULL").drop("kind")
    name = F.format_string("duplicates/group_%05d_%s", F.col("group_id"), F.col("group_date"))
    grouped = members.select(F.concat(name, F.when(F.col("is_first"), "/_keeper").otherwise("/_others")).alias("rel_dir"), F.col("path").alias("original"))
    plan = flagged.unionByName(grouped)
    return plan.where(F.split("rel_dir", "/")[0].isin(*include)) if include else plan


def keepers_plan(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("year_month").alias("rel_dir"), F.col("path").alias("original"))


def _head_and_tail(name: Column) -> tuple[Column, Column]:
    """A name before and from its last dot; a dot in front doesn't count."""
    head = F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 1)
    return F.when(head == "", name).otherwise(head), F.when(head == "", "").otherwise(F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 2))


def _numbered_from(base: Column) -> tuple[Column, Column]:
    """The name that base would be a number of, and the number: x (3).jpg is 3 of x.jpg; null if it is none."""
    head, tail = _head_and_tail(base)
    pattern = r"(?s)^(.+) \(([2-9]|[1-9]\d{1,17})\)$"
    return F.when(head.rlike(pattern), F.concat(F.regexp_extract(head, pattern, 1), tail)), F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 2).cast("long"))


def _kept_names(children: DataFrame) -> DataFrame:
    """(rel_dir, base, parent, kept, free) of base names that are numbers of other base names in their folder.

    Whoever comes first has a name: the first file of `x (3).jpg`, or the file of `x.jpg` whose turn number 3 is. That is
    file 3 - 1 - r of those that need a number, if r smaller numbers are kept by their own files, so it is told from `earlier`,
    how many files of x.jpg come before, going through the numbers of a name upwards with r as the only state. A name that
    lost its own makes its first file one more that needs a number. free: how many smaller numbers are left for others.
    The rows are base names, not files: a name that a million files share is a row.
    """

    def run(batches):
        import pyarrow as pa

        family, lost, of, r = None, set(), None, 0
        for batch in batches:
            kept, free = [], []
            for row in zip(*(batch[c].to_pylist() for c in ("rel_dir", "root", "base", "parent", "k", "earlier")), strict=True):
                rel_dir, root, base, parent, k, earlier = row
                if (rel_dir, root) != family:
                    family, lost, of = (rel_dir, root), set(), None
                if parent != of:
                    of, r = parent, 0
                left = k - 2 - r
                mine = left >= earlier - (parent not in lost)
                kept.append(mine)
                free.append(left)
                if mine:
                    r += 1
                else:
                    lost.add(base)
            yield pa.RecordBatch.from_arrays([batch["rel_dir"], batch["base"], batch["parent"], pa.array(kept, pa.bool_()), pa.array(free, pa.int64())], names=["rel_dir", "base", "parent", "kept", "free"])

    head, tail = _head_and_tail(F.col("base"))
    root = F.concat(F.regexp_replace(head, r"( \(([2-9]|[1-9]\d{1,17})\))+$", ""), tail)
    depth = F.length(head) - F.length(F.regexp_replace(head, r" (?=\(\d+\))", ""))
    dealt = children.withColumn("root", root).withColumn("depth", depth).repartition("rel_dir", "root").sortWithinPartitions("rel_dir", "root", "depth", "parent", "k")
    return dealt.mapInArrow(run, "rel_dir string, base string, parent string, kept boolean, free long")


def unique_names(plan: DataFrame) -> DataFrame:
    """(rel_dir, original, name): base names made unique in each folder, in order of path: the first stays, then name (2), name (3).

    A number that another file's own name has taken is left out, as if names were given out one after the other. A file's
    place among those of its base name comes from one sort by range, so a name that is met a million times in a folder is spread
    over tasks; its number is its place among the numbers not taken, which another such sort counts.
    """
    rows = written(plan.select("rel_dir", "original").distinct().withColumn("base", X.basename(F.col("original"))), "names")
    placed = in_order(rows, ["rel_dir", "base", "original"], "place")
    bases = placed.groupBy("rel_dir", "base").agg(F.min("place").alias("first"), F.min("original").alias("arrives"))
    parent, k = _numbered_from(F.col("base"))
    named = bases.select("rel_dir", "base", "arrives", parent.alias("parent"), k.alias("k")).where("parent IS NOT NULL")
    children = written(named.join(bases.select("rel_dir", F.col("base").alias("parent"), F.col("first").alias("parent_first")), ["rel_dir", "parent"]), "numbered")
    at = F.col("place") - F.col("first")  # how many files of the name come before
    files = placed.join(bases.select("rel_dir", "base", "first").hint("merge"), ["rel_dir", "base"])
    if children.limit(1).count():
        asked = children.select("rel_dir", F.col("parent").alias("base"), F.col("arrives").alias("original"), F.col("base").alias("child"), F.lit(0).alias("n"))
        among = written(placed.select("rel_dir", "base", "original", F.lit(None).cast("string").alias("child"), F.lit(1).alias("n")).unionByName(asked), "arrivals")
        before = in_order(among, ["rel_dir", "base", "original"], "before", "n").where("child IS NOT NULL").select("rel_dir", F.col("child").alias("base"), "before")
        earlier = children.join(before, ["rel_dir", "base"]).withColumn("earlier", F.col("before") - F.col("parent_first"))
        told = written(_kept_names(earlier), "kept")
        lost = told.where("NOT kept").select("rel_dir", "base", F.lit(1).alias("lost"))
        files = files.join(lost, ["rel_dir", "base"], "left").withColumn("turn", at + F.coalesce("lost", F.lit(0)))
        # taken numbers among a name's: those with fewer free numbers below them than the file's turn
        taken = told.where("kept").select("rel_dir", F.col("parent").alias("base"), F.col("free").alias("turn"), F.lit(None).cast("string").alias("original"), F.lit(1).alias("n"))
        among = written(files.select("rel_dir", "base", "turn", "original", F.lit(0).alias("n")).unionByName(taken), "turns")
        counted = in_order(among, [F.asc("rel_dir"), F.asc("base"), F.asc("turn"), F.desc_nulls_last("original")], "before", "n")
        below = counted.groupBy("rel_dir", "base").agg(F.min("before").alias("none"))
        files = counted.where("original IS NOT NULL").join(below, ["rel_dir", "base"]).withColumn("number", F.col("turn") + 1 + F.col("before") - F.col("none"))
    else:
        files = files.withColumn("turn", at).withColumn("number", at + 1)
    head, tail = _head_and_tail(F.col("base"))
    name = F.when(F.col("turn") == 0, F.col("base")).otherwise(F.concat(head, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), tail))
    return files.select("rel_dir", "original", name.alias("name"))


def copies_needed(plan: DataFrame, sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of a named plan whose copy is missing, of another size, or older than its source.

    sources: (path, size_bytes, mtime_ns); listing: (rel_path, size_bytes, mtime_ns) of what is there.
    """
    there = listing.select("rel_path", F.col("size_bytes").alias("there_bytes"), F.col("mtime_ns").alias("there_ns"))
    src = sources.select(F.col("path").alias("original"), "size_bytes", "mtime_ns")
    rows = plan.withColumn("rel_path", F.concat_ws("/", "rel_dir", "name")).join(src, "original").join(there, "rel_path", "left")
    stale = F.col("there_bytes").isNull() | (F.col("there_bytes") != F.col("size_bytes")) | (F.col("mtime_ns") > F.col("there_ns"))
    return rows.where(stale).select("rel_path", "original", "size_bytes")


def copy_estimate(needed: DataFrame) -> DataFrame:
    return needed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def stale_copies(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths that are there and not expected; both with rel_path."""
    return listing.select("rel_path").distinct().join(expected.select("rel_path").hint("merge"), "rel_path", "left_anti")


def finished_paths(kept: DataFrame, by_month: bool = True, extension: str = ".jpg") -> DataFrame:
    """(file_id, rel_path) of finished files: month folder, unique stem, extension."""
    base = F.concat(F.regexp_replace(X.basename(F.col("path")), r"\.[^.]*$", ""), F.lit(extension))
    folder = F.col("year_month") if by_month else F.lit("")
    # the source's path keeps equal stems apart as originals
    plan = kept.select(folder.alias("rel_dir"), F.concat_ws("/", "path", base).alias("target"), "path", "file_id")
    named = unique_names(plan.select("rel_dir", F.col("target").alias("original")))
    out = plan.join(named.withColumnRenamed("original", "target").hint("merge"), ["rel_dir", "target"])
    return out.select("file_id", F.when(F.col("rel_dir") == "", F.col("name")).otherwise(F.concat_ws("/", "rel_dir", "name")).alias("rel_path"))
