"""Joins that built-in operators don't express at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.storage import drop_written, in_order, written


def missing_rows(left: DataFrame, right: DataFrame, left_key: str = "id", right_key: str = "file_id") -> DataFrame:
    """Rows of left that right has no row for: the work list of a step."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_anti")


def needs_processing(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a listing that aren't catalogued with the same path, time and size."""
    keys = ["path", "mtime_ns", "size_bytes"]
    return listing.join(files.select(*keys), keys, "left_anti")


def work_list(files: DataFrame, embeddings: DataFrame, iqa: DataFrame) -> DataFrame:
    """(id, path, want_embedding, want_iqa) of files that lack one or both."""
    has = lambda df, name: df.select(F.col("file_id").alias("id")).distinct().withColumn(name, F.lit(True))
    both = files.select("id", "path").join(has(embeddings, "e"), "id", "left").join(has(iqa, "q"), "id", "left")
    return both.select("id", "path", F.isnull("e").alias("want_embedding"), F.isnull("q").alias("want_iqa")).where("want_embedding OR want_iqa")


#: Rows of a block in order of time. A bucket with more isn't joined as a whole.
BLOCK = 2048
#: Rows up to which a block grows with what a window reaches, so that a row isn't sent to many blocks.
REACH = 16_384
#: Pairs of a task, about.
PAIRS = 1 << 22


def blocks_in_time(timed: DataFrame, key: str, at: str, window: int, block: int = BLOCK) -> DataFrame:
    """Rows of timed dealt to pairs of blocks (i, j), own being i or j: whatever is at most window apart meets in one pair.

    Rows are put in order of time by a sort by range and cut into blocks of equal size, so one instant that a million rows
    share makes some hundred blocks and not one. A block is paired with itself and with those after it that begin within
    window of its end; to another block only rows go that are near enough to its border. In the shared folder stay the rows in
    order and the pairs of blocks, which the result reads.
    """
    timed = written(timed, "timed")
    placed = in_order(timed, [at, key], "place").withColumn("own", F.floor(F.col("place") / block).cast("int")).drop("place")
    drop_written(timed)
    spans = written(placed.groupBy("own").agg(F.min(at).alias("low"), F.max(at).alias("high")), "spans")
    # how many blocks begin before a block's end and window are past: one merge of beginnings and ends in order
    marks = spans.select(F.col("low").alias("value"), F.lit(None).cast("int").alias("i"), F.lit(1).alias("n"))
    marks = written(marks.unionByName(spans.select((F.col("high") + window).alias("value"), F.col("own").alias("i"), F.lit(0).alias("n"))), "marks")
    merged = in_order(marks, [F.asc("value"), F.desc("n")], "upto", "n")
    reach = merged.where("i IS NOT NULL")
    pairs = reach.select("i", F.explode(F.sequence("i", (F.col("upto") - 1).cast("int"))).alias("j"), (F.col("value") - window).alias("high"))
    pairs = written(pairs.join(spans.select(F.col("own").alias("j"), "low"), "j"), "pairs")
    for done in (marks, merged, spans):
        drop_written(done)
    left = placed.join(pairs.select("i", "j", "low"), F.col("own") == F.col("i")).where(F.col(at) >= F.col("low") - window).drop("low")
    right = placed.join(pairs.where("i < j").select("i", "j", "high"), F.col("own") == F.col("j")).where(F.col(at) <= F.col("high") + window).drop("high")
    return left.unionByName(right)


def interval_pairs(df: DataFrame, key: str, at: str, window: int, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of rows whose times are at most window apart, the smaller key first: (a_key, b_key, apart, and kept columns).

    Each row is in the bucket of its time; one side is also matched with the bucket after it, so this is an equality join on a
    bucket with a residual test, and never a nested loop. If a bucket has more than block rows, rows are cut into
    blocks by their order in time instead (blocks_in_time), with the same result. Blocks have block rows or, if more, as many as
    the fullest bucket, up to REACH: a window then reaches few blocks, and a row is sent to these few.
    """
    keep = keep or []
    width = max(int(window), 1)
    timed = df.where(F.col(at).isNotNull()).select(key, at, *keep)
    bucket = F.floor(F.col(at) / F.lit(width))
    named = lambda side: [F.col(key).alias(f"{side}_{key}"), F.col(at).alias(f"{side}_at"), *[F.col(c).alias(f"{side}_{c}") for c in keep]]
    first = F.col(f"a_{key}") < F.col(f"b_{key}")
    apart = F.abs(F.col("a_at") - F.col("b_at"))
    most, n = (x or 0 for x in timed.groupBy(bucket).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    # far more leaves a task than it reads, so tasks are as many as the pairs ask for and not as the bytes do
    tasks = min(20_000, max(df.sparkSession.sparkContext.defaultParallelism, n * most // PAIRS))
    # of different buckets or blocks each pair is met once, in the order of time; in one twice
    once = first | (F.col("before") & (F.col(f"a_{key}") != F.col(f"b_{key}")))
    if most <= block:
        on = ["__bucket"]
        left = timed.select(*named("a"), F.explode(F.array(bucket, bucket + 1)).alias("__bucket")).withColumn("before", F.floor(F.col("a_at") / F.lit(width)) < F.col("__bucket"))
        right = timed.select(*named("b"), bucket.alias("__bucket"))
    else:
        on, block = ["i", "j"], max(block, min(most, REACH))
        dealt = blocks_in_time(timed, key, at, window, block)
        left = dealt.where("own = i").select("i", "j", (F.col("i") < F.col("j")).alias("before"), *named("a"))
        right = dealt.where("own = j").select("i", "j", *named("b"))
    met = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on).where(once & (apart <= window))
    turned = lambda side, other, c: F.when(first, F.col(f"{side}_{c}")).otherwise(F.col(f"{other}_{c}")).alias(f"{side}_{c}")
    pairs = met.select(*[turned(*sides, c) for c in dict.fromkeys([key, "at", *keep]) for sides in ("ab", "ba")])
    return pairs.withColumn("apart", apart).select(f"a_{key}", f"b_{key}", *[f"{s}_{c}" for c in keep for s in "ab"], "apart")


def with_baseline(rows: DataFrame, baselines: DataFrame, min_samples: int) -> DataFrame:
    """rows (with camera_model, lens_model, focal_bucket, aperture_index) and p10, p90 of their own bucket, else of all.

    The row over all files has camera and lens '*'. Baselines are one row a bucket; Spark broadcasts them if they are
    small by its own statistics, and joins by key otherwise.
    """
    own = baselines.where((F.col("camera_model") != "*") & (F.col("n_samples") >= min_samples))
    own = own.select("camera_model", "lens_model", "focal_bucket", "aperture_index", F.col("s_subject_p10").alias("own_p10"), F.col("s_subject_p90").alias("own_p90"))
    everyone = baselines.where(F.col("camera_model") == "*").select(F.col("s_subject_p10").alias("all_p10"), F.col("s_subject_p90").alias("all_p90")).limit(1)
    joined = rows.join(own, ["camera_model", "lens_model", "focal_bucket", "aperture_index"], "left").join(F.broadcast(everyone), F.lit(True), "left")
    spans = (F.col("own_p90") - F.col("own_p10")) > X.FLOAT_EPSILON
    return joined.select(
        *[F.col(c) for c in rows.columns],
        F.coalesce("own_p10", "all_p10").alias("p10"),
        F.when(spans, F.col("own_p10")).otherwise(F.col("all_p10")).alias("span_p10"),
        F.when(spans, F.col("own_p90")).otherwise(F.col("all_p90")).alias("span_p90"),
        F.when(F.col("own_p10").isNotNull(), "bucket").when(F.col("all_p10").isNotNull(), "global").alias("source"),
    )


def optional(predicate: Column | None) -> Column:
    """The predicate, or true where there is none."""
    return F.lit(True) if predicate is None else predicate
