"""Mixing sources to target weights: blocks of equal numbers of words, apportioned by Sainte-Laguë's highest quotients.

1. Sources in order of code point, null last, weigh 1, 2, 3, repeating (`weights`), and share all words. A target stops at
   LIMIT times its source's words and the excess is shared anew by weight, until none is above.
2. The documents of a source, in order of id and size, are one stream of words, cut into blocks of `block` words (the last
   may be shorter) and into shards of `per_shard` blocks. As many blocks as all words make are seats; source i with target
   t gets a seat for each of the highest quotients t / (2 s + 1), s = 0, 1, 2 ..., of equal ones the earlier source first,
   at most LIMIT seats a block.
3. A source's seats go to its shards in the same way, with their numbers of blocks as votes. All shards but the last are
   equal, so the quota of each follows from two numbers of the source (`shard_quotas`).
4. A shard with n blocks and a quota of q takes every block q // n times and q % n of them once more: those with the smallest
   md5 of `seed:source:block`. That needs no data, so a document is only told its place in the stream and finds out what
   is taken of it. A quota is at most LIMIT times n, so no block is taken more often.

Places come from one sort by range with an offset a partition, so a source of any size is spread over tasks. Sources are a
table too: the search for the least quotient with a seat halves an interval of doubles 64 ways at once, each time by one row
of sums; what ties at its end is ranked by a sort. Only such sums reach the driver. Sources whose table is small by Spark's
own statistics are broadcast, otherwise joined by merge.

Edge cases: a null text or one without words has size 0 and nothing is taken. Rows of one id, source and size are
interchangeable; null ids are a document each like others. Without words there are no seats and targets are 0. Empty tables
give an empty result. Columns of docs other than those named aren't returned by `mix`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gallerist.storage import in_order

from ._common import written

WEIGHTS = (1, 2, 3)
#: How often a word is taken at most.
LIMIT = 3
BLOCK = 128
PER_SHARD = 4096
#: Ways that a pass of the search for a quotient divides its interval.
WAYS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sources (source, source_size) with place, weight and target."""
    ranked = in_order(sources, [F.asc_nulls_last("source")], "place", label="sources")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1))
    most = F.lit(limit).cast("decimal(38,0)") * F.col("source_size")
    full = F.lit(False)
    while True:
        # shares of those not full grow from round to round, so whoever is full stays full
        got = ranked.agg(
            F.sum(F.col("source_size").cast("decimal(38,0)")).alias("all"), F.sum(F.when(full, most)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("shares"), F.count(F.when(full, 1)).alias("full")
        ).first()
        rest, shares = int(got["all"] or 0) - int(got["given"] or 0), int(got["shares"] or 0)
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(shares, 1)))
        above = full | (share > most.cast("double"))
        if ranked.where(above).count() == got["full"]:
            break
        full = above
    return ranked.withColumn("target", F.when(full, most.cast("double")).otherwise(share))


def _seats(votes: Column, most: Column, quotient: Column) -> Column:
    """How many of votes / 1, votes / 3, votes / 5 ... are at least quotient, most at most."""
    return F.least(most, F.floor((votes / quotient + 1) / 2))


def _given(parties: DataFrame, votes: Column, most: Column, cuts: list[float]) -> list[int]:
    """The seats that all parties have at each of some quotients: one number a cut reaches the driver."""
    at = parties.select(votes.alias("votes"), most.alias("most"), F.posexplode(F.array(*[F.lit(x) for x in cuts])).alias("i", "cut"))
    got = at.groupBy("i").agg(F.sum(_seats(F.col("votes"), F.col("most"), F.col("cut"))).alias("n")).collect()
    return [r["n"] for r in sorted(got, key=lambda r: r["i"])]


def apportion(parties: DataFrame, seats: int, votes: str, most: str, order: str) -> DataFrame:
    """parties, a written table, with seats: the highest quotients votes / (2 s + 1) get one each, of equals the first in order."""
    v, m = F.col(votes), F.col(most).cast("long")
    low, high = 0.0, float(parties.agg(F.max(v)).first()[0] or 0.0)
    if not seats or not high:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low, high = high / 2.0**64, high * 2  # nobody has a seat at high
    if _given(parties, v, m, [low])[0] < seats:
        return parties.withColumn("seats", _seats(v, m, F.lit(low)))  # all that may be given
    while True:
        # geometric steps: quotients span many orders of magnitude
        cuts = sorted({x for x in (low * (high / low) ** (i / WAYS) for i in range(1, WAYS)) if low < x < high})
        if not cuts:
            break
        got = _given(parties, v, m, cuts)
        enough = [x for x, n in zip(cuts, got, strict=True) if n >= seats]
        low, high = max([low, *enough]), min([high, *[x for x, n in zip(cuts, got, strict=True) if n < seats]])
    base = written(parties.withColumn("seats", _seats(v, m, F.lit(high))), "seats")
    left = seats - int(base.agg(F.sum("seats")).first()[0])
    wants = written(base.where(F.col("seats") < _seats(v, m, F.lit(low))).select(order, (v / (2 * F.col("seats") + 1)).alias("quotient")), "wants")
    more = in_order(wants, [F.desc("quotient"), F.asc(order)], "before", label="ties").where(F.col("before") < left).select(order, F.lit(1).alias("one_more"))
    return base.join(more, order, "left").withColumn("seats", F.col("seats") + F.coalesce("one_more", F.lit(0))).drop("one_more")


def shard_quotas(n_blocks: int, seats: int, per_shard: int) -> tuple[int, int, int]:
    """(k, more, last): of a source's whole shards each gets k seats and the first `more` of them one more; the shorter last shard gets `last`.

    Whole shards have the same votes, so their quotients per_shard / (2 k + 1) come all at once. Before the round with that
    quotient the last shard, of r blocks, has a seat for every j with r / (2 j + 1) above it.
    """
    whole, r = divmod(n_blocks, per_shard)
    if not whole:
        return 0, 0, seats
    ahead = lambda k: -((per_shard - r * (2 * k + 1)) // (2 * per_shard)) if r * (2 * k + 1) > per_shard else 0
    low, high = 0, seats // whole + 1
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if whole * k + ahead(k) <= seats else (low, k)
    return low, seats - whole * low - ahead(low), ahead(low)


def times(seed: int, place: int, first: int, n: int, quota: int) -> np.ndarray:
    """How often each of a shard's n blocks, the first of which is number `first` of its source, is taken."""
    out = np.full(n, quota // n, np.int64)
    more = quota % n
    if more:
        keys = [hashlib.md5(f"{seed}:{place}:{b}".encode()).digest() for b in range(first, first + n)]
        out[sorted(range(n), key=keys.__getitem__)[:more]] += 1
    return out


def _takes(place: int, start: int, size: int, total: int, seats: int, block: int, per_shard: int, seed: int, held: dict) -> list[tuple[int, int, int]]:
    """(first word, words, times) of a document's runs that are taken; start is its place in its source's stream of total words."""
    n_blocks = -(-total // block)
    k, more, last = shard_quotas(n_blocks, seats, per_shard)
    runs: list[tuple[int, int, int]] = []
    for shard in range(start // (block * per_shard), (start + size - 1) // (block * per_shard) + 1) if size else ():
        first = shard * per_shard
        if held.get("at") != (place, shard):
            n = min(per_shard, n_blocks - first)
            held |= {"at": (place, shard), "times": times(seed, place, first, n, (k + (shard < more)) if n == per_shard else last)}
        taken = held["times"]
        b, stop = max(start // block, first), min((start + size - 1) // block, first + len(taken) - 1)
        while b <= stop:
            end = b
            while end < stop and taken[end + 1 - first] == taken[b - first]:
                end += 1
            if taken[b - first]:
                at = max(start, b * block)
                runs.append((at - start, min(start + size, (end + 1) * block) - at, int(taken[b - first])))
            b = end + 1
    return runs


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, runs) of every document; runs: (start, length, times), in words, of what is taken."""
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aimed = written(targets(sources, weights, limit), "targets")
    words = int(sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    blocks = F.ceil(F.col("source_size") / block)
    given = written(apportion(written(aimed.withColumn("most", blocks * limit), "parties"), (2 * words + block) // (2 * block), "target", "most", "place"), "given")
    placed = in_order(sized, [F.asc_nulls_last("source"), F.asc_nulls_last("id"), F.asc("size")], "before", "size", "stream")
    # where a source begins in the order of all
    given = in_order(given, [F.asc("place")], "first", "source_size", "begins").withColumnRenamed("source", "of")
    rows = placed.join(given, placed["source"].eqNullSafe(given["of"]))
    rows = rows.select("id", "source", "size", "source_size", "target", "place", (F.col("before") - F.col("first")).alias("start"), "seats")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("times", pa.int64())]))
        for batch in batches:
            place, start, size, total, seats = (batch[c].to_pylist() for c in ("place", "start", "size", "source_size", "seats"))
            found = [_takes(*x, block, per_shard, seed, held) for x in zip(place, start, size, total, seats, strict=True)]
            taken = pa.array([sum(n * t for _, n, t in runs) for runs in found], pa.int64())
            named = pa.array([[{"start": a, "length": n, "times": t} for a, n, t in runs] for runs in found], struct)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "source", "size", "source_size", "target")], taken, named], names=["id", "source", "size", "source_size", "target", "taken", "runs"])

    out = rows.sortWithinPartitions("place", "start").mapInArrow(run, f"id {kind}, source string, size long, source_size long, target double, taken long, runs array<struct<start: long, length: long, times: long>>")
    return out.withColumnsRenamed({"id": id_col, "source": source_col})
