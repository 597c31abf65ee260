"""Language-model scores by prediction by partial matching over bytes, pretrained on one part of the corpus.

Gathering: every training text, closed by a mark that no UTF-8 text holds, adds its (ORDER + 1)-byte strings and its
words to counts over the whole corpus. The byte strings give the trie of contexts of 0 to ORDER bytes. All contexts are
kept, so the model grows with the training text.

Scoring: a byte is predicted by the longest context before it that was met; counts of shorter contexts tell in how many
longer ones a byte was met (update exclusion). The mass of escape is estimated from what each occurrence in a context
would have met had it been left out: contexts are classed by their last two bytes, length, total and number of symbols,
and a class with little evidence leans on method D (half an occurrence of each symbol). After an escape the symbols of the
longer context are excluded, down to all bytes alike. So each (ORDER + 1)-byte string has one code length. The strings of
all documents, those not learnt from too, are dealt by the two bytes before the last: a task then has every longer
context that it needs, whole groups at a time, and shorter ones are a table of 65,536 counts at most. The code lengths are
written; strings as frequent as MAX_GRAMS strings are get theirs in place, the others by a join, so none is left out.

Word counts for the add-one base score: words with a count of at least a threshold that MAX_WORDS words pass are looked
up in place, the others by a join, so none is left out. Words are known by a 64-bit hash.

Null and empty texts consist of the end alone. Repeated rows count and are scored each; rows of one id with different
texts are scored by their own, and rows with a null id are learnt from and come out with a null id. Without training rows
all contexts are empty: bytes are alike and no word is known. An empty table gives an empty result. Ties of frequency at a
bound fall on one side together. Only the id and the text are read, so other columns may have any names. A long text is
worked on whole, in some 20 times its size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from .shingles import lowered, word_hashes

ORDER = 6
MAX_GRAMS, MAX_WORDS = 1 << 20, 1 << 19  # of those looked up in place
HELD, HANDED = 2_500_000, 65_536  # counts that a task holds of each kind before it hands them on, and hands on at a time
LEAN = 16  # occurrences that method D counts for in a class of contexts
MARK = 0xFF
_END_WORD = -(1 << 62) + 1  # stands for the end among the hashes of words
_WORD, _GRAM = 0, 1


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte strings that end in each byte of each text and in its closing mark, as numbers, and where each text's begin."""
    pad = bytes([MARK]) * order
    data = np.frombuffer(pad + b"".join(t + bytes([MARK]) + pad for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = len(data) - order
    key = np.zeros(n, np.uint64)
    for k in range(order + 1):
        key = key << np.uint64(8) | data[k : k + n]
    skip = np.cumsum(sizes + order) - sizes - order
    keep = np.ones(n, bool)
    for k in range(order):
        keep[np.minimum(skip + sizes + k, n - 1)] = False
    if len(texts):
        keep[-order:] = False
        keep[skip[-1] + sizes[-1] - 1] = True
    return key[keep], np.cumsum(sizes) - sizes


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def gather(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(kind, key, n, places): counts of words (kind 0) and byte strings (kind 1) over the rows that are not held_out.

    Byte strings are counted over all rows too, as places; those of held-out rows alone have an n of 0.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        def rows(kind: int, learnt: bool, found) -> Iterator:
            for s in range(0, len(found[0]), HANDED):
                key, n = (x[s : s + HANDED] for x in found)
                columns = (np.full(len(key), kind, np.int32), key.view(np.int64), n if learnt else np.zeros(len(key), np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "places"])

        # (kind, learnt): counts so far, in order of key, and those not yet put among them
        held: dict[tuple[int, bool], list] = {}

        def put(kind: int, learnt: bool, new) -> Iterator:
            parts = held.setdefault((kind, learnt), [])
            parts.append(new)
            if sum(len(k) for k, _ in parts[1:]) > HELD // 4:
                parts[:] = [_tally(parts)]
                if len(parts[0][0]) > HELD:
                    yield from rows(kind, learnt, parts.pop())

        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            every = [lowered(x) for x in batch.column("text").to_pylist()]
            for learnt in (True, False):
                texts = [every[i] for i in np.flatnonzero(out != learnt).tolist()]
                if learnt:
                    yield from put(_WORD, True, (np.array([_END_WORD], np.int64).view(np.uint64), np.array([len(texts)])))
                s = 0
                while s < len(texts):
                    e, size = s, 0
                    while e < len(texts) and size < 1_000_000:
                        size += len(texts[e])
                        e += 1
                    yield from put(_GRAM, learnt, np.unique(_grams(texts[s:e], order)[0], return_counts=True))
                    if learnt:
                        yield from put(_WORD, True, np.unique(word_hashes(b"\n".join(texts[s:e]))[0], return_counts=True))
                    s = e
        for kind, learnt in list(held):
            parts = held.pop((kind, learnt))
            if parts:
                yield from rows(kind, learnt, parts[0] if len(parts) == 1 else _tally(parts))

    found = docs.select("held_out", F.col(text).alias("text")).mapInArrow(run, "kind int, key long, n long, places long")
    # what a task has counted is dealt as it is: a second count of it before the shuffle would hold much and merge nothing
    return found.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` rows reach. Counts fall in classes of a leading bit and the four bits after it."""
    bit = F.floor(F.log2(F.col("n").cast("double")))
    step = F.greatest(F.pow(F.lit(2.0), bit - 4), F.lit(1.0))
    floor = (F.floor(F.col("n") / step) * step).cast("long")
    classes = counts.select(floor.alias("least")).groupBy("least").agg(F.count("*").alias("rows")).orderBy(F.desc("least")).collect()
    total, least = 0, 1 << 62
    for r in classes:
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return int(least)


def _class(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A number below 1024 for contexts of about as many occurrences, of about as many symbols; small numbers exactly."""
    step = lambda x: np.where(x < 8, x, 8 + np.minimum(np.floor(2 * np.log2(np.maximum(x, 8) / 8)), 23)).astype(np.int64)
    return step(total) * 32 + step(kinds)


def _short_contexts(pairs: np.ndarray) -> np.ndarray:
    """(256, 256) probabilities of a byte after the one before it; pairs: in how many longer contexts each was met."""
    pairs = pairs.astype(np.float64)
    single = (pairs > 0).sum(axis=0).astype(np.float64)
    kinds, n = (single > 0).sum(), single.sum()
    none = np.where(single > 0, (single - 0.5) / n, kinds / 2 / n / max(256 - kinds, 1)) if n else np.full(256, 1 / 256)
    total, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = kinds / 2 / total
        left = 1 - ((pairs > 0) * none).sum(axis=1, keepdims=True)
        one = np.where(pairs > 0, (1 - escape) * pairs / total, escape * none / left)
    return np.where(total > 0, one, none)


def code_lengths(key: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of the last byte of each distinct string after the bytes before it.

    n: how often each was met in training; with a string, all that share the two bytes before its last must be here.
    pairs: (256, 256), byte before and byte: the number of bytes met before both in training.
    """
    entries, counts = {order: key.astype(np.int64)}, {order: n.astype(np.float64)}
    for k in range(order - 1, 1, -1):
        entries[k], at = np.unique(entries[k + 1] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts[k] = np.bincount(at, weights=counts[k + 1] > 0, minlength=len(entries[k]))
    out = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(2, order + 1):
            e, c = entries[k], counts[k]
            low = np.log10(_short_contexts(pairs)[e >> 8 & 255, e & 255]) if k == 2 else out[np.searchsorted(entries[k - 1], e & ((1 << 8 * k) - 1))]
            _, owner = np.unique(e >> 8, return_inverse=True)
            total, kinds = np.bincount(owner, weights=c)[owner], np.bincount(owner, weights=c > 0)[owner]
            # what the class of a context met when each of its occurrences was left out: the symbol was new, or known
            group = (e >> 8 & 0xFFFF) << 10
            classes, mine = np.unique(group | _class(total, kinds), return_inverse=True)

            def met(some: np.ndarray, after: np.ndarray, weight: np.ndarray, group=group, classes=classes) -> np.ndarray:
                at = np.minimum(np.searchsorted(classes, group[some] | after), len(classes) - 1)
                has = classes[at] == group[some] | after
                return np.bincount(at[has], weights=weight[has], minlength=len(classes))

            once, more = c == 1, c > 1
            new = met(once, _class(total[once] - 1, kinds[once] - 1), c[once])[mine]
            known = met(more, _class(total[more] - 1, kinds[more]), c[more])[mine]
            escape = (new + LEAN * kinds / 2 / total) / (new + known + LEAN)
            taken = np.bincount(owner, weights=np.where(c > 0, 10**low, 0))[owner]
            after_escape = np.log10(escape) + low - np.log10(np.maximum(1 - taken, 1e-9))
            out = np.where(total > 0, np.where(c > 0, np.log10((1 - escape) * c / total), after_escape), low)
    return out


def coded(grams: DataFrame, order: int = ORDER, at_once: int = 250_000) -> DataFrame:
    """(key, places, log_p) for every row of grams: (key, n, places); a task holds about at_once rows, or those of two bytes."""
    pairs = np.zeros((256, 256), np.int64)
    triples = grams.where("n > 0").select(F.col("key").bitwiseAND(0xFFFFFF).alias("triple")).distinct()
    last = triples.groupBy(F.col("triple").bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("n")).toArrow()
    pairs.ravel()[last["pair"].to_numpy()] = last["n"].to_numpy()
    model = grams.sparkSession.sparkContext.broadcast(pickle.dumps(pairs, protocol=5))

    def run(batches) -> Iterator:
        import pyarrow as pa

        table = pickle.loads(model.value)

        def lengths(t) -> Iterator:
            log_p = code_lengths(t["key"].to_numpy(), t["n"].to_numpy(), table, order)
            yield from pa.table({"key": t["key"], "places": t["places"], "log_p": pa.array(log_p)}).combine_chunks().to_batches(max_chunksize=100_000)

        held, size, enough = [], 0, at_once
        for batch in batches:
            if size >= enough:  # rows come sorted by pair: all but the last pair's are whole
                t = pa.Table.from_batches(held).combine_chunks()
                pair = t["pair"].to_numpy()
                cut = int(np.searchsorted(pair, pair[-1]))
                if cut:
                    yield from lengths(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
                enough = max(at_once, 2 * size)
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from lengths(pa.Table.from_batches(held).combine_chunks())

    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("pair")
    dealt = grams.select(pair, "key", "n", "places").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "key long, places long, log_p double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, max_grams: int = MAX_GRAMS, max_words: int = MAX_WORDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; held_out, over the column id, is not learnt from."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    source = source.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    counts = written(gather(source, order=order), "counts")
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("key") == _END_WORD, F.col("n"))).alias("ends")).first()
    train_tokens, distinct, end = int(totals["n"] or 0), int(totals["v"]), int(totals["ends"] or 0)
    grams = written(coded(counts.where(F.col("kind") == _GRAM), order), "grams")
    frequent = _threshold(grams.select(F.col("places").alias("n")), max_grams)
    often = grams.where(F.col("places") >= frequent).select("key", "log_p").toArrow()
    by = np.argsort(often["key"].to_numpy())
    gram_keys = often["key"].to_numpy().view(np.uint64)[by]
    gram_codes = often["log_p"].to_numpy()[by].astype(np.float32)

    least = _threshold(words, max_words)
    top = words.where(F.col("n") >= least).toArrow()
    by = np.argsort(top["key"].to_numpy().view(np.uint64))
    top_keys = top["key"].to_numpy().view(np.uint64)[by]
    top_counts = np.append(top["n"].to_numpy()[by], 0)
    model = spark.sparkContext.broadcast(pickle.dumps((gram_keys, gram_codes, top_keys, top_counts), protocol=5))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        strings, codes, keys, numbers = pickle.loads(model.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [lowered(x) for x in batch.column("text").to_pylist()]
            s = 0
            while s < len(texts):
                e, size = s, 0
                while e < len(texts) and size < 250_000:
                    size += len(texts[e])
                    e += 1
                part = texts[s:e]
                string, first = _grams(part, order)
                once, which = np.unique(string, return_inverse=True)
                at = np.minimum(np.searchsorted(strings, once), len(strings) - 1) if len(strings) else np.zeros(len(once), np.int64)
                held = strings[at] == once if len(strings) else np.zeros(len(once), bool)
                scores = np.add.reduceat((np.where(held, codes[at].astype(np.float64), 0.0) if len(strings) else np.zeros(len(once)))[which], first)
                other = np.flatnonzero(~held[which])
                other_cut = np.searchsorted(other, np.append(first, len(string))).astype(np.int32)
                hashes, starts = word_hashes(b"\n".join(part))
                owner = np.searchsorted(np.cumsum([0, *(len(x) + 1 for x in part)]), starts, side="right") - 1
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1) if len(keys) else np.zeros(len(hashes), np.int64)
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                n = np.where(hit, numbers[at], 0)
                tokens = np.bincount(owner, minlength=len(part)) + 1
                known = np.bincount(owner[hit], minlength=len(part)) + (end > 0)
                base = np.bincount(owner, weights=np.log10(n + 1.0), minlength=len(part)) + np.log10(end + 1.0)
                rest_owner = owner[~hit]
                cut = np.searchsorted(rest_owner, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(part))), batch.column("id").slice(s, e - s), batch.column("held_out").slice(s, e - s),
                        pa.array(tokens), pa.array(known), pa.array(base), pa.array(scores), pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[~hit].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(other_cut), pa.array(string[other].view(np.int64))),
                    ],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "rest", "others"],
                )
                row += len(part)
                s = e

    rows = written(source.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, others array<long>"), "scores")
    rare = rows.select("row", F.explode("rest").alias("key")).join(words.where(F.col("n") < least), "key")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("gain"))
    others = rows.select("row", F.explode("others").alias("key")).join(grams.where(F.col("places") < frequent).select("key", "log_p"), "key")
    others = others.groupBy("row").agg(F.sum("log_p").alias("others_score"))
    out = rows.drop("others").join(rare, "row", "left").join(others, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("others_score", F.lit(0.0))).alias("score"),
    )
    return out
