"""Centroid clustering, importance resampling and source mixing against brute force, definitions and SQL."""

import hashlib
import heapq
import math
import os
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gallerist.llm import centroids, mixing, resampling

SF = "/root/testdata/sf0.001"
smallest = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, source string"


def same_rows(got, want):
    plain = lambda v: "NULL" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    key = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
    assert key(got) == key(want)


@smallest
@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_importance_resampling", "op13_source_mixing"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    same_rows([tuple(r) for r in got.select(*want.columns).collect()], want.fetchall())


# --- clusters -----------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, seed, scale=64):
    """The definition: all distances, in whole numbers of any size."""
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in vectors:
            d, j = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
            out.append((i, j, d, v))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, j, _, v in assign():
            members[j].append(v)
        for j, own in members.items():
            at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), at


def clustered(rows, k, rounds, seed):
    found, at = lloyd(rows, k, rounds, seed)
    inertia = Counter()
    for _, j, d, _ in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d, _ in found]


@pytest.mark.parametrize("size", [64, 13])
def test_clusters_of_awkward_vectors(spark, size):
    r = np.random.default_rng(3)
    middles = r.normal(0, 2, (5, size))
    rows = [(i, [float(x) for x in (middles[i % 5] + r.normal(0, 0.3, size)).astype(np.float32)]) for i in range(240)]
    rows += [(500 + i, rows[3][1]) for i in range(90)]  # equal vectors, many of them
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, [0.0] * size), (901, [1.0 / 128] * size), (902, [-1.0 / 128] * size)]
    odd = [(1000, None), (1001, []), (1002, rows[0][1][:-1]), (1003, [None, *rows[0][1][1:]]), (1004, [math.nan, *rows[0][1][1:]]), (1005, [math.inf, *rows[0][1][1:]])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("id", "vector", "cluster", "norms", "distance")})
    got = centroids.digest(df, k=16, rounds=3, seed=1, size=size)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same_rows([tuple(x) for x in got.collect()], clustered(rows, 16, 3, 1))


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [0.5, -0.25]), (2, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same_rows([tuple(x) for x in centroids.digest(df, size=2).collect()], clustered(rows, 16, 3, 1))
    assert centroids.digest(df, size=3).count() == 0
    assert centroids.digest(df.limit(0), size=2).columns[0] == "vec_id"


def test_too_wide_a_vector_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="don't fit into a long"):
        centroids.digest(df, size=2).collect()


def test_bounds_screen_centroids_and_lose_none():
    r = np.random.default_rng(5)
    at = r.integers(-900, 900, (40, 64))
    m = at[r.integers(0, 40, 3000)] + r.integers(-120, 120, (3000, 64))
    m[:10] = (at[1] + at[2]) // 2
    origin = at.sum(axis=0) // len(at)
    norms = centroids.segment_norms(m, origin)
    best, distance, made = centroids.nearest(m, norms, at, origin)
    d = ((m[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert made < 0.2 * d.size
    # the smaller of two equal centroids, also if it isn't looked at first
    twice = np.concatenate([at[5:6], at, at[5:6]])
    best = centroids.nearest(at[5:6], centroids.segment_norms(at[5:6], origin), twice, origin)[0]
    assert best[0] == 0


# --- resampling ---------------------------------------------------------------------------------------------------


def features(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def resampled(rows, target):
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(crc32(f.encode()) % 10_000 for f in features(t)[0])
    for t in target:
        wanted.update(crc32(f.encode()) % 10_000 for f in features(t)[0])
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000))))
    out, fit = [], []
    for i, text in rows:
        f, n = features(text)
        weight = sum(gain(crc32(x.encode()) % 10_000) for x in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            fit.append(out[-1])
    for rank, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0], r[1]))[: 5 * len(fit) // 100], 1):
        row[4] = rank
    return [tuple(r) for r in out]


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


WORDS = [*"the a of to in".split(), *(f"w{i}x" for i in range(200)), "Über", "naïve", "日本", "don't", "x-y", "A", "B1"]


def test_resampling_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 700)
    texts = [None, "", "  \n", "one", "ONE two", "one two three", "é" * 9, "a\x00b\x7fc", "-" * 50, "[]{}", prose(0, 4000, WORDS)]
    texts += [prose(i, 5 + i % 60, WORDS) for i in range(150)] + [prose(3, 40, WORDS)] * 12
    rows = list(enumerate(texts)) + [(60, texts[60]), (61, texts[99]), (None, texts[70])]
    target = [prose(f"t{i}", 30, WORDS[:60]) for i in range(8)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("id", "score", "weight", "rank", "before", "stream")})
    to = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(df, to)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same_rows([tuple(r) for r in got.collect()], resampled(rows, target))
    chosen = resampling.drawn(df, to)
    assert chosen.columns == df.columns and {r["doc_id"] for r in chosen.collect()} == {r[0] for r in resampled(rows, target) if r[4]}


def test_resampling_of_empty_tables(spark):
    some = spark.createDataFrame([(i, prose(i, 30, WORDS)) for i in range(40)], "doc_id long, text string")
    assert resampling.resample(some.limit(0), some).count() == 0
    same_rows([tuple(r) for r in resampling.resample(some, some.limit(0)).collect()], resampled([tuple(r) for r in some.collect()], []))


@pytest.mark.parametrize("span", [1, 7, 50])
def test_features_across_spans(monkeypatch, span):
    text = prose(1, 300, WORDS) + " " + "y" * 400 + "  " + prose(2, 3, WORDS)
    whole = Counter(resampling.buckets(text)[0].tolist())
    monkeypatch.setattr(resampling, "SPAN", span)
    found, n = resampling.buckets(text)
    assert Counter(found.tolist()) == whole == Counter(crc32(f.encode()) % 10_000 for f in features(text)[0]) and n == features(text)[1]


# --- mixing -------------------------------------------------------------------------------------------------------


def quotients(votes, most, seats):
    """The highest quotients, one after the other."""
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    heapq.heapify(heap)
    got = [0] * len(votes)
    while heap and seats:
        _, i, s = heapq.heappop(heap)
        got[i], seats = got[i] + 1, seats - 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-(votes[i] / (2 * s + 3)), i, s + 1))
    return got


def mixed(rows, block, per_shard, seed=42):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight, full, words = {s: p % 3 + 1 for p, s in enumerate(sources)}, set(), sum(total.values())
    while True:
        rest, shares = words - sum(3 * total[s] for s in full), sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and float(rest) * weight[s] / float(max(shares, 1)) > 3 * total[s]}
        if not more:
            break
        full |= more
    target = {s: float(3 * total[s]) if s in full else float(rest) * weight[s] / float(max(shares, 1)) for s in sources}
    blocks = [-(-total[s] // block) for s in sources]
    seats = quotients([target[s] for s in sources], [3 * b for b in blocks], (2 * words + block) // (2 * block))
    out = []
    for place, s in enumerate(sources):
        shards = [min(per_shard, blocks[place] - f) for f in range(0, blocks[place], per_shard)]
        times = []
        for shard, quota in enumerate(quotients(shards, [3 * n for n in shards], seats[place])):
            n, first = shards[shard], shard * per_shard
            order = sorted(range(first, first + n), key=lambda b: hashlib.md5(f"{seed}:{place}:{b}".encode()).hexdigest())
            own = dict.fromkeys(range(first, first + n), quota // n)
            for b in order[: quota % n]:
                own[b] += 1
            times += [own[b] for b in range(first, first + n)]
        at = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is None, r[0] or 0, size(r[1]))):
            out.append((i, size(t), total[s], target[s], sum(times[w // block] for w in range(at, at + size(t)))))
            at += size(t)
    return out


@pytest.mark.parametrize("block, per_shard", [(8, 5), (1, 3), (128, 4096)])
def test_mixing_of_awkward_documents(spark, block, per_shard):
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(0, 60), WORDS), f"s{i % 7}" if i % 3 else "s0") for i in range(160)]
    rows += [(200, None, "s1"), (201, "", None), (202, prose(5, 30, WORDS), None), (203, " \t\n\x0b\x0c\r ", "z"), (204, prose(6, 900, WORDS), "Ünï"), (205, "one", "\U0001f600"), (206, "one two", "￮")]
    rows += [rows[5], rows[5], (5, "another text of this id", rows[5][2]), (None, "no id", "s2"), (None, "none either", "s2")]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("id", "size", "place", "target", "before", "start", "taken", "seats", "of")})
    got = mixing.mix(df, block=block, per_shard=per_shard)
    same_rows([tuple(x) for x in got.select("doc_id", "size", "source_size", "target", "taken").collect()], mixed(rows, block, per_shard))
    for x in got.collect():
        assert x["taken"] == sum(y["length"] * y["times"] for y in x["runs"]) <= 3 * x["size"]
        assert all(0 <= y["start"] and y["start"] + y["length"] <= x["size"] and 1 <= y["times"] <= 3 for y in x["runs"])
    again = mixing.mix(df.repartition(2), block=block, per_shard=per_shard)
    same_rows([tuple(map(str, x)) for x in got.collect()], [tuple(map(str, x)) for x in again.collect()])


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(i, 100, WORDS), "abcdefgh"[min(7, int(random.Random(i).expovariate(0.7)))]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=32).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert len(got) == 8 and any(x["target"] == 3 * x["size"] for x in got)
    assert all(abs(x["taken"] - x["target"]) <= 3 * 32 for x in got)


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "a"), (2, "", "b")]
    same_rows([tuple(x)[:1] + tuple(x)[2:6] for x in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()], [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


@pytest.mark.parametrize("seed", range(4))
def test_seats_by_search_and_one_by_one(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    votes = [float(r.choice([0, 1, 5, 5, 5, 1000, r.randint(1, 10**9)])) for _ in range(n)]
    most = [r.choice([0, 1, 3, 50, 10**6]) for _ in range(n)]
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "place long, votes double, most long")
    for seats in (0, 1, n, 5 * n, 400):
        got = {x["place"]: x["seats"] for x in mixing.apportion(df, seats, "votes", "most", "place").collect()}
        assert [got[i] for i in range(n)] == quotients(votes, most, seats)


def test_quotas_of_shards_from_two_numbers():
    for n_blocks in range(1, 40):
        for per_shard in (1, 2, 3, 7, 64):
            shards = [min(per_shard, n_blocks - f) for f in range(0, n_blocks, per_shard)]
            for seats in range(3 * n_blocks + 1):
                k, more, last = mixing.shard_quotas(n_blocks, seats, per_shard)
                got = [k + (i < more) if n == per_shard else last for i, n in enumerate(shards)]
                assert got == quotients(shards, [3 * n for n in shards], seats), (n_blocks, per_shard, seats)


# --- rows without an id, or with one twice ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op7_token_counts", "op8_byte_bpe", "op9_certified_packing"])
def test_rows_without_an_id_or_with_one_twice(spark, tmp_path, name):
    pytest.importorskip("public_tokenizers")
    rows = [(1, "some words here", "s"), (1, "some words here", "s"), (1, "other words", "s"), (None, "some words here", "s"), (None, None, None), (2, "", "s")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    same = [r for r in got if r["doc_id"] in (1, None)]
    key = "length" if "op9" in name else "n_tokens"
    counts = Counter(r[key] for r in same)
    assert counts[min(r[key] for r in same)] == 1 and max(counts.values()) == 3  # the text that three rows share
