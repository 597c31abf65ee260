import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerist.functions import kernels, lut
from gallerist.operators import calibration, decisions, duplicates, graph, joins, output, review, vectors
from gallerist.operators.duplicates import DedupeConfig
from gallerist.sources import config, exif, listing
from gallerist.storage import shared_dir

EXIF = "file_id long, captured_at long, camera_model string, lens_model string, focal_length_mm double, aperture double, iso int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_interval_pairs(spark):
    df = spark.createDataFrame([(1, 0), (2, 60), (3, 61), (4, 130), (5, None), (6, -59)], "id long, t long")
    want = sorted((a, b, abs(x - y)) for a, x in [(1, 0), (2, 60), (3, 61), (4, 130), (6, -59)] for b, y in [(1, 0), (2, 60), (3, 61), (4, 130), (6, -59)] if a < b and abs(x - y) <= 60)
    assert rows(joins.interval_pairs(df, "id", "t", 60), "a_id", "b_id", "apart") == want
    assert "NestedLoop" not in joins.interval_pairs(df, "id", "t", 60)._jdf.queryExecution().toString()


def test_interval_pairs_of_window_zero(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, t long")
    assert rows(joins.interval_pairs(df, "id", "t", 0), "a_id", "b_id") == [(1, 2)]


@pytest.mark.parametrize("block", [1, 2, 5, 64])
@pytest.mark.parametrize("window", [0, 3, 40])
def test_interval_pairs_in_blocks_of_time(spark, block, window):
    r = np.random.default_rng(block * 100 + window)
    times = [(i, int(t)) for i, t in enumerate([*r.integers(-50, 400, 60), *[100] * 25, *[103] * 4, *r.integers(100_000, 100_050, 10)])]
    df = spark.createDataFrame([(i, t, f"n{i}") for i, t in [*times, (900, None)]], "id long, t long, name string")
    want = sorted((a, b, f"n{a}", f"n{b}", abs(x - y)) for a, x in times for b, y in times if a < b and abs(x - y) <= window)
    got = joins.interval_pairs(df, "id", "t", window, ["name"], block)
    assert got.columns == ["a_id", "b_id", "a_name", "b_name", "apart"] and rows(got, *got.columns) == want


def test_pairs_in_time_are_joined_once_and_not_by_broadcast(spark):
    """Files of a few MB are many millions of rows of a broadcast."""
    df = spark.range(1000).select("id", F.floor(F.col("id") / 2).alias("t"))
    for block in (4, 2048):
        plan = joins.interval_pairs(df, "id", "t", 5, block=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("SortMergeJoin [" + ("i" if block == 4 else "__bucket")) == 1 and "Exchange hashpartitioning(__bucket" in plan.replace("i#", "__bucket#")
    assert "Broadcast" not in plan


def test_blocks_grow_with_what_a_window_reaches(spark, monkeypatch):
    """Blocks of four under a window of hundreds of rows would send each row to a hundred of them."""
    sent, dealt = [], joins.blocks_in_time
    monkeypatch.setattr(joins, "blocks_in_time", lambda *a: (sent.append(dealt(*a)), sent[-1])[1])
    df = spark.range(2000).select("id", F.floor(F.col("id") / 2).alias("t"))
    assert joins.interval_pairs(df, "id", "t", 200, block=4).count() == sum(1 for a in range(2000) for b in range(a + 1, min(2000, a + 402)) if b // 2 - a // 2 <= 200)
    assert sent[0].count() <= 6 * 2000


def test_blocks_in_time_leave_in_the_shared_folder_what_the_result_reads(spark):
    def stored():
        return {f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))}

    before = stored()
    df = spark.range(2000).select("id", F.floor(F.col("id") / 2).alias("t"))
    pairs = joins.interval_pairs(df, "id", "t", 3, block=4)
    assert sorted(x.split("-")[0] for x in stored() - before) == ["ordered", "pairs"]  # the input was there a second time, unordered
    assert pairs.count() == sum(1 for a in range(2000) for b in range(a + 1, min(2000, a + 8)) if b // 2 - a // 2 <= 3)


def test_full_buckets_leave_in_the_shared_folder_what_the_result_reads(spark, monkeypatch):
    """As blocks of the usual size are cut where a bucket has more rows than one."""
    kept, stored = [], joins.written
    monkeypatch.setattr(joins, "written", lambda *a: (kept.append(stored(*a)), kept[-1])[1])
    df = spark.range(3000).select("id", F.floor(F.col("id") / 2000).alias("t"))
    assert joins.interval_pairs(df, "id", "t", 0).count() == 2000 * 1999 // 2 + 1000 * 999 // 2
    assert joins.interval_pairs(df, "id", "t", 3).count() == 3000 * 2999 // 2
    there = [os.path.exists(x._written_path.removeprefix("file://")) for x in kept]
    assert there == [False, False, False, True]  # the input, the blocks' spans, their marks; pairs of blocks


def test_an_instant_shared_by_many_rows_is_spread(spark):
    n, block = 200_000, 2048
    df = spark.range(n).select("id", F.lit(7).cast("long").alias("t")).union(spark.range(n, n + 50_000).select("id", F.col("id") * 1000))
    dealt = joins.blocks_in_time(df, "id", "t", 60, block)
    by = dealt.groupBy("i", "j").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert by[0] <= 2 * block and by[1] >= 98 * 99 // 2
    alone = dealt.where(F.col("id") > n + block).groupBy("id").count().agg(F.max("count")).first()[0]
    assert alone == 1  # rows that are near nothing aren't sent to other blocks


def test_close_pairs_of_one_instant(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(300, 6))
    m[150:200] = m[0] + r.normal(size=(50, 6)) * 0.05
    m /= np.linalg.norm(m, axis=1)[:, None]
    at = [5] * 200 + [int(x) for x in r.integers(0, 60, 100)]
    v = spark.createDataFrame([*enumerate(m.tolist()), (999, None)], "id long, vector array<double>")
    t = spark.createDataFrame([*enumerate(at), (999, 5), (998, 5), (997, None)], "id long, captured_at long")
    s = m @ m.T
    want = sorted((i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.9 and abs(at[i] - at[j]) <= 4)
    for block in (16, 2048):
        assert rows(vectors.close_pairs(v, t, 4, 0.9, block), "a", "b") == want


@pytest.mark.parametrize("block", [3, 2048])
def test_vectors_against_numpy(spark, block):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 5))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[7] = m[3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, vector array<double>")
    s = m @ m.T
    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5)
    assert rows(vectors.cosine_pairs(df, 0.5, block), "a", "b") == want
    got = {}
    for r in vectors.knn(df, 4, block).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:4]
        assert [got[i][k] for k in range(1, 5)] == order


def test_pairs_of_blocks_get_each_vector_a_bounded_number_of_times(spark):
    n = 60_000
    df = spark.range(n).select("id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    dealt = vectors._block_pairs(df, 2048)
    assert dealt.count() <= vectors.GRID * n  # in blocks of 2048 each was sent to 30 pairs
    assert dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= 2 * vectors.HELD // 16


def test_copies_among_neighbours_are_told_by_id(spark):
    """Equal vectors have one similarity to any other, however they are dealt, so of more copies than k the smallest ids count."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3000, 64))
    m[np.arange(0, 3000, 3)] = m[:10][rng.integers(0, 10, 1000)]
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, vector array<double>")
    s = sum(m[:, None, c] * m[None, :, c] for c in range(64))
    np.fill_diagonal(s, -2)
    for block in (100, 4096):
        got = rows(vectors.knn(df, 3, block), "id", "rank", "neighbour")
        assert got == [(i, k + 1, int(j)) for i in range(3000) for k, j in enumerate(np.lexsort((np.arange(3000), -s[i]))[:3])]
    near = rows(vectors.knn(df, 3, 100, least=0.9), "id", "neighbour")
    assert near == sorted((i, j) for i, _, j in got if s[i, j] >= 0.9)


def test_hyperplane_cells_against_all_pairs(spark):
    """Near copies among 6000 vectors: found as all pairs find them, 9 in 10 of them at least, a cell over a block included."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 64))
    m = np.concatenate([m, m[:2000] + 0.15 * rng.normal(size=(2000, 64)), m[:1] + 0.02 * rng.normal(size=(1000, 64))])
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, vector array<double>").repartition(4).cache()
    s = np.triu(m @ m.T, 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(s >= 0.97)), strict=True))
    got = rows(vectors.cosine_pairs(df, 0.97, 256, exact=False), "a", "b")
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)
    apart = {p for p in want if p[0] > 0 and p[1] < 5000}
    assert len(apart) > 1000 and len(apart & set(got)) >= 0.97 * len(apart)
    near = {(r["id"], r["neighbour"]) for r in vectors.knn(df, 3, 256, exact=False).collect()}
    exact = {(r["id"], r["neighbour"]) for r in vectors.knn(df, 3, exact=True).where("similarity >= 0.9").collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert vectors.knn(df.limit(0), 3, exact=False).count() == 0


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.normalize(F.col("v")).alias("v"))
    assert [list(r["v"]) for r in df.collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (200, 200)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def calibration_tables(spark, values, background=None, score=None):
    exif_rows = [(i, 0, "M", "L", 50.0, 2.8, 100) for i in range(len(values))]
    sharp = [(i, v, (background or {}).get(i)) for i, v in enumerate(values)]
    iqa = [(i, s) for i, s in (score or {}).items()]
    return (spark.createDataFrame(sharp, "file_id long, s_subject double, s_background double"), spark.createDataFrame(exif_rows, EXIF), spark.createDataFrame(iqa, "file_id long, score double"))


def test_baselines_and_flags(spark):
    sharp, ex, iqa = calibration_tables(spark, [0.0, 1000.0, 1000.0, 1000.0, 1000.0, None], {0: 0.0}, {0: 0.01, 1: 0.8, 2: 0.8, 3: 0.8, 4: 0.8, 5: 0.8})
    base = calibration.sharpness_baselines(sharp, ex, 3)
    assert rows(base, "camera_model", "n_samples") == [("*", 5), ("M", 5)]
    flags = rows(calibration.reflag(sharp, ex, iqa, base, 3), "file_id", "flag_type", "bumped")
    assert flags == [(0, "blur", True), (0, "low_iqa", False)]  # zero is blur, and a file without sharpness gets no flag at all
    assert rows(calibration.sharpness_baselines(sharp, ex, 30), "camera_model") == [("*",)]


def test_back_focus(spark):
    sharp, ex, iqa = calibration_tables(spark, [100.0, 1000.0, 1000.0, 1000.0], {0: 250.0})
    base = calibration.sharpness_baselines(sharp, ex, 2)
    assert rows(calibration.reflag(sharp, ex, iqa, base, 2), "file_id", "flag_type") == [(0, "back_focus")]
    report = calibration.calibration_report(calibration.reflag(sharp, ex, iqa, base, 2)).first()
    assert report["flagged_back_focus"] == 1


def test_no_baseline_no_flags(spark):
    sharp, ex, iqa = calibration_tables(spark, [])
    assert calibration.sharpness_baselines(sharp, ex, 1).count() == 0
    assert calibration.reflag(sharp, ex, iqa, calibration.sharpness_baselines(sharp, ex, 1), 1).count() == 0


def test_dedupe(spark):
    files = spark.createDataFrame([(i, f"/syn/file{i}.jpg", str(i)) for i in range(4)], "id long, path string, content_hash string")
    emb = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.999, 0.044, 0.0]), (2, [0.998, 0.0, 0.063]), (3, [0.0, 1.0, 0.0])], "file_id long, vector array<float>")
    ex = spark.createDataFrame([(i, 1000 + 2 * i, "M", "L", 50.0, 2.8, 100) for i in range(4)], EXIF)
    scores = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.4), (3, 1.0)], "id long, quality_score double")
    got = rows(duplicates.run_dedupe(files, emb, ex, scores), "group_id", "file_id", "is_suggested_keeper")
    assert got == [(1, 0, False), (1, 1, True), (1, 2, False)]
    assert duplicates.run_dedupe(files, emb, ex, scores, DedupeConfig(enable=False)).count() == 0
    assert duplicates.run_dedupe(files, emb.limit(1), ex, scores).count() == 0


def test_group_numbers_follow_the_smallest_id(spark):
    elected = spark.createDataFrame([(c, c + k, 0.0, k == 0) for c in range(0, 50, 5) for k in range(2)], "component long, id long, quality_score double, is_suggested_keeper boolean")
    ids, _ = duplicates.numbered(elected)
    assert rows(ids, "component", "group_id") == [(5 * i, i + 1) for i in range(10)]


DECISIONS = "file_id long, verdict string, is_keeper boolean, note string, decided_at long"


def test_pick_keeper(spark):
    old = spark.createDataFrame([(2, "keep", True, "mine", 1), (9, "keep", False, None, 1)], DECISIONS)
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 9)], "group_id long, file_id long")
    new = decisions.pick_keepers(old, members, spark.createDataFrame([(1,)], "file_id long"), 7)
    assert rows(new, "file_id", "verdict", "is_keeper", "note", "decided_at") == [(1, "keep", True, None, 7), (2, "reject", False, "mine", 7), (9, "keep", False, None, 1)]


def test_set_and_clear_decision(spark):
    old = spark.createDataFrame([(1, "keep", True, "n", 1)], DECISIONS)
    assert rows(decisions.set_decision(old, 1, "keep", 2), "file_id", "verdict", "is_keeper") == [(1, "keep", False)]
    assert decisions.clear_decision(old, 1).count() == 0
    with pytest.raises(ValueError):
        decisions.set_decision(old, 1, "perhaps", 2)


def test_unique_names(spark):
    plan = spark.createDataFrame([("d", "/a/IMG_1.jpg"), ("d", "/b/IMG_1.jpg"), ("d", "/c/IMG_1 (2).jpg"), ("d", "/e/IMG_1.jpg"), ("e", "/b/IMG_1.jpg"), ("d", "/z/.hidden"), ("d", "/y/.hidden")], "rel_dir string, original string")
    got = {(d, o): n for d, o, n in rows(output.unique_names(plan), "rel_dir", "original", "name")}
    assert got[("d", "/a/IMG_1.jpg")] == "IMG_1.jpg" and got[("d", "/b/IMG_1.jpg")] == "IMG_1 (2).jpg" and got[("e", "/b/IMG_1.jpg")] == "IMG_1.jpg"
    assert got[("d", "/c/IMG_1 (2).jpg")] == "IMG_1 (2) (2).jpg" and got[("d", "/e/IMG_1.jpg")] == "IMG_1 (3).jpg"
    assert {got[("d", "/y/.hidden")], got[("d", "/z/.hidden")]} == {".hidden", ".hidden (2)"}


def one_after_the_other(plan):
    taken, out = set(), []
    for d, o in sorted(set(plan), key=lambda r: (r[0], r[1].encode())):
        name = base = o.rsplit("/", 1)[-1]
        dot, n = base.rfind("."), 2
        head, tail = (base[:dot], base[dot:]) if dot > 0 else (base, "")
        while (d, name) in taken:
            name, n = f"{head} ({n}){tail}", n + 1
        taken.add((d, name))
        out.append((d, o, name))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_unique_names_one_after_the_other(spark, seed):
    import random

    r = random.Random(seed)
    bases = ["x.jpg", "x (2).jpg", "x (3).jpg", "x (4).jpg", "x (7).jpg", "x (2) (2).jpg", "x (2) (3).jpg", "x (3) (2).jpg", "x (2) (2) (2).jpg", "x (02).jpg", "x (1).jpg", ".x", ".x (2)", "x", "x (2)", "x (3)", " (2).jpg", ".jpg", "a.b (2)", "a.b", "é (2).x", "é.x", "y.JPG"]
    bases = bases if seed else bases[:6]
    plan = [(r.choice("de"), f"/{r.choice('abcdefgh')}{r.randint(0, 9)}/{r.choice(bases)}") for _ in range(400)]
    got = output.unique_names(spark.createDataFrame(plan, "rel_dir string, original string"))
    assert rows(got, "rel_dir", "original", "name") == one_after_the_other(plan)


def test_one_name_a_million_times(spark):
    n = 1_000_000
    plan = spark.range(n).select(F.lit("d").alias("rel_dir"), F.format_string("/%07d/x.jpg", "id").alias("original"))
    own = spark.createDataFrame([("d", "/0000000a/x (500).jpg"), ("d", "/9999999/x (700).jpg")], "rel_dir string, original string")
    got = output.unique_names(plan.union(own))
    assert tuple(got.agg(F.count("*"), F.countDistinct("name")).first()) == (n + 2, n + 2)
    name = {x["original"]: x["name"] for x in got.where("original IN ('/0000000/x.jpg', '/0000001/x.jpg', '/0000498/x.jpg', '/0000499/x.jpg', '/0999999/x.jpg', '/0000000a/x (500).jpg', '/9999999/x (700).jpg')").collect()}
    assert name == {
        "/0000000/x.jpg": "x.jpg", "/0000001/x.jpg": "x (2).jpg", "/0000498/x.jpg": "x (499).jpg", "/0000499/x.jpg": "x (501).jpg", "/0999999/x.jpg": "x (1000001).jpg",
        "/0000000a/x (500).jpg": "x (500).jpg", "/9999999/x (700).jpg": "x (700) (2).jpg",
    }
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 0.7 * n


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_percentiles_by_aggregate_and_in_one_order(spark, groups):
    from gallerist.operators import aggregates

    r = np.random.default_rng(4)
    data = [(None if g == 3 else f"g{g}", None if i % 17 == 0 else float(round(x, 1))) for i, (g, x) in enumerate(zip(r.integers(0, 5, 400), r.normal(size=400), strict=True))] + [("lone", 5.0), ("empty", None)]
    df = spark.createDataFrame(data, "g string, x double")
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}
    want = []
    for g in {d[0] for d in data} if groups else {""}:
        own = [x for k, x in data if x is not None and (not groups or k == g)]
        if own:
            want.append((*([g] if groups else []), *np.percentile(own, [0, 10, 50, 90, 100]).round(9).tolist(), len(own)))
    plain = lambda found: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in found.collect()), key=str)
    for few in (0, 10**6):
        assert plain(aggregates.percentiles(df, groups, "x", wanted, few=few)) == sorted(want, key=str)
    counts = aggregates.value_counts(df, ["g"], "x")
    assert plain(aggregates.percentiles(None, groups, "x", wanted, counts)) == sorted(want, key=str)


def test_filtered(spark):
    df = spark.createDataFrame([(1, "blur", None, None, False), (2, "", "keep", 4, True), (3, "blur,low_iqa", "reject", None, False)], "file_id long, flags string, verdict string, group_id long, is_keeper boolean")
    ids = lambda *a, **k: [r[0] for r in rows(review.filtered(df, *a, **k), "file_id")]
    assert ids() == [1, 2, 3] and ids(("low_iqa",)) == [3] and ids(("!",)) == [2] and ids(("*",)) == [1, 3] and ids(("!", "low_iqa")) == [2, 3]
    assert ids(undecided_only=True) == [1] and ids(duplicates_only=True) == [2] and ids(keepers_only=True) == [2]


# --- arrays -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("level, hi, lo", [(255, 1.0, 0.0), (0, 0.0, 1.0), (128, 0.0, 0.0)])
def test_exposure(level, hi, lo):
    e = kernels.exposure(np.full((8, 8, 3), level, np.uint8))
    assert (e["clipped_highlights"], e["clipped_shadows"], e["histogram_skew"]) == (hi, lo, 0.0)
    assert e["mean_luma"] == pytest.approx(level / 255)


def test_sharpness():
    board = (np.indices((64, 64)).sum(axis=0) % 2 * 255).astype(np.uint8)
    flat = np.full((64, 64), 90, np.uint8)
    s = kernels.sharpness(board)
    assert s["s_global"] > 0 and s["detector_used"] == "center-crop-fallback" and s["subject_ratio"] == pytest.approx(0.16)
    assert kernels.sharpness(flat)["s_global"] == 0.0
    half = flat.copy()
    half[:, 32:] = board[:, 32:]
    boxed = kernels.sharpness(half, [(0.55, 0.0, 0.45, 1.0)], "d")
    assert boxed["s_subject"] > boxed["s_background"] and boxed["detector_used"] == "d"
    assert kernels.sharpness(half, [(0.5, 0.5, 0.1, 0.1)])["detector_used"] == "center-crop-fallback"  # too small a box
    assert kernels.sharpness(np.zeros((2, 9)))["s_subject"] is None


def test_sample_stats():
    s = kernels.sample_stats(np.array([0.0, 50.0, 100.0, np.nan, np.inf]), 0.0, 100.0)
    assert (s["p50"], s["clipped_frac"], s["black_frac"]) == (0.0, 0.2, 0.2)
    assert kernels.sample_stats(np.zeros(0), 0.0, 1.0)["p50"] == 0.0
    assert kernels.sample_stats(np.array([5.0]), float("nan"), float("inf"))["p50"] == pytest.approx(5 / 65535)
    assert len(kernels.stride_samples(np.zeros((100, 100)), (0, 0, 50, 50), 100)) == 100


def test_illuminant():
    light = np.array([0.8, 0.5, 0.3])
    v = kernels.illuminant(np.linspace(0.1, 0.9, 400)[:, None] * light)
    assert v == pytest.approx((light / np.linalg.norm(light)).tolist())
    assert kernels.illuminant(np.zeros((100, 3))) is None and kernels.illuminant(np.full((10, 3), 0.5)) is None


def test_cell_colours():
    plane = np.tile(np.array([[10.0, 20.0], [30.0, 40.0]]), (4, 4))
    c = kernels.cell_colours(plane, "RGGB", 0.0, 100.0)
    assert c.shape == (16, 3) and c[0].tolist() == pytest.approx([0.1, 0.25, 0.4])
    assert len(kernels.cell_colours(plane, "RGGE", 0.0, 100.0)) == 0


def test_detections():
    d = kernels.decode_detections(np.array([[0.0, 3.0], [-3.0, -4.0], [2.0, 2.0]]), np.array([[0.5, 0.5, 0.4, 0.2]] * 3))
    assert [x["class"] for x in d] == [1, 1] and d[0]["x"] == pytest.approx(0.3)
    frame = kernels.letterbox(1280, 640)
    assert frame == (0, 160, 640, 320)
    assert kernels.unletterbox((0.0, 0.25, 1.0, 0.5), frame) == pytest.approx((0.0, 0.0, 1.0, 1.0))


def test_lut():
    table = lut.identity()
    rgb = np.random.default_rng(0).random((50, 3))
    assert lut.apply(table, rgb) == pytest.approx(rgb, abs=1e-6)
    assert lut.from_cube(lut.to_cube(table)) == pytest.approx(table, abs=1e-6)
    assert lut.fuse([table, table], [0.25, 0.25])[-1, -1, -1].tolist() == [0.5, 0.5, 0.5]
    assert (lut.fuse([table], [float("nan")]) == table).all() and (lut.fuse([table], [1.0, 2.0]) == table).all()
    assert lut.content_hash(table) == lut.content_hash(table + 1e-9)
    image = np.array([[[0, 30000, 65535]]], np.uint16)
    assert abs(lut.apply_16_bit(table, image).astype(int) - image.astype(int)).max() <= 1
    for bad in ("LUT_3D_SIZE 2\n0 0 0\n", "0 0 0\n", "LUT_3D_SIZE 33\n0 0\n"):
        with pytest.raises(ValueError):
            lut.from_cube(bad)


def test_basis(tmp_path):
    np.save(tmp_path / "b.npy", np.stack([np.moveaxis(lut.identity(), -1, 0)]).astype("<f4"))
    assert (lut.read_basis(str(tmp_path / "b.npy"))[0] == lut.identity()).all()
    np.save(tmp_path / "c.npy", np.zeros((1, 2)))
    with pytest.raises(ValueError):
        lut.read_basis(str(tmp_path / "c.npy"))


def test_resize():
    a = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(6, 4, 3)
    assert kernels.resize(a, 6) is a and kernels.resize(a, 3).shape == (3, 2, 3)
    assert kernels.resize(np.full((100, 50, 3), 7, np.uint8), 10).max() == 7


# --- sources ------------------------------------------------------------------------------------------------------


def jpeg_with_exif(order="<"):
    import struct

    mark = b"II" if order == "<" else b"MM"
    pack = lambda f, *v: struct.pack(order + f, *v)

    def block(entries, base):
        body, extra = pack("H", len(entries)), b""
        tail = base + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in sorted(entries):
            if len(raw) > 4:
                at, extra = tail + len(extra), extra + raw
                raw = pack("I", at)
            body += pack("HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return body + pack("I", 0) + extra

    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    ratio = lambda n, d: (5, 1, pack("II", n, d))
    sub = [(0x9003, *text("2023:06:15 12:00:00")), (0x920A, *ratio(50, 1)), (0x829D, *ratio(28, 10)), (0x8827, 3, 1, pack("H", 200)), (0x829A, *ratio(1, 100)), (0xA434, *text("TestLens 50mm"))]
    first = [(0x010F, *text("TestMake")), (0x0110, *text("TestModel")), (0x0112, 3, 1, pack("H", 1)), (0x8769, 4, 1, pack("I", 0))]
    size = len(block(first, 8))
    first[-1] = (0x8769, 4, 1, pack("I", 8 + size))
    tiff = mark + pack("HI", 42, 8) + block(first, 8) + block(sub, 8 + size)
    segment = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xda"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    df = spark.createDataFrame([("/a.jpg", bytearray(jpeg_with_exif(order))), ("/b.jpg", bytearray(b"not a jpeg")), ("/c.jpg", None)], "path string, content binary")
    got = {r["path"]: r for r in exif.exif_rows(df).collect()}
    a = got["/a.jpg"]
    assert (a["camera_make"], a["camera_model"], a["lens_model"], a["captured_at"], a["iso"], a["orientation"]) == ("TestMake", "TestModel", "TestLens 50mm", 1686830400, 200, 1)
    assert (a["focal_length_mm"], a["aperture"], a["shutter_seconds"]) == (50.0, 2.8, 0.01) and a["error"] is None
    assert got["/b.jpg"]["error"] and len(got["/b.jpg"]["content_hash"]) == 32


def test_listing(spark):
    paths = ["/r/a.ARW", "/r/a.jpg", "/r/b.jpg", "/r/out/.gallerist-tree", "/r/out/sub/c.jpg", "/r/d.txt", "/r/E.JPEG", "/r/x/a.jpg"]
    df = spark.createDataFrame([(p, 1, 1) for p in paths], "path string, mtime_ns long, size_bytes long")
    kept = listing.without_sidecars(listing.ingestable(df, "/r"))
    assert [r[0] for r in rows(kept, "path")] == ["/r/E.JPEG", "/r/a.ARW", "/r/b.jpg", "/r/x/a.jpg"]
    flagged = dict(rows(listing.with_sidecar_flag(kept, df), "path", "has_sidecar_jpg"))
    assert flagged["/r/a.ARW"] and not flagged["/r/b.jpg"]
    inside = listing.ingestable(df.where("path LIKE '/r/out/%'"), "/r/out")
    assert [r[0] for r in rows(inside, "path")] == ["/r/out/sub/c.jpg"]  # a marked root itself is walked


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    assert config.load(str(p)) == config.Config()
    p.write_text('[dedupe]\ntime_window_seconds = 5\n[defect.blur]\nmin_samples_for_bucket = 3\n[ingest]\nextensions = ["png"]\n[other]\nx = 1\n')
    c = config.load(str(p))
    assert (c.dedupe.time_window_seconds, c.defect.blur.min_samples_for_bucket, c.ingest.extensions, c.dedupe.k_neighbors) == (5, 3, ("png",), 10)
    p.write_text("nonsense")
    with pytest.raises(ValueError):
        config.load(str(p))
    assert config.substitute_library("<library>/_out", "/a") == "/a/_out"
