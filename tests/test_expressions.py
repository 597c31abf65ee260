import math

import pytest
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.functions.profile import profile_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("mm, bucket", [(50.0, 50), (14.0, 14), (600.0, 600), (60.0, 50), (61.0, 70), (8.0, 14), (10000.0, 600), (None, None)])
def test_focal_bucket(spark, mm, bucket):
    assert one(spark, X.focal_bucket(F.lit(mm).cast("float"))) == bucket


@pytest.mark.parametrize("f, bucket", [(1.7, 1.587401), (2.8, 2.519842), (0.0, 1.0), (-3.0, 1.0), (8.0, 8.0)])
def test_aperture_bucket(spark, f, bucket):
    assert one(spark, X.aperture_bucket(F.lit(f))) == pytest.approx(bucket, abs=1e-5)


@pytest.mark.parametrize("iso, strength", [(50, 0.0), (100, 0.0), (400, 0.15), (1600, 0.3), (6400, 0.6), (25600, 0.85), (51200, 0.9), (10**9, 0.98)])
def test_denoise(spark, iso, strength):
    assert one(spark, X.denoise(F.lit(iso))) == pytest.approx(strength)


@pytest.mark.parametrize("v, out", [(0.5, 0.0), (1.0, 0.25), (-1.0, -0.25), (0.75, 0.0)])
def test_deadband(spark, v, out):
    assert one(spark, X.deadband(F.lit(v), 0.75)) == pytest.approx(out)


def test_relative_sharpness(spark):
    f = lambda s, a, b: one(spark, X.relative_sharpness(F.lit(s).cast("double"), F.lit(a), F.lit(b)))
    assert (f(15.0, 10.0, 20.0), f(5.0, 10.0, 20.0), f(25.0, 10.0, 20.0), f(1.0, 3.0, 3.0), f(None, 1.0, 2.0)) == (0.5, 0.0, 1.0, 0.5, 0.5)


@pytest.mark.parametrize(
    "flag, confidence, folder",
    [("blur", 0.6, "rejected/blur"), ("blur", 0.59, "uncertain"), ("low_iqa", 0.9, "rejected/low_quality"), ("other", 0.9, None)],
)
def test_category(spark, flag, confidence, folder):
    assert one(spark, X.category(F.lit(flag), F.lit(confidence))) == folder


def test_quality_score(spark):
    null = F.lit(None)
    assert one(spark, X.quality_score(null.cast("double"), null.cast("boolean"), null.cast("boolean"), null.cast("double"), null.cast("double"))) == 0.0
    assert one(spark, X.quality_score(F.lit(0.9), F.lit(True), F.lit(True), F.lit(0.1), F.lit(0.3))) == pytest.approx(0.9 - 0.3 - 0.2 - 0.06)


@pytest.mark.parametrize("text, epoch", [("2023:06:15 12:00:00", 1686830400), ("2023-06-15T12:00:00", 1686830400), ("2023:13:01 00:00:00", None), ("2023:06:15", None), ("abcd:06:15 12:00:00", None), ("1970:01:01 00:00:00", 0)])
def test_exif_epoch(spark, text, epoch):
    assert one(spark, X.exif_epoch(F.lit(text))) == epoch


@pytest.mark.parametrize("n, text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (10_000_000, "9.5 MB"), (5 * 1024**4, "5.0 TB"), (5 * 1024**5, "5120.0 TB")])
def test_humanize_bytes(spark, n, text):
    assert one(spark, X.humanize_bytes(F.lit(n).cast("long"))) == text


def test_verdict(spark):
    assert one(spark, X.verdict(F.lit("keep"))) == "keep"
    with pytest.raises(Exception, match="unknown verdict"):
        one(spark, X.verdict(F.lit("maybe")))


def test_guard(spark):
    g = lambda a, b: one(spark, X.guard_passes(F.lit(a).cast("double"), F.lit(b).cast("double"), 0.02))
    assert (g(0.5, 0.49), g(0.5, 0.47), g(None, 0.1), g(0.5, None)) == (True, False, True, True)


def test_decide_and_profile(spark):
    r = one(spark, X.decide(F.lit(0.0587), F.lit(0.3), F.lit(0.05), F.lit(0.05), F.lit(1600), F.lit("lens"), F.lit(0.625)))
    assert r["exposure_ev"] == pytest.approx(math.log2(0.18 / 0.0587) - 0.75)
    assert (r["highlight_recovery"], r["denoise_luma"], r["lens_correct"]) == (1.0, pytest.approx(0.3), True)
    assert r["shadow_lift"] == pytest.approx(0.35) and r["denoise_chroma"] == pytest.approx(0.36) and r["sharpen_amount"] == pytest.approx(0.5)
    recipe = F.struct(*[F.lit(v).alias(n) for n, v in zip(X.RECIPE, (0.75, 0.8, 0.4, 0.3, 0.36, 0.5), strict=True)], F.lit(True).alias("lens_correct"))
    text = one(spark, profile_text(recipe, "t"))
    assert text.startswith("# One photo's settings, made by t ") and len(text.splitlines()) == 38
    for line in ("Compensation=0.750", "Method=Coloropp", "Shadows=40", "Luma=30", "Chroma=36", "Contrast=50", "LcMode=lfauto"):
        assert line in text.splitlines()
    off = F.struct(*[F.lit(0.0).alias(n) for n in X.RECIPE], F.lit(False).alias("lens_correct"))
    text = one(spark, profile_text(off))
    assert text.count("Enabled=false") == 4 and "LensProfile" not in text
    assert one(spark, X.recipe_hash(recipe)) != one(spark, X.recipe_hash(off))


def test_natural_order(spark):
    names = ["IMG_10.jpg", "img_9.jpg", "IMG_1.jpg", "a2b10", "a2b9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(X.natural_key(F.col("n"))).collect()] == ["a2b9", "a2b10", "IMG_1.jpg", "img_9.jpg", "IMG_10.jpg"]


def test_display(spark):
    assert one(spark, X.exif_line(F.lit(50.0), F.lit(2.8), F.lit(0.01), F.lit(200))) == "50mm · f/2.8 · 1/100s · ISO 200"
    assert [one(spark, X.relative_time(F.lit(t).cast("long"), F.lit(100_000).cast("long"))) for t in (None, 99_990, 99_880, 92_000, 1)] == ["never", "just now", "2 minutes ago", "2 hours ago", "1 day ago"]
    assert [one(spark, X.better(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in ((1, 0), (0, 1), (1, 1), (None, 1))] == [1, 2, None, None]
    assert one(spark, X.subject_class(F.lit(14))) == "animal" and one(spark, X.sigmoid(F.lit(0.0))) == 0.5
