"""A small library from folder to trees. PNG files stand in for photos: the Java runtime decodes them, and .jpg in a name is enough."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerist.catalog import Catalog, ConcurrentWrite
from gallerist.engine import Engine, doctor, find_library, read_any
from gallerist.sinks import trees
from gallerist.sinks.cache import ContentCache
from gallerist.storage import shared_dir
from gallerist.streaming.ingest import run_ingest


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    for name, level in (("white", 255), ("black", 0), ("grey", 128)):
        (root / f"{name}.jpg").write_bytes(png(np.full((64, 64, 3), level)))
    (root / "broken.jpg").write_bytes(b"not a jpeg")
    return root


def test_library(spark, folder, tmp_path):
    e = Engine(spark, str(folder), str(tmp_path / "store"))
    assert e.count_pending() == 4
    assert e.scan() == {"processed": 4, "skipped": 0, "measured": 3, "errored": 1}
    flags = {os.path.basename(r["path"]): r["flag_type"] for r in e.catalog["defect_flags"].join(e.catalog["files"].select(F.col("id").alias("file_id"), "path"), "file_id").collect()}
    assert flags == {"white.jpg": "overexposed", "black.jpg": "underexposed"}
    again = e.scan()
    assert (again["processed"], again["skipped"], again["measured"]) == (0, 4, 0) and e.count_pending() == 0
    assert e.calibrate()["flags_cleared"] == 0
    assert e.dedupe() == {"groups": 0, "members": 0, "keepers": 0}
    listed = [(os.path.basename(r["path"]), r["flags"]) for r in e.review_list().collect()]
    assert len(listed) == 4 and {n for n, f in listed[:2]} == {"white.jpg", "black.jpg"}
    ids = {os.path.basename(r["path"]): r["id"] for r in e.catalog["files"].collect()}
    e.decide(ids["grey.jpg"], "keep")
    e.decide(ids["black.jpg"], "reject")
    assert e.stats()["decisions"].first().asDict() == {"kept": 1, "rejected": 1, "undecided": 2}
    assert '"grey.jpg' in e.file(ids["grey.jpg"]).first()["dump"] or "grey.jpg" in e.file(ids["grey.jpg"]).first()["dump"]

    out = tmp_path / "review"
    r = e.review_tree(str(out))
    assert (r.copied, r.errors) == (2, 0) and (out / "rejected/overexposed/unknown-date/white.jpg").exists()
    r = e.review_tree(str(out))
    assert (r.copied, r.skipped, r.removed) == (0, 2, 0)
    (out / "stray.txt").write_text("x")
    assert e.review_tree(str(out)).removed == 1 and not (out / "stray.txt").exists()
    kept = tmp_path / "kept"
    assert e.export_keepers(str(kept)).copied == 1 and (kept / "unknown-date/grey.jpg").exists()
    e.undecide(ids["grey.jpg"])
    assert e.export_keepers(str(kept)).removed == 1 and not (kept / "unknown-date").exists()
    with pytest.raises(PermissionError):
        e.review_tree(str(folder))
    assert read_any(spark, str(tmp_path / "store")).count() == 1
    assert e.finish_plan().count() == 0


def test_models_previews_and_the_rest(spark, folder, tmp_path):
    class Mean:  # within the test, so that it is sent to the workers by value
        name = "mean"

        def embed(self, rgb):
            return [rgb.mean() / 255, 1.0]

        def score(self, rgb):
            return float(rgb.mean() / 255)

    e = Engine(spark, str(folder), str(tmp_path / "store"))
    e.scan()
    assert e.analyze_models(Mean(), Mean()) == {"embedded": 3, "scored": 3} and e.analyze_models(Mean(), Mean()) == {"embedded": 0, "scored": 0}
    assert e.cache_previews() == 3 and e.cache_previews() == 3
    assert e.dedupe() == {"groups": 0, "members": 0, "keepers": 0}
    ids = {os.path.basename(r["path"]): r["id"] for r in e.catalog["files"].collect()}
    for name in ("grey.jpg", "white.jpg"):
        e.decide(ids[name], "keep")
    target = tmp_path / "kept"
    assert e.estimate_keepers(str(target)).first()["files"] == 2
    e.export_keepers(str(target))
    assert tuple(e.estimate_keepers(str(target)).first()) == (0, 0) and e.estimate_review_tree(str(tmp_path / "r")).first()["files"] == 2
    done = tmp_path / "done"
    done.mkdir()
    (done / "old.jpg").write_text("x")
    e.catalog.upsert("edits", spark.createDataFrame([(ids["black.jpg"], str(done / "old.jpg")), (ids["grey.jpg"], str(done / "grey.jpg"))], "file_id long, output_path string"))
    assert e.prune_finished(str(done)) == 1 and e.catalog["edits"].count() == 1
    assert find_library(spark, str(tmp_path / "store"), str(folder / "sub" / "x.jpg")) == os.path.realpath(folder) and find_library(spark, str(tmp_path / "store"), "/nowhere/x") is None
    assert all(fine for _, fine, _ in doctor(spark, str(tmp_path / "store")))


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.schema_version() == 5 and c["files"].count() == 0
    c.upsert("files", spark.createDataFrame([("/b", "h1"), ("/a", "h2")], "path string, content_hash string"))
    c.upsert("files", spark.createDataFrame([("/a", "h3"), ("/c", "h4")], "path string, content_hash string"))
    assert sorted((r["id"], r["path"], r["content_hash"]) for r in c["files"].collect()) == [(1, "/a", "h3"), (2, "/b", "h1"), (3, "/c", "h4")]
    assert c.version("files") == 1
    assert c.delete_where("files", F.col("path") == "/b") == 1 and c.delete_where("files", F.col("path") == "/none") == 0
    c.set_library_meta("/x", 1)
    c.set_library_meta("/y", 2)
    c.set_last_analyzed(9)
    assert [tuple(r) for r in c["library_meta"].collect()] == [("/x", 1, 9)]
    assert Catalog(spark, str(tmp_path / "cat"))["files"].count() == 2


def test_failed_write_leaves_the_snapshot(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.upsert("iqa", spark.createDataFrame([(1, 0.5)], "file_id long, score float"))
    with pytest.raises(Exception):
        c.upsert("iqa", spark.createDataFrame([(2, 0.5)], "file_id long, score float").withColumn("score", F.raise_error(F.lit("no")).cast("float")))
    assert [r["file_id"] for r in c["iqa"].collect()] == [1]


def test_stream(spark, folder, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    for expected in (4, 4, 5):
        if expected == 5:
            (folder / "more.jpg").write_bytes(png(np.zeros((4, 4, 3))))
        run_ingest(c, str(folder), str(tmp_path / "checkpoint"), 1).awaitTermination()
        assert c["files"].count() == expected


def test_cache(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path / "cache"))
    entries = spark.createDataFrame([("aabb", bytearray(b"1")), ("ccdd", bytearray(b"2"))], "content_hash string, bytes binary")
    cache.add(entries)
    cache.add(entries)
    assert cache.read().count() == 2 and cache.missing(spark.createDataFrame([("aabb",), ("ee",)], "content_hash string")).count() == 1


def test_safety(tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/x").write_text("x")
    with pytest.raises(PermissionError):
        trees.remove_managed(str(tmp_path / "mine"))
    (tmp_path / "mine" / trees.MARKER).write_text("")
    trees.remove_managed(str(tmp_path / "mine"))
    assert not (tmp_path / "mine").exists()


@pytest.mark.parametrize("n", [20_000, 200_000, 1_000_000])
def test_catalog_gives_each_row_an_id_of_its_own(spark, tmp_path, n):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.upsert("files", spark.createDataFrame([("/0", "x")], "path string, content_hash string"))
    c.upsert("files", spark.range(n).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.lit("h").alias("content_hash")))
    got = c["files"].agg(F.count("*"), F.countDistinct("id"), F.countDistinct("path"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (n, n, n, 1, n)
    assert c["files"].where("path = '/0'").first()["id"] == 1
    if n == 20_000:  # in order of path
        rows = [r["path"] for r in c["files"].where("id > 1").orderBy("id").select("path").collect()]
        assert rows == sorted(rows)


def test_second_of_two_writers_is_refused(spark, tmp_path):
    one, two = (Catalog(spark, str(tmp_path / "cat")) for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, 0.5)], "file_id long, score float")
    one.upsert("iqa", row(1))
    base = two.version("iqa")
    one.upsert("iqa", row(2))
    with pytest.raises(ConcurrentWrite):
        two.replace("iqa", row(3), base)
    assert sorted(r["file_id"] for r in two["iqa"].collect()) == [1, 2]
    for i in range(4, 10):
        one.upsert("iqa", row(i))
    assert one.expire("iqa", 2) == 6 and one["iqa"].count() == 8 and one.expire("iqa", 2) == 0


def test_shared_folder_must_be_named_off_local_masters():
    class Off:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(Off)
