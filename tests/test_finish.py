"""Finishing: chunks, claims, errors, looks and the guard, runs that are killed, and trees that are swept."""

import os

import numpy as np
import pytest

from gallerist import finish as F_
from gallerist.catalog import Catalog
from gallerist.functions import lut
from gallerist.sinks import trees
from gallerist.sources.config import DevelopConfig, LookConfig

LOOK = DevelopConfig(look=LookConfig(enable=True, guard_iqa=True, guard_margin=0.02))


@pytest.fixture
def made(spark, tmp_path):
    """A catalogue of twelve kept raw files, a rejected one and a kept JPEG, and stand-ins for the plug-ins that log their calls."""
    log = tmp_path / "log"
    log.mkdir()

    class Decoder:
        def decode(self, path):
            (log / f"decode-{os.path.basename(path)}-{os.urandom(4).hex()}").touch()
            if "07" in path:
                raise ValueError("no such sensor")
            n = int(os.path.basename(path)[1:3])
            return {"plane": np.full((8, 8), 100 + 50 * n, np.float32), "pattern": "RGGB", "black": 64.0, "white": 1023.0, "white_balance": (2.0, 1.0, 1.5)}

    class Renderer:
        name = "render-1"
        broken = "05"

        def render(self, path, profile):
            (log / f"render-{os.path.basename(path)}-{os.urandom(4).hex()}").touch()
            assert "Compensation=" in profile
            if self.broken in path:
                raise OSError("renderer fell over")
            return np.full((4, 6, 3), 20 * int(os.path.basename(path)[1:3]) % 256, np.uint8)

    class Look:
        name, version = "look", "1"

        def predict(self, rgb):
            if rgb.max() == 40:
                raise RuntimeError("no look for this")
            return np.clip(lut.identity() * 0.5, 0, 1)

    class Scorer:
        name = "brightness"

        def score(self, rgb):
            return -float(rgb.mean()) / 255 if rgb.max() < 130 else float(rgb.mean()) / 255

    store = Catalog(spark, str(tmp_path / "cat"))
    files = [(f"/in/f{i:02d}.arw" if i < 13 else "/in/f13.jpg", f"h{i}", "arw" if i < 13 else "jpg") for i in range(14)]
    store.upsert("files", spark.createDataFrame(files, "path string, content_hash string, file_format string"))
    ids = {os.path.basename(r["path"])[1:3]: r["id"] for r in store["files"].collect()}
    store.upsert("decisions", spark.createDataFrame([(ids[f"{i:02d}"], "reject" if i == 12 else "keep") for i in range(14)], "file_id long, verdict string"))
    calls = lambda kind: sorted(f.split("-")[1][1:3] for f in os.listdir(log) if f.startswith(kind))
    return store, str(tmp_path / "out"), Decoder, Renderer, Look, Scorer, ids, calls


def test_runs_until_all_is_current(spark, made):
    store, out, Decoder, Renderer, _, _, ids, calls = made
    r = F_.finish(store, out, Decoder(), Renderer(), chunk=5)
    assert (r.rendered, r.skipped, r.skipped_unsupported, r.errored, r.pruned) == (10, 0, 1, 2, 0)
    assert calls("decode") == [f"{i:02d}" for i in range(12)] and "07" not in calls("render")
    edits = {x["file_id"]: x for x in store["edits"].collect()}
    assert set(edits) == {ids[f"{i:02d}"] for i in range(12) if i not in (5, 7)}
    for x in edits.values():
        assert os.path.getsize(x["output_path"]) == x["output_size_bytes"] and os.path.exists(x["output_path"][:-4] + ".pp3") and not x["look_applied"]
    errors = {x["file_id"]: (x["state"], x["error"], x["content_hash"]) for x in store["develop_work"].where("error IS NOT NULL").collect()}
    assert errors == {ids["05"]: ("error", "OSError: renderer fell over", "h5"), ids["07"]: ("error", "ValueError: no such sensor", None)}
    assert store["raw_stats"].count() == 11 and store["raw_stats"].where("wb_r = 2.0").count() == 11
    # again: what is current is passed over, what failed is tried, and statistics of the same content are not measured twice
    before = calls("render"), calls("decode")
    r = F_.finish(store, out, Decoder(), Renderer(), chunk=5)
    assert (r.rendered, r.skipped, r.errored) == (0, 10, 2)
    assert sorted([*before[0], "05"]) == calls("render") and sorted([*before[1], "07"]) == calls("decode")
    # a new version of a file is measured anew, one whose output is gone is only rendered, one no longer kept goes
    store.upsert("files", spark.createDataFrame([("/in/f01.arw", "new", "arw")], "path string, content_hash string, file_format string"))
    os.remove(edits[ids["02"]]["output_path"])
    store.upsert("decisions", spark.createDataFrame([(ids["03"], "reject")], "file_id long, verdict string"))
    before = calls("render"), calls("decode")
    r = F_.finish(store, out, Decoder(), Renderer(), chunk=50)
    assert (r.rendered, r.skipped, r.errored, r.pruned) == (2, 7, 2, 2) and not os.path.exists(edits[ids["03"]]["output_path"])
    assert sorted([*before[0], "01", "02", "05"]) == calls("render") and sorted([*before[1], "01", "07"]) == calls("decode")
    assert store["edits"].where(f"file_id = {ids['03']}").count() == 0


def test_a_killed_run_goes_on_without_repeating_rows(spark, made, monkeypatch):
    store, out, Decoder, Renderer, _, _, ids, calls = made
    work_on, seen = F_.work_on, []

    def killed(*a):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return work_on(*a)

    monkeypatch.setattr(F_, "work_on", killed)
    with pytest.raises(KeyboardInterrupt):
        F_.finish(store, out, Decoder(), Renderer(), chunk=3, run="first")
    monkeypatch.setattr(F_, "work_on", work_on)
    assert calls("render") == ["00", "01", "02", "03", "04", "05"] and store["develop_work"].where("state = 'claimed'").count() == 3
    # another run leaves the claimed rows to it, and takes the others; 05 failed in another run, so it is tried
    r = F_.finish(store, out, Decoder(), Renderer(), chunk=3, run="second")
    assert (r.rendered, r.skipped, r.left_to_others, r.errored) == (3, 5, 3, 1) and calls("render") == ["00", "01", "02", "03", "04", "05", "05", "09", "10", "11"]
    # gone on with under its name, it does the rest, and doesn't try again what failed in it
    r = F_.finish(store, out, Decoder(), Renderer(), chunk=3, run="first")
    assert (r.rendered, r.errored) == (2, 2 if calls("render").count("05") == 3 else 1) and sorted(set(calls("render"))) == [f"{i:02d}" for i in range(12) if i != 7]
    assert all(calls("render").count(f"{i:02d}") == 1 for i in range(12) if i not in (5, 7))


def test_claims_of_silent_runs_lapse(spark, made):
    store, out, _, _, _, _, ids, _ = made
    rows = F_.plan(store, out, "render-1", None, 30)
    assert F_.claim(store, rows, "a", 0, lease=100, now=1000).count() == 12
    assert F_.claim(store, rows, "b", 0, lease=100, now=1050).count() == 0
    assert F_.claim(store, rows, "a", 0, lease=100, now=1050).count() == 12
    assert F_.claim(store, rows, "b", 0, lease=100, now=1200).count() == 12


def test_looks_and_the_guard(spark, made):
    store, out, Decoder, Renderer, Look, Scorer, ids, calls = made
    r = F_.finish(store, out, Decoder(), Renderer(), Look(), Scorer(), LOOK, luts=out + "-luts")
    assert r.rendered == 10
    got = {x["file_id"]: x for x in store["edits"].collect()}
    # darker is better below 130 and worse above; level 40 has no look at all
    for i in (0, 1, 3, 4, 6):
        x = got[ids[f"{i:02d}"]]
        assert x["look_applied"] and x["iqa_after"] >= x["iqa_before"] - 0.02 and x["lut_hash"]
    for i in (8, 9, 10, 11):
        assert not got[ids[f"{i:02d}"]]["look_applied"] and got[ids[f"{i:02d}"]]["lut_hash"]
    assert not got[ids["02"]]["look_applied"] and got[ids["02"]]["lut_hash"] is None and got[ids["02"]]["look_model"] == "look"
    assert os.listdir(out + "-luts") == [f"{got[ids['00']]['lut_hash']}.cube"]
    assert F_.finish(store, out, Decoder(), Renderer(), Look(), Scorer(), LOOK).rendered == 0
    assert F_.finish(store, out, Decoder(), Renderer()).rendered == 10  # without the look all are made anew


def test_a_plan_is_cut_below_its_recipes_and_rendering_is_spread(spark, made, monkeypatch):
    store, out, Decoder, Renderer, *_ = made
    assert "Join" not in F_.plan(store, out, "render-1", None, 30)._jdf.queryExecution().optimizedPlan().toString()
    parts, rendered = [], F_.rendered
    monkeypatch.setattr(F_, "rendered", lambda rows, *a: (parts.append(rows.rdd.getNumPartitions()), rendered(rows, *a))[1])
    F_.finish(store, out, Decoder(), Renderer())
    assert parts == [spark.sparkContext.defaultParallelism]


def test_a_folder_of_others_is_refused(spark, made, tmp_path):
    store, _, Decoder, Renderer, *_ = made
    (tmp_path / "photos").mkdir()
    (tmp_path / "photos/mine.jpg").write_text("x")
    with pytest.raises(PermissionError):
        F_.finish(store, str(tmp_path / "photos"), Decoder(), Renderer())
    assert F_.prune(store, str(tmp_path / "photos"), spark.createDataFrame([], "output_path string")) == 0 and (tmp_path / "photos/mine.jpg").exists()


def test_sweep_of_many_files(spark, tmp_path):
    top = tmp_path / "tree"
    n = 100_000
    for d in range(50):
        (top / f"d{d}/_keeper").mkdir(parents=True)
        for i in range(n // 50):
            (top / f"d{d}/_keeper/{'_' if i % 2 else '.' if i % 3 else ''}{i}.jpg").touch()
    expected = spark.createDataFrame([("d0/_keeper/0.jpg",), ("d3/_keeper/_1.jpg",), ("d4/none.jpg",)], "rel_path string")
    with pytest.raises(PermissionError):
        trees.sweep(expected, str(top))
    (top / trees.MARKER).touch()
    assert trees.sweep(expected, str(top)) == n - 2
    assert sorted(os.listdir(top)) == [trees.MARKER, "d0", "d3"] and os.listdir(top / "d0/_keeper") == ["0.jpg"]
    assert trees.sweep(expected, str(top)) == 0
