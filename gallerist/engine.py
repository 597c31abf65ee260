"""One library of photos: scan, calibrate, deduplicate, review, decide, and write trees."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import finish, models
from .catalog import Catalog
from .functions import kernels
from .operators import aggregates, calibration, decisions, develop, duplicates, joins, output, review
from .schemas import BLUR_FLAGS, SCHEMAS
from .sinks import trees
from .sinks.cache import ContentCache
from .sources import content, listing
from .sources.config import Config
from .storage import drop_written, written
from .streaming.ingest import take_in


def library_key(folder: str) -> str:
    """The name of a library's store: a hash of the real path."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(os.path.realpath(folder).encode())


class Engine:
    """The library of a folder, its catalogue below store; on_step(stage) is told what runs."""

    def __init__(self, spark: SparkSession, folder: str, store: str, cfg: Config = Config(), on_step: Callable[[str], None] = lambda stage: None):
        self.spark, self.folder, self.cfg, self.on_step = spark, os.path.realpath(folder), cfg, on_step
        self.catalog = Catalog(spark, f"{store}/{library_key(folder)}")
        self.catalog.set_library_meta(self.folder, int(time.time()))

    def _all_files(self) -> DataFrame:
        return listing.list_files(self.spark, self.folder, self.cfg.ingest.follow_symlinks)

    def _photos(self, found: DataFrame) -> DataFrame:
        return listing.without_sidecars(listing.ingestable(found, self.folder, self.cfg.ingest.extensions))

    def count_pending(self) -> int:
        return joins.needs_processing(self._photos(self._all_files()), self.catalog["files"]).count()

    def scan(self, detector: models.Detector | None = None) -> dict[str, int]:
        """Takes in new and changed files and measures those without measures; other files are listed and not opened."""
        self.on_step("ingest")
        found = self._all_files()
        photos = self._photos(found)
        total = photos.count()
        taken = take_in(self.catalog, photos, int(time.time()))
        self._flag_sidecars(found)
        self.on_step("defects")
        measured, failed = self.analyze_defects(detector)
        self.catalog.set_last_analyzed(int(time.time()))
        return {"processed": taken, "skipped": total - taken, "measured": measured, "errored": failed}

    def _flag_sidecars(self, found: DataFrame) -> None:
        """Puts in the flag where it has changed."""
        with self.catalog.transaction() as tx:
            files = tx["files"].withColumnRenamed("has_sidecar_jpg", "had")
            changed = written(listing.with_sidecar_flag(files, found).where(~F.col("had").eqNullSafe(F.col("has_sidecar_jpg"))).select("path", "has_sidecar_jpg"), "sidecars")
            if changed.limit(1).count():
                tx.upsert("files", changed, ["has_sidecar_jpg"])
        drop_written(changed)

    def analyze_defects(self, detector: models.Detector | None = None) -> tuple[int, int]:
        """(measured, unreadable) files without sharpness; raw files need a decoder and are left for it."""
        todo = joins.missing_rows(self.catalog["files"], self.catalog["sharpness"]).where("file_format = 'jpg'").select(F.col("id").alias("file_id"), "path")
        with content.pictures(todo) as images:
            rows = written(kernels.measure_images(images.where("image.height > 0"), self.cfg.defect.blur, detector).where("error IS NULL").withColumn("file_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long")), "measured")
        n = rows.count()
        unreadable = todo.count() - n
        if n:
            e = self.cfg.defect.exposure
            flags = calibration.exposure_flags(rows, e.clipped_highlights_threshold, e.clipped_shadows_threshold)
            with self.catalog.transaction() as tx:
                tx.upsert("sharpness", rows)
                tx.upsert("exposure", rows)
                tx.upsert("defect_flags", flags, ["confidence", "reason"])
        drop_written(rows)
        return n, unreadable

    def calibrate(self) -> dict[str, int]:
        """Builds baselines anew and flags all files by them; exposure flags stay."""
        self.on_step("calibrate")
        blur = self.cfg.defect.blur
        with self.catalog.transaction() as tx:
            cleared = tx.delete_where("defect_flags", F.col("flag_type").isin(*BLUR_FLAGS))
            built = calibration.sharpness_baselines(tx["sharpness"], tx["exif"], blur.min_samples_for_bucket)
            tx.replace("sharpness_baseline", built.withColumn("aperture_bucket", F.pow(F.lit(2.0), F.col("aperture_index") / 3)).withColumn("last_updated", F.lit(int(time.time()))))
            flags = calibration.reflag(tx["sharpness"], tx["exif"], tx["iqa"], tx["sharpness_baseline"], blur.min_samples_for_bucket, blur.iqa_second_opinion)
            flags = written(flags, "flags")
            tx.upsert("defect_flags", flags, ["confidence", "reason"])
        report = calibration.calibration_report(flags).first().asDict()
        return report | {"flags_cleared": cleared, "buckets_built": self.catalog["sharpness_baseline"].where("camera_model <> '*'").count()}

    def dedupe(self) -> dict[str, int]:
        """Builds the groups of similar files anew."""
        self.on_step("dedupe")
        cat = self.catalog
        scores = duplicates.quality_scores(duplicates.quality_inputs(cat["files"], cat["iqa"], cat["exposure"], cat["defect_flags"]))
        members = duplicates.run_dedupe(cat["files"], cat["embeddings"], cat["exif"], scores, self.cfg.dedupe)
        with cat.transaction() as tx:
            tx.replace("duplicate_members", members)
            members = tx["duplicate_members"]
            groups = members.select(F.col("group_id").alias("id")).distinct().withColumn("method", F.lit(duplicates.METHOD)).withColumn("created_at", F.lit(int(time.time())))
            tx.replace("duplicate_groups", groups)
        return {"groups": cat["duplicate_groups"].count(), "members": members.count(), "keepers": members.where("is_suggested_keeper").count()}

    def analyze(self) -> dict[str, dict]:
        return {"scan": self.scan(), "calibrate": self.calibrate(), "dedupe": self.dedupe()}

    # reads
    def review_list(self, **filters) -> DataFrame:
        return review.review_list(self.catalog, **filters)

    def clusters(self) -> DataFrame:
        return review.clusters_for_review(self.catalog)

    def groups(self) -> DataFrame:
        return review.groups_for_review(self.catalog)

    def file(self, file_id: int) -> DataFrame:
        return review.file_dump(self.catalog).where(F.col("id") == file_id)

    def lookup(self, *file_ids: int) -> DataFrame:
        """(id, path, content_hash) of some files."""
        return review.lookup(self.catalog, self.spark.createDataFrame([(i,) for i in file_ids], "file_id long"))

    def stats(self) -> dict[str, DataFrame]:
        cat = self.catalog
        return {
            "catalogue": aggregates.catalogue_stats(cat), "flags": aggregates.flag_counts(cat["defect_flags"]), "cameras": aggregates.per_camera_counts(cat["exif"]),
            "lenses": aggregates.per_lens_counts(cat["exif"]), "decisions": aggregates.decision_counts(cat["files"], cat["decisions"]),
        }

    # decisions
    def decide(self, file_id: int, verdict: str, note: str | None = None) -> None:
        self.catalog.upsert("decisions", decisions.decision_row(self.spark, file_id, verdict, int(time.time()), note))

    def undecide(self, *file_ids: int) -> None:
        self.catalog.delete("decisions", self.spark.createDataFrame([(i,) for i in file_ids], "file_id long").coalesce(1))

    def _keep(self, members: DataFrame, keepers: DataFrame) -> None:
        self.catalog.upsert("decisions", decisions.keeper_rows(members, keepers, int(time.time())), decisions.KEEPER_COLUMNS)

    def pick_keeper(self, *file_ids: int) -> None:
        self._keep(self.catalog["duplicate_members"], self.spark.createDataFrame([(i,) for i in file_ids], "file_id long"))

    def accept_all(self) -> None:
        """Picks the suggested keeper of every group without a keeper."""
        members = self.catalog["duplicate_members"]
        decided = members.join(self.catalog["decisions"].where("is_keeper").select("file_id"), "file_id", "left_semi").select("group_id").distinct()
        self._keep(members, members.where("is_suggested_keeper").join(decided, "group_id", "left_anti").select("file_id"))

    # trees
    def review_tree(self, root: str, include: tuple[str, ...] = (), regenerate: bool = False) -> trees.CopyReport:
        plan = output.review_tree_plan(review.review_entries(self.catalog), review.group_members(self.catalog), include)
        return trees.materialize(plan, root, trees.review_readme(), regenerate)

    def export_keepers(self, root: str, regenerate: bool = False) -> trees.CopyReport:
        return trees.materialize(output.keepers_plan(review.keeper_files(self.catalog)), root, "This folder holds copies of kept photos.\n", regenerate)

    def _estimate(self, plan: DataFrame, root: str) -> DataFrame:
        """(files, bytes) that copying a plan below root would write now."""
        sources = self.catalog["files"].select("path", "size_bytes", "mtime_ns")
        return output.copy_estimate(output.copies_needed(output.unique_names(plan), sources, trees.listing(self.spark, root)))

    def estimate_review_tree(self, root: str, include: tuple[str, ...] = ()) -> DataFrame:
        return self._estimate(output.review_tree_plan(review.review_entries(self.catalog), review.group_members(self.catalog), include), root)

    def estimate_keepers(self, root: str) -> DataFrame:
        return self._estimate(output.keepers_plan(review.keeper_files(self.catalog)), root)

    def cache_previews(self) -> int:
        """Previews of files whose content has none yet, under the hash of the content; the number of contents there are then."""
        cache = ContentCache(self.spark, f"{self.catalog.root}/cache")
        todo = cache.missing(self.catalog["files"].where("file_format = 'jpg'").select("content_hash", "path", F.col("id").alias("file_id")))
        with content.pictures(todo) as images:
            made = kernels.previews(images, self.cfg.ingest.preview_max_long_edge).withColumn("file_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long"))
            cache.add(made.select("file_id", "bytes").join(todo, "file_id"))
        return cache.read().count()

    def analyze_models(self, embedder: models.Embedder | None = None, scorer: models.Scorer | None = None) -> dict[str, int]:
        """Vectors and scores of files that lack them, by models given as plug-ins; either may be missing."""
        self.on_step("models")
        work = joins.work_list(self.catalog["files"], self.catalog["embeddings"], self.catalog["iqa"])
        with content.pictures(work.select(F.col("id").alias("file_id"), "path")) as images:
            found = written(models.infer(images, embedder, scorer), "models")
        out = {"embedded": 0, "scored": 0}
        if embedder:
            vectors = joins.missing_rows(found.where("vector IS NOT NULL"), self.catalog["embeddings"], "file_id")
            out["embedded"] = vectors.count()
        if scorer:
            scores = joins.missing_rows(found.where("score IS NOT NULL"), self.catalog["iqa"], "file_id")
            out["scored"] = scores.count()
        with self.catalog.transaction() as tx:
            if out["embedded"]:
                tx.upsert("embeddings", vectors.select("file_id", F.lit(embedder.name).alias("model"), "vector"))
            if out["scored"]:
                tx.upsert("iqa", scores.select("file_id", F.lit(scorer.name).alias("model"), "score"))
        return out

    def prune_finished(self, root: str) -> int:
        """Removes edits of files that aren't kept any more, and what else is below root that no edit of a kept file records."""
        kept = self.catalog["edits"].join(self.catalog["decisions"].where("verdict = 'keep'").select("file_id"), "file_id", "left_semi")
        return finish.prune(self.catalog, root, kept.where("output_path IS NOT NULL").select("output_path"))

    def finish(self, root: str, decoder: models.RawDecoder, renderer: models.Renderer, look: models.LookPredictor | None = None, scorer: models.Scorer | None = None, **options) -> finish.FinishReport:
        """Finishes the kept raw files into root, by a decoder and a renderer given as plug-ins."""
        luts = os.path.join(self.catalog.root.removeprefix("file://"), "cache", "luts") if "://" not in self.catalog.root.removeprefix("file://") else None
        return finish.finish(self.catalog, root, decoder, renderer, look, scorer, self.cfg.develop, self.cfg.defect.blur.min_samples_for_bucket, luts=luts, on_step=self.on_step, **options)

    def finish_plan(self, renderer: str = "external") -> DataFrame:
        """What finishing would do with each kept file; rendering itself is left to a renderer given the profile."""
        from .functions.profile import profile_text

        plan = develop.finish_plan(self.catalog, self.cfg.defect.blur.min_samples_for_bucket, renderer)
        return plan.withColumn("profile", F.when(F.col("action") == "render", profile_text(F.col("recipe"))))


def read_any(spark: SparkSession, store: str) -> DataFrame:
    """(folder_path, created_at, last_analyzed) of all libraries below store, the latest analysed first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/*/library_meta")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    metas = [Catalog(spark, f.getPath().getParent().toString())["library_meta"] for f in found]
    out = spark.createDataFrame([], SCHEMAS["library_meta"])
    for m in metas:
        out = out.unionByName(m)
    return out.orderBy(F.desc_nulls_last("last_analyzed"))


def find_library(spark: SparkSession, store: str, path: str) -> str | None:
    """The nearest folder above a file that has a library."""
    folder = os.path.dirname(os.path.realpath(path))
    while True:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{library_key(folder)}/library_meta")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return folder
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def doctor(spark: SparkSession, store: str) -> list[tuple[str, bool, str]]:
    """(what, fine, more) of checks on the session and the store."""
    checks = [("spark", True, spark.version), ("time zone", spark.conf.get("spark.sql.session.timeZone") == "UTC", spark.conf.get("spark.sql.session.timeZone"))]
    named = spark.conf.get("spark.checkpoint.dir", None)
    checks.append(("shared folder", named is not None, named or "spark.checkpoint.dir is unset"))
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/.probe")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.create(at, True).close()
        fs.delete(at, False)
        checks.append(("store", True, store))
    except Exception as e:  # whatever the file system reports is the answer
        checks.append(("store", False, str(e).splitlines()[0]))
    return checks


__all__ = ["Engine", "doctor", "find_library", "library_key", "read_any"]
