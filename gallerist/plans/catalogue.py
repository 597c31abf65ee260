"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.functions import expressions as X
from gallerist.operators import aggregates, calibration, decisions, develop, duplicates, joins, output, review, vectors
from gallerist.operators.graph import connected_components

from .projection import MIN_SAMPLES, Projection, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, recursive: str = ""):
    """Registers a function of the projected catalogue under its name."""

    def register(f: Callable[[Projection], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if oracle:
            _ORACLES[f.__name__] = sql(oracle, recursive=recursive)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# --- counts -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS files FROM files")
def file_count(cat):
    return cat["files"].agg(F.count("*").alias("files"))


@query("""SELECT (SELECT count(*) FROM files) AS files_count, (SELECT count(*) FROM sharpness) AS sharpness_count, (SELECT count(*) FROM embeddings) AS embeddings_count, (SELECT count(*) FROM iqa) AS iqa_count,
(SELECT count(*) FROM decisions) AS decisions_count, (SELECT count(DISTINCT group_id) FROM duplicate_members) AS duplicate_groups_count, (SELECT count(*) FROM duplicate_members) AS duplicate_members_count""")
def table_counts(cat):
    return aggregates.table_counts(cat)


@query("""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT file_id) FROM defect_flags) AS flagged_files, (SELECT count(DISTINCT group_id) FROM duplicate_members) AS duplicate_groups,
(SELECT count(*) FROM duplicate_members) AS duplicate_members, (SELECT count(*) FROM decisions) AS decided""")
def catalog_stats(cat):
    return aggregates.catalogue_stats(cat)


@query("SELECT flag_type, count(*) AS n FROM defect_flags GROUP BY flag_type")
def flag_counts(cat):
    return aggregates.flag_counts(cat["defect_flags"])


@query("SELECT count(*) AS n FROM defect_flags WHERE flag_type = 'blur'")
def count_flag(cat):
    return cat["defect_flags"].where("flag_type = 'blur'").agg(F.count("*").alias("n"))


@query("SELECT coalesce(camera_model, '(unknown)') AS camera, count(*) AS n FROM exif GROUP BY camera_model")
def per_camera_counts(cat):
    return aggregates.per_camera_counts(cat["exif"])


@query("SELECT coalesce(camera_model, '(unknown)') AS camera, coalesce(lens_model, '(unknown)') AS lens, count(*) AS n FROM exif GROUP BY camera_model, lens_model")
def per_lens_counts(cat):
    return aggregates.per_lens_counts(cat["exif"])


_DECIDED = "SELECT count(*) FILTER (verdict = 'keep') AS kept, count(*) FILTER (verdict = 'reject') AS rejected, greatest((SELECT count(*) FROM files) - count(*), 0) AS undecided FROM decisions"


@query(_DECIDED)
def decision_counts(cat):
    return aggregates.decision_counts(cat["files"], cat["decisions"])


@query(f"""SELECT kept + rejected AS decided, round(kept / (kept + rejected + undecided)::DOUBLE * 100)::INT AS kept_percent, round(rejected / (kept + rejected + undecided)::DOUBLE * 100)::INT AS rejected_percent,
round((kept + rejected) / (kept + rejected + undecided)::DOUBLE * 100)::INT AS decided_percent FROM ({_DECIDED})""")
def review_progress(cat):
    return aggregates.progress(aggregates.decision_counts(cat["files"], cat["decisions"]))


@query("""SELECT flag AS name, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM review WHERE flags <> '') GROUP BY flag
UNION ALL SELECT '(any)', count(*) FILTER (flags <> '') FROM review UNION ALL SELECT '(none)', count(*) FILTER (flags = '') FROM review UNION ALL SELECT '(dup)', count(group_id) FROM review""")
def client_flag_counts(cat):
    return aggregates.review_counts(review.review_rows(cat))


@query("SELECT count(*) AS keepers, count(*) FILTER (file_format <> 'jpg') AS raw_keepers FROM kept")
def finish_estimate(cat):
    return aggregates.finish_estimate(review.keeper_files(cat))


@query("SELECT '/lib/' || source AS folder, count(*) AS photos FROM documents GROUP BY source")
def folder_counts(cat):
    from gallerist.sources import listing

    return listing.folder_summary(cat["files"])


# --- work lists ---------------------------------------------------------------------------------------------------


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def files_needing_embedding(cat):
    return joins.missing_rows(cat["files"], cat["embeddings"]).select("id", "path")


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM iqa)")
def files_needing_iqa(cat):
    return joins.missing_rows(cat["files"], cat["iqa"]).select("id", "path")


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM exposure)")
def files_needing_defect_analysis(cat):
    return joins.missing_rows(cat["files"], cat["exposure"]).select("id", "path")


@query("SELECT id, path, id NOT IN (SELECT vec_id FROM embeddings) AS want_embedding, id NOT IN (SELECT file_id FROM iqa) AS want_iqa FROM files WHERE id NOT IN (SELECT vec_id FROM embeddings) OR id NOT IN (SELECT file_id FROM iqa)")
def work_list_union(cat):
    return joins.work_list(cat["files"], cat["embeddings"], cat["iqa"])


def _listing(files: DataFrame) -> DataFrame:
    """A later listing: every fifth file is touched, every seventh of another size, and one more for every eleventh."""
    changed = files.select("path", (F.col("mtime_ns") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("mtime_ns"), (F.col("size_bytes") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("size_bytes"))
    return changed.union(files.where("id % 11 = 0").select(F.concat("path", F.lit("_new")), "mtime_ns", "size_bytes"))


@query("""SELECT path, mtime_ns + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS mtime_ns, size_bytes + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes FROM files WHERE id % 5 = 0 OR id % 7 = 0
UNION ALL SELECT path || '_new', mtime_ns, size_bytes FROM files WHERE id % 11 = 0""")
def needs_processing(cat):
    return joins.needs_processing(_listing(cat["files"]), cat["files"]).select("path", "mtime_ns", "size_bytes")


@query("""SELECT count(*) AS pending FROM files WHERE id % 5 = 0 OR id % 7 = 0""")
def count_pending(cat):
    changed = _listing(cat["files"]).where(~F.col("path").endswith("_new"))
    return joins.needs_processing(changed, cat["files"]).agg(F.count("*").alias("pending"))


# --- review -------------------------------------------------------------------------------------------------------

_LISTED = "SELECT * EXCLUDE (captured_at) REPLACE (round(iqa_score, 6) AS iqa_score, round(max_confidence, 6) AS max_confidence) FROM review"
_ORDER = "ORDER BY max_confidence IS NOT NULL DESC, captured_at NULLS LAST, file_id"
_PAGE = "SELECT * EXCLUDE (captured_at) REPLACE (round(iqa_score, 6) AS iqa_score, round(max_confidence, 6) AS max_confidence) FROM (SELECT * FROM review {where} " + _ORDER + " LIMIT {limit} OFFSET {offset})"


@query(_PAGE.format(where="", limit=200, offset=0))
def review_list(cat):
    return _rounded(review.review_list(cat), "iqa_score", "max_confidence")


@query(_PAGE.format(where="WHERE file_id IN (SELECT file_id FROM defect_flags WHERE flag_type = 'blur')", limit=50, offset=5))
def review_list_flagged(cat):
    return _rounded(review.review_list(cat, flag_type="blur", limit=50, offset=5), "iqa_score", "max_confidence")


@query(_PAGE.format(where="WHERE verdict IS NULL", limit=100, offset=10))
def review_list_undecided(cat):
    return _rounded(review.review_list(cat, decided=False, limit=100, offset=10), "iqa_score", "max_confidence")


@query(f"{_LISTED} WHERE flags <> '' AND verdict IS NULL")
def review_filtered(cat):
    return _rounded(review.filtered(review.review_rows(cat), ("*",), undecided_only=True).drop("captured_at"), "iqa_score", "max_confidence")


@query("SELECT file_id, CASE WHEN is_keeper THEN 'keeper' ELSE coalesce(verdict, 'undecided') END AS decision FROM review")
def decision_of(cat):
    return review.review_rows(cat).select("file_id", review.decision_of(F.col("verdict"), F.col("is_keeper")).alias("decision"))


@query("SELECT file_id, path, flag_type, round(confidence, 6) AS confidence, year_month FROM entries")
def review_entries(cat):
    return _rounded(review.review_entries(cat), "confidence")


@query("""SELECT m.group_id, min(group_date) AS group_date, max(CASE WHEN is_suggested_keeper THEN path END) AS keeper, coalesce(string_agg(CASE WHEN NOT is_suggested_keeper THEN path END, '|' ORDER BY path), '') AS others
FROM duplicate_members m JOIN files ON files.id = file_id JOIN dated ON dated.group_id = m.group_id GROUP BY m.group_id""")
def groups_for_review(cat):
    return review.groups_for_review(cat).withColumn("others", F.concat_ws("|", "others"))


@query("SELECT * REPLACE (round(iqa_score, 6) AS iqa_score, round(max_confidence, 6) AS max_confidence) FROM clusters")
def clusters_for_review(cat):
    return _rounded(review.clusters_for_review(cat), "iqa_score", "max_confidence")


@query("""SELECT count(*) AS clusters, count(*) FILTER (d) AS decided, sum(n)::BIGINT AS frames, count(*) FILTER (s AND NOT d) AS eligible
FROM (SELECT group_id, bool_or(is_keeper) AS d, count(*) AS n, bool_or(is_suggested_keeper) AS s FROM clusters GROUP BY group_id)""")
def cluster_summary(cat):
    return aggregates.cluster_summary(review.clusters_for_review(cat))


@query("""SELECT count(*) AS clusters, coalesce(sum(n - 1), 0)::BIGINT AS rejections
FROM (SELECT group_id, bool_or(is_keeper) AS d, count(*) AS n, bool_or(is_suggested_keeper) AS s FROM clusters GROUP BY group_id) WHERE s AND NOT d""")
def accept_all_totals(cat):
    return aggregates.accept_all_totals(review.clusters_for_review(cat))


@query("SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY file_id) AS place, count(*) OVER (PARTITION BY group_id) AS size FROM duplicate_members")
def group_position(cat):
    return review.group_positions(cat["duplicate_members"])


@query("SELECT file_id, score, greatest(1, least(100, round(rank() OVER (ORDER BY score DESC) / (count(*) OVER ())::DOUBLE * 100)::INT)) AS top_percent FROM iqa")
def iqa_rank_pct(cat):
    return review.score_percentiles(cat["iqa"])


@query("""SELECT id, path, file_format, camera_model, captured_at, round(s_subject, 6) AS s_subject, round(clipped_highlights, 6) AS clipped_highlights, round(i.score, 6) AS score, len(embedding) AS dim,
coalesce(flags, '') AS flags, verdict, (SELECT string_agg(group_id, ',' ORDER BY group_id) FROM duplicate_members m WHERE m.file_id = id) AS group_ids
FROM files LEFT JOIN exif e ON e.file_id = id LEFT JOIN sharpness s ON s.file_id = id LEFT JOIN exposure x ON x.file_id = id LEFT JOIN iqa i ON i.file_id = id
LEFT JOIN embeddings v ON v.vec_id = id LEFT JOIN flags_by_file b ON b.file_id = id LEFT JOIN decisions d ON d.file_id = id""")
def dump_file(cat):
    d = review.file_dump(cat)
    flat = d.select(
        "id", "path", "file_format", "exif.camera_model", "exif.captured_at", "sharpness.s_subject", "exposure.clipped_highlights", "iqa.score", "embedding.dim",
        F.coalesce(F.concat_ws(",", F.transform("flags", lambda f: f["flag_type"])), F.lit("")).alias("flags"), "decisions.verdict",
        F.when(F.size("group_ids") > 0, F.concat_ws(",", F.transform("group_ids", lambda g: g.cast("string")))).alias("group_ids"),
    )
    return _rounded(flat, "s_subject", "clipped_highlights", "score")


@query()
def dump_file_json(cat):
    return review.file_dump(cat).select("id", "dump")


@query("""SELECT id, path, camera_model, captured_at, verdict, len(embedding) AS dim, string_split(flags, ',')[1] AS first_flag FROM files LEFT JOIN exif e ON e.file_id = id LEFT JOIN embeddings v ON v.vec_id = id
LEFT JOIN flags_by_file b ON b.file_id = id LEFT JOIN decisions d ON d.file_id = id""")
def dump_file_json_fields(cat):
    """Fields as a reader of the JSON finds them."""
    at = lambda path: F.get_json_object("dump", path)
    return review.file_dump(cat).select(
        at("$.id").cast("long").alias("id"), at("$.path").alias("path"), at("$.exif.camera_model").alias("camera_model"), at("$.exif.captured_at").cast("long").alias("captured_at"), at("$.decisions.verdict").alias("verdict"),
        at("$.embedding.dim").cast("long").alias("dim"), at("$.flags[0].flag_type").alias("first_flag"),
    )


@query("SELECT * FROM kept")
def keeper_files(cat):
    return review.keeper_files(cat)


@query("SELECT file_id FROM duplicate_members WHERE is_suggested_keeper")
def suggested_keepers(cat):
    return cat["duplicate_members"].where("is_suggested_keeper").select("file_id")


@query("SELECT file_id, captured_at FROM files LEFT JOIN exif ON file_id = id WHERE file_id IS NOT NULL UNION ALL SELECT id, NULL FROM files WHERE id NOT IN (SELECT file_id FROM exif)")
def captured_at_map(cat):
    return cat["files"].select(F.col("id").alias("file_id")).join(cat["exif"].select("file_id", "captured_at"), "file_id", "left")


# --- calibration --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT focal_length_mm, focal_bucket, aperture, CAST(round(log2(aperture) * 3) AS INT) AS aperture_index, round(2 ** (round(log2(aperture) * 3) / 3), 6) AS aperture_bucket FROM exif JOIN bucketed USING (file_id)")
def focal_aperture_buckets(cat):
    f, a = F.col("focal_length_mm"), F.col("aperture")
    return cat["exif"].select("focal_length_mm", X.focal_bucket(f).alias("focal_bucket"), "aperture", X.aperture_index(a).alias("aperture_index"), F.round(X.aperture_bucket(a), 6).alias("aperture_bucket")).distinct()


@query("SELECT camera_model, lens_model, focal_bucket, aperture_index, round(p10, 6) AS s_subject_p10, round(p50, 6) AS s_subject_p50, round(p90, 6) AS s_subject_p90, n AS n_samples FROM baseline")
def sharpness_baselines(cat):
    return _rounded(cat["sharpness_baseline"], "s_subject_p10", "s_subject_p50", "s_subject_p90")


@query("""SELECT camera_model, lens_model, aperture_index, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.9), 6) AS p90, count(*) AS n
FROM samples GROUP BY camera_model, lens_model, aperture_index HAVING count(*) >= 5""")
def coarse_baselines(cat):
    rows = cat["sharpness"].where("s_subject IS NOT NULL").join(calibration.bucketed(cat["exif"]).dropna(), "file_id")
    rows = rows.withColumn("s_subject", F.col("s_subject").cast("double"))
    found = aggregates.percentiles(rows, ["camera_model", "lens_model", "aperture_index"], "s_subject", {"p10": 0.1, "p90": 0.9})
    return _rounded(found.where(F.col("n") >= MIN_SAMPLES), "p10", "p90")


@query("SELECT file_id, source, round(p10, 6) AS p10, round(span_p10, 6) AS span_p10, round(span_p90, 6) AS span_p90 FROM ranged")
def baseline_fallback(cat):
    rows = cat["sharpness"].select("file_id").join(calibration.bucketed(cat["exif"]), "file_id", "left")
    found = joins.with_baseline(rows, cat["sharpness_baseline"], MIN_SAMPLES).select("file_id", "source", "p10", "span_p10", "span_p90")
    return _rounded(found, "p10", "span_p10", "span_p90")


@query("SELECT round(quantile_cont(score, 0.1), 6) AS iqa_p10 FROM iqa")
def iqa_global_p10(cat):
    return _rounded(calibration.iqa_p10(cat["iqa"]), "iqa_p10")


@query("SELECT file_id, flag_type, round(confidence, 6) AS confidence, bumped FROM soft_flags")
def calibration_reflag(cat):
    return _rounded(calibration.reflag(cat["sharpness"], cat["exif"], cat["iqa"], cat["sharpness_baseline"], MIN_SAMPLES).drop("reason"), "confidence")


@query("""SELECT count(*) FILTER (flag_type = 'blur') AS flagged_blur, count(*) FILTER (flag_type = 'back_focus') AS flagged_back_focus, count(*) FILTER (flag_type = 'low_iqa') AS flagged_low_iqa,
count(*) FILTER (bumped) AS blur_confidence_bumped FROM soft_flags""")
def calibration_report(cat):
    return calibration.calibration_report(calibration.reflag(cat["sharpness"], cat["exif"], cat["iqa"], cat["sharpness_baseline"], MIN_SAMPLES))


@query("SELECT file_id, flag_type, round(confidence, 6) AS confidence FROM exposure_flags")
def exposure_flags(cat):
    return _rounded(calibration.exposure_flags(cat["exposure"]).drop("reason"), "confidence")


@query("""SELECT file_id, 'overexposed' AS flag_type, CAST(c_custkey % 23 AS VARCHAR) || '.0% pixels at \u2265 0.99' AS reason FROM customer JOIN exposure ON file_id = c_custkey WHERE clipped_highlights > 0.05
UNION ALL SELECT file_id, 'underexposed', CAST(c_custkey % 31 AS VARCHAR) || '.0% pixels at \u2264 0.01' FROM customer JOIN exposure ON file_id = c_custkey WHERE clipped_shadows > 0.10""")
def exposure_reasons(cat):
    return calibration.exposure_flags(cat["exposure"]).select("file_id", "flag_type", "reason")


@query("""SELECT file_id, flag_type, CASE flag_type WHEN 'low_iqa' THEN printf('iqa %.2f < global p10 %.2f', round(round(score, 6), 2), round(round(q10, 6), 2))
ELSE printf('subject %.1f < p10 %.1f', round(round(s, 6), 1), round(round(p10, 6), 1)) || CASE WHEN flag_type = 'back_focus' THEN printf(', background %.1fx sharper', round(round(coalesce(bg, s) / s, 6), 1)) WHEN bumped THEN ' (confirmed by low IQA)' ELSE '' END END AS reason
FROM soft_flags JOIN judged USING (file_id)""")
def reflag_reasons(cat):
    return calibration.reflag(cat["sharpness"], cat["exif"], cat["iqa"], cat["sharpness_baseline"], MIN_SAMPLES).select("file_id", "flag_type", "reason")


@query("SELECT file_id, round(CASE WHEN s IS NULL OR span_p10 IS NULL OR span_p90 - span_p10 <= 1.1920929e-07 THEN 0.5 ELSE greatest(0.0, least(1.0, (s - span_p10) / (span_p90 - span_p10))) END, 6) AS s_relative FROM ranged WHERE file_id IN (SELECT id FROM files)")
def relative_sharpness(cat):
    rows = develop.develop_inputs(cat, MIN_SAMPLES).join(cat["sharpness"].select("file_id"), "file_id", "left_semi")
    return _rounded(rows.select("file_id", "s_relative"), "s_relative")


@query("""SELECT l_suppkey AS grp, p[1 + round((n - 1) * 0.01)::INT] AS p1, p[1 + round((n - 1) * 0.5)::INT] AS p50, p[1 + round((n - 1) * 0.99)::INT] AS p99, p[1 + round((n - 1) * 0.999)::INT] AS p999
FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS p, count(*) AS n FROM lineitem GROUP BY l_suppkey)""")
def nearest_rank_percentiles(cat):
    rows = cat.source("lineitem").select(F.col("l_suppkey").alias("grp"), "l_extendedprice")
    return aggregates.nearest_rank(rows, "grp", "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999})


@query("""SELECT grp, round(hi / t, 6) AS clipped_highlights, round(lo / t, 6) AS clipped_shadows, round(m / 255, 6) AS mean_luma, round(CASE WHEN sqrt(v) > 1e-6 THEN k / v ** 1.5 ELSE 0 END, 6) AS histogram_skew FROM (
SELECT grp, sum(n) AS t, sum(CASE WHEN x >= 253 THEN n ELSE 0 END) AS hi, sum(CASE WHEN x <= 2 THEN n ELSE 0 END) AS lo, any_value(m) AS m, sum(n * (x - m) ** 2) / sum(n) AS v, sum(n * (x - m) ** 3) / sum(n) AS k
FROM (SELECT *, sum(x * n) OVER (PARTITION BY grp) / sum(n) OVER (PARTITION BY grp) AS m FROM (
SELECT l_suppkey AS grp, least(255, l_partkey % 300)::DOUBLE AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)) GROUP BY grp)""")
def luma_histogram_moments(cat):
    rows = cat.source("lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") % 300).alias("level"))
    return _rounded(aggregates.histogram_moments(rows, "grp", "level"), "clipped_highlights", "clipped_shadows", "mean_luma", "histogram_skew")


# --- development --------------------------------------------------------------------------------------------------

_DENOISE = """CASE WHEN iso <= 100 THEN 0.0 WHEN iso <= 1600 THEN 0.3 * (log2(iso) - log2(100)) / (log2(1600) - log2(100)) WHEN iso <= 6400 THEN 0.3 + 0.3 * (log2(iso) - log2(1600)) / 2
WHEN iso <= 25600 THEN 0.6 + 0.25 * (log2(iso) - log2(6400)) / 2 ELSE least(0.98, 0.85 + 0.05 * (log2(iso) - log2(25600))) END"""


@query(f"SELECT iso, round({_DENOISE}, 6) AS strength FROM (SELECT DISTINCT (50 * (1 + doc_id % 1200))::INT AS iso FROM documents)")
def denoise_curve(cat):
    isos = cat.source("documents").select((F.lit(50) * (1 + F.col("doc_id") % 1200)).cast("int").alias("iso")).distinct()
    return _rounded(isos.withColumn("strength", X.denoise(F.col("iso"))), "strength")


_RECIPES = f"""SELECT file_id, sign(w) * greatest(abs(w) - 0.75, 0) + 0.0::DOUBLE AS exposure_ev, least(1.0, clipped_frac / 0.05) AS highlight_recovery,
greatest(0.0, least(1.0, (black_frac - 0.005) / 0.045)) * 0.5 * (1 - dn) AS shadow_lift, dn AS denoise_luma, least(1.0, dn * 1.2) AS denoise_chroma, rel * 0.8 AS sharpen_amount, lens_model IS NOT NULL AS lens_correct
FROM (SELECT r.*, e.lens_model, greatest(-3.0, least(3.0, least(log2(0.18 / p50), log2(0.95 / p99)))) AS w, {_DENOISE.replace("iso", "coalesce(e.iso, 100)")} AS dn,
CASE WHEN s IS NULL OR span_p10 IS NULL OR span_p90 - span_p10 <= 1.1920929e-07 THEN 0.5 ELSE greatest(0.0, least(1.0, (s - span_p10) / (span_p90 - span_p10))) END AS rel
FROM raw_stats r LEFT JOIN exif e USING (file_id) LEFT JOIN ranged g ON g.file_id = r.file_id)"""


@query(f"""SELECT file_id, round(exposure_ev, 6) + 0.0::DOUBLE AS exposure_ev, round(highlight_recovery, 6) AS highlight_recovery, round(shadow_lift, 6) AS shadow_lift, round(denoise_luma, 6) AS denoise_luma,
round(denoise_chroma, 6) AS denoise_chroma, round(sharpen_amount, 6) AS sharpen_amount, lens_correct FROM ({_RECIPES})""")
def decide_recipe(cat):
    rows = develop.recipes(cat, MIN_SAMPLES).select("file_id", "recipe.*")
    return _rounded(rows, *X.RECIPE)


_SHARE = lambda c: f"round(round(greatest(0, least(1, {c}))::DOUBLE, 6) * 100)::INT"


@query(f"""SELECT file_id, replace('# One photo''s settings, made by gallerist to go over the neutral profile; the next run writes them anew.~~[Exposure]~Auto=false~Compensation=' || printf('%.3f', exposure_ev)
|| '~~[HLRecovery]~' || CASE WHEN highlight_recovery > 0 THEN 'Enabled=true~Method=' || CASE WHEN highlight_recovery < 0.5 THEN 'Blend' ELSE 'Coloropp' END ELSE 'Enabled=false' END
|| '~~[Shadows & Highlights]~' || CASE WHEN shadow_lift > 0 THEN 'Enabled=true~Shadows=' || {_SHARE("shadow_lift")} || '~Highlights=0' ELSE 'Enabled=false' END || '~~[White Balance]~Enabled=true~Setting=Camera'
|| '~~[Directional Pyramid Denoising]~' || CASE WHEN denoise_luma > 0 OR denoise_chroma > 0 THEN 'Enabled=true~Method=Lab~CMethod=MAN~Luma=' || {_SHARE("denoise_luma")} || '~Chroma=' || {_SHARE("denoise_chroma")} ELSE 'Enabled=false' END
|| '~~[PostDemosaicSharpening]~' || CASE WHEN sharpen_amount > 0 THEN 'Enabled=true~AutoContrast=false~AutoRadius=false~Contrast=' || {_SHARE("sharpen_amount")} || '~DeconvRadius=0.750' ELSE 'Enabled=false' END
|| CASE WHEN lens_correct THEN '~~[LensProfile]~LcMode=lfauto~UseDistortion=true~UseVignette=true~UseCA=false~' ELSE '~' END, '~', chr(10)) AS profile FROM ({_RECIPES})""")
def profile_text(cat):
    from gallerist.functions.profile import profile_text as text

    return develop.recipes(cat, MIN_SAMPLES).select("file_id", text(F.col("recipe")).alias("profile"))


@query("SELECT a.file_id, coalesce(b.score >= a.score - 0.02, TRUE) AS passes FROM iqa a LEFT JOIN iqa b ON b.file_id = a.file_id + 1")
def guard_verdict(cat):
    after = cat["iqa"].select((F.col("file_id") - 1).alias("file_id"), F.col("score").alias("after"))
    return cat["iqa"].join(after, "file_id", "left").select("file_id", X.guard_passes(F.col("score"), F.col("after"), 0.02).alias("passes"))


@query("SELECT file_id, output_path FROM edits LEFT JOIN decisions USING (file_id) WHERE verdict IS DISTINCT FROM 'keep'")
def orphaned_edits(cat):
    return review.orphaned_edits(cat["edits"], cat["decisions"]).select("file_id", "output_path")


@query("SELECT output_path FROM edits WHERE output_path IS NOT NULL")
def all_edit_outputs(cat):
    return cat["edits"].where("output_path IS NOT NULL").select("output_path")


@query("""SELECT k.file_id, k.path, k.year_month, CASE WHEN file_format = 'jpg' THEN 'skip_unsupported' WHEN e.content_hash <> k.content_hash THEN 'measure' ELSE 'render' END AS action
FROM kept k LEFT JOIN edits e ON e.file_id = k.file_id""")
def finish_plan(cat):
    return develop.finish_plan(cat, MIN_SAMPLES, "render-1").drop("recipe")


# --- duplicates ---------------------------------------------------------------------------------------------------


@query("SELECT id, iqa_score, round(hi, 6) AS clipped_highlights, round(lo, 6) AS clipped_shadows, has_blur, has_back_focus FROM inputs")
def quality_inputs(cat):
    return _rounded(duplicates.quality_inputs(cat["files"], cat["iqa"], cat["exposure"], cat["defect_flags"]), "clipped_highlights", "clipped_shadows")


@query("SELECT id, round(quality_score, 6) AS quality_score FROM quality")
def quality_score(cat):
    return _rounded(cat["quality"], "quality_score")


@query("SELECT group_id AS component, id FROM files JOIN copies USING (content_hash)")
def exact_duplicate_groups(cat):
    return duplicates.exact_groups(cat["files"])


@query("SELECT group_id AS component, file_id AS id, round(quality_score, 6) AS quality_score, is_suggested_keeper, place FROM duplicate_members")
def keeper_election(cat):
    return _rounded(duplicates.elect(duplicates.exact_groups(cat["files"]), cat["quality"]), "quality_score")


@query("SELECT dense_rank() OVER (ORDER BY group_id) AS group_id, file_id, is_suggested_keeper, round(quality_score, 6) AS quality_score FROM duplicate_members")
def numbered_groups(cat):
    elected = duplicates.elect(duplicates.exact_groups(cat["files"]), cat["quality"])
    return _rounded(duplicates.numbered(elected)[1], "quality_score")


@query("SELECT a.file_id AS a_id, b.file_id AS b_id, abs(a.captured_at - b.captured_at) AS apart FROM exif a JOIN exif b ON a.file_id < b.file_id AND abs(a.captured_at - b.captured_at) <= 600")
def time_window_pairs(cat):
    times = cat["exif"].select(F.col("file_id").alias("id"), "captured_at")
    return joins.interval_pairs(times, "id", "captured_at", 600)


@query("SELECT a.file_id AS a_id, b.file_id AS b_id, abs(a.captured_at - b.captured_at) AS apart FROM exif a JOIN exif b ON a.file_id < b.file_id AND abs(a.captured_at - b.captured_at) <= 600")
def time_window_pairs_in_blocks(cat):
    """Every bucket is taken for a hot one: rows are cut into blocks of four in order of time."""
    return joins.interval_pairs(cat["exif"].select(F.col("file_id").alias("id"), "captured_at"), "id", "captured_at", 600, block=4)


_UNIT = "unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))"
PAIR_COSINE = 0.40


def _unit(cat) -> DataFrame:
    return cat["embeddings"].select(F.col("file_id").alias("id"), vectors.normalize(F.col("vector")).alias("vector"))


@query(f"SELECT a.id AS a, b.id AS b, round({_DOT}, 6) AS similarity FROM unit a JOIN unit b ON a.id < b.id WHERE {_DOT} >= {PAIR_COSINE}", recursive=_UNIT)
def cosine_pairs(cat):
    return _rounded(vectors.cosine_pairs(_unit(cat), PAIR_COSINE), "similarity")


_KNN = f"near AS (SELECT id, neighbour, similarity, rank FROM (SELECT a.id, b.id AS neighbour, {_DOT} AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY {_DOT} DESC, b.id) AS rank FROM unit a JOIN unit b ON a.id <> b.id) WHERE rank <= 10)"


@query("SELECT id, neighbour, round(similarity, 6) AS similarity, rank FROM near WHERE rank <= 3", recursive=f"{_UNIT}, {_KNN}")
def knn_topk(cat):
    return _rounded(vectors.knn(_unit(cat), 3), "similarity")


_EDGES = f"""edges AS (SELECT DISTINCT least(id, neighbour) AS a, greatest(id, neighbour) AS b FROM near WHERE similarity >= {PAIR_COSINE}
UNION SELECT x.file_id, y.file_id FROM exif x JOIN exif y ON x.file_id < y.file_id AND abs(x.captured_at - y.captured_at) <= 3600 JOIN unit a ON a.id = x.file_id JOIN unit b ON b.id = y.file_id WHERE {_DOT} >= 0.3)"""


def _edges(cat) -> DataFrame:
    times = cat["exif"].select(F.col("file_id").alias("id"), "captured_at")
    return vectors.similarity_edges(_unit(cat), times, 3600, 0.3, PAIR_COSINE, duplicates.DedupeConfig().k_neighbors)


@query("SELECT a, b FROM edges", recursive=f"{_UNIT}, {_KNN}, {_EDGES}")
def dedupe_edges(cat):
    return _edges(cat)


@query(
    "SELECT id, min(root) AS component FROM reach GROUP BY id",
    recursive=f"{_UNIT}, {_KNN}, {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON w.a = r.id)",
)
def dedupe_components(cat):
    return connected_components(_edges(cat))


@query("SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM unit", recursive=_UNIT)
def l2_normalized(cat):
    return _unit(cat).select("id", F.round(vectors.norm(F.col("vector")), 6).alias("length"))


# --- decisions ----------------------------------------------------------------------------------------------------


@query("""SELECT file_id, CASE WHEN k THEN 'keep' WHEN r THEN 'reject' ELSE verdict END AS verdict, CASE WHEN k THEN TRUE WHEN r THEN FALSE ELSE is_keeper END AS is_keeper
FROM (SELECT coalesce(d.file_id, m.file_id) AS file_id, verdict, is_keeper, coalesce(m.is_suggested_keeper, FALSE) AS k, coalesce(NOT m.is_suggested_keeper, FALSE) AS r
FROM decisions d FULL JOIN duplicate_members m ON m.file_id = d.file_id)""")
def pick_keeper_result(cat):
    keepers = cat["duplicate_members"].where("is_suggested_keeper").select("file_id")
    return decisions.pick_keepers(cat["decisions"], cat["duplicate_members"], keepers, 1).select("file_id", "verdict", "is_keeper")


@query("SELECT file_id, CASE WHEN file_id = 3 THEN 'reject' ELSE verdict END AS verdict, file_id <> 3 AND is_keeper AS is_keeper FROM (SELECT * FROM decisions UNION ALL SELECT 3, 'reject', FALSE WHERE 3 NOT IN (SELECT file_id FROM decisions))")
def set_decision_result(cat):
    return decisions.set_decision(cat["decisions"], 3, "reject", 1).select("file_id", "verdict", "is_keeper")


@query("SELECT file_id, verdict FROM decisions WHERE file_id NOT IN (1, 2, 3)")
def clear_decision_result(cat):
    return decisions.clear_decision(cat["decisions"], 1, 2, 3).select("file_id", "verdict")


@query("""SELECT file_id, CASE WHEN file_id IN (SELECT id FROM files WHERE id % 4 = 0) THEN 0.5 ELSE score END AS score FROM iqa UNION ALL SELECT id, 0.5 FROM files WHERE id % 4 = 0 AND id NOT IN (SELECT file_id FROM iqa)""")
def upsert_result(cat):
    new = cat["files"].where("id % 4 = 0").select(F.col("id").alias("file_id"), F.lit(0.5).alias("score"))
    return decisions.upsert(cat["iqa"], new, ["file_id"])


@query("SELECT * FROM defect_flags WHERE flag_type NOT IN ('blur', 'back_focus', 'low_iqa')".replace("*", "file_id, flag_type, round(confidence, 6) AS confidence"))
def clear_blur_flags(cat):
    """By deletes in a store."""
    from gallerist.schemas import BLUR_FLAGS

    store = _store(cat)
    store.upsert("defect_flags", cat["defect_flags"])
    store.delete_where("defect_flags", F.col("flag_type").isin(*BLUR_FLAGS))
    return _rounded(store["defect_flags"].select("file_id", "flag_type", "confidence"), "confidence")


def _store(cat):
    """A store of its own below the shared folder."""
    import uuid

    from gallerist.catalog import Catalog
    from gallerist.storage import shared_dir

    return Catalog(cat.spark, f"{shared_dir(cat.spark)}/catalogue-{uuid.uuid4().hex}")


def _stored(cat, *batches: DataFrame) -> DataFrame:
    """The files of a store of its own after an upsert of each batch."""
    store = _store(cat)
    for rows in batches:
        store.upsert("files", rows.drop("id"))
    return store["files"]


@query("""SELECT row_number() OVER (ORDER BY path) AS id, path, size_bytes + 1 AS size_bytes FROM files WHERE files.id % 2 = 0
UNION ALL SELECT (SELECT count(*) FROM files WHERE files.id % 2 = 0) + row_number() OVER (ORDER BY path), path, size_bytes + 1 FROM files WHERE files.id % 2 <> 0""")
def catalog_upsert(cat):
    later = cat["files"].withColumn("size_bytes", F.col("size_bytes") + 1)
    return _stored(cat, cat["files"].where("id % 2 = 0"), later).select("id", "path", "size_bytes")


@query("SELECT path, size_bytes + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS size_bytes, captured_at, camera_model FROM files LEFT JOIN exif ON file_id = id")
def one_commit(cat):
    """Files and their metadata in three commits over both tables; the second fails between them."""
    store, named = _store(cat), cat["exif"].join(cat["files"].select(F.col("id").alias("file_id"), "path"), "file_id").drop("file_id")

    def put(files: DataFrame, fails: bool = False) -> None:
        with store.transaction() as tx:
            tx.upsert("files", files.drop("id"))
            if fails:
                raise InterruptedError
            tx.upsert("exif", named.join(tx["files"].select(F.col("id").alias("file_id"), "path"), "path"))

    put(cat["files"].where("id % 2 = 0 OR id % 3 <> 0"))
    try:
        put(cat["files"].withColumn("size_bytes", F.lit(0)), fails=True)
    except InterruptedError:
        pass
    put(cat["files"].where("id % 3 = 0").withColumn("size_bytes", F.col("size_bytes") + 1))
    return store["files"].join(store["exif"].withColumnRenamed("file_id", "id"), "id", "left").select("path", "size_bytes", "captured_at", "camera_model")


#: Verdicts set and cleared in ten rounds of events, the last round of a file being the one that counts.
ROUNDS = 10


@query(f"""SELECT file_id, verdict, decided_at FROM (
SELECT coalesce(d.file_id, l.file_id) AS file_id, CASE WHEN l.file_id IS NULL THEN d.verdict WHEN NOT l.cleared THEN l.verdict END AS verdict, CASE WHEN l.file_id IS NULL THEN 0 ELSE l.event_id END AS decided_at
FROM decisions d FULL JOIN (
  SELECT user_id AS file_id, arg_max(CASE WHEN event_type = 'click' THEN 'keep' ELSE 'reject' END, event_id) FILTER (event_type <> 'error') AS verdict, max(event_id) FILTER (event_type <> 'error') AS event_id, bool_or(event_type = 'error') AS cleared
  FROM (SELECT *, max(event_id % {ROUNDS}) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id % {ROUNDS} = last GROUP BY user_id) l ON l.file_id = d.file_id) WHERE verdict IS NOT NULL""")
def change_log(cat):
    """Each round is one commit that sets verdicts and then clears others; the store merges and compacts what was changed."""
    store = _store(cat)
    store.replace("decisions", cat["decisions"])
    events = cat.source("events").select(F.col("user_id").alias("file_id"), "event_id", "event_type")
    for i in range(ROUNDS):
        of = events.where(F.col("event_id") % ROUNDS == i)
        verdict = F.when(F.col("event_type") == "click", "keep").otherwise("reject")
        made = of.where("event_type <> 'error'").groupBy("file_id").agg(F.max_by(verdict, "event_id").alias("verdict"), F.max("event_id").alias("decided_at"))
        with store.transaction() as tx:
            tx.upsert("decisions", made)
            tx.delete("decisions", of.where("event_type = 'error'").select("file_id"))
    return store["decisions"].select("file_id", "verdict", "decided_at")


@query("SELECT id, path, size_bytes, 5 AS version FROM files")
def migrated_store(cat):
    """Files of a store of the first version, with a log for each table, after it was opened twice."""
    import uuid

    from gallerist.catalog import Catalog
    from gallerist.storage import shared_dir

    root, spark = f"{shared_dir(cat.spark)}/catalogue-{uuid.uuid4().hex}", cat.spark
    for table, df in (("files", cat["files"]), ("raw_stats", cat["raw_stats"]), ("schema_version", spark.createDataFrame([(1,)], "version int"))):
        df.write.parquet(f"{root}/{table}/00000000-first")
        spark.createDataFrame([("00000000-first",)], "name string").coalesce(1).write.text(f"{root}/{table}/_written")
        _move_text(spark, f"{root}/{table}/_written", f"{root}/{table}/_log/00000000")
    Catalog(spark, root)
    store = Catalog(spark, root)
    if store["raw_stats"].limit(1).count():
        raise ValueError("statistics of an older version are left")
    return store["files"].join(F.broadcast(store["schema_version"]), F.lit(True)).select("id", "path", "size_bytes", "version")


def _move_text(spark: SparkSession, folder: str, to: str) -> None:
    """The one text file that Spark wrote into folder, under a name."""
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(to).getParent())
    fs.rename(part, path(to))


@query("SELECT path, file_id, captured_at, camera_model FROM files JOIN exif ON file_id = id WHERE id % 20 = 0")
def exif_by_path(cat):
    return review.exif_by_path(cat, cat["files"].where("id % 20 = 0").select("path")).select("path", "file_id", "captured_at", "camera_model")


@query("SELECT id, path, content_hash FROM files WHERE id % 20 = 0")
def lookup_files(cat):
    wanted = cat.source("events").where("event_id % 20 = 0").select(F.col("event_id").alias("file_id"))
    return review.lookup(cat, wanted)


@query("SELECT file_id, verdict, is_keeper FROM decisions WHERE file_id % 20 = 0")
def get_decisions(cat):
    return review.decisions_of(cat, cat["files"].where("id % 20 = 0").select(F.col("id").alias("file_id")))


@query("SELECT a.file_id, CASE WHEN a.score > b.score THEN 1 WHEN b.score > a.score THEN 2 END AS better FROM iqa a JOIN iqa b ON b.file_id = a.file_id + 1")
def better_index(cat):
    other = cat["iqa"].select((F.col("file_id") - 1).alias("file_id"), F.col("score").alias("theirs"))
    return cat["iqa"].join(other, "file_id").select("file_id", X.better(F.col("score"), F.col("theirs")).alias("better"))


@query("""SELECT DISTINCT (doc_id % 85)::INT AS coco, CASE WHEN doc_id % 85 = 0 THEN 'person' WHEN doc_id % 85 <= 8 THEN 'vehicle' WHEN doc_id % 85 <= 13 THEN 'object' WHEN doc_id % 85 <= 23 THEN 'animal'
WHEN doc_id % 85 <= 79 THEN 'object' ELSE 'other' END AS subject FROM documents""")
def subject_classes(cat):
    coco = (F.col("doc_id") % 85).cast("int")
    return cat.source("documents").select(coco.alias("coco"), X.subject_class(coco).alias("subject")).distinct()


@query("SELECT id, list_extract(string_split(path, '/'), -1) AS name FROM files")
def base_names(cat):
    return cat["files"].select("id", X.basename(F.col("path")).alias("name"))


# --- output -------------------------------------------------------------------------------------------------------


@query("SELECT rel_dir, original FROM tree")
def review_tree_plan(cat):
    return output.review_tree_plan(review.review_entries(cat), review.group_members(cat))


@query("SELECT rel_dir, original FROM tree WHERE rel_dir LIKE 'rejected/%'")
def review_tree_rejected(cat):
    return output.review_tree_plan(review.review_entries(cat), review.group_members(cat), ("rejected",))


_COLLIDING = "SELECT year_month AS rel_dir, path || '/IMG_' || (file_id % 40) || '.jpg' AS original, 'IMG_' || (file_id % 40) AS stem FROM kept"


def _colliding(cat) -> DataFrame:
    return review.keeper_files(cat).select(F.col("year_month").alias("rel_dir"), F.concat("path", F.lit("/IMG_"), (F.col("file_id") % 40).cast("string"), F.lit(".jpg")).alias("original"))


@query(f"SELECT rel_dir, original, stem || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.jpg' AS name FROM (SELECT *, row_number() OVER (PARTITION BY rel_dir, stem ORDER BY original) AS k FROM ({_COLLIDING}))")
def dedupe_names(cat):
    return output.unique_names(_colliding(cat))


@query("SELECT count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM kept WHERE file_id % 3 <> 1")
def copy_estimate(cat):
    kept = review.keeper_files(cat)
    plan = output.unique_names(output.keepers_plan(kept))
    times = cat["files"].select("path", "size_bytes", "mtime_ns")
    # there already: two of three, and of those every other third is older than its source
    there = plan.join(times.withColumnRenamed("path", "original"), "original").join(kept.select(F.col("path").alias("original"), "file_id"), "original").where("file_id % 3 <> 0")
    listing = there.select(F.concat_ws("/", "rel_dir", "name").alias("rel_path"), "size_bytes", (F.col("mtime_ns") - F.when(F.col("file_id") % 3 == 2, 1).otherwise(0)).alias("mtime_ns"))
    return output.copy_estimate(output.copies_needed(plan, times, listing))


@query("SELECT path || '/old' AS rel_path FROM files WHERE id % 6 = 0")
def prune_diff(cat):
    expected = cat["files"].select(F.col("path").alias("rel_path"))
    there = expected.union(cat["files"].where("id % 6 = 0").select(F.concat("path", F.lit("/old"))))
    return output.stale_copies(expected, there)


@query("SELECT id, file_format, file_format <> 'jpg' AS raw FROM files")
def file_formats(cat):
    name = F.concat("path", F.lit("."), F.when(F.col("file_format") == "jpg", F.lit("JPEG")).otherwise(F.upper("file_format")))
    fmt = X.file_format(name)
    return cat["files"].select("id", fmt.alias("file_format"), X.is_raw(fmt).alias("raw"))


@query("SELECT file_id, captured_at FROM exif")
def exif_times(cat):
    text = F.date_format(F.timestamp_seconds("captured_at"), "yyyy:MM:dd HH:mm:ss")
    return cat["exif"].select("file_id", X.exif_epoch(text).alias("captured_at"))


# --- arrays -------------------------------------------------------------------------------------------------------

_LEVEL = "list_sort(list_transform(embedding, lambda x: greatest(0.0, least(1.0, (x + 1) / 2)))::DOUBLE[])"


@query(f"""SELECT vec_id AS file_id, round(v[2], 5) AS p1, round(v[33], 5) AS p50, round(v[63], 5) AS p99, round(v[64], 5) AS p999, c / 64.0::DOUBLE AS clipped_frac, b / 64.0::DOUBLE AS black_frac
FROM (SELECT vec_id, {_LEVEL} AS v, len(list_filter(embedding, lambda x: x >= 1)) AS c, len(list_filter(embedding, lambda x: x <= -1)) AS b FROM embeddings)""")
def sensor_stats(cat):
    """Vectors of 64 as planes of eight by eight, black at -1 and white at 1."""
    from gallerist.functions import kernels

    planes = cat["embeddings"].select("file_id", F.col("vector").alias("samples"), *[F.lit(v).alias(n) for n, v in (("width", 8), ("height", 8), ("black", -1.0), ("white", 1.0), ("pattern", "RGGB"))])
    return _rounded(kernels.measure_raw(planes), "p1", "p50", "p99", "p999", digits=5).drop("illum_r", "illum_g", "illum_b")


# --- libraries ----------------------------------------------------------------------------------------------------


@query("SELECT source AS library, count(*) AS photo_count, max(doc_id) AS last_analyzed FROM documents GROUP BY source")
def library_totals(cat):
    return aggregates.library_totals(cat["files"].withColumn("last_processed", F.col("id")), F.split("path", "/")[2])


@query("""SELECT vec_id AS file_id, (list_position(embedding[5:], top) - 1)::INT AS class, round(1 / (1 + exp(-top::DOUBLE)), 5) AS confidence,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[1]::DOUBLE - embedding[3]::DOUBLE / 2)), 5) AS x
FROM (SELECT *, list_max(embedding[5:]) AS top FROM embeddings) WHERE 1 / (1 + exp(-top::DOUBLE)) >= 0.57""")
def best_class(cat):
    """Vectors of 64 as one query of a detector each: a box and the scores of sixty classes."""
    from gallerist.functions import kernels

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, v in zip(batch["file_id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                v = np.array(v, np.float64)[None]
                out += [{"file_id": i, **{k: d[k] for k in ("class", "confidence", "x")}} for d in kernels.decode_detections(v[:, 4:], v[:, :4], 0.57)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_id", pa.int64()), ("class", pa.int32()), ("confidence", pa.float64()), ("x", pa.float64())]))

    return _rounded(cat["embeddings"].mapInArrow(run, "file_id long, class int, confidence double, x double"), "confidence", "x", digits=5)




# --- files, detectors and finishing -------------------------------------------------------------------------------


def _raw_file(i: int) -> bytes:
    """A raw file with a number's metadata, in either byte order: two directories, and a preview behind them."""
    import struct
    import time

    order, preview = "<>"[i % 2], b"\xff\xd8" + bytes(8 + i % 50)
    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + value
    taken, model = time.strftime("%Y:%m:%d %H:%M:%S", time.gmtime(1_500_000_000 + 61 * i)).encode() + b"\0", f"M{i % 7}".encode() + b"\0"
    capture_at, text_at, ratio_at, preview_at = 100, 200, 240, 300
    long, short = (lambda v: struct.pack(order + "I", v)), (lambda v: struct.pack(order + "HH", v, 0))
    first = [entry(0x0103, 3, 1, short(6)), entry(0x0110, 2, len(model), model.ljust(4, b"\0")), entry(0x0111, 4, 1, long(preview_at)), entry(0x0117, 4, 1, long(len(preview))), entry(0x8769, 4, 1, long(capture_at))]
    capture = [entry(0x829D, 5, 1, long(ratio_at)), entry(0x8827, 3, 1, short(100 + i % 900)), entry(0x9003, 2, len(taken), long(text_at))]
    out = bytearray(preview_at)
    for at, part in ((0, (b"II*\0" if order == "<" else b"MM\0*") + long(8)), (text_at, taken), (ratio_at, long(14 + i % 200) + long(10))):
        out[at : at + len(part)] = part
    for at, entries in ((8, first), (capture_at, capture)):
        body = struct.pack(order + "H", len(entries)) + b"".join(entries)
        out[at : at + len(body)] = body
    return bytes(out) + preview


@query("""SELECT path, 'M' || (id % 7) AS camera_model, 1500000000 + 61 * id AS captured_at, (100 + id % 900)::INT AS iso, round((14 + id % 200) / 10.0::DOUBLE, 6) AS aperture, (10 + id % 50)::BIGINT AS preview_bytes FROM files""")
def raw_headers(cat):
    """Metadata and previews of a raw file for each file, its bytes made from its number."""
    from gallerist.sources import exif, raw

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([_raw_file(i) for i in batch["id"].to_pylist()], pa.binary())], names=["path", "content"])

    made = cat["files"].select("id", "path").mapInArrow(run, "path string, content binary")
    shown = raw.embedded_previews(made).select("path", F.length("preview").cast("long").alias("preview_bytes"))
    return _rounded(exif.exif_rows(made).join(shown, "path").select("path", "camera_model", "captured_at", "iso", "aperture", "preview_bytes"), "aperture")


class LeftHalf:
    """A detector that takes the left half of any picture for the subject."""

    name = "left-half"

    def detect(self, rgb) -> list[dict]:
        return [{"class": 0, "confidence": 1.0, "x": 0.0, "y": 0.0, "w": 0.5, "h": 1.0}]


@query("""SELECT vec_id AS file_id, round(var_pop(l), 4) AS s_global, round(var_pop(l) FILTER (x <= 4), 4) AS s_subject, round(var_pop(l) FILTER (x > 4), 4) AS s_background, 'left-half' AS detector_used FROM (
SELECT vec_id, x, g[8 * y + x - 7] + g[8 * y + x + 9] + g[8 * y + x] + g[8 * y + x + 2] - 4 * g[8 * y + x + 1] AS l
FROM (SELECT vec_id, list_transform(embedding, lambda v: floor(greatest(0.0, least(1.0, (v::DOUBLE + 1) / 2)) * 255)) AS g FROM embeddings), range(1, 7) a(x), range(1, 7) b(y)) GROUP BY vec_id""")
def detector_regions(cat):
    """Vectors of 64 as grey pictures of eight by eight, measured inside and outside of a detector's box."""
    from gallerist.functions import kernels

    level = F.transform("vector", lambda v: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 1) / 2)) * 255)), 2, "0"))
    image = F.struct(F.col("file_id").cast("string").alias("origin"), *[F.lit(v).alias(n) for n, v in (("height", 8), ("width", 8), ("nChannels", 1), ("mode", 0))], F.unhex(F.array_join(level, "")).alias("data"))
    rows = kernels.measure_images(cat["embeddings"].select(image.alias("image")), detector=LeftHalf())
    return _rounded(rows.select(F.col("path").cast("long").alias("file_id"), "s_global", "s_subject", "s_background", "detector_used"), "s_global", "s_subject", "s_background", digits=4)


class EvenPlane:
    """A decoder whose sensor planes are of one level, told from the number in a path."""

    def decode(self, path: str) -> dict:
        import numpy as np

        return {"plane": np.full((4, 4), (int(path.rsplit("_", 1)[1]) % 97 + 1) / 100, np.float32), "pattern": "RGGB", "black": 0.0, "white": 1.0}


class PlainPicture:
    """A renderer that makes a small picture, and none of every eleventh file."""

    name = "plain-1"

    def render(self, path: str, profile: str):
        import numpy as np

        i = int(path.rsplit("_", 1)[1])
        if i % 11 == 0:
            raise ValueError("out of ink")
        return np.full((2, 2, 3), i % 256, np.uint8)


@query(f"""SELECT file_id, CASE WHEN file_id % 11 = 0 THEN 'error' ELSE 'done' END AS state, CASE WHEN file_id % 11 = 0 THEN 'ValueError: out of ink' END AS error, level,
CASE WHEN file_id % 11 <> 0 THEN round(sign(w) * greatest(abs(w) - 0.75, 0), 3) + 0.0::DOUBLE END AS exposure_ev, CASE WHEN file_id % 11 <> 0 THEN round(dn, 3) END AS denoise_luma, CASE WHEN file_id % 11 <> 0 THEN round(rel * 0.8, 3) END AS sharpen_amount
FROM (SELECT k.file_id, round((k.file_id % 97 + 1) / 100.0::DOUBLE, 4) AS level, greatest(-3.0, least(3.0, least(log2(0.18 / ((k.file_id % 97 + 1) / 100.0::DOUBLE)), log2(0.95 / ((k.file_id % 97 + 1) / 100.0::DOUBLE))))) AS w, {_DENOISE.replace("iso", "coalesce(e.iso, 100)")} AS dn,
CASE WHEN s IS NULL OR span_p10 IS NULL OR span_p90 - span_p10 <= 1.1920929e-07 THEN 0.5 ELSE greatest(0.0, least(1.0, (s - span_p10) / (span_p90 - span_p10))) END AS rel
FROM kept k LEFT JOIN exif e USING (file_id) LEFT JOIN ranged g ON g.file_id = k.file_id WHERE file_format <> 'jpg')""")
def finished_files(cat):
    """All kept raw files measured, decided on and rendered by stand-ins, twice: the second run only tries again what failed."""
    from gallerist import finish
    from gallerist.storage import shared_dir

    store = _store(cat)
    with store.transaction() as tx:
        for t in ("files", "exif", "sharpness", "decisions", "sharpness_baseline"):
            tx.replace(t, cat[t])
    root = f"/{shared_dir(cat.spark).removeprefix('file:').strip('/')}/finished-{store.root.rsplit('-', 1)[1]}"
    for _ in range(2):
        finish.finish(store, root, EvenPlane(), PlainPicture(), min_samples=MIN_SAMPLES, chunk=100_000)
    rows = store["develop_work"].select("file_id", "state", "error").join(store["raw_stats"].select("file_id", F.col("p50").alias("level")), "file_id")
    rows = rows.join(store["edits"].select("file_id", "exposure_ev", "denoise_luma", "sharpen_amount"), "file_id", "left")
    return _rounded(_rounded(rows, "level", digits=4), "exposure_ev", "denoise_luma", "sharpen_amount", digits=3)
