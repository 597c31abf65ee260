"""A catalogue projected from the driver's tables, in DataFrames and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gallerist.operators import calibration, duplicates

MIN_SAMPLES = 5


class Projection(dict):
    """Tables by name, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = out = getattr(self, f"_{name}")()
        return out

    def __contains__(self, name) -> bool:
        return hasattr(self, f"_{name}")

    def _files(self) -> DataFrame:
        d = self.source("documents")
        formats = F.element_at(F.array(*map(F.lit, ("arw", "cr3", "cr2", "nef", "raf", "rw2", "dng", "jpg", "jpg"))), (F.col("doc_id") % 9 + 1).cast("int"))
        return d.select(
            F.col("doc_id").alias("id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string")).alias("path"),
            F.md5(F.col("text").cast("binary")).alias("content_hash"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") * 1000).alias("mtime_ns"), formats.alias("file_format"),
        )

    def _exif(self) -> DataFrame:
        """Of every event but signups, which stand for files without metadata."""
        return self.source("events").where("event_type <> 'signup'").select(
            F.col("event_id").alias("file_id"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("captured_at"),
            F.nullif("event_type", F.lit("error")).alias("camera_model"), F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")).alias("lens_model"),
            (F.lit(10) + F.col("event_id") % 600).cast("double").alias("focal_length_mm"), (F.lit(1) + F.pmod(F.floor("value"), F.lit(20))).cast("double").alias("aperture"),
            (F.lit(100) * F.pow(F.lit(2.0), F.col("event_id") % 9)).cast("int").alias("iso"),
        )

    def _sharpness(self) -> DataFrame:
        return self.source("part").select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_size") != 1, F.col("p_retailprice")).alias("s_subject"), (F.col("p_retailprice") * (F.col("p_size") % 4)).alias("s_background"))

    def _exposure(self) -> DataFrame:
        """Of the customers of all segments but one, whose files aren't measured yet."""
        return self.source("customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 23 / 100.0).alias("clipped_highlights"), (F.col("c_custkey") % 31 / 100.0).alias("clipped_shadows"))

    def _iqa(self) -> DataFrame:
        """Of the orders that aren't pending."""
        return self.source("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_id"), (F.floor("o_totalprice").cast("long") % 1000 / 1000.0).alias("score"))

    def _embeddings(self) -> DataFrame:
        return self.source("embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"))

    def _decisions(self) -> DataFrame:
        kept = F.col("quality") == 1
        return self.source("labels").select(F.col("doc_id").alias("file_id"), F.when(kept, "keep").otherwise("reject").alias("verdict"), (kept & (F.col("toxic") == 0)).alias("is_keeper"), F.lit(None).cast("string").alias("note"), F.lit(0).cast("long").alias("decided_at"))

    def _sharpness_baseline(self) -> DataFrame:
        return calibration.sharpness_baselines(self["sharpness"], self["exif"], MIN_SAMPLES)

    def _defect_flags(self) -> DataFrame:
        soft = calibration.reflag(self["sharpness"], self["exif"], self["iqa"], self["sharpness_baseline"], MIN_SAMPLES)
        return soft.drop("bumped", "reason").unionByName(calibration.exposure_flags(self["exposure"]).drop("reason"))

    def _quality(self) -> DataFrame:
        return duplicates.quality_scores(duplicates.quality_inputs(self["files"], self["iqa"], self["exposure"], self["defect_flags"]))

    def _duplicate_members(self) -> DataFrame:
        """Exact copies, their groups named after the smallest id."""
        elected = duplicates.elect(duplicates.exact_groups(self["files"]), self["quality"])
        return elected.select(F.col("component").alias("group_id"), F.col("id").alias("file_id"), "is_suggested_keeper", "quality_score")

    def _duplicate_groups(self) -> DataFrame:
        return self["duplicate_members"].select(F.col("group_id").alias("id")).distinct()

    def _raw_stats(self) -> DataFrame:
        """Levels of a file from its number: percentiles and clipping that cross every threshold."""
        i = F.col("doc_id")
        return self.source("documents").select(
            i.alias("file_id"), ((i % 97 + 1) / 100.0).alias("p50"), ((i % 89 + 11) / 100.0).alias("p99"), ((i % 13) / 200.0).alias("clipped_frac"), ((i % 17) / 300.0).alias("black_frac")
        )

    def _edits(self) -> DataFrame:
        """Edits of every third file, some of them of other content or without an output."""
        f = self["files"].where("id % 3 = 0")
        return f.select(
            F.col("id").alias("file_id"), F.when(F.col("id") % 12 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("r").alias("recipe_hash"), F.lit("decide-3").alias("decider_version"),
            F.lit("render-1").alias("renderer"), F.lit(None).cast("string").alias("look_model"), F.lit(None).cast("string").alias("look_version"),
            F.when(F.col("id") % 2 == 0, F.concat(F.lit("/out/"), F.col("id").cast("string"))).alias("output_path"), F.col("size_bytes").alias("output_size_bytes"),
        )


_FOCAL = """CASE WHEN focal_length_mm <= 16 THEN 14 WHEN focal_length_mm <= 21 THEN 18 WHEN focal_length_mm <= 26 THEN 24 WHEN focal_length_mm <= 31.5 THEN 28
    WHEN focal_length_mm <= 42.5 THEN 35 WHEN focal_length_mm <= 60 THEN 50 WHEN focal_length_mm <= 77.5 THEN 70 WHEN focal_length_mm <= 95 THEN 85
    WHEN focal_length_mm <= 120 THEN 105 WHEN focal_length_mm <= 167.5 THEN 135 WHEN focal_length_mm <= 250 THEN 200 WHEN focal_length_mm <= 350 THEN 300
    WHEN focal_length_mm <= 500 THEN 400 WHEN focal_length_mm IS NOT NULL THEN 600 END"""

_CTES = {
    "files": """SELECT doc_id AS id, '/lib/' || source || '/' || lang || '_' || doc_id AS path, md5(text) AS content_hash, n_chars AS size_bytes, doc_id * 1000 AS mtime_ns,
    ['arw', 'cr3', 'cr2', 'nef', 'raf', 'rw2', 'dng', 'jpg', 'jpg'][(doc_id % 9 + 1)::INT] AS file_format FROM documents""",
    "exif": """SELECT event_id AS file_id, CAST(floor(epoch(ts)) AS BIGINT) AS captured_at, nullif(event_type, 'error') AS camera_model, 'L' || (user_id % 4) AS lens_model,
    (10 + event_id % 600)::DOUBLE AS focal_length_mm, (1 + ((CAST(floor(value) AS BIGINT) % 20) + 20) % 20)::DOUBLE AS aperture, (100 * 2 ** (event_id % 9))::INT AS iso
    FROM events WHERE event_type <> 'signup'""",
    "sharpness": """SELECT p_partkey AS file_id, CASE WHEN p_size <> 1 THEN p_retailprice END AS s_subject, p_retailprice * (p_size % 4) AS s_background
    FROM part""",
    "exposure": """SELECT c_custkey AS file_id, (c_custkey % 23) / 100.0::DOUBLE AS clipped_highlights, (c_custkey % 31) / 100.0::DOUBLE AS clipped_shadows
    FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "iqa": """SELECT o_orderkey AS file_id, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0::DOUBLE AS score
    FROM orders WHERE o_orderstatus <> 'P'""",
    "decisions": "SELECT doc_id AS file_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS verdict, quality = 1 AND toxic = 0 AS is_keeper FROM labels",
    "bucketed": f"""SELECT file_id, camera_model, lens_model, {_FOCAL} AS focal_bucket, CAST(round(log2(aperture) * 3) AS INT) AS aperture_index FROM exif""",
    "samples": """SELECT b.*, s_subject AS s FROM bucketed b JOIN sharpness USING (file_id)
    WHERE s_subject IS NOT NULL AND camera_model IS NOT NULL AND lens_model IS NOT NULL AND focal_bucket IS NOT NULL AND aperture_index IS NOT NULL""",
    "baseline": """SELECT camera_model, lens_model, focal_bucket, aperture_index, quantile_cont(s, 0.1) AS p10, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90, count(*)::INT AS n
    FROM samples GROUP BY ALL HAVING count(*) >= 5
    UNION ALL SELECT '*', '*', 0, 0, quantile_cont(s, 0.1), quantile_cont(s, 0.5), quantile_cont(s, 0.9), count(*)::INT FROM samples HAVING count(*) > 0""",
    "ranged": """SELECT s.file_id, s_subject AS s, s_background AS bg, score, b.camera_model, b.lens_model, b.focal_bucket, b.aperture_index, coalesce(o.p10, g.p10) AS p10,
    CASE WHEN o.p90 - o.p10 > 1.1920929e-07 THEN o.p10 ELSE g.p10 END AS span_p10, CASE WHEN o.p90 - o.p10 > 1.1920929e-07 THEN o.p90 ELSE g.p90 END AS span_p90,
    CASE WHEN o.p10 IS NOT NULL THEN 'bucket' WHEN g.p10 IS NOT NULL THEN 'global' END AS source,
    (SELECT quantile_cont(score, 0.1) FROM iqa) AS q10
    FROM sharpness s LEFT JOIN bucketed b USING (file_id) LEFT JOIN iqa USING (file_id)
    LEFT JOIN baseline o ON o.camera_model = b.camera_model AND o.lens_model = b.lens_model AND o.focal_bucket = b.focal_bucket AND o.aperture_index = b.aperture_index
    LEFT JOIN (SELECT * FROM baseline WHERE camera_model = '*') g ON TRUE""",
    "judged": """SELECT *, s < p10 AS soft, s < p10 AND s > 0 AND coalesce(bg, s) > 2 * s AS behind, coalesce(score < q10, FALSE) AS poor,
    greatest(0.01, least(1.0, (p10 - s) / p10)) AS c_soft, greatest(0.01, least(1.0, (q10 - score) / q10)) AS c_poor FROM ranged WHERE s IS NOT NULL AND p10 IS NOT NULL""",
    "soft_flags": """SELECT file_id, 'back_focus' AS flag_type, c_soft AS confidence, FALSE AS bumped FROM judged WHERE behind
    UNION ALL SELECT file_id, 'blur', CASE WHEN poor THEN least(c_soft + 0.2, 1.0) ELSE c_soft END, poor FROM judged WHERE soft AND NOT behind
    UNION ALL SELECT file_id, 'low_iqa', c_poor, FALSE FROM judged WHERE poor""",
    "exposure_flags": """SELECT file_id, 'overexposed' AS flag_type, least(clipped_highlights / 0.05, 1.0) AS confidence FROM exposure WHERE clipped_highlights > 0.05
    UNION ALL SELECT file_id, 'underexposed', least(clipped_shadows / 0.10, 1.0) FROM exposure WHERE clipped_shadows > 0.10""",
    "defect_flags": "SELECT file_id, flag_type, confidence FROM soft_flags UNION ALL SELECT * FROM exposure_flags",
    "inputs": """SELECT f.id, score AS iqa_score, coalesce(clipped_highlights, 0) AS hi, coalesce(clipped_shadows, 0) AS lo, coalesce(b, FALSE) AS has_blur, coalesce(k, FALSE) AS has_back_focus
    FROM files f LEFT JOIN iqa ON iqa.file_id = f.id LEFT JOIN exposure x ON x.file_id = f.id
    LEFT JOIN (SELECT file_id, bool_or(flag_type = 'blur') AS b, bool_or(flag_type = 'back_focus') AS k FROM defect_flags GROUP BY file_id) d ON d.file_id = f.id""",
    "quality": """SELECT id, coalesce(iqa_score, 0) - CASE WHEN has_blur THEN 0.3 ELSE 0 END - CASE WHEN has_back_focus THEN 0.2 ELSE 0 END - greatest(hi, lo) * 0.2 AS quality_score FROM inputs""",
    "copies": "SELECT content_hash, min(id) AS group_id FROM files GROUP BY content_hash HAVING count(*) > 1",
    "duplicate_members": """SELECT group_id, id AS file_id, quality_score, row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, id) AS place,
    row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, id) = 1 AS is_suggested_keeper FROM files JOIN copies USING (content_hash) JOIN quality USING (id)""",
    "flags_by_file": "SELECT file_id, string_agg(flag_type, ',' ORDER BY flag_type) AS flags, max(confidence) AS max_confidence FROM defect_flags GROUP BY file_id",
    "review": """SELECT f.id AS file_id, f.path, f.content_hash, coalesce(strftime(make_timestamp(captured_at * 1000000), '%Y-%m'), 'unknown-date') AS year_month, i.score AS iqa_score,
    coalesce(flags, '') AS flags, max_confidence, group_id, verdict, coalesce(is_keeper, FALSE) AS is_keeper, captured_at
    FROM files f LEFT JOIN exif e ON e.file_id = f.id LEFT JOIN iqa i ON i.file_id = f.id LEFT JOIN decisions d ON d.file_id = f.id
    LEFT JOIN flags_by_file b ON b.file_id = f.id LEFT JOIN (SELECT file_id, min(group_id) AS group_id FROM duplicate_members GROUP BY file_id) m ON m.file_id = f.id""",
    "dated": """SELECT group_id, file_id AS keeper_id, coalesce(strftime(make_timestamp(captured_at * 1000000), '%Y-%m-%d'), 'unknown-date') AS group_date
    FROM duplicate_members LEFT JOIN exif USING (file_id) WHERE is_suggested_keeper""",
    "entries": """SELECT file_id, path, flag_type, confidence, coalesce(strftime(make_timestamp(captured_at * 1000000), '%Y-%m'), 'unknown-date') AS year_month
    FROM defect_flags JOIN files ON files.id = file_id LEFT JOIN exif USING (file_id)""",
    "kept": """SELECT file_id, path, content_hash, file_format, size_bytes, coalesce(strftime(make_timestamp(captured_at * 1000000), '%Y-%m'), 'unknown-date') AS year_month
    FROM decisions JOIN files ON files.id = file_id LEFT JOIN exif USING (file_id) WHERE verdict = 'keep'""",
    "clusters": """SELECT m.group_id, group_date, row_number() OVER (PARTITION BY m.group_id ORDER BY is_suggested_keeper DESC, iqa_score DESC NULLS LAST, path) AS place,
    m.file_id, path, content_hash, year_month, iqa_score, flags, max_confidence, verdict, is_keeper, is_suggested_keeper
    FROM duplicate_members m JOIN review USING (file_id) LEFT JOIN dated ON dated.group_id = m.group_id""",
    "tree": """SELECT CASE WHEN confidence >= 0.6 THEN 'rejected/' || CASE flag_type WHEN 'low_iqa' THEN 'low_quality' ELSE flag_type END ELSE 'uncertain' END || '/' || year_month AS rel_dir, path AS original FROM entries
    UNION ALL SELECT printf('duplicates/group_%05d_%s', m.group_id, group_date) || CASE WHEN is_suggested_keeper THEN '/_keeper' ELSE '/_others' END, path
    FROM duplicate_members m JOIN files ON files.id = m.file_id JOIN dated ON dated.group_id = m.group_id""",
    "raw_stats": "SELECT doc_id AS file_id, (doc_id % 97 + 1) / 100.0::DOUBLE AS p50, (doc_id % 89 + 11) / 100.0::DOUBLE AS p99, (doc_id % 13) / 200.0::DOUBLE AS clipped_frac, (doc_id % 17) / 300.0::DOUBLE AS black_frac FROM documents",
    "edits": """SELECT id AS file_id, CASE WHEN id % 12 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN id % 2 = 0 THEN '/out/' || id END AS output_path FROM files WHERE id % 3 = 0""",
}


def sql(body: str, *, recursive: str = "") -> str:
    """body after the expressions it needs, and theirs; recursive: further expressions, put in last."""
    import re

    needed, queue = set(), [body, recursive]
    while queue:
        text = queue.pop()
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(_CTES[name])
    ctes = [f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed]
    ctes += [recursive] if recursive else []
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" if ctes else "") + body
