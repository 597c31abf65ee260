"""The fixed schemas of the catalogue's tables, their keys, and the version they stand for."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 5

_DDL = {
    "files": "id long, path string, content_hash string, size_bytes long, mtime_ns long, file_format string, has_sidecar_jpg boolean, last_processed long",
    "exif": "file_id long, captured_at long, camera_make string, camera_model string, lens_model string, focal_length_mm float, aperture float, iso int, shutter_seconds float, width int, height int, orientation short",
    "sharpness": "file_id long, s_global float, s_subject float, s_background float, subject_ratio float, detector_used string",
    "exposure": "file_id long, clipped_highlights float, clipped_shadows float, mean_luma float, histogram_skew float",
    "iqa": "file_id long, model string, score float",
    "embeddings": "file_id long, model string, vector array<float>",
    "defect_flags": "id long, file_id long, flag_type string, confidence float, reason string",
    "duplicate_groups": "id long, method string, created_at long",
    "duplicate_members": "group_id long, file_id long, is_suggested_keeper boolean, quality_score float",
    "sharpness_baseline": "camera_model string, lens_model string, focal_bucket int, aperture_index int, aperture_bucket float, s_subject_p10 float, s_subject_p50 float, s_subject_p90 float, n_samples int, last_updated long",
    "decisions": "file_id long, verdict string, is_keeper boolean, note string, decided_at long",
    "library_meta": "folder_path string, created_at long, last_analyzed long",
    "raw_stats": "file_id long, p1 float, p50 float, p99 float, p999 float, clipped_frac float, black_frac float, wb_r float, wb_g float, wb_b float, illum_r float, illum_g float, illum_b float",
    "edits": "file_id long, content_hash string, exposure_ev float, highlight_recovery float, shadow_lift float, denoise_luma float, denoise_chroma float, sharpen_amount float, lens_correct boolean, recipe_hash string, decider_version string, renderer string, look_model string, look_version string, lut_hash string, look_applied boolean, iqa_before float, iqa_after float, output_path string, output_size_bytes long, rendered_at long",
    "develop_work": "file_id long, content_hash string, run string, state string, error string, at long",
    "schema_version": "version int",
}
_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "array<float>": T.ArrayType(T.FloatType()),
}
SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(field.split()[0], _TYPES[field.split()[1]]) for field in ddl.split(", ")]) for name, ddl in _DDL.items()
}
KEYS: dict[str, tuple[str, ...]] = {
    "files": ("path",), "exif": ("file_id",), "sharpness": ("file_id",), "exposure": ("file_id",), "iqa": ("file_id",), "embeddings": ("file_id",),
    "defect_flags": ("file_id", "flag_type"), "duplicate_groups": ("id",), "duplicate_members": ("group_id", "file_id"),
    "sharpness_baseline": ("camera_model", "lens_model", "focal_bucket", "aperture_index"), "decisions": ("file_id",), "library_meta": ("folder_path",),
    "raw_stats": ("file_id",), "edits": ("file_id",), "develop_work": ("file_id",), "schema_version": ("version",),
}
#: Tables whose id is given out by the catalogue.
SEQUENCES = {"files": "id", "defect_flags": "id", "duplicate_groups": "id"}

FLAG_TYPES = ("blur", "back_focus", "low_iqa", "overexposed", "underexposed")
BLUR_FLAGS = ("blur", "back_focus", "low_iqa")
VERDICTS = ("keep", "reject")
RAW_FORMATS = ("arw", "cr3", "cr2", "nef", "raf", "rw2", "dng")
