"""Measures of images and sensor planes on numpy arrays, and their Arrow-batched operators.

Everything here needs whole pixel arrays, which column expressions can't walk; a batch of rows is handed over by Arrow
and each array is measured in vectorised steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Weights of red, green and blue in luma (Rec. 709).
LUMA = np.array([0.2126, 0.7152, 0.0722])
BRIGHT_FRACTION, MIN_PIXELS, CLIP_CEILING, BLACK_FLOOR, POWER_STEPS = 0.035, 32, 0.99, 0.01, 64
MAX_SAMPLES, MAX_CELLS = 2_000_000, 250_000


@dataclass(frozen=True)
class BlurConfig:
    subject_min_area_ratio: float = 0.02
    fallback_center_crop: float = 0.4


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ LUMA


def exposure(rgb: np.ndarray) -> dict:
    """Clipping, mean and population skewness of the luma histogram of an (h, w, 3) image."""
    if not rgb.size:
        return dict.fromkeys(("clipped_highlights", "clipped_shadows", "mean_luma", "histogram_skew"), 0.0)
    bins = np.bincount(np.clip(np.floor(luma(rgb) + 0.5), 0, 255).astype(np.int64).ravel(), minlength=256)
    share, level = bins / bins.sum(), np.arange(256)
    mean = share @ level
    sigma = np.sqrt(share @ (level - mean) ** 2)
    skew = share @ ((level - mean) / sigma) ** 3 if sigma > 1e-6 else 0.0
    return {"clipped_highlights": float(share[253:].sum()), "clipped_shadows": float(share[:3].sum()), "mean_luma": float(mean / 255), "histogram_skew": float(skew)}


def _spread(values: np.ndarray) -> float | None:
    return float(values.var()) if values.size > 1 else None


def sharpness(grey: np.ndarray, boxes: list[tuple[float, float, float, float]] | None = None, detector: str | None = None, cfg: BlurConfig = BlurConfig()) -> dict:
    """Variance of the four-neighbour Laplacian over the inside of an (h, w) image: all of it, its subject and the rest.

    boxes: (x, y, w, h) as shares of the image; those of at least the least area are the subject, borders included.
    Without any, the subject is a crop in the middle.
    """
    h, w = grey.shape
    fallback = "center-crop-fallback"
    if w <= 2 or h <= 2:
        return {"s_global": 0.0, "s_subject": None, "s_background": None, "subject_ratio": None, "detector_used": fallback}
    g = grey.astype(np.int32)
    lap = (g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).astype(np.float64)
    y, x = np.mgrid[1 : h - 1, 1 : w - 1]
    usable = [b for b in boxes or () if np.float32(b[2]) * np.float32(b[3]) >= np.float32(cfg.subject_min_area_ratio)]
    if usable:
        fx, fy = (x.astype(np.float32) / np.float32(w)), (y.astype(np.float32) / np.float32(h))
        inside = np.zeros(lap.shape, bool)
        for bx, by, bw, bh in np.array(usable, np.float32):
            inside |= (fx >= bx) & (fx <= bx + bw) & (fy >= by) & (fy <= by + bh)
        ratio, used = float(inside.mean()), detector or "unknown-detector"
    else:
        edge = lambda size, share: min(max(int(np.float32(size) * np.float32(share)), 1), size - 1)
        half = cfg.fallback_center_crop / 2
        inside = (x >= edge(w, 0.5 - half)) & (x < edge(w, 0.5 + half)) & (y >= edge(h, 0.5 - half)) & (y < edge(h, 0.5 + half))
        ratio, used = cfg.fallback_center_crop**2, fallback
    return {"s_global": _spread(lap) or 0.0, "s_subject": _spread(lap[inside]), "s_background": _spread(lap[~inside]), "subject_ratio": ratio, "detector_used": used}


def _nearest(ordered: np.ndarray, q: float) -> float:
    return float(ordered[int(np.floor(np.float32(len(ordered) - 1) * np.float32(q) + np.float32(0.5)))])


def sample_stats(samples: np.ndarray, black: float, white: float) -> dict:
    """Percentiles of the levels between black and white, and the shares at either end; what isn't finite counts as black."""
    black = black if np.isfinite(black) else 0.0
    white = white if np.isfinite(white) else 65535.0
    out = dict.fromkeys(("p1", "p50", "p99", "p999", "clipped_frac", "black_frac"), 0.0)
    if len(samples):
        finite = np.isfinite(samples)
        level = np.sort(np.clip((np.where(finite, samples, black) - black) / max(white - black, 1.0), 0.0, 1.0))
        out |= {name: _nearest(level, q) for name, q in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99), ("p999", 0.999))}
        out |= {"clipped_frac": float((finite & (samples >= white)).mean()), "black_frac": float((finite & (samples <= black)).mean())}
    return out


def stride_samples(plane: np.ndarray, area: tuple[int, int, int, int] | None = None, most: int = MAX_SAMPLES) -> np.ndarray:
    """Every n-th value of an (h, w) plane within area (x, y, w, h), about most of them."""
    if area is not None:
        x, y, w, h = area
        plane = plane[y : y + h, x : x + w]
    flat = plane.ravel()
    return flat[:: max(len(flat) // most, 1)]


def cell_colours(plane: np.ndarray, pattern: str, black: float, white: float, area: tuple[int, int, int, int] | None = None, most: int = MAX_CELLS) -> np.ndarray:
    """(n, 3): mean red, green and blue of two-by-two cells of a mosaic; pattern: four letters, row by row. Other letters are left out."""
    top, left = 0, 0
    h, w = plane.shape
    bottom, right = h, w
    if area is not None:
        left, top = min(area[0], w), min(area[1], h)
        right, bottom = min(area[0] + area[2], w), min(area[1] + area[3], h)
    rows, columns = max(bottom - top - 1, 0) + 1 >> 1, max(right - left - 1, 0) + 1 >> 1
    if bottom - top < 2 or right - left < 2:
        return np.zeros((0, 3))
    level = np.clip((plane.astype(np.float64) - black) / max(white - black, 1.0), 0.0, 1.0)
    sums, counts = np.zeros((rows, columns, 3)), np.zeros(3)
    for dy in range(2):
        for dx in range(2):
            letter = pattern[(top + dy) % 2 * 2 + (left + dx) % 2]
            if letter in "RGB":
                c = "RGB".index(letter)
                sums[:, :, c] += level[top + dy : bottom : 2, left + dx : right : 2][:rows, :columns]
                counts[c] += 1
    if (counts == 0).any():
        return np.zeros((0, 3))
    stride = max(w * h // (4 * most), 1)
    return (sums / counts).reshape(-1, 3)[stride - 1 :: stride]


def illuminant(pixels: np.ndarray) -> list[float] | None:
    """Unit direction of the light from linear RGB: the first uncentred principal axis of the brightest well-exposed pixels."""
    usable = pixels[np.isfinite(pixels).all(axis=1)]
    usable = usable[(usable < CLIP_CEILING).all(axis=1) & (usable > BLACK_FLOOR).any(axis=1)].astype(np.float64)
    if len(usable) < MIN_PIXELS:
        return None
    take = max(int(np.float32(len(usable)) * np.float32(BRIGHT_FRACTION)), MIN_PIXELS)
    bright = usable[np.argsort(-usable.sum(axis=1), kind="stable")[:take]]
    scatter, v = bright.T @ bright, np.ones(3)
    for _ in range(POWER_STEPS):
        v = scatter @ v
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size < 1e-12:
            return None
        v = v / size
    v = -v if v.sum() < 0 else v
    return v.tolist() if (v > 0).all() else None


def decode_detections(logits: np.ndarray, boxes: np.ndarray, confidence: float = 0.5) -> list[dict]:
    """Boxes of (queries, 4) as centre and size, whose likeliest class of (queries, classes) is sure enough; of equals the last class counts."""
    best = logits.shape[1] - 1 - np.argmax(logits[:, ::-1], axis=1)
    sure = 1 / (1 + np.exp(-logits[np.arange(len(logits)), best]))
    out = []
    for q in np.flatnonzero(sure >= confidence).tolist():
        cx, cy, w, h = boxes[q]
        x, y, w, h = np.clip([cx - w / 2, cy - h / 2, w, h], 0, 1).tolist()
        out.append({"class": int(best[q]), "confidence": float(sure[q]), "x": x, "y": y, "w": w, "h": h})
    return out


def letterbox(width: int, height: int, size: int = 640) -> tuple[float, float, float, float]:
    """(pad x, pad y, new width, new height) of an image fitted into a square."""
    scale = min(size / width, size / height)
    w, h = int(np.floor(width * scale + 0.5)), int(np.floor(height * scale + 0.5))
    return (size - w) // 2, (size - h) // 2, w, h


def unletterbox(box: tuple[float, float, float, float], frame: tuple[float, float, float, float], size: int = 640) -> tuple[float, ...]:
    """A box in shares of the square as shares of the image."""
    x, y, w, h = box
    px, py, nw, nh = frame
    return tuple(np.clip([(x * size - px) / nw, (y * size - py) / nh, w * size / nw, h * size / nh], 0, 1).tolist())


def resize(image: np.ndarray, long_edge: int) -> np.ndarray:
    """An (h, w, c) image whose longer edge is at most long_edge, by averaging over areas; smaller ones stay."""
    h, w = image.shape[:2]
    if max(h, w) <= long_edge:
        return image
    nh, nw = max(1, round(h * long_edge / max(h, w))), max(1, round(w * long_edge / max(h, w)))

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        share = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
        return np.maximum(share, 0) / (n / m)

    small = np.einsum("yh,hwc,xw->yxc", weights(h, nh), image.astype(np.float64), weights(w, nw), optimize=True)
    return np.clip(np.floor(small + 0.5), 0, 255).astype(image.dtype)


def image_array(row: dict) -> np.ndarray:
    """(h, w, 3) RGB of a row of Spark's image source, which stores BGR."""
    a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1]


DEFECTS = "path string, s_global double, s_subject double, s_background double, subject_ratio double, detector_used string, clipped_highlights double, clipped_shadows double, mean_luma double, histogram_skew double, width int, height int, error string"


def measure_images(images: DataFrame, cfg: BlurConfig = BlurConfig(), detector=None) -> DataFrame:
    """One row of DEFECTS for each row of Spark's image source (a column image); one that can't be read has error set.

    detector: a plug-in whose detect(rgb) gives boxes as shares of the image ({x, y, w, h} and more), by which subject and
    background are told apart. An image in which it fails or finds none is measured by its middle.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.column("image").to_pylist():
                row = dict.fromkeys(names)
                row["path"] = r["origin"]
                try:
                    rgb = image_array(r)
                    grey = np.clip(np.floor(luma(rgb) + 0.5), 0, 255)
                    boxes = None
                    if detector is not None:
                        try:
                            boxes = [(d["x"], d["y"], d["w"], d["h"]) for d in detector.detect(rgb)]
                        except Exception:  # a detector's failure isn't the picture's
                            boxes = None
                    row |= sharpness(grey, boxes, detector.name if detector is not None else None, cfg) | exposure(rgb) | {"width": r["width"], "height": r["height"]}
                except (ValueError, TypeError) as e:
                    row["error"] = str(e)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = images.sparkSession.createDataFrame([], DEFECTS).schema
    names, arrow = shape.names, to_arrow_schema(shape)
    return images.select("image").mapInArrow(run, DEFECTS)


RAW = "file_id long, p1 double, p50 double, p99 double, p999 double, clipped_frac double, black_frac double, illum_r double, illum_g double, illum_b double"


def measure_raw(planes: DataFrame) -> DataFrame:
    """RAW rows for sensor planes: (file_id, samples array<float>, width, height, black, white, pattern)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                plane = np.array(r["samples"], np.float32).reshape(r["height"], r["width"])
                light = illuminant(cell_colours(plane, r["pattern"], r["black"], r["white"])) or [None] * 3
                out.append({"file_id": r["file_id"], **sample_stats(stride_samples(plane), r["black"], r["white"]), **dict(zip(("illum_r", "illum_g", "illum_b"), light, strict=True))})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(planes.sparkSession.createDataFrame([], RAW).schema)
    return planes.select("file_id", "samples", "width", "height", "black", "white", "pattern").mapInArrow(run, RAW)


def encode_png(rgb: np.ndarray) -> bytes:
    """An (h, w, 3) image of bytes as PNG."""
    import struct
    import zlib

    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def previews(images: DataFrame, long_edge: int = 2048) -> DataFrame:
    """(path, bytes): rows of Spark's image source, no longer than long_edge, as PNG; what can't be read is left out."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.column("image").to_pylist():
                if r["height"] > 0:
                    yield pa.RecordBatch.from_arrays([pa.array([r["origin"]]), pa.array([encode_png(resize(image_array(r), long_edge))], pa.binary())], names=["path", "bytes"])

    return images.select("image").mapInArrow(run, "path string, bytes binary")
