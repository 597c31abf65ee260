"""Models as plug-ins: anything with these methods is run in Arrow batches, loaded once in each task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from .functions.kernels import image_array


class Embedder(Protocol):
    name: str

    def embed(self, rgb: np.ndarray) -> np.ndarray: ...


class Scorer(Protocol):
    name: str

    def score(self, rgb: np.ndarray) -> float: ...


class Detector(Protocol):
    name: str

    def detect(self, rgb: np.ndarray) -> list[dict]: ...


class RawDecoder(Protocol):
    def decode(self, path: str) -> dict:
        """plane (h, w), pattern of four letters, black, white, and white_balance (three numbers) or None."""
        ...


class Renderer(Protocol):
    name: str

    def render(self, path: str, profile: str) -> np.ndarray: ...


class LookPredictor(Protocol):
    name: str
    version: str

    def predict(self, rgb: np.ndarray) -> np.ndarray: ...


def infer(rows: DataFrame, embedder: Embedder | None, scorer: Scorer | None) -> DataFrame:
    """(file_id, vector, score) for rows of (file_id, image); each image is decoded once for both models."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {"file_id": r["file_id"], "vector": None, "score": None}
                if r["image"]["height"] > 0:
                    rgb = image_array(r["image"])
                    row["vector"] = [float(x) for x in embedder.embed(rgb)] if embedder else None
                    row["score"] = float(scorer.score(rgb)) if scorer else None
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_id", pa.int64()), ("vector", pa.list_(pa.float32())), ("score", pa.float32())]))

    return rows.select("file_id", "image").mapInArrow(run, "file_id long, vector array<float>, score float")
