"""JPEG files of ours as another decoder sees them, and the codes that they are made of."""

import numpy as np
import pytest

from gallerist.functions import jpeg
from gallerist.functions.kernels import image_array


def pictures():
    r = np.random.default_rng(1)
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([x * 3 % 256, y * 4 % 256, (x + y) * 2 % 256], axis=2).astype(np.uint8)
    return {
        "smooth": (smooth // 2 + 60, 3), "grey": (np.full((16, 16, 3), 128, np.uint8), 1), "white": (np.full((1, 1, 3), 255, np.uint8), 1), "red": (np.tile(np.array([250, 10, 20], np.uint8), (9, 5, 1)), 4),
        "noise": (r.integers(0, 256, (40, 33, 3)).astype(np.uint8), 12), "long": (r.integers(0, 256, (3, 700, 3)).astype(np.uint8), 14),
    }


def test_another_decoder_sees_the_picture(spark, tmp_path):
    made = pictures()
    for name, (rgb, _) in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode_jpeg(rgb, 95))
        (tmp_path / f"{name}-low.jpg").write_bytes(jpeg.encode_jpeg(rgb.astype(np.uint16) << 8, 20))
    got = {r["image"]["origin"].rsplit("/", 1)[1].removesuffix(".jpg"): image_array(r["image"].asDict()).astype(float) for r in spark.read.format("image").load(str(tmp_path)).collect()}
    assert len(got) == 2 * len(made)
    for name, (rgb, off) in made.items():
        assert got[name].shape == rgb.shape and np.abs(got[name] - rgb).mean() < off, name
        assert got[f"{name}-low"].shape == rgb.shape
    assert (tmp_path / "smooth-low.jpg").stat().st_size < (tmp_path / "smooth.jpg").stat().st_size / 2


def test_lengths_are_of_a_prefix_code_without_ones():
    r = np.random.default_rng(2)
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    for counts in (fib, [5], [0, 7, 0], [1] * 200, r.integers(0, 50, 256), 2 ** np.minimum(np.arange(60), 50)):
        counts = np.asarray(counts, np.int64)
        bits = jpeg.code_lengths(counts)
        used = bits[counts > 0]
        assert (bits[counts == 0] == 0).all() and used.min() >= 1 and used.max() <= 16
        assert sum(2.0 ** -int(b) for b in used) < 1  # room for the code of ones
        by_count = used[np.lexsort((-used, counts[counts > 0]))]
        assert (np.diff(by_count) <= 0).all()


def test_zigzag_begins_and_ends_right():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert (jpeg.steps(jpeg._LUMINANCE, 100) == 1).all() and jpeg.steps(jpeg._LUMINANCE, 50)[0] == 16


def test_too_large_or_empty():
    with pytest.raises(ValueError):
        jpeg.encode_jpeg(np.zeros((0, 4, 3), np.uint8))
