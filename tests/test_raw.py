"""Headers and previews of photo files in several containers, made here, in both byte orders."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from gallerist.sources import exif, raw

JPEG = b"\xff\xd8" + bytes(range(256)) * 8 + b"\xff\xd9"


def directory(order, entries, at, following=0):
    """A TIFF directory at a place, values that don't fit behind it; entries: (tag, kind, count, value bytes or number)."""
    body, extra, end = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in sorted(entries, key=lambda e: e[0]):
        if isinstance(value, int):
            value = struct.pack(order + ("H" if kind == 3 else "I"), value)
        if len(value) > 4:
            field = struct.pack(order + "I", end + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        else:
            field = value.ljust(4, b"\0")
        body += struct.pack(order + "HHI", tag, kind, count) + field
    return struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", following) + extra


def text(tag, s):
    return (tag, 2, len(s) + 1, s.encode() + b"\0")


def tiff(order, preview=JPEG, mark=None, model="Model X", how="subdirectory"):
    """A raw file: a primary directory, one of capture data, and a preview that one of three ways points at; a megabyte of sensor data between."""
    ratio = lambda a, b: struct.pack(order + "II", a, b)
    head = mark or (b"II*\0" if order == "<" else b"MM\0*")
    sensor = os.urandom(1 << 20)
    capture_at, sub_at, preview_at = 4096, 8192, 16384 + len(sensor)
    capture = directory(order, [(0x829A, 5, 1, ratio(1, 250)), (0x829D, 5, 1, ratio(28, 10)), (0x8827, 3, 1, 400), text(0x9003, "2024:05:06 07:08:09"), (0x920A, 5, 1, ratio(50, 1)), (0xA002, 4, 1, 6000), (0xA003, 3, 1, 4000), text(0xA434, "Lens of some length")], capture_at)
    entries = [text(0x010F, "Maker"), text(0x0110, model), (0x0112, 3, 1, 6), (0x8769, 4, 1, capture_at)]
    following = 0
    if how == "subdirectory":
        entries.append((0x014A, 4, 2, struct.pack(order + "II", sub_at, sub_at)))
        sub = directory(order, [(0x0103, 3, 1, 7), (0x0111, 4, 1, preview_at), (0x0117, 4, 1, len(preview))], sub_at)
    elif how == "next":
        following = sub_at
        sub = directory(order, [(0x0103, 3, 1, 6), (0x0201, 4, 1, preview_at), (0x0202, 4, 1, len(preview))], sub_at, 8)
    else:
        entries.append((0x002E, 7, len(preview), None))
        sub = b""
    if how == "inline":
        entries = [e for e in entries if e[0] != 0x002E]
        first = directory(order, [*entries, (0x002E, 7, len(preview), b"x" * 5)], 8)  # its place is put in below
        at = first.index(struct.pack(order + "HHI", 0x002E, 7, len(preview)))
        first = first[: at + 8] + struct.pack(order + "I", preview_at) + first[at + 12 :]
    else:
        first = directory(order, entries, 8, following)
    out = bytearray(preview_at)
    for at, part in ((0, head + struct.pack(order + "I", 8)), (8, first), (capture_at, capture), (sub_at, sub), (16384, sensor)):
        out[at : at + len(part)] = part
    return bytes(out) + preview


def fuji(order):
    segment = b"Exif\0\0" + (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + directory(order, [text(0x0110, "Model X"), text(0x010F, "Maker")], 8)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + b"\xff\xda" + b"z" * 5000
    return b"FUJIFILMCCD-RAW ".ljust(84, b"0") + struct.pack(">II", 200, len(jpeg)) + bytes(200 - 92) + jpeg, jpeg


def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def canon(order):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    one = head + directory(order, [text(0x0110, "Model X"), text(0x010F, "Maker"), (0x0112, 3, 1, 6)], 8)
    two = head + directory(order, [(0x8827, 3, 1, 400), text(0xA434, "Lens of some length")], 8)
    meta = box(b"uuid", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"), box(b"CNCV", b"x"), box(b"CMT1", one), box(b"CMT2", two))
    preview = box(b"uuid", bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16"), bytes(8), box(b"PRVW", bytes(12), struct.pack(">I", len(JPEG)), JPEG))
    return box(b"ftyp", b"crx ", bytes(4)) + box(b"moov", box(b"mvhd", bytes(20)), meta) + preview + struct.pack(">I4sQ", 1, b"mdat", 16 + 100_000) + bytes(100_000)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", ["subdirectory", "next", "inline"])
def test_tiff_shaped(order, how):
    with raw.Ranges(tiff(order, how=how)) as source:
        found = raw.read_headers(source)
        assert source.read(found["preview_at"], found["preview_bytes"]) == JPEG
        assert source.taken < len(JPEG) + 5000 < source.size / 100
    names = ("camera_make", "camera_model", "orientation", "shutter_seconds", "aperture", "iso", "captured_text", "focal_length_mm", "width", "height", "lens_model")
    assert [found[n] for n in names] == ["Maker", "Model X", 6, 1 / 250, 2.8, 400, "2024:05:06 07:08:09", 50.0, 6000, 4000, "Lens of some length"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_other_containers(order):
    data, jpeg = fuji(order)
    found = raw.read_headers(raw.Ranges(data))
    assert found["camera_model"] == "Model X" and data[found["preview_at"] :][: found["preview_bytes"]] == jpeg
    data = canon(order)
    found = raw.read_headers(raw.Ranges(data))
    assert (found["camera_model"], found["orientation"], found["iso"], found["lens_model"]) == ("Model X", 6, 400, "Lens of some length")
    assert data[found["preview_at"] :][: found["preview_bytes"]] == JPEG
    assert raw.read_headers(raw.Ranges(tiff("<", mark=b"IIU\0", how="inline")))["preview_bytes"] == len(JPEG)


def test_broken_files_are_errors_and_end():
    whole = tiff("<", how="next")
    for cut in (0, 1, 7, 9, 30, 100, 4100, 8200):
        with pytest.raises(ValueError):
            raw.read_headers(raw.Ranges(whole[:cut]))
    loop = bytearray(whole)
    loop[8192 + 2 + 36 : 8192 + 2 + 40] = struct.pack("<I", 8192)  # a directory that follows itself
    assert raw.read_headers(raw.Ranges(bytes(loop)))["camera_model"] == "Model X"
    many = b"II*\0\x08\0\0\0" + directory("<", [(0x0111, 4, 1, 99), (0x0103, 3, 1, 7), (0x0117, 4, 1, 1 << 31)], 8)
    assert "preview_at" not in raw.read_headers(raw.Ranges(many))  # beyond the end
    for junk in (b"x" * 100, b"\xff\xd8\xff\xda" + b"0" * 50, b"\0\0\0\x18ftypcrx ", b"FUJIFILMCCD-RAW "):
        try:
            raw.read_headers(raw.Ranges(junk))
        except ValueError:
            pass


def test_rows_of_files(spark, tmp_path):
    import xxhash

    files = {"a.ARW": tiff("<"), "b.nef": tiff(">", how="next"), "c.raf": fuji("<")[0], "d.CR3": canon(">"), "e.dng": b"no photo", "_DSC1.RW2": tiff("<", mark=b"IIU\0", how="inline")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "gone.arw"]], "path string").repartition(3)
    got = {os.path.basename(r["path"]): r for r in exif.exif_rows(paths).collect()}
    assert {n: r["content_hash"] for n, r in got.items()} == {n: xxhash.xxh3_128_hexdigest(d) for n, d in files.items()} | {"gone.arw": None}
    assert {n for n, r in got.items() if r["camera_model"] == "Model X"} == set(files) - {"e.dng"} and {n for n, r in got.items() if r["error"]} == {"e.dng", "gone.arw"}
    assert got["a.ARW"]["captured_at"] == got["b.nef"]["captured_at"] == 1714979289
    shown = {os.path.basename(r["path"]): r for r in raw.embedded_previews(paths).collect()}
    assert {n for n, r in shown.items() if r["preview"]} == set(files) - {"e.dng"} and bytes(shown["b.nef"]["preview"]) == JPEG
    assert shown["a.ARW"]["bytes_read"] < 10_000 < len(files["a.ARW"])
    one = {r["path"]: r["content_hash"] for r in exif.exif_rows(paths.where(F.col("path").endswith("nef")).withColumn("content", F.lit(files["b.nef"]))).collect()}
    assert list(one.values()) == [got["b.nef"]["content_hash"]]
