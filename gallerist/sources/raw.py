"""Capture metadata and embedded previews of photo files, read by byte ranges: only headers, directories and the values asked for.

JPEG files hold their directories in a segment; raw files are TIFF files with other names and more directories (ARW, CR2, NEF,
DNG, RW2 with a mark of its own), a header that points at a JPEG (RAF), or boxes of which some hold TIFF directories (CR3).
The preview is the largest JPEG that a directory, a header or a box points at.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Tags, by directory.
_PRIMARY = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation"}
_EXIF = {
    0x829A: "shutter_seconds", 0x829D: "aperture", 0x8827: "iso", 0x9003: "captured_text", 0x920A: "focal_length_mm",
    0xA002: "width", 0xA003: "height", 0xA434: "lens_model",
}
_EXIF_POINTER, _SUBDIRECTORIES, _COMPRESSION, _STRIP, _STRIP_SIZE, _JPEG, _JPEG_SIZE, _JPEG_INLINE = 0x8769, 0x014A, 0x0103, 0x0111, 0x0117, 0x0201, 0x0202, 0x002E
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_TEXT, _RATIONAL, _WHOLE = ("camera_make", "camera_model", "captured_text", "lens_model"), ("shutter_seconds", "aperture", "focal_length_mm"), ("iso", "width", "height", "orientation")
_ORDERS = {b"II*\0": "<", b"MM\0*": ">", b"IIU\0": "<"}
_CANON_META = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
_CANON_PREVIEW = bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16")
#: Directories that a file is followed through, and bytes of a text, at most.
MOST_DIRECTORIES, LONGEST_TEXT = 64, 1 << 16


class Ranges:
    """Bytes by place and number, of a file or of what is in memory; taken: how many were read."""

    def __init__(self, of: str | bytes):
        self._data = of if isinstance(of, bytes) else None
        self._file = None if self._data is not None else os.open(of, os.O_RDONLY)
        self.size = len(of) if self._data is not None else os.fstat(self._file).st_size
        self.taken = 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"truncated: {n} bytes at {at} of {self.size}")
        self.taken += n
        return self._data[at : at + n] if self._data is not None else os.pread(self._file, n, at)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *error) -> None:
        if self._file is not None:
            os.close(self._file)


class _Walk:
    """The directories of a TIFF structure that begins at base."""

    def __init__(self, source: Ranges, base: int, out: dict):
        self.source, self.base, self.out = source, base, out
        self.order = _ORDERS.get(source.read(base, 4))
        if self.order is None:
            raise ValueError("no byte order")
        self.seen: set[int] = set()

    def _numbers(self, kind: int, data: bytes) -> list[int]:
        return list(struct.unpack(f"{self.order}{len(data) // _SIZES[kind]}{'H' if kind == 3 else 'I'}", data))

    def all(self, first: dict[int, str] = _PRIMARY) -> None:
        queue = [(struct.unpack(self.order + "I", self.source.read(self.base + 4, 4))[0], first)]
        while queue and len(self.seen) < MOST_DIRECTORIES:
            at, names = queue.pop(0)
            if at and at not in self.seen:
                self.seen.add(at)
                queue += self._directory(at, names)

    def _directory(self, at: int, names: dict[int, str]) -> list[tuple[int, dict[int, str]]]:
        n = struct.unpack(self.order + "H", self.source.read(self.base + at, 2))[0]
        entries = self.source.read(self.base + at + 2, 12 * n)
        more, found = [], {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(self.order + "HHI", entries, 12 * i)
            size = _SIZES.get(kind, 0) * count
            inline = entries[12 * i + 8 : 12 * i + 8 + size]
            place = self.base + struct.unpack_from(self.order + "I", entries, 12 * i + 8)[0] if size > 4 else None
            value = lambda most, inline=inline, place=place, size=size: inline if place is None else self.source.read(place, min(size, most))
            name = names.get(tag)
            if tag == _EXIF_POINTER and names is _PRIMARY:
                more += [(x, _EXIF) for x in self._numbers(kind, value(4)) if kind in (3, 4)]
            elif tag == _SUBDIRECTORIES and kind in (3, 4):
                more += [(x, {}) for x in self._numbers(kind, value(4 * MOST_DIRECTORIES))]
            elif tag == _JPEG_INLINE and kind == 7 and place is not None:
                self._preview(place, size)
            elif tag in (_COMPRESSION, _STRIP, _STRIP_SIZE, _JPEG, _JPEG_SIZE) and kind in (3, 4) and count == 1:
                found[tag] = self._numbers(kind, value(4))[0]
            if name in self.out:
                continue  # the first directory that has it counts
            if name in _TEXT and kind == 2:
                self.out[name] = value(LONGEST_TEXT).split(b"\0")[0].decode("utf-8", "replace").strip() or None
            elif name in _RATIONAL and kind == 5 and size:
                a, b = struct.unpack(self.order + "II", value(8)[:8])
                self.out[name] = a / b if b else None
            elif name in _WHOLE and kind in (3, 4) and count:
                self.out[name] = self._numbers(kind, value(4)[: _SIZES[kind]])[0]
        if found.get(_COMPRESSION) in (6, 7) and _STRIP in found:
            self._preview(self.base + found[_STRIP], found.get(_STRIP_SIZE, 0))
        if _JPEG in found:
            self._preview(self.base + found[_JPEG], found.get(_JPEG_SIZE, 0))
        after = self.base + at + 2 + 12 * n
        if names is not _EXIF and after + 4 <= self.source.size:
            more.append((struct.unpack(self.order + "I", self.source.read(after, 4))[0], {}))
        return more

    def _preview(self, at: int, size: int) -> None:
        _longer(self.source, self.out, at, size)


def _longer(source: Ranges, out: dict, at: int, size: int) -> None:
    """Takes a place for the preview if it holds a JPEG and is longer than the one known."""
    if size > out.get("preview_bytes", 0) and at + size <= source.size and source.read(at, min(size, 2)) == b"\xff\xd8":
        out["preview_at"], out["preview_bytes"] = at, size


def _segment(source: Ranges, at: int) -> int:
    """Where the directories of a JPEG begin."""
    if source.read(at, 2) != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at += 2
    while at + 10 <= source.size:
        mark, kind, size = struct.unpack(">BBH", source.read(at, 4))
        if mark != 0xFF or kind == 0xDA:
            break
        if kind == 0xE1 and size >= 8 and source.read(at + 4, 6) == b"Exif\0\0":
            return at + 10
        at += 2 + size
    raise ValueError("no Exif segment")


def _boxes(source: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its content begins, where it ends) of the boxes between two places."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", source.read(at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", source.read(at + 8, 8))[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            raise ValueError("a box beyond its end")
        yield kind, at + head, at + size
        at += size


def _canon(source: Ranges, out: dict) -> None:
    for kind, at, end in _boxes(source, 0, source.size):
        if kind == b"moov":
            for inner, a, e in _boxes(source, at, end):
                if inner == b"uuid" and source.read(a, 16) == _CANON_META:
                    for box, x, _ in _boxes(source, a + 16, e):
                        if box in (b"CMT1", b"CMT2"):
                            _Walk(source, x, out).all(_PRIMARY if box == b"CMT1" else _EXIF)
        elif kind == b"uuid" and source.read(at, 16) == _CANON_PREVIEW:
            for box, x, e in _boxes(source, at + 24, end):
                if box == b"PRVW" and e - x > 16:
                    _longer(source, out, x + 16, struct.unpack(">I", source.read(x + 12, 4))[0])


def read_headers(source: Ranges) -> dict:
    """The metadata of a photo file, and preview_at and preview_bytes if it holds a preview. ValueError if it isn't one that is known."""
    out: dict = {}
    try:
        head = source.read(0, min(source.size, 16))
        if head[:4] in _ORDERS:
            _Walk(source, 0, out).all()
        elif head.startswith(b"FUJIFILMCCD-RAW"):
            at, size = struct.unpack(">II", source.read(84, 8))
            _longer(source, out, at, size)
            _Walk(source, _segment(source, at), out).all()
        elif head[4:8] == b"ftyp":
            _canon(source, out)
        else:
            _Walk(source, _segment(source, 0), out).all()
    except struct.error as e:
        raise ValueError(f"truncated: {e}") from e
    return out


def embedded_previews(files: DataFrame) -> DataFrame:
    """(path, preview, bytes_read, error) of rows of (path, content), or of (path) for files on a file system that all executors share: the JPEG inside."""
    by_path = "content" not in files.columns

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            contents = [None] * batch.num_rows if by_path else batch["content"]
            for path, content in zip(batch["path"].to_pylist(), contents, strict=True):
                data = error = None
                taken = 0
                try:
                    with Ranges(path if by_path else content.as_py() or b"") as source:
                        found = read_headers(source)
                        data = source.read(found["preview_at"], found["preview_bytes"]) if "preview_at" in found else None
                        taken = source.taken
                except (OSError, ValueError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([taken]), pa.array([error], pa.string())], names=["path", "preview", "bytes_read", "error"])

    return files.select("path", *([] if by_path else ["content"])).mapInArrow(run, "path string, preview binary, bytes_read long, error string")
