"""Baseline TIFF: image directories, strips and tiles, no compression, LZW, deflate and PackBits, horizontal predictor.

Reading gives one row per page (image directory). A null or malformed file gives one row with page null and error set;
pages before the defect are kept. Directories that point back to one already read end the walk with an error. A page
larger than max_page_bytes is reported, not decoded, so that memory stays bounded. Equal files give equal rows, also under
one id or none. Empty tables give empty results, and columns other than those named are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

# Fixed values of the format: compression schemes, field types with their sizes, and tags.
RAW, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
MAX_PAGE_BYTES = 256 << 20


class TiffError(ValueError):
    pass


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes become runs, all else literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(a[1:] != a[:-1]) + 1
    starts = np.append(0, edges)
    lengths = np.diff(np.append(starts, len(a)))
    out, done = bytearray(), 0

    def literal(upto: int) -> None:
        for s in range(done, upto, 128):
            part = data[s : min(s + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    long_runs = lengths >= 3
    for s, n in zip(starts[long_runs].tolist(), lengths[long_runs].tolist(), strict=True):
        literal(s)
        done = s + n
        while n:
            k = min(n, 128)
            out.extend((257 - k, data[s]) if k > 1 else (0, data[s]))
            n -= k
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_compress(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, width changing one code early."""
    singles = {bytes((i,)): i for i in range(256)}
    table, width, nxt = dict(singles), 9, 258
    acc, bits, out = 256, 9, bytearray()

    word = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        longer = word + c
        if longer in table:
            word = longer
            continue
        acc, bits = acc << width | table[word], bits + width
        table[longer] = nxt
        nxt += 1
        if nxt == 4095:
            acc, bits = acc << 12 | 256, bits + 12
            table, width, nxt = dict(singles), 9, 258
        elif nxt + 1 > 1 << width:
            width += 1
        word = c
        if bits > 4096:
            out += (acc >> (bits & 7)).to_bytes(bits >> 3, "big")
            acc, bits = acc & ((1 << (bits & 7)) - 1), bits & 7
    if word:
        acc, bits = acc << width | table[word], bits + width
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) >> 3, "big")


def lzw_expand(data: bytes, size: int) -> bytes:
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, previous = list(singles), 9, None
    out, made, acc, bits, at = [], 0, 0, 0, 0
    while made < size:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            acc, bits, at = (acc << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big"), bits + 32, at + 4)
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 256:
            table, width, previous = list(singles), 9, None
            continue
        if code == 257:
            break
        if previous is None:
            entry = table[code] if code < 256 else b""
        elif code < len(table):
            entry = table[code]
            table.append(previous + entry[:1])
        elif code == len(table):
            entry = previous + previous[:1]
            table.append(entry)
        else:
            raise TiffError(f"LZW code {code} beyond the table")
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        out.append(entry)
        made += len(entry)
        previous = entry
    return b"".join(out)


def _compress(data: bytes, scheme: int) -> bytes:
    if scheme == RAW:
        return data
    if scheme == LZW:
        return lzw_compress(data)
    if scheme in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(data, 3)
    if scheme == PACKBITS:
        return pack_bits(data)
    raise TiffError(f"compression {scheme}")


def _expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == RAW:
        return data
    if scheme == LZW:
        return lzw_expand(data, size)
    if scheme in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    raise TiffError(f"compression {scheme}")


@dataclass
class Page:
    """samples: (height, width, samples per pixel), uint8 or uint16."""

    samples: np.ndarray
    compression: int = DEFLATE
    predictor: int = 1
    tile: tuple[int, int] | None = None  # (width, height), multiples of 16
    rows_per_strip: int = 0  # 0: one strip
    chunks: int = 0


def write_tiff(pages: list[Page], order: str = "<") -> bytes:
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w, n = page.samples.shape
        kind = page.samples.dtype.newbyteorder(order)
        if page.tile:
            tw, th = page.tile
            parts = []
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = np.zeros((th, tw, n), page.samples.dtype)
                    part = page.samples[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    parts.append(block)
        else:
            rows = page.rows_per_strip or max(h, 1)
            parts = [page.samples[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for part in parts:
            if page.predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            data = _compress(part.astype(kind).tobytes(), page.compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        bits = page.samples.dtype.itemsize * 8
        fields = [
            (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * n), (COMPRESSION, 3, [page.compression]),
            (PHOTOMETRIC, 3, [2 if n == 3 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]), (PREDICTOR, 3, [page.predictor]),
        ]
        if page.tile:
            fields += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind_id, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind_id == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind_id, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[Page]:
    """The pages in order of their directories; TiffError at the first defect."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        try:
            fields, at = _directory(data, at, order)
            page = _page(data, fields, order, max_page_bytes)
        except (struct.error, zlib.error, IndexError, KeyError, ValueError) as e:
            raise e if isinstance(e, TiffError) else TiffError(f"{type(e).__name__}: {e}") from e
        yield page


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    fields, n = {}, struct.unpack_from(order + "H", data, at)[0]
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        where = at + 10 + 12 * i
        if kind not in (1, 3, 4) or count * SIZES[kind] > len(data):
            continue
        if count * SIZES[kind] > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        fields[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, fields: dict[int, tuple], order: str, max_page_bytes: int) -> Page:
    one = lambda tag, default=None: fields[tag][0] if tag in fields or default is None else default
    w, h, n, scheme, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    bits = set(fields.get(BITS, (1,)))
    if len(bits) > 1 or not bits <= {8, 16}:
        raise TiffError(f"bits per sample {sorted(bits)}")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    kind = np.dtype(np.uint8 if bits == {8} else np.uint16)
    if w * h * n * kind.itemsize > max_page_bytes:
        raise TiffError("page too large")
    planes = n if one(PLANAR, 1) == 2 else 1
    inner = n // planes
    tiled = TILE_OFFSETS in fields
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_COUNTS])
    if bw <= 0 or bh <= 0 or bw * bh * n * kind.itemsize > 4 * max_page_bytes:
        raise TiffError("block size")
    out = np.zeros((h, w, n), kind)
    across = -(-w // bw)
    per_plane = across * -(-h // bh)
    if len(offsets) < per_plane * planes:
        raise TiffError("missing blocks")
    for k in range(per_plane * planes):
        plane, i = divmod(k, per_plane)
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - y)
        size = rows * bw * inner * kind.itemsize
        raw = _expand(data[offsets[k] : offsets[k] + counts[k]], scheme, size)
        if len(raw) < size:
            raise TiffError("block too short")
        block = np.frombuffer(raw[:size], kind.newbyteorder(order)).reshape(rows, bw, inner).astype(kind)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        part = out[y : y + rows, x : x + bw, plane * inner : (plane + 1) * inner]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(out, scheme, predictor, (bw, bh) if tiled else None, 0 if tiled else bh, len(offsets))


PAGE_FIELDS = (
    "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, n_blocks int, pixels binary, error string"
)


def _page_row(i: int, p: Page) -> dict:
    h, w, n = p.samples.shape
    return {
        "page": i, "width": w, "height": h, "samples_per_pixel": n, "bits": p.samples.dtype.itemsize * 8, "compression": p.compression,
        "predictor": p.predictor, "tiled": p.tile is not None, "n_blocks": p.chunks, "pixels": p.samples.tobytes(), "error": None,
    }


def page_rows(data: bytes | None, max_page_bytes: int = MAX_PAGE_BYTES) -> list[dict]:
    rows: list[dict] = []
    try:
        for p in read_tiff(data or b"", max_page_bytes):
            rows.append(_page_row(len(rows), p))
    except TiffError as e:
        rows.append({"error": str(e)})
    return rows


def tiff_pages(files: DataFrame, id_col: str, content: str, max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """One row per page of each file: id_col and the fields of PAGE_FIELDS; pixels are native-order samples."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, data in zip(batch.column("id"), batch.column("content"), strict=True):
                rows = [r | {"id": key.as_py()} for r in page_rows(data.as_py(), max_page_bytes)]
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    source = files.select(F.col(id_col).alias("id"), F.col(content).alias("content"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, {PAGE_FIELDS}"
    shape = files.sparkSession.createDataFrame([], schema).schema
    arrow, names = to_arrow_schema(shape), shape.names
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


ROW_BYTES, PAGE_ROWS = 192, 64
#: How the pages of a stored text are laid out, in turn.
LAYOUTS = (
    {"compression": DEFLATE, "predictor": 2, "rows_per_strip": 32},
    {"compression": PACKBITS, "rows_per_strip": 16},
    {"compression": LZW, "predictor": 2, "tile": (32, 32)},
    {"compression": DEFLATE, "tile": (64, 64)},
)


def payload_of(text: str) -> bytes:
    """UTF-8, with blanks up to a positive multiple of 192 bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(-(-len(raw) // ROW_BYTES), 1) * ROW_BYTES, b" ")


def store(payload: bytes) -> bytes:
    """As pages of up to 64 rows of 64 RGB pixels."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    return write_tiff([Page(grid[y : y + PAGE_ROWS], **LAYOUTS[y // PAGE_ROWS % len(LAYOUTS)]) for y in range(0, len(grid), PAGE_ROWS)])


def media_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as a multi-page TIFF and read back from the stored bytes: id_col, n_bytes, media, and pages, an array of PAGE_FIELDS."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                media = [store(payload_of(x)) for x in texts]
                rows = [[{k: r.get(k) for k in names} for r in page_rows(m)] for m in media]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(rows, kind)],
                    names=["id", "n_bytes", "media", "pages"],
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    shape = docs.sparkSession.createDataFrame([], PAGE_FIELDS).schema
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary, pages array<struct<{', '.join(x.replace(' ', ':') for x in PAGE_FIELDS.split(', '))}>>"
    kind, names = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema).field("pages").type, shape.names
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def page_feature(pixels: bytes, channels: int = 3) -> tuple[int, int, int]:
    """Sum of samples, sum of squares, and sum of absolute steps between neighbours in a row of 8-bit pixels."""
    a = np.frombuffer(pixels, np.uint8).reshape(-1, ROW_BYTES // 3, channels).astype(np.int64)
    return int(a.sum()), int((a * a).sum()), int(np.abs(np.diff(a, axis=1)).sum())


def digest_pages(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digests and the feature of media_documents()' rows: all from the pages that were read back."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pages = batch.column("pages").to_pylist()
            media = batch.column("media").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for ps, m in zip(pages, media, strict=True):
                payload = b"".join(p["pixels"] for p in ps)
                sums = np.array([page_feature(p["pixels"]) for p in ps]).sum(axis=0)
                mean = sums[0] / len(payload)
                feature = f"pages={len(ps)} mean={mean:.4f} var={sums[1] / len(payload) - mean * mean:.4f} step={sums[2] / len(payload):.4f}"
                found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature)
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    source = rows.withColumnRenamed(id_col, "id")
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
