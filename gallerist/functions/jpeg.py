"""Baseline JPEG of an RGB picture, in numpy: full colour resolution, Huffman codes made for each picture."""

from __future__ import annotations

import struct

import numpy as np

# The steps of luminance and chrominance that the standard gives for quality 50, row by row.
_LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of a block by diagonals, each walked the other way than the one before.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
_LONGEST = 16
_END, _SIXTEEN_ZEROS = 0x00, 0xF0


def steps(base: tuple[int, ...], quality: int) -> np.ndarray:
    """A table of steps for a quality from 1 to 100."""
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(blocks, 64) whole multiples of the steps, in zigzag order; edges are repeated up to a multiple of eight."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    b = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    c = _COSINES @ b @ _COSINES.T
    return np.rint(c.reshape(-1, 64) / table)[:, ZIGZAG].astype(np.int64)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols of some counts: Huffman's, none over 16 bits and no code of ones alone."""
    symbols = np.flatnonzero(counts)
    # one symbol more, the rarest, takes the code of ones
    nodes = [(int(counts[s]), [int(s)]) for s in symbols] + [(0, [len(counts)])]
    length = np.zeros(len(counts) + 1, np.int64)
    while len(nodes) > 1:
        nodes.sort(key=lambda x: (-x[0], len(x[1])))
        (n, a), (m, b) = nodes.pop(), nodes.pop()
        length[a + b] += 1
        nodes.append((n + m, a + b))
    most = int(length.max())
    bits = np.bincount(length, minlength=max(most, _LONGEST) + 1)
    bits[0] = 0
    for i in range(most, _LONGEST, -1):  # pairs that are too deep: one goes up, the other beside a shorter one's split
        while bits[i]:
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    # the longest codes go to the rarest symbols, the very last to the one more
    order = sorted([*symbols.tolist(), len(counts)], key=lambda s: (s == len(counts), -int(counts[s]) if s < len(counts) else 0, s))
    length[:] = 0
    length[order] = np.repeat(np.arange(len(bits)), bits)
    return length[:-1]


def _codes(length: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(code of each symbol, symbols in order of their codes)."""
    order = [int(s) for s in sorted(np.flatnonzero(length), key=lambda s: (length[s], s))]
    code, at, last = np.zeros(len(length), np.int64), 0, 0
    for s in order:
        at <<= int(length[s]) - last
        last = int(length[s])
        code[s] = at
        at += 1
    return code, order


def _category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(coded: np.ndarray, n_planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is it a first coefficient, symbol, value behind it, bits of that value) in the order of the stream; blocks are interleaved by plane."""
    first = coded[:, 0].reshape(-1, n_planes)
    change = np.diff(first, axis=0, prepend=np.zeros((1, n_planes), np.int64)).ravel()
    block, at = np.nonzero(coded[:, 1:])
    value, at = coded[block, at + 1], at + 1
    before = np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, at[:-1]]) if len(at) else at
    run = at - before - 1
    long = np.repeat(np.arange(len(at)), run // 16)
    last = np.zeros(len(coded), np.int64)
    np.maximum.at(last, block, at)
    open_ = np.flatnonzero(last < 63)
    n, m, k, o = len(change), len(at), len(long), len(open_)
    where = np.r_[np.arange(n), block, block[long], open_]
    place = np.r_[np.zeros(n, np.int64), 2 * at, 2 * at[long] - 1, np.full(o, 999)]
    symbol = np.r_[_category(change), (run % 16) << 4 | _category(value), np.full(k, _SIXTEEN_ZEROS), np.full(o, _END)]
    number = np.r_[change, value, np.zeros(k + o, np.int64)]
    is_first = np.r_[np.ones(n, bool), np.zeros(m + k + o, bool)]
    order = np.lexsort((place, where))
    symbol, number, is_first = symbol[order], number[order], is_first[order]
    size = np.where(is_first, symbol, symbol & 15)
    return is_first, symbol, np.where(number < 0, number + (1 << size) - 1, number), size


def encode_jpeg(rgb: np.ndarray, quality: int = 92) -> bytes:
    """An (h, w, 3) picture of bytes, or of 16-bit numbers, as a JPEG file."""
    if rgb.dtype == np.uint16:
        rgb = rgb >> 8
    h, w, _ = rgb.shape
    if not (0 < h < 1 << 16 and 0 < w < 1 << 16):
        raise ValueError(f"a JPEG can't be {w} by {h}")
    r, g, b = np.moveaxis(rgb.astype(np.float64), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    tables = steps(_LUMINANCE, quality), steps(_CHROMINANCE, quality)
    planes = [_blocks(y, tables[0]), _blocks((b - y) / 1.772 + 128, tables[1]), _blocks((r - y) / 1.402 + 128, tables[1])]
    is_first, symbol, number, size = _symbols(np.stack(planes, axis=1).reshape(-1, 64), 3)

    value, length, trees = number.copy(), size.copy(), []
    for kind, mine in ((0, is_first), (1, ~is_first)):
        bits = code_lengths(np.bincount(symbol[mine], minlength=256))
        code, order = _codes(bits)
        trees.append(bytes([kind << 4]) + bytes(int((bits == i).sum()) for i in range(1, _LONGEST + 1)) + bytes(order))
        value[mine] |= code[symbol[mine]] << size[mine]
        length[mine] += bits[symbol[mine]]
    stream = np.repeat(value, length) >> (np.repeat(np.cumsum(length), length) - 1 - np.arange(int(length.sum()))) & 1
    data = np.packbits(np.r_[stream.astype(np.uint8), np.ones(-len(stream) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")

    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i, t in enumerate(tables):
        out += part(0xDB, bytes([i]) + bytes(t[ZIGZAG].astype(np.uint8)))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for t in trees:
        out += part(0xC4, t)
    return out + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
