"""Colour lookup tables of 33 points an axis: identity, blending, text form, and trilinear application."""

from __future__ import annotations

import numpy as np

SIZE = 33
LENGTH = SIZE**3 * 3
GENERATOR = "gallerist"


def identity() -> np.ndarray:
    """Shape (blue, green, red, 3): red runs fastest."""
    b, g, r = np.meshgrid(*[np.arange(SIZE, dtype=np.float32) / np.float32(SIZE - 1)] * 3, indexing="ij")
    return np.stack([r, g, b], axis=-1)


def fuse(basis: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """The weighted sum of tables, clamped; the identity if tables and weights don't match or a weight isn't finite."""
    w = np.array(weights, np.float32)
    if not basis or len(basis) != len(w) or not np.isfinite(w).all() or any(b.size != LENGTH for b in basis):
        return identity()
    mixed = sum(x * b.reshape(SIZE, SIZE, SIZE, 3).astype(np.float32) for x, b in zip(w, basis, strict=True))
    return np.clip(np.nan_to_num(mixed, nan=0.0, posinf=0.0, neginf=0.0), 0.0, 1.0)


def to_cube(table: np.ndarray, generator: str = GENERATOR) -> str:
    head = [f"# Generated by {generator}", f'TITLE "{generator} adaptive look"', f"LUT_3D_SIZE {SIZE}", "DOMAIN_MIN 0.0 0.0 0.0", "DOMAIN_MAX 1.0 1.0 1.0"]
    return "\n".join([*head, *("%.6f %.6f %.6f" % tuple(rgb) for rgb in table.reshape(-1, 3).tolist())]) + "\n"


def from_cube(text: str) -> np.ndarray:
    """The table of a .cube text of the right size; ValueError otherwise."""
    declared, values = None, []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        word = line.split()[0]
        if word == "LUT_3D_SIZE":
            declared = int(line.split()[1]) if line.split()[1:] and line.split()[1].isdigit() else None
        elif word.startswith(("TITLE", "DOMAIN", "LUT_")):
            continue
        else:
            row = line.split()[:3]
            if len(row) < 3:
                raise ValueError("an entry has fewer than three values")
            values.append([float(x) for x in row])
    if declared != SIZE:
        raise ValueError(f"size {declared}, expected {SIZE}")
    if len(values) * 3 != LENGTH:
        raise ValueError(f"{len(values) * 3} values, expected {LENGTH}")
    return np.array(values, np.float32).reshape(SIZE, SIZE, SIZE, 3)


def content_hash(table: np.ndarray) -> str:
    """Sixteen hex digits over the values in hundred-thousandths."""
    import xxhash

    return xxhash.xxh3_64_hexdigest(np.rint(table.astype(np.float64).ravel() * 100_000).astype("<i4").tobytes())


def apply(table: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """The colours of (..., 3) values in 0 to 1, interpolated among the eight points around each."""
    at = np.clip(rgb.astype(np.float64), 0.0, 1.0) * (SIZE - 1)
    low = np.floor(at).astype(np.int64)
    high, share = np.minimum(low + 1, SIZE - 1), at - low
    out = np.zeros(at.shape)
    for corner in np.ndindex(2, 2, 2):
        place = [np.where(c, high[..., k], low[..., k]) for k, c in enumerate(corner)]
        weight = np.prod([share[..., k] if c else 1 - share[..., k] for k, c in enumerate(corner)], axis=0)
        out += weight[..., None] * table[place[2], place[1], place[0]]
    return out


def apply_16_bit(table: np.ndarray, image: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(apply(table, image / 65535.0), 0, 1) * 65535 + 0.5).astype(np.uint16)


def read_basis(path: str) -> list[np.ndarray]:
    """Tables of a .npy file of shape (n, 3, 33, 33, 33), float32 in C order; ValueError otherwise."""
    a = np.load(path, allow_pickle=False)
    if a.dtype != np.dtype("<f4") or not a.flags.c_contiguous or a.shape[1:] != (3, SIZE, SIZE, SIZE):
        raise ValueError(f"basis of {a.dtype} {a.shape}")
    return [np.moveaxis(x, 0, -1) for x in a]
