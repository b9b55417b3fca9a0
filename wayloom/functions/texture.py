"""Block-compressed textures (the published DXT1, DXT3 and DXT5 layouts) to RGBA, and a PNG writer over ``zlib``."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _palette(lo: int, hi: int, sharp: bool) -> np.ndarray:
    """Four colours of a block from two of 5, 6 and 5 bits; in DXT1 with lo <= hi the last is clear."""
    ends = np.array([[(c >> 11) * 255 // 31, (c >> 5 & 63) * 255 // 63, (c & 31) * 255 // 31, 255] for c in (lo, hi)], np.int32)
    if sharp and lo <= hi:
        return np.stack([ends[0], ends[1], (ends[0] + ends[1]) // 2, np.zeros(4, np.int32)])
    return np.stack([ends[0], ends[1], (2 * ends[0] + ends[1]) // 3, (ends[0] + 2 * ends[1]) // 3])


def decode(data: bytes, wide: int, high: int, kind: str) -> np.ndarray:
    """RGBA of shape (high, wide, 4)."""
    size = 8 if kind == "DXT1" else 16
    out = np.zeros((-(-high // 4) * 4, -(-wide // 4) * 4, 4), np.uint8)
    at = 0
    for y in range(0, out.shape[0], 4):
        for x in range(0, out.shape[1], 4):
            block = data[at : at + size].ljust(size, b"\0")
            at += size
            lo, hi, bits = struct.unpack("<HHI", block[-8:])
            texels = _palette(lo, hi, kind == "DXT1")[[bits >> 2 * k & 3 for k in range(16)]]
            if kind == "DXT3":
                alpha = int.from_bytes(block[:8], "little")
                texels[:, 3] = [(alpha >> 4 * k & 15) * 17 for k in range(16)]
            elif kind == "DXT5":
                a, b = block[0], block[1]
                steps = [a, b, *((a * (7 - k) + b * k) // 7 for k in range(1, 7))] if a > b else [a, b, *((a * (5 - k) + b * k) // 5 for k in range(1, 5)), 0, 255]
                picks = int.from_bytes(block[2:8], "little")
                texels[:, 3] = [steps[picks >> 3 * k & 7] for k in range(16)]
            out[y : y + 4, x : x + 4] = texels.reshape(4, 4, 4)
    return out[:high, :wide]


def average(rgba: np.ndarray) -> list[float]:
    """Colour weighed by alpha, and the mean alpha."""
    a = rgba[..., 3].astype(float)
    total = a.sum()
    return [*(float((rgba[..., k] * a).sum() / total) if total else 0.0 for k in range(3)), float(a.mean())]


def png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit grey, RGB or RGBA, or of 16-bit grey."""
    high, wide = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    depth = 16 if pixels.dtype == np.uint16 else 8
    rows = (pixels.astype(">u2") if depth == 16 else pixels.astype(np.uint8)).reshape(high, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", wide, high, depth, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
