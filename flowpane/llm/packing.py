"""Arrays of unsigned numbers as bytes, for rows that carry many of them."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the greatest needs, byte by byte of equal weight."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], n).T
    return out.view("<u8").ravel()


def pack_many(arrays: list[np.ndarray]) -> bytes:
    """Several arrays: their sizes, then each one packed."""
    parts = [pack(a) for a in arrays]
    head = np.array([len(arrays), *[x for a, p in zip(arrays, parts, strict=True) for x in (len(a), len(p))]], "<i8")
    return head.tobytes() + b"".join(parts)


def unpack_many(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for size, length in sizes:
        out.append(unpack(raw[at : at + length], size).astype(np.int64))
        at += length
    return out
