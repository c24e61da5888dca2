"""Integers in whole bytes, coded and decoded in bulk."""

from __future__ import annotations

import numpy as np

# For each control byte: the bytes that its four numbers take, their sum, and which bytes of four 32-bit numbers they fill.
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
LENGTHS = (_CODES + 1).astype(np.uint8)
TOTALS = LENGTHS.sum(1).astype(np.int64)
FILLED = np.arange(4) < LENGTHS[:, :, None]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers. A control byte holds the lengths (less one, two bits each, the first lowest) of four
    numbers; the data are their little-endian bytes without the zeros above. The last four are filled up with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control, v.view(np.uint8).reshape(-1, 4, 4)[FILLED[control]]


def unpack(control: np.ndarray, data: np.ndarray, n: int, block: int = 1 << 18):
    """The n numbers, a block of control bytes at a time: each block's place in the data is a sum of table entries, and one look-up says which bytes
    of its numbers the data fill."""
    at = 0
    for lo in range(0, len(control), block):
        some = control[lo : lo + block]
        size = int(TOTALS[some].sum())
        out = np.zeros((len(some), 4, 4), np.uint8)
        out[FILLED[some]] = data[at : at + size]
        at += size
        yield out.reshape(-1).view("<u4")[: n - 4 * lo]


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative 64-bit numbers, seven bits a byte, the lowest first, the top bit set where more follow; and where each number ends."""
    v = np.asarray(values, np.uint64)
    sizes = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        sizes += v >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    starts = ends - sizes
    for k in range(int(sizes.max()) if len(v) else 0):
        some = sizes > k
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[starts[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def from_varbytes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)
