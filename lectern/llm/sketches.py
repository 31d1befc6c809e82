"""Fixed-size summaries of shingle sets: a 128-bit digest and an odd sketch.

An odd sketch keeps, for each of m slots, the parity of the number of members that hash there. Two
sketches differ in at most as many slots as the sets differ in members, so a pair whose sketches
differ too much cannot link; no pair that links is ever discarded. m is a power of two of 2 to 4
slots a member, and a sketch folds to half its slots by one exclusive or.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lectern.llm.shingles import mix

#: Slot comparisons held in memory at once, in bytes.
_CHUNK = 8 << 20


def digest(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set of distinct hashes."""
    turned = mix(found ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([found.sum(), turned.sum(), np.bitwise_xor.reduce(turned) if len(turned) else 0, len(found)], np.uint64)
    return mix(both[:2] + mix(both[2:] + mix(both[1::-1]))).tobytes()


def odd_sketch(found: np.ndarray) -> bytes:
    """Parities of the slots, at least 64 of them."""
    bits = max(64, 1 << int(2 * len(found) - 1).bit_length()) if len(found) else 64
    slots = ((found >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of an Arrow column, as one matrix for each width."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.width = np.diff(offsets)
        self.place = np.zeros(len(column), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.ascontiguousarray(data[offsets[at][:, None] + np.arange(w)]).view(np.uint64)


def differing(left: Sketches, i: np.ndarray, right: Sketches, j: np.ndarray) -> np.ndarray:
    """Slots in which left[i] and right[j] differ, at the narrower of the two widths."""
    out = np.zeros(len(i), np.int64)
    kinds = left.width[i] * (1 << 32) + right.width[j]
    for kind in np.unique(kinds).tolist():
        of = np.flatnonzero(kinds == kind)
        a, b = left.rows[kind >> 32], right.rows[kind & 0xFFFFFFFF]
        step = max(1, _CHUNK // (8 * max(a.shape[1], b.shape[1])))
        for s in range(0, len(of), step):
            part = of[s : s + step]
            x, y = a[left.place[i[part]]], b[right.place[j[part]]]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def may_link(differ: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False where sets of sizes a and b that differ in ``differ`` members or more cannot reach the similarity."""
    return differ * (100 + percent) <= (100 - percent) * (a + b)
