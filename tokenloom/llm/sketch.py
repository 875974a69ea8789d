"""Fast similarity sketching: t coordinates from rounds of hashed bin placement.

Round i < t throws every element into one of t bins with a random value; a bin keeps the least
i + value. Round i >= t throws every element into bin i - t, so that after 2 t rounds every bin is
filled, whatever the set's size. Rounds stop once all bins are filled, which for sets of t log t
elements takes one. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, and the number of agreements is concentrated as for independent coordinates.
"""

from __future__ import annotations

import numpy as np

from .common import U, _M1, mix, ranges

EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(h: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """(documents, t) coordinates of the sets h[off[i]:off[i + 1]]; a coordinate tells round, value and so
    the element. Empty sets keep EMPTY everywhere."""
    n = len(off) - 1
    out = np.full((n, t), EMPTY)
    flat = out.reshape(-1)
    size = np.diff(off)
    live = np.flatnonzero(size > 0)
    for i in range(2 * t):
        if not len(live):
            break
        at = ranges(off[live], size[live])
        doc = np.repeat(live, size[live])
        x = mix(h[at] ^ mix(np.array([i + 1], U) * _M1)[0])
        b = (x % U(t)).astype(np.int64) if i < t else i - t
        value = (U(i) << U(52)) | (x >> U(12))
        np.minimum.at(flat, doc * t + b, value)
        live = live[(out[live] == EMPTY).any(1)]
    return out


def bands(coords: np.ndarray, rows: int) -> np.ndarray:
    """(documents, t // rows) keys, each of `rows` coordinates."""
    n, t = coords.shape
    c = coords.reshape(n, t // rows, rows)
    key = np.zeros((n, t // rows), U)
    for i in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + c[:, :, i])
    return key
