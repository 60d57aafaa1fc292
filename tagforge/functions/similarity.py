"""Structural similarity of two gray images over sliding windows (Wang et al., 2004), and resizing, with numpy."""

from __future__ import annotations

import numpy as np

from tagforge.functions.pixels import C1, C2

#: A fixed value: the side of a window.
SIDE = 7


def window_sums(x: np.ndarray, side: int) -> np.ndarray:
    """Sums over all side x side windows inside x."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, axis=0), axis=1, out=total[1:, 1:])
    return total[side:, side:] - total[:-side, side:] - total[side:, :-side] + total[:-side, :-side]


def windowed_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The mean over all windows, with sample variances; an image smaller than a window has one of its own size."""
    side = min(SIDE, *a.shape)
    n = side * side
    ma, mb, aa, bb, ab = (window_sums(x, side) / n for x in (a, b, a * a, b * b, a * b))
    sample = n / max(n - 1, 1)
    va, vb, cov = sample * (aa - ma * ma), sample * (bb - mb * mb), sample * (ab - ma * mb)
    return float(((2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean())


def resized(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear between pixel centers, borders repeated, rounded half up (as `pixels.resized_grid`)."""
    place = lambda n, to: np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    y, z = place(x.shape[0], rows), place(x.shape[1], cols)
    y0, z0 = y.astype(int), z.astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(z0 + 1, x.shape[1] - 1)
    fy, fz = (y - y0)[:, None], z - z0
    above = x[y0][:, z0] * (1 - fz) + x[y0][:, z1] * fz
    below = x[y1][:, z0] * (1 - fz) + x[y1][:, z1] * fz
    return np.floor(above * (1 - fy) + below * fy + 0.5)
