"""Images as numpy arrays (rows, columns, blue-green-red): what is done to pixels inside a task.

The same rules as the expressions in `pixels`, for images that are too large to be rows or arrays of a
DataFrame.  Levels are 8 bits; sums and shares are double.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from tagforge.functions.pixels import COLORED, LEAST_S, LEAST_V, RED, YELLOW

#: Sides under which an image has no orientation.
LEAST_TURNED = 4


def image(data: bytes, h: int, w: int, channels: int = 3) -> np.ndarray | None:
    """The image that row-major bytes hold; None if their number is another."""
    if data is None or h is None or w is None or h <= 0 or w <= 0 or len(data) != h * w * channels:
        return None
    flat = np.frombuffer(data, np.uint8)
    return flat.reshape((h, w) if channels == 1 else (h, w, channels))


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma, rounded half up; an image of one channel is gray already."""
    if bgr.ndim == 2:
        return bgr.astype(float)
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)


def edges(levels: np.ndarray) -> np.ndarray:
    """The Laplacian of four neighbours; borders mirror without repeating the edge pixel."""
    high, wide = (np.pad(levels, pad, "reflect") if n > 1 else np.pad(levels, pad, "edge") for n, pad in zip(levels.shape, (((1, 1), (0, 0)), ((0, 0), (1, 1))), strict=True))
    return high[:-2] + high[2:] + wide[:, :-2] + wide[:, 2:] - 4 * levels


def sharpness(bgr: np.ndarray, block: int = 1 << 20) -> float:
    """Population variance of the edges, in blocks of rows that overlap by one, so a large frame needs little memory."""
    h, w = bgr.shape[:2]
    step, total, square = max(block // max(w, 1), 1), 0.0, 0.0
    for y in range(0, h, step):
        # a row more on either side; at a border the mirrored one is found inside
        a, z = max(y - 1, 0), min(y + step + 1, h)
        if z - a < 2 <= h:
            a = max(a - 1, 0)
        own = edges(gray(bgr[a:z]))[y - a : min(y + step, h) - a]
        total += float(own.sum())
        square += float((own * own).sum())
    n = h * w
    return square / n - (total / n) ** 2


def hues(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 179), saturation and value, rounded half up."""
    b, g, r = (bgr[..., i].astype(int) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    over = np.maximum(d, 1).astype(float)
    angle = np.select([d == 0, v == r, v == g], [0.0, 30 * (g - b) / over, 60 + 30 * (b - r) / over], 120 + 30 * (r - g) / over)
    angle = np.where(angle < 0, angle + 180, angle)
    s = np.where(v == 0, 0.0, 255 * d / np.maximum(v, 1))
    return np.floor(angle + 0.5).astype(int) % 180, np.floor(s + 0.5).astype(int), v


def masks(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and yellow pixels."""
    h, s, v = hues(bgr)
    vivid = (s >= LEAST_S) & (v >= LEAST_V)
    inside = lambda ranges: np.logical_or.reduce([(h >= a) & (h <= z) for a, z in ranges])
    return vivid & inside(RED), vivid & inside(YELLOW)


def color_of(red: np.ndarray, yellow: np.ndarray) -> str:
    """red is asked before yellow; a share must exceed COLORED; an image without pixels is unknown."""
    if not red.size:
        return "unknown"
    return "red" if red.mean() > COLORED else "yellow" if yellow.mean() > COLORED else "unknown"


def best_turn(colored: np.ndarray) -> tuple[int, float]:
    """Quarters clockwise after which the lower half is the more colored one, by most; the least of equals."""
    best = (0, 0.0)
    if min(colored.shape, default=0) < LEAST_TURNED:
        return best
    for k in range(4):
        own = np.rot90(colored, -k)
        half = own.shape[0] // 2
        score = float(own[half:].mean() - own[:half].mean())
        if k == 0 or score > best[1]:
            best = (k, score)
    return best


def turned(img: np.ndarray, quarters: int) -> np.ndarray:
    """Turned clockwise."""
    return np.rot90(img, -quarters)


def source_points(corners: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of a w x h image lies (x, y) if its corner pixels lie at corners: top left, top right, bottom right, bottom left."""
    x, y = np.arange(w, dtype=float), np.arange(h, dtype=float)
    (x1, y1), (x2, ya), (x3, y3), (xa, y4) = corners
    if x1 == xa and x2 == x3 and y1 == ya and y3 == y4:
        return np.broadcast_to(x1 + x * ((x2 - x1) / max(w - 1, 1)), (h, w)), np.broadcast_to((y1 + y * ((y4 - y1) / max(h - 1, 1)))[:, None], (h, w))
    to = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows, want = [], []
    for (u, v), (px, py) in zip(to, corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -px * u, -px * v], [0, 0, 0, u, v, 1, -py * u, -py * v]]
        want += [px, py]
    try:
        m = np.append(np.linalg.solve(np.array(rows, float), np.array(want, float)), 1).reshape(3, 3)
    except np.linalg.LinAlgError:  # corners on one line
        m = np.array([[0, 0, x1], [0, 0, y1], [0, 0, 1]], float)
    u, v = np.meshgrid(x, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = m[2, 0] * u + m[2, 1] * v + m[2, 2]
        return (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / z, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / z


def sampled(region: np.ndarray, x: np.ndarray, y: np.ndarray, left: int = 0, top: int = 0) -> np.ndarray:
    """Levels at the points, bilinear and rounded half up, from a region whose first pixel is at (left, top); 0 outside of it."""
    h, w = region.shape[:2]
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.where(ok, x - left, -9.0).clip(-9, w + 9), np.where(ok, y - top, -9.0).clip(-9, h + 9)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]

    framed = np.zeros((h + 2, w + 2, *region.shape[2:]), region.dtype)  # a border of zeros stands for all that is outside
    framed[1:-1, 1:-1] = region

    def at(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return framed[row.clip(-1, h) + 1, col.clip(-1, w) + 1].astype(float)

    above = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    below = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.floor(above * (1 - fy) + below * fy + 0.5).clip(0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def area_weights(n: int, to: int) -> np.ndarray:
    """to x n: the share of each of n equal parts of a line that falls into each of to parts."""
    edge = np.arange(to + 1) * (n / to)
    part = np.arange(n)
    return np.clip(np.minimum(edge[1:, None], part + 1) - np.maximum(edge[:-1, None], part), 0, None) * (to / n)


def thumbnail(img: np.ndarray, most: int) -> np.ndarray:
    """The image with no side longer than `most`, its shape kept, each pixel the mean of the area that it covers; a small one as it is."""
    h, w = img.shape[:2]
    if max(h, w) <= most:
        return img
    scale = most / max(h, w)
    high, wide = max(round(h * scale), 1), max(round(w * scale), 1)
    levels = img.reshape(h, w, -1).astype(float)
    out = np.einsum("yh,hwc->ywc", area_weights(h, high), levels)
    out = np.einsum("xw,ywc->yxc", area_weights(w, wide), out)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8).reshape(high, wide, *img.shape[2:])


def inside_polygon(corners: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels of the polygon by even-odd scan conversion: those whose center a row's crossings enclose, and its outline."""
    out = np.zeros((h, w), bool)
    points = np.asarray(corners, float)
    low, high = max(int(np.ceil(points[:, 1].min())), 0), min(int(np.floor(points[:, 1].max())), h - 1)
    for y in range(low, high + 1):
        cross = []
        for (xa, ya), (xb, yb) in zip(points, np.roll(points, -1, axis=0), strict=True):
            if min(ya, yb) <= y < max(ya, yb):
                cross.append(xa + (y - ya) * (xb - xa) / (yb - ya))
        cross.sort()
        for a, z in zip(cross[::2], cross[1::2], strict=False):
            out[y, max(int(np.ceil(a)), 0) : max(min(int(np.floor(z)), w - 1) + 1, 0)] = True
    return out | outline(points, h, w)


def outline(corners: np.ndarray, h: int, w: int, thick: int = 1) -> np.ndarray:
    """Pixels within about half of `thick` of the closed line through the corners."""
    out = np.zeros((h, w), bool)
    points = np.asarray(corners, float)
    for a, b in zip(points, np.roll(points, -1, axis=0), strict=True):
        n = int(np.abs(b - a).max()) + 1
        x, y = (np.floor(np.linspace(a[i], b[i], n + 1) + 0.5).astype(int) for i in (0, 1))
        for dy in range(-(thick // 2), thick - thick // 2):
            for dx in range(-(thick // 2), thick - thick // 2):
                ok = (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h)
                out[y[ok] + dy, x[ok] + dx] = True
    return out


#: The share of light that is left outside of tags, and the color and thickness of outlines.
DARK, GREEN, THICK = 0.3, (0, 255, 0), 2


def highlighted(bgr: np.ndarray, polygons: list[np.ndarray]) -> np.ndarray:
    """The frame darkened outside of the polygons, which are outlined."""
    h, w = bgr.shape[:2]
    out = (bgr * DARK).astype(np.uint8)
    corners = [np.trunc(np.asarray(p, float)) for p in polygons]
    for p in corners:
        own = inside_polygon(p, h, w)
        out[own] = bgr[own]
    for p in corners:
        out[outline(p, h, w, THICK)] = GREEN
    return out


def png(img: np.ndarray) -> bytes:
    """The image as a PNG file, gray or color."""
    h, w = img.shape[:2]
    rows = img[..., ::-1] if img.ndim == 3 else img
    raw = np.zeros((h, 1 + rows[0].size), np.uint8)  # each row is led by its filter, 0: none
    raw[:, 1:] = rows.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
