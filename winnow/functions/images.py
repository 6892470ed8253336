"""Measures of grey images as (px array<short>, height, width): small numpy helpers behind Arrow UDFs.

Decoders and segmenters are models of the caller's; these take their pixels or masks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BORDER, PAD, LEAST_LINES = 0.15, 2, 8
# fixed values of the line score: the frame it is taken in, the scales of its lines in pixels, the share of pixels that count
FRAME = 256
SCALES = (1.0, 2.0)
TOP_SHARE = 0.02


def pixel_stats(image: np.ndarray) -> tuple[float, float]:
    """Standard deviation (n - 1) and the share of pixels at 1 or less, or 254 or more."""
    v = image.astype(np.float64)
    return (float(v.std(ddof=1)) if v.size > 1 else float("nan")), float(((v <= 1) | (v >= 254)).mean())


def bounding_box(mask: np.ndarray, pad: int = 0) -> tuple[int, int, int, int]:
    """(top, bottom, left, right), ends included, of the true cells, widened by ``pad`` within the mask; all of it if none is true."""
    box = []
    for axis, size in enumerate(mask.shape):
        hit = mask.any(axis=1 - axis)
        low, high = (int(hit.argmax()), size - 1 - int(hit[::-1].argmax())) if hit.any() else (0, size - 1)
        box += [max(low - pad, 0), min(high + pad, size - 1)]
    return box[0], box[1], box[2], box[3]


def crop_box(image: np.ndarray) -> tuple[int, int, int, int]:
    """(top, bottom, left, right), ends included: the box around where bright rows and bright columns meet, padded; all of it if few are bright.

    A line is bright if its mean is over a share of the brightest line's.
    """
    levels = [image.mean(axis=axis, dtype=np.float64) for axis in (1, 0)]
    bright = [level > BORDER * level.max() for level in levels]
    if any(np.count_nonzero(lines) < LEAST_LINES for lines in bright):
        return bounding_box(np.ones(image.shape, bool))
    return bounding_box(np.outer(*bright), PAD)


def grey(image: np.ndarray) -> np.ndarray:
    """A colour image (h, w, 3 or more) as luma (0.299, 0.587, 0.114), rounded; a grey one as it is."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(image.dtype)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, a * (((x - 5) * x + 8) * x - 4), 0.0))


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


FILTERS = {"lanczos": (_lanczos, 3), "bicubic": (_cubic, 2), "bilinear": (_triangle, 1)}


def _weights(old: int, new: int, kind: str) -> np.ndarray:
    """A row for each new pixel: the share of each old one. Where pixels become fewer, the filter is as wide as a new pixel."""
    shape, support = FILTERS[kind]
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    first, last = np.maximum(np.floor(centre - support * wide + 0.5), 0), np.minimum(np.floor(centre + support * wide + 0.5), old)
    at = np.arange(old)[None, :]
    out = shape((at + 0.5 - centre[:, None]) / wide) * ((at >= first[:, None]) & (at < last[:, None]))
    return out / out.sum(1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """By a separable filter: ``lanczos`` (three lobes), ``bicubic`` (a = -1/2) or ``bilinear``.

    Columns first, then rows; whole numbers are rounded and held to their range after each, as 8-bit images are.
    """
    out = image
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] == size:
            continue
        mixed = np.moveaxis(np.tensordot(_weights(out.shape[axis], size, kind), out.astype(np.float64), (1, axis)), 0, axis)
        if image.dtype.kind in "ui":
            most = np.iinfo(image.dtype).max if image.dtype == np.uint8 else 255
            mixed = np.clip(np.floor(mixed + 0.5), 0, most).astype(image.dtype)
        out = mixed
    return out


def _derived(a: np.ndarray, sigma: float, orders: tuple[int, int]) -> np.ndarray:
    """``a`` under a Gaussian, derived once along the axes of order 1; mirrored at the edges."""
    for axis, order in enumerate(orders):
        # narrow Gaussians end late, so that what a cut would leave at the edge of the taps is nothing
        reach = int((8 if sigma > 0.75 else 100) * sigma + 0.5)
        x = np.arange(-reach, reach + 1)
        taps = np.exp(-0.5 * (x / sigma) ** 2)
        taps /= taps.sum()
        if order:
            taps = -x / sigma**2 * taps
        full = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(np.convolve, axis, full, taps, "valid")
    return a


def ridges(image: np.ndarray, scales: tuple[float, ...] = SCALES) -> np.ndarray:
    """Strength of thin bright lines (grey values 0 to 1): over the scales, how fast the brightness bends down across a line, by the larger eigenvalue of the Hessian.

    Second derivatives of a Gaussian of a scale are two first ones of half its variance.
    """
    a, best = image.astype(np.float64) / 255.0, np.zeros(image.shape)
    for s in scales:
        half = s / 2**0.5
        gy, gx = _derived(a, half, (1, 0)), _derived(a, half, (0, 1))
        yy, yx, xx = _derived(gy, half, (1, 0)), _derived(gy, half, (0, 1)), _derived(gx, half, (0, 1))
        mean, gap = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + yx**2)
        best = np.maximum(best, np.maximum(gap - mean, 0) * s * s)
    return best


def framed(image: np.ndarray) -> np.ndarray:
    """A grey image in the frame of the line score."""
    image = np.clip(grey(image), 0, 255).astype(np.uint8)
    return image if image.shape == (FRAME, FRAME) else resized(image, FRAME, FRAME, "bicubic")


def line_score(image: np.ndarray) -> float:
    """Mean strength of the strongest two percent of all pixels of the frame."""
    strength = ridges(framed(image)).reshape(-1)
    k = strength.size - int((1 - TOP_SHARE) * strength.size)
    return float(np.partition(strength, strength.size - k)[strength.size - k :].mean())


def line_coverage(image: np.ndarray) -> float:
    return float(ridges(framed(image)).mean())


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image: np.ndarray, level: int = 6) -> bytes:
    """A grey (h, w) or colour (h, w, 3) image of 8 bits as a PNG file; each row by the filter whose bytes are the smallest in sum."""
    rows = np.ascontiguousarray(image, np.uint8).reshape(image.shape[0], -1).astype(np.int16)
    step = rows.shape[1] // image.shape[1]
    left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    above = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    guess = left + above - corner
    gaps = np.abs(np.stack([guess - left, guess - above, guess - corner]))
    paeth = np.where((gaps[0] <= gaps[1]) & (gaps[0] <= gaps[2]), left, np.where(gaps[1] <= gaps[2], above, corner))
    filtered = np.stack([rows, rows - left, rows - above, rows - (left + above) // 2, rows - paeth]).astype(np.uint8)
    best = np.abs(filtered.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    lines = np.concatenate([best[:, None].astype(np.uint8), filtered[best, np.arange(len(rows))]], 1)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def row_extent(mask: np.ndarray) -> int:
    """The widest distance between the first and the last set pixel of a row, both included."""
    m = mask > 0
    if not m.any():
        return 0
    m = m[m.any(1)]
    return int((m.shape[1] - m[:, ::-1].argmax(1) - m.argmax(1)).max())


def width_ratio(inner: np.ndarray, outer: np.ndarray) -> float:
    """Extent of one mask over that of another; NaN without the other."""
    w = row_extent(outer)
    return row_extent(inner) / w if w else float("nan")


def scorer(fn: Callable[[np.ndarray], float]):
    """A pandas UDF (px, height, width) -> double from a function of one image; null pixels give null."""

    @F.pandas_udf(T.DoubleType())
    def score(px: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else fn(np.asarray(p).reshape(int(h), int(w))) for p, h, w in zip(px, height, width)], dtype="float64")

    return score


@F.pandas_udf(T.StructType([T.StructField("std", T.DoubleType()), T.StructField("rails", T.DoubleType())]))
def pixel_stats_udf(px: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if p is None else pixel_stats(np.asarray(p).reshape(int(h), int(w))) for p, h, w in zip(px, height, width)], columns=["std", "rails"], dtype="float64")


def resized_udf(size: int, kind: str = "lanczos"):
    """A pandas UDF (px, height, width) -> (px, height, width) of a square of ``size``; null pixels stay null."""

    @F.pandas_udf("px array<short>, height int, width int")
    def resize(px: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, w in zip(px, height, width):
            image = None if p is None else resized(np.clip(np.asarray(p), 0, 255).astype(np.uint8).reshape(int(h), int(w)), size, size, kind)
            out.append((None, None, None) if image is None else (image.ravel().astype(np.int16), size, size))
        return pd.DataFrame(out, columns=["px", "height", "width"])

    return resize


@F.pandas_udf(T.StructType([T.StructField("px", T.ArrayType(T.ShortType())), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]))
def crop_udf(px: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for p, h, w in zip(px, height, width):
        if p is None:
            out.append((None, None, None))
            continue
        image = np.asarray(p).reshape(int(h), int(w))
        t, b, l, r = crop_box(image)
        image = image[t : b + 1, l : r + 1]
        out.append((image.ravel().astype(np.int16), image.shape[0], image.shape[1]))
    return pd.DataFrame(out, columns=["px", "height", "width"])
