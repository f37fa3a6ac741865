"""Raster kernels on small images: array expressions for metrics, numpy inside one mapInPandas stage for enhancement.

The published algorithms; exact parity with a particular imaging library is not claimed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bright_ratio(gray: Column) -> Column:
    return F.size(F.filter(gray, lambda g: g > 240)) / F.size(gray)


def spread(gray: Column) -> Column:
    n = F.size(gray)
    mean = F.aggregate(gray, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(gray, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean)


#: Angles at which a line still tells the skew, and the least skew that is turned back, in degrees.
STEEPEST, LEAST_SKEW = 45.0, 0.3


def skew(lines: DataFrame, image: str, angle: str) -> DataFrame:
    """(image, angle): the median angle of an image's flat lines, where it is worth turning back."""
    flat = lines.where(F.abs(F.col(angle)) < STEEPEST)
    return flat.groupBy(image).agg(F.median(angle).alias("angle")).where(F.abs("angle") >= LEAST_SKEW)


def slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How steep a line is, without sign; null where it is upright."""
    return F.when(x1 != x2, F.abs((y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))))


def mean_slope(lines: DataFrame, image: str, slope_col: str) -> DataFrame:
    """(image, slope) over an image's lines that are not upright."""
    return lines.where(F.col(slope_col).isNotNull()).groupBy(image).agg(F.avg(slope_col).alias("slope"))


def any_glare(gray: Column) -> Column:
    """Whether there is a pixel to repair at all."""
    return F.exists(gray, lambda g: g > 240)


def mirrored(i: Column, n: Column) -> Column:
    """A place within n of one that may lie outside: mirrored at the borders without repeating them, however far it is."""
    period = F.greatest(2 * n - 2, F.lit(1))
    k = F.pmod(i, period)
    return F.when(k >= n, period - k).otherwise(k)


def clamped(i: Column, n: Column) -> Column:
    """A place within n of one that may lie outside: the nearest border."""
    return F.greatest(F.lit(0), F.least(i, n - 1))


def stencil(gray: Column, width: int | Column, weights: dict[tuple[int, int], float], border: Callable[[Column, Column], Column] = mirrored) -> Column:
    """A weighted sum over each pixel's surroundings (row and column offsets); a flat array of rows in, one out."""
    height = (F.size(gray) / width).cast("int")

    def pixel(_: Column, i: Column) -> Column:
        row, col = F.floor(i / width).cast("int"), i % width
        out = F.lit(0.0)
        for (dr, dc), weight in weights.items():
            out = out + weight * F.get(gray, border(row + dr, height) * width + border(col + dc, F.lit(width)))
        return out

    return F.transform(gray, pixel)


#: The second derivative of a raster.
LAPLACIAN = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}


def blur_variance(gray: Column, width: int) -> Column:
    """Variance of the second derivative; under 100 an image counts as blurred."""
    return F.pow(spread(stencil(gray, width, LAPLACIAN)), 2.0)


def upscale(img: np.ndarray, width: int = 1200) -> np.ndarray:
    """Cubic (Catmull-Rom) upscale to a least width."""
    h, w = img.shape
    if w >= width:
        return img
    k = width / w

    def along(a: np.ndarray, n: int) -> np.ndarray:
        x = (np.arange(n) + 0.5) / k - 0.5
        i = np.floor(x).astype(int)
        t = (x - i)[:, None]
        p = [a[np.clip(i + d, 0, len(a) - 1)] for d in (-1, 0, 1, 2)]
        return p[1] + 0.5 * t * (p[2] - p[0] + t * (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3] + t * (3 * (p[1] - p[2]) + p[3] - p[0])))

    return np.clip(along(along(img.astype(float), round(h * k)).T, width).T, 0, 255)


def remove_glare(img: np.ndarray, most: float = 240) -> np.ndarray:
    """Pixels over ``most`` are filled by diffusion from their surroundings."""
    mask = img > most
    if not mask.any() or mask.all():
        return img
    out = np.where(mask, img[~mask].mean(), img.astype(float))
    for _ in range(60):
        p = np.pad(out, 1, mode="edge")
        out[mask] = ((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4)[mask]
    return out


def laplacian_variance(img: np.ndarray) -> float:
    p = np.pad(img.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img).var())


def unsharp(img: np.ndarray) -> np.ndarray:
    """1.5 times the image less half its blur, where it is blurred."""
    if laplacian_variance(img) >= 100:
        return img
    p = np.pad(img.astype(float), 1, mode="edge")
    blur = sum(p[i : i + img.shape[0], j : j + img.shape[1]] for i in range(3) for j in range(3)) / 9
    return np.clip(1.5 * img - 0.5 * blur, 0, 255)


def sauvola(img: np.ndarray, window: int = 51, k: float = 0.2, r: float = 128.0) -> np.ndarray:
    """Binary image by Sauvola's local threshold, from integral images."""
    h = min(window // 2, min(img.shape) - 1)
    p = np.pad(img.astype(float), h, mode="reflect")

    def box(a: np.ndarray) -> np.ndarray:
        s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        w = 2 * h + 1
        return (s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]) / w**2

    mean = box(p)
    dev = np.sqrt(np.maximum(box(p * p) - mean**2, 0))
    return np.where(img > mean * (1 + k * (dev / r - 1)), 255.0, 0.0)


def order_corners(pts: np.ndarray) -> np.ndarray:
    """Top-left, top-right, bottom-right, bottom-left."""
    s, d = pts.sum(1), pts[:, 1] - pts[:, 0]
    return pts[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), dst.reshape(-1)), 1).reshape(3, 3)


def png(img: np.ndarray) -> bytes:
    """A gray image as a PNG file."""
    rows = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def image_files(images: DataFrame, id_col: str, gray_col: str, width: int) -> DataFrame:
    """(id, content): each image as a PNG in a binary column, made where its row lies; ids may be null or repeat."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "content": [png(np.array(g, float).reshape(-1, width)) for g in f[gray_col]]})

    return images.select(id_col, gray_col).mapInPandas(run, f"`{id_col}` {images.schema[id_col].dataType.simpleString()}, content binary")


STEPS = (("glare", remove_glare), ("unsharp", unsharp), ("binarize", sauvola))


def enhance(images: DataFrame, id_col: str, gray_col: str, width: int) -> DataFrame:
    """All steps fused in one stage; a step that fails leaves its input and is named in ``failed``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, gray in zip(frame[id_col], frame[gray_col], strict=True):
                img, failed = np.array(gray, float).reshape(-1, width), []
                for name, step in STEPS:
                    try:
                        img = step(img)
                    except Exception:  # fail open
                        failed.append(name)
                out.append((key, img.ravel().tolist(), laplacian_variance(np.array(gray, float).reshape(-1, width)), ",".join(failed)))
            yield pd.DataFrame(out, columns=["image_id", "pixels", "sharpness", "failed"])

    return images.select(id_col, gray_col).mapInPandas(run, "image_id long, pixels array<double>, sharpness double, failed string")
