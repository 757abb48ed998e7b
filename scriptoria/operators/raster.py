"""Image kernels on grey pixels, one image per row, in numpy (IMG). Statistics of pixel tables are in aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import geometry


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def whiteness(r: Column, g: Column, b: Column) -> Column:
    return F.least(r, g, b)


def blurred(g: np.ndarray) -> np.ndarray:
    """Binomial 5 by 5, edges repeated, each pass rounded."""
    def along(x: np.ndarray) -> np.ndarray:
        p = np.pad(x.astype(np.int32), ((0, 0), (2, 2)), "edge")
        return (p[:, :-4] + 4 * p[:, 1:-3] + 6 * p[:, 2:-2] + 4 * p[:, 3:-1] + p[:, 4:] + 8) >> 4
    return along(along(g).T).T.astype(np.uint8)


def edges(g: np.ndarray, low: int = 60, high: int = 150) -> np.ndarray:
    """Thin ridges of the gradient above high, and those above low that touch them."""
    p = np.pad(g.astype(np.int32), 1, "edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    steep, flat = np.abs(dy) > 2.414 * np.abs(dx), np.abs(dx) > 2.414 * np.abs(dy)
    rising = dx * dy > 0
    pick = lambda a, b, c, d: np.where(flat, a, np.where(steep, b, np.where(rising, c, d)))
    one = pick(q[1:-1, 2:], q[2:, 1:-1], q[2:, 2:], q[2:, :-2])
    two = pick(q[1:-1, :-2], q[:-2, 1:-1], q[:-2, :-2], q[:-2, 2:])
    ridge = (m >= one) & (m > two)
    weak, strong = ridge & (m >= low), ridge & (m >= high)
    while True:
        grown = dilated(strong) & weak
        if (grown == strong).all():
            return strong
        strong = grown | strong


def dilated(b: np.ndarray) -> np.ndarray:
    p = np.pad(b, 1)
    h, w = b.shape
    out = np.zeros_like(b)
    for y in range(3):
        for x in range(3):
            out |= p[y : y + h, x : x + w]
    return out


def labelled(b: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Components of set pixels, each with its smallest index plus 1; 0 elsewhere. Labels spread until they settle."""
    h, w = b.shape
    lab = np.where(b, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        before = lab.copy()
        for dy, dx in steps:
            for sy, sx in ((dy, dx), (-dy, -dx)):
                near = np.zeros_like(lab)
                near[max(0, sy) : h + min(0, sy), max(0, sx) : w + min(0, sx)] = lab[max(0, -sy) : h + min(0, -sy), max(0, -sx) : w + min(0, -sx)]
                lab = np.where(b & (near > 0) & (near < lab), near, lab)
        flat = np.concatenate([[0], lab.ravel()])
        lab = np.where(b, flat[lab], 0)  # jump to the label's own label
        if (lab == before).all():
            return lab


def document_quad(g: np.ndarray) -> tuple[np.ndarray | None, float]:
    """The best four-cornered outline and its score: by area, how straight it is filled, largest component first."""
    h, w = g.shape
    lab = labelled(dilated(edges(blurred(g))))
    best: tuple[np.ndarray | None, float] = (None, 0.0)
    sizes = np.bincount(lab.ravel())
    for k in np.argsort(-sizes[1:], kind="stable")[:6] + 1:
        if not sizes[k]:
            continue
        y, x = np.nonzero(lab == k)
        q = geometry.quad_of_hull(np.stack([x, y], axis=1))
        if q is None:
            continue
        a = abs(sum(q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4))) / 2 / (h * w)
        around = np.concatenate([np.linspace(q[i], q[(i + 1) % 4], 40) for i in range(4)]).astype(int)
        support = (lab[around[:, 1].clip(0, h - 1), around[:, 0].clip(0, w - 1)] == k).mean()
        score = a * (0.25 + 0.75 * support) * (0.5 + 0.5 * support)
        if a >= 0.08 and score > best[1]:
            best = (q, float(score))
    return best


def detect(images: DataFrame, key: str) -> DataFrame:
    """Images (key, w, h, pixels binary) to (key, found, score, corners): one Arrow pass, an image at a time."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score, corners = [], [], []
            for w, h, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                q, s = document_quad(np.frombuffer(data, np.uint8).reshape(h, w))
                found.append(q is not None)
                score.append(round(s, 6))
                corners.append(None if q is None else [float(v) for p in q for v in p])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(score), pa.array(corners, pa.list_(pa.float64()))], names=["key", "found", "score", "corners"])

    return images.select(F.col(key).alias("key"), "w", "h", "pixels").mapInArrow(run, f"key {kind}, found boolean, score double, corners array<double>").withColumnRenamed("key", key)


def _sharpness(v: np.ndarray, w: int) -> tuple[float | None, float | None]:
    """Variance of the Laplacian at pixels with all four neighbours, and deviation of all values; sums are whole numbers."""
    n = len(v)
    if not n:
        return None, None
    std = math.sqrt(max(0, n * int((v * v).sum()) - int(v.sum()) ** 2)) / n
    if n <= 2 * w:
        return None, std
    x = np.arange(w, n - w) % w
    lap = (v[: n - 2 * w] + v[2 * w :] + v[w - 1 : n - w - 1] + v[w + 1 : n - w + 1] - 4 * v[w : n - w])[(x > 0) & (x < w - 1)]
    if not len(lap):
        return None, std
    mean = int(lap.sum()) / len(lap)
    return int((lap * lap).sum()) / len(lap) - mean * mean, std


def sharpness(images: DataFrame, key: str, w: int) -> DataFrame:
    """(key, blur, std) of images (key, codes binary): four bytes a pixel, the highest first, of which the last counts, w pixels
    a line; the last line may be shorter (AGG-7). One Arrow pass, an image at a time: no pixel is shuffled. Images without codes are left out."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sharpness(np.frombuffer(x.as_buffer(), np.uint8)[3::4].astype(np.int64), w) for x in batch.column(1)]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "blur", "std"])

    given = images.select(F.col(key).alias("key"), "codes").where("codes IS NOT NULL")
    return given.mapInArrow(run, f"key {kind}, blur double, std double").withColumnRenamed("key", key)
