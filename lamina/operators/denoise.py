"""Denoising: opponent colour, non-local means in three steps, and the high-resolution variant.

Written from the published method; library kernels differ in rounding, so results are close, not equal: means over
shifted copies of the image in exact arithmetic, weights from the mean absolute patch difference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamina.functions.pixel import WHITE16

CHANNELS = ("b", "m", "t")
#: Class -> strength and colour transform.
CLASSES = {"STD": (100.0, "std"), "F20": (70.0, "top"), "F23": (300.0, "top4")}


def nlm(v: np.ndarray, h: float, template: int = 3, search: int = 11) -> np.ndarray:
    """Non-local means of one channel with replicated borders; h = 0 leaves it as it is."""
    if h <= 0:
        return v.astype(float)
    r, s = template // 2, search // 2
    wide = np.pad(v.astype(float), r + s, mode="edge")
    rows, columns = v.shape
    centre = wide[s : s + rows + 2 * r, s : s + columns + 2 * r]
    total, weight = np.zeros(v.shape), np.zeros(v.shape)
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            moved = wide[s + dy : s + dy + rows + 2 * r, s + dx : s + dx + columns + 2 * r]
            box = np.cumsum(np.cumsum(np.pad(np.abs(moved - centre), ((1, 0), (1, 0))), axis=0), axis=1)
            distance = (box[template:, template:] - box[:-template, template:] - box[template:, :-template] + box[:-template, :-template]) / template**2
            w = np.exp(-((distance / h) ** 2))
            total += w * moved[r : r + rows, r : r + columns]
            weight += w
    return total / weight


def median3(v: np.ndarray) -> np.ndarray:
    wide = np.pad(v, 1, mode="edge")
    return np.median(np.stack([wide[i : i + v.shape[0], j : j + v.shape[1]] for i in range(3) for j in range(3)]), axis=0)


def shrink4(v: np.ndarray) -> np.ndarray:
    """Area means of 4x4 blocks; blocks cut by the edge average what they have."""
    rows, columns = -(-v.shape[0] // 4), -(-v.shape[1] // 4)
    y, x = np.arange(v.shape[0]) // 4, np.arange(v.shape[1]) // 4
    total, count = np.zeros((rows, columns)), np.zeros((rows, columns))
    np.add.at(total, (y[:, None], x[None, :]), v)
    np.add.at(count, (y[:, None], x[None, :]), 1)
    return total / count


def grow(v: np.ndarray, rows: int, columns: int, a: float = -0.75) -> np.ndarray:
    """Cubic resize, half-pixel centres, replicated borders."""

    def taps(n_in: int, n_out: int) -> np.ndarray:
        m = np.zeros((n_out, n_in))
        for d in range(n_out):
            s = (d + 0.5) * n_in / n_out - 0.5
            base = int(np.floor(s))
            for k in range(-1, 3):
                x = abs(k - (s - base))
                w = (a + 2) * x**3 - (a + 3) * x * x + 1 if x <= 1 else a * x**3 - 5 * a * x * x + 8 * a * x - 4 * a if x < 2 else 0
                m[d, min(max(base + k, 0), n_in - 1)] += w
        return m

    return taps(v.shape[0], rows) @ v @ taps(v.shape[1], columns).T


def three_steps(yuv: np.ndarray, h: float) -> np.ndarray:
    """Chroma: fine non-local means, median of V, then the coarse noise of a quarter-size image taken away. Luma stays."""
    out = yuv.astype(float).copy()
    for c in (1, 2):
        out[:, :, c] = nlm(out[:, :, c], h)
    out[:, :, 2] = median3(out[:, :, 2])
    for c, strength in ((1, h / 8), (2, h / 4)):
        small = shrink4(out[:, :, c])
        coarse = small - nlm(small, strength, 3, 21)
        out[:, :, c] -= grow(coarse, *out.shape[:2])
    return np.clip(np.rint(out), 0, WHITE16)


def high_resolution(yuv: np.ndarray, h: float) -> np.ndarray:
    """One pass over chroma, twice as strong on V."""
    out = yuv.astype(float).copy()
    out[:, :, 1], out[:, :, 2] = nlm(out[:, :, 1], h), nlm(out[:, :, 2], 2 * h)
    return np.clip(np.rint(out), 0, WHITE16)


def _trunc(a: np.ndarray, n: int) -> np.ndarray:
    return np.trunc(a / n)


def forward(p: np.ndarray, kind: str) -> np.ndarray:
    b, m, t = (p[:, :, i].astype(float) for i in range(3))
    y = {"std": _trunc(b + m + t + 1, 3), "top": t, "top4": 4 * t}[kind]
    return np.clip(np.stack([y, 2 * b - 2 * t + 32768, b - 2 * m + t + 32768], axis=2), 0, WHITE16)


def backward(p: np.ndarray, kind: str) -> np.ndarray:
    y, u, v = p[:, :, 0], p[:, :, 1] - 32768, p[:, :, 2] - 32768
    if kind == "std":
        out = [_trunc(12 * y + 3 * u + 2 * v + 6, 12), _trunc(3 * y - v + 1, 3), _trunc(12 * y - 3 * u + 2 * v + 6, 12)]
    elif kind == "top":
        out = [_trunc(2 * y + u + 1, 2), _trunc(4 * y + u - 2 * v + 2, 4), y]
    else:
        out = [_trunc(y + 2 * u + 2, 4), _trunc(y + u - 2 * v + 2, 4), _trunc(y + 2, 4)]
    return np.clip(np.stack(out, axis=2), 0, WHITE16)


#: Pixels around a tile that its result can depend on: 6 + 1 at full size, and 11 at a quarter plus the resize.
HALO, TILE = 60, 512


def denoise(pixels: DataFrame, kind: str = "STD", group: str = "image_id", high: bool = False, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """(image, y, x, b, m, t) denoised, tile by tile: each tile is its own group and takes a halo of its neighbours.

    ``tile`` and ``halo`` are multiples of four, so that quarter-size blocks line up; images smaller than a
    tile are one group.
    """
    from pyspark.sql import functions as F

    h, colour = CLASSES.get(kind, CLASSES["STD"])
    near = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - halo) / tile)), F.floor((F.col(c) + halo) / tile))
    sent = pixels.select(group, "y", "x", *CHANNELS).withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        grid = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1, 3))
        y, x = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        grid[y, x] = pdf[list(CHANNELS)].to_numpy()
        yuv = forward(grid, colour)
        done = backward(high_resolution(yuv, h) if high else three_steps(yuv, h), colour)[y, x].astype("int64")
        own = ((pdf["y"] // tile == pdf["_ty"]) & (pdf["x"] // tile == pdf["_tx"])).to_numpy()
        out = pdf.loc[own, [group, "y", "x"]].copy()
        for i, c in enumerate(CHANNELS):
            out[c] = done[own, i]
        return out

    schema = f"{group} {pixels.schema[group].dataType.simpleString()}, y long, x long, b long, m long, t long"
    return sent.where("_ty >= 0 and _tx >= 0").groupBy(group, "_ty", "_tx").applyInPandas(run, schema)
