"""Operators that read a pixel's neighbours, in numpy on tiles with a halo: no self-join, no row for each tap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.pixel import WHITE16, clamp16, opponent_top4, opponent_top4_inverse
from lamina.operators.tiles import TILE, own_places, tiled


def median3(pixels: DataFrame, value: str, width: int, height: int, area: tuple[int, int, int, int] | None = None, group: str = "image_id", tile: int = TILE) -> DataFrame:
    """3x3 median with replicated borders: (image, y, x, median) over ``area`` (x0, y0, x1, y1), or everywhere.

    Pixels outside the area are read, not written.
    """
    x0, y0, x1, y1 = area or (0, 0, width - 1, height - 1)

    def run(grid, there, corner, own):
        y, x = own_places(there, corner, own, tile)
        inside = (x + corner[1] >= x0) & (x + corner[1] <= x1) & (y + corner[0] >= y0) & (y + corner[0] <= y1)
        y, x = y[inside], x[inside]
        wide = np.pad(grid[:, :, 0], 1, mode="edge")
        taps = np.stack([wide[y + i, x + j] for i in range(3) for j in range(3)], axis=1)
        return y + corner[0], x + corner[1], np.partition(taps, 4, axis=1)[:, 4]

    return tiled(pixels, [value], run, ["median"], 1, group, tile)


def median_area(pixels: DataFrame, value: str, width: int, height: int, area: tuple[int, int, int, int] | Column | None = None, group: str = "image_id") -> DataFrame:
    """``pixels`` with the median written over ``value`` inside the area, which may be a struct column (null: everywhere)."""
    fixed = None if isinstance(area, Column) else area
    found = median3(pixels, value, width, height, fixed, group)
    new = F.coalesce("median", value)
    if isinstance(area, Column):
        inside = area.isNull() | (F.col("x").between(area["x0"], area["x1"]) & F.col("y").between(area["y0"], area["y1"]))
        new = F.when(inside, new).otherwise(F.col(value))
    return pixels.join(found, [group, "y", "x"], "left").withColumn(value, new).drop("median")


def cubic_weight(x: Column, a: float = -0.5) -> Column:
    """The cubic convolution kernel; -0.5 is the Catmull-Rom spline."""
    x = F.abs(x)
    near = (a + 2) * x * x * x - (a + 3) * x * x + 1
    far = a * x * x * x - 5 * a * x * x + 8 * a * x - 4 * a
    return F.when(x <= 1, near).when(x < 2, far).otherwise(F.lit(0.0))


def bicubic(pixels: DataFrame, values: list[str], size_in: tuple[int, int], size_out: tuple[int, int], library_kernel: bool = False, group: str = "image_id", tile: int = TILE) -> DataFrame:
    """Bicubic resize of (width, height) ``size_in`` to ``size_out``.

    By default the Catmull-Rom kernel at (d + 0.5) * scale, without the half-pixel shift, truncated; with
    ``library_kernel`` a = -0.75 at (d + 0.5) * scale - 0.5, rounded. The axes are separable: a tile is multiplied by a
    matrix of taps on either side. A destination belongs to the tile that holds its base pixel.
    """
    a, centre = (-0.75, 0.5) if library_kernel else (-0.5, 0.0)
    (wi, hi), (wo, ho) = size_in, size_out

    def taps(n_in: int, n_out: int, first: int, corner: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Destinations whose base lies in [first, first + tile), and their weights over the grid's lines."""
        s = (np.arange(n_out) + 0.5) * (n_in / n_out) - centre
        base = np.floor(s).astype(int)
        at = np.clip(base, 0, n_in - 1)
        mine = np.nonzero((at >= first) & (at < first + tile))[0]
        m = np.zeros((len(mine), size))
        for k in range(-1, 3):
            d = np.abs(k - (s - base))[mine]
            w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d * d + 1, np.where(d < 2, a * d**3 - 5 * a * d * d + 8 * a * d - 4 * a, 0))
            line = np.clip(base[mine] + k, 0, n_in - 1) - corner
            some = (line >= 0) & (line < size)  # lines that the image lacks have no weight
            np.add.at(m, (np.nonzero(some)[0], line[some]), w[some])
        return mine, m

    def run(grid, there, corner, own):
        ys, down = taps(hi, ho, own[0], corner[0], grid.shape[0]) if own[0] <= corner[0] + grid.shape[0] - 1 else (np.zeros(0, int), np.zeros((0, grid.shape[0])))
        xs, across = taps(wi, wo, own[1], corner[1], grid.shape[1]) if own[1] <= corner[1] + grid.shape[1] - 1 else (np.zeros(0, int), np.zeros((0, grid.shape[1])))
        weight = (down @ there @ across.T)[:, :, None]
        big = np.stack([down @ grid[:, :, i] @ across.T for i in range(grid.shape[2])], axis=2) / np.where(weight == 0, 1, weight)
        big = np.clip(big, 0, WHITE16)
        done = np.rint(big) if library_kernel else np.floor(np.round(big, 9))
        rows, columns = np.meshgrid(ys, xs, indexing="ij")
        some = (weight[:, :, 0] != 0).ravel()
        return rows.ravel()[some], columns.ravel()[some], done.reshape(-1, grid.shape[2])[some]

    return tiled(pixels, values, run, values, 2, group, tile)


def quattro_expand(pixels: DataFrame, top: DataFrame, size_in: tuple[int, int], size_out: tuple[int, int], library_kernel: bool = False, group: str = "image_id") -> DataFrame:
    """Colour at low resolution, luma from the full-resolution top layer (image, y, x, v), aligned at the top left.

    Places that the top layer does not cover keep their resized luma.
    """
    luma, u, v = opponent_top4(F.col("b"), F.col("m"), F.col("t"))
    low = pixels.select(group, "y", "x", luma.alias("_luma"), u.alias("_u"), v.alias("_v"))
    big = bicubic(low, ["_luma", "_u", "_v"], size_in, size_out, library_kernel, group)
    full = top.select(group, "y", "x", clamp16(F.col("v") * 4).alias("_top"))
    joined = big.join(full, [group, "y", "x"], "left").withColumn("_luma", F.coalesce("_top", "_luma"))
    b, m, t = opponent_top4_inverse(F.col("_luma"), F.col("_u"), F.col("_v"))
    return joined.select(group, "y", "x", b.alias("b"), m.alias("m"), t.alias("t"))
