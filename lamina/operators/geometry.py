"""Rectangles, crops, block previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.matrix import XYZ_TO_SRGB
from lamina.functions.pixel import apply_matrix, clamp, gamma_srgb


def clip_rect(rect: list[Column], keep: list[Column], size: tuple[Column, Column] | None = None) -> Column:
    """A rectangle (x0, y0, x1, y1, inclusive) cut to ``keep`` and made relative to it; null where they are apart.

    With ``size`` (width, height) it is rescaled from keep's size by integer division.
    """
    x0, y0, x1, y1 = rect
    k0, l0, k1, l1 = keep
    apart = (x0 > k1) | (y0 > l1) | (x1 < k0) | (y1 < l0)
    cut = [F.greatest(x0, k0) - k0, F.greatest(y0, l0) - l0, F.least(x1, k1) - k0, F.least(y1, l1) - l0]
    if size:
        sides = [k1 - k0 + 1, l1 - l0 + 1] * 2
        cut = [F.call_function("div", c * s, n) for c, s, n in zip(cut, [*size, *size], sides, strict=True)]
    return F.when(~apart, F.struct(*[c.cast("long").alias(n) for c, n in zip(cut, ("x0", "y0", "x1", "y1"), strict=True)]))


def crop(pixels: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """The pixels inside a rectangle, moved to its corner. The bounds reach the scan as filters."""
    x0, y0, x1, y1 = rect
    inside = pixels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def centre_rect(width: int, height: int, target_width: int, target_height: int) -> tuple[int, int, int, int]:
    """The centred rectangle of a target size; a zero target means everything."""
    if not target_width or not target_height:
        target_width, target_height = width, height
    x, y = (width - target_width) // 2, (height - target_height) // 2
    return x, y, x + target_width - 1, y + target_height - 1


def plan_dimensions(width: int, height: int, crop_to: tuple[int, int, int, int] | None = None, header: tuple[int, int] = (0, 0), cropped: bool = True) -> tuple[int, int, int, int]:
    """The rectangle to keep: everything, the active area, or the centre of the header's size."""
    if not cropped:
        return 0, 0, width - 1, height - 1
    return crop_to or centre_rect(width, height, *header)


def reduction(width: int, most: int = 300) -> int:
    return max(1, -(-width // most))


def preview(pixels: DataFrame, width: int, height: int, most: int = 300, white: float = 65535.0, group: str = "image_id") -> DataFrame:
    """Block means of whole blocks, colour matrix, sRGB curve, and a clip that keeps the channels' proportions."""
    k = reduction(width, most)
    w, h = width // k, height // k
    blocks = pixels.where((F.col("x") < w * k) & (F.col("y") < h * k)).groupBy(group, F.expr(f"y div {k}").alias("y"), F.expr(f"x div {k}").alias("x"))
    mean = blocks.agg(*[F.sum(c).alias(c) for c in ("b", "m", "t")])
    unit = [clamp(F.col(c) / float(k * k) / white, 0, 1) for c in ("b", "m", "t")]
    rgb = [gamma_srgb(v) * 255.0 for v in apply_matrix(XYZ_TO_SRGB, *unit)]
    out = mean.select(group, "y", "x", *[v.alias(n) for v, n in zip(rgb, "rgb", strict=True)])
    peak = F.greatest(*[F.col(c) for c in "rgb"])
    shrink = F.when(peak > 255, 255.0 / peak).otherwise(F.lit(1.0))
    return out.select(group, "y", "x", *[F.floor(F.greatest(F.lit(0.0), F.col(c) * shrink) + 0.5).cast("long").alias(c) for c in "rgb"])
