"""Black level, intermediate range, linear map, and the full-resolution top layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.pixel import clamp16

UNIT, BIAS_FACTOR, MAX_RAW, TOP_BLACK = 16383, 4.0, 4095, 2046.0
FALLBACK_LEVEL, FALLBACK_DEVIATION, FALLBACK_GAIN = (16.112489, 16.053343, 16.193610), (10.918860,) * 3, (1.96768, 1.15026, 0.777087)
CHANNELS = ("b", "m", "t")


def black_level(pixels: DataFrame, areas: list[tuple[int, int, int, int]], group: str = "image_id") -> DataFrame:
    """Mean and population deviation of each channel over dark rectangles (x0, y0, x1, y1, inclusive).

    A pixel in two rectangles counts twice; no pixel gives zeros. The number of rectangles is at most four, so a
    pixel's weight is a sum of as many comparisons: no join, one partial aggregate.
    Deviations come from exact integer sums.
    """
    inside = [((F.col("x").between(x0, x1)) & (F.col("y").between(y0, y1))).cast("long") for x0, y0, x1, y1 in areas]
    weight = inside[0] if inside else F.lit(0).cast("long")
    for w in inside[1:]:
        weight = weight + w
    sums = [F.sum("_w").alias("n")]
    for c in CHANNELS:
        sums += [F.sum(F.col("_w") * F.col(c)).alias(f"_s_{c}"), F.sum(F.col("_w") * F.col(c) * F.col(c)).alias(f"_q_{c}")]
    found = pixels.withColumn("_w", weight).groupBy(group).agg(*sums)
    out = [F.col(group), F.col("n")]
    for c in CHANNELS:
        s, q = F.col(f"_s_{c}"), F.col(f"_q_{c}")
        out.append(F.when(F.col("n") == 0, 0.0).otherwise(s / F.col("n")).alias(f"level_{c}"))
        out.append(F.when(F.col("n") == 0, 0.0).otherwise(F.sqrt((F.col("n") * q - s * s).cast("double")) / F.col("n")).alias(f"dev_{c}"))
    return found.select(*out)


def black_level_join(pixels: DataFrame, areas: DataFrame, group: str = "image_id") -> DataFrame:
    """The same from a table of rectangles for each image (image_id, x0, y0, x1, y1): an equal-key join with bounds."""
    hit = pixels.join(areas, group).where("x between x0 and x1 and y between y0 and y1")
    sums = [F.count(F.lit(1)).alias("n")]
    for c in CHANNELS:
        sums += [F.sum(c).alias(f"_s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}")]
    found = hit.groupBy(group).agg(*sums)
    out = [F.col(group), F.col("n")]
    for c in CHANNELS:
        s, q = F.col(f"_s_{c}"), F.col(f"_q_{c}")
        out += [(s / F.col("n")).alias(f"level_{c}"), (F.sqrt((F.col("n") * q - s * s).cast("double")) / F.col("n")).alias(f"dev_{c}")]
    return found.select(*out)


def max_intermediate(gain: list[Column], bias: Column | float = 0.0) -> list[Column]:
    """The top of each channel's intermediate range; the channel with the largest gain fills it."""
    bias = bias if isinstance(bias, Column) else F.lit(float(bias))
    peak = F.greatest(*gain)
    return [F.round(g * (F.lit(float(UNIT)) - bias) / peak + bias).cast("long") for g in gain]


def intermediate_bias(dev: list[Column], level: list[Column], tops: list[Column], max_raw: list[Column]) -> Column:
    """Room below black for four deviations of the noisiest channel, zero at least."""
    each = [BIAS_FACTOR * d * t / (r - b) for d, b, t, r in zip(dev, level, tops, max_raw, strict=True)]
    return F.greatest(F.lit(0.0), *each)


def linear(v: Column, level: Column, top: Column, bias: Column, max_raw: Column) -> Column:
    """Raw to intermediate: scale over black, add the bias, round, clamp."""
    return clamp16(F.round((top - bias) / (max_raw - level) * (v - level) + bias))


def with_range(levels: DataFrame, gain: list[Column], max_raw: list[Column]) -> DataFrame:
    """Add bias and the top of each channel to a frame of level_* and dev_* columns, one row for each image."""
    level, dev = [F.col(f"level_{c}") for c in CHANNELS], [F.col(f"dev_{c}") for c in CHANNELS]
    per = levels.withColumn("bias", intermediate_bias(dev, level, max_intermediate(gain), max_raw))
    return per.withColumns({f"top_{c}": t for c, t in zip(CHANNELS, max_intermediate(gain, F.col("bias")), strict=True)})


def linearise(pixels: DataFrame, levels: DataFrame, gain: tuple[float, float, float], max_raw: int = MAX_RAW, channels: tuple[str, ...] = CHANNELS, group: str = "image_id") -> DataFrame:
    """Map every pixel with its image's levels; bias and tops are computed once for each image, then joined."""
    raw = [F.lit(float(max_raw))] * 3
    per = with_range(levels, [F.lit(float(x)) for x in gain], raw)
    per = per.select(group, "bias", *[f"level_{c}" for c in CHANNELS], *[f"top_{c}" for c in CHANNELS])
    done = {c: linear(F.col(c), F.col(f"level_{c}"), F.col(f"top_{c}"), F.col("bias"), raw[0]) for c in channels}
    return pixels.join(per, group).withColumns(done)


def top_downsample(top: DataFrame, group: str = "image_id", value: str = "v") -> DataFrame:
    """Means of whole 2x2 blocks; blocks cut by the edge are left out."""
    blocks = top.groupBy(group, F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return blocks.where("_n = 4").select(group, "y", "x", (F.col("_s") / 4.0).alias("mean"))


def top_linear(v: Column, top: Column, bias: Column, max_raw: Column, black: float = TOP_BLACK) -> Column:
    return linear(v, F.lit(black), top, bias, max_raw)
