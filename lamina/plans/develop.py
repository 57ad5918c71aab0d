"""The whole development of a raster: options, stage order, outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.functions import pixel as px
from lamina.operators import badpixels, denoise, geometry, levels, neighbourhood


@dataclass(frozen=True)
class Options:
    """What a run asks for; the defaults are those of the command line."""

    colour_space: str = "sRGB"
    white_balance: str = "Auto"
    tone: str = "agx"
    quality: int = 98
    denoise: bool = True
    stops: float = 0.0
    crop: bool = True
    unprocessed: bool = False
    preprocessed: bool = False
    top_only: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.quality <= 100:
            raise ValueError("quality is 1 to 100")


@dataclass(frozen=True)
class Calibration:
    """What the metadata gives for one image, or its defaults."""

    width: int
    height: int
    gain: tuple[float, float, float] = levels.FALLBACK_GAIN
    layers_to_xyz: tuple[float, ...] = tuple(mx.SRGB_TO_XYZ)
    max_raw: int = levels.MAX_RAW
    dark: tuple[tuple[int, int, int, int], ...] = ()
    active: tuple[int, int, int, int] | None = None
    denoise_class: str = "STD"
    header: tuple[int, int] = (0, 0)


def preprocess(pixels: DataFrame, cal: Calibration, options: Options = Options(), bad: DataFrame | None = None) -> DataFrame:
    """Levels, linear map, bad pixels, median of V on the active area, denoising; keeps bias and tops for the colour step."""
    lv = levels.black_level(pixels, list(cal.dark))
    done = levels.linearise(pixels, lv, cal.gain, cal.max_raw)
    per = done.select("image_id", "bias", "top_b", "top_m", "top_t").dropDuplicates(["image_id"])
    done = done.select("image_id", "y", "x", "b", "m", "t")
    if bad is not None:
        done = badpixels.inpaint(done, bad)
    luma, u, v = px.opponent_std(F.col("b"), F.col("m"), F.col("t"))
    yuv = done.select("image_id", "y", "x", luma.alias("luma"), u.alias("u"), v.alias("v"))
    yuv = neighbourhood.median_area(yuv, "v", cal.width, cal.height, cal.active)
    b, m, t = px.opponent_std_inverse(F.col("luma"), F.col("u"), F.col("v"))
    done = yuv.select("image_id", "y", "x", b.alias("b"), m.alias("m"), t.alias("t"))
    if options.denoise:
        done = denoise.denoise(done, cal.denoise_class)
    return done.join(per, "image_id")


def develop(pixels: DataFrame, cal: Calibration, options: Options = Options(), bad: DataFrame | None = None, cube: tuple[int, list] | None = None) -> DataFrame:
    """(image_id, y, x, r, g, b) in 16 bits: preprocessing, crop, linear sRGB, exposure, tone and gamma.

    The output matrix is always sRGB's; the colour space chooses the gamma. Without a cube the default
    tone curve is the ACES one.
    """
    done = preprocess(pixels, cal, options, bad)
    rect = geometry.plan_dimensions(cal.width, cal.height, cal.active, cal.header, options.crop)
    done = geometry.crop(done, rect)
    matrix = mx.multiply(mx.XYZ_TO_SRGB, mx.raw_to_xyz(list(cal.layers_to_xyz), list(cal.gain)))
    rgb = px.to_linear_srgb((F.col("b"), F.col("m"), F.col("t")), matrix, F.col("bias"), (F.col("top_b"), F.col("top_m"), F.col("top_t")))
    unit = tuple(c / 65535.0 for c in rgb)
    shown = px.develop(unit, options.stops, options.tone, mx.GAMMAS[mx.space_name(options.colour_space)], cube)
    return done.select("image_id", "y", "x", *[px.to_uint16(c).alias(n) for c, n in zip(shown, "rgb", strict=True)])
