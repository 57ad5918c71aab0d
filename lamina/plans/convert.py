"""Many containers at once: calibration as a frame, development with each file's own values, outputs by kind.

    python -m lamina.plans.convert INPUT OUTPUT [--wb Sunlight] [--cs sRGB] [--tm aces] [--ev 0.5] [--quality 98] ...
"""

from __future__ import annotations

import argparse
import logging
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.functions import pixel as px
from lamina.operators import badpixels, denoise, gain, geometry, levels, metadata, neighbourhood
from lamina.plans.develop import Options
from lamina.sinks import images, text
from lamina.sources import container

LOG = logging.getLogger("lamina")
_RECT = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"


def _rect(df: DataFrame, column: str) -> list:
    return [F.get(F.col(column), F.lit(i)) for i in range(4)]


def calibrations(files: DataFrame, preset: str = "Auto") -> DataFrame:
    """One row for each file: image_id (its path), width, height, gain, layers, max_raw, dark rectangles, active rectangle.

    An empty preset means the file's own. Missing gains and matrices take the fallback values.
    """
    header = container.headers(files).select("path", "version", F.col("columns").alias("header_columns"), F.col("rows").alias("header_rows"), "white_balance")
    quattro = F.col("layout") == "quattro"
    planes = container.plane_rows(files).where("plane = 0").select("path", "layout", F.when(quattro, F.col("columns")).otherwise(F.col("image_columns")).alias("width"), F.when(quattro, F.col("rows")).otherwise(F.col("image_rows")).alias("height"))
    model = metadata.property_named(container.property_rows(files), "CAMMODEL").withColumnRenamed("value", "model")
    # all metadata lookups are expressions over one array a file: three joins instead of one for each name
    df = planes.join(header, "path").join(metadata.gather(container.metadata_rows(files)), "path", "left").join(model, "path", "left")
    e = F.col("e")
    one = lambda name: F.get(metadata.numbers_in(e, name, 1), F.lit(0))
    wanted = F.lit(preset) if preset else metadata.white_balance(one("WhiteBalance"), F.col("white_balance"))
    df = df.withColumns({"wanted": wanted, "camera": one("CAMERAID"), "depth": one("ImageDepth")})
    df = df.withColumns({n: metadata.numbers_in(e, k, 4) for n, k in (("keep", "KeepImageArea"), ("active_area", "ActiveImageArea"), ("top_dark", "DarkShieldTop"), ("bottom_dark", "DarkShieldBottom"), ("side", "DarkShieldColRange"))})
    gains, layers = metadata.gains_in(e, F.col("wanted")), metadata.layers_in(e, F.col("wanted"))
    has = lambda n: F.exists(e, lambda x: (x["kind"] == "props") & x["name"].isin(n, f"DP1_{n}"))
    top = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth").cast("int")) - 1
    saturation = F.when(has("WhiteBalanceColorCorrections") & has("WhiteBalanceGains"), metadata.numbers_in(e, "RawSaturationLevel", 3)).otherwise(metadata.numbers_in(e, "SaturationLevel", 3))
    max_raw = F.coalesce(F.when(F.col("depth").isNotNull(), F.array(top, top, top)), saturation, F.array([F.lit(4095).cast("long")] * 3))
    size = (F.col("width"), F.col("height"))
    four = lambda v: [F.get(v, F.lit(i)) for i in range(4)]
    pair = lambda c: F.struct(F.col(c).alias("r"), F.col("keep").alias("k"))
    clipped = lambda c: metadata.let(pair(c), lambda s: F.when(s["r"].isNotNull() & s["k"].isNotNull(), geometry.clip_rect(four(s["r"]), four(s["k"]), size)))
    keep_columns = F.get("keep", F.lit(2)) - F.get("keep", F.lit(0)) + 1
    scaled = lambda i: F.call_function("div", F.get("side", F.lit(i)) * F.col("width"), keep_columns)
    band = lambda i: F.when(F.col("side").isNotNull() & F.col("keep").isNotNull(), F.struct(scaled(i).alias("x0"), F.lit(0).cast("long").alias("y0"), scaled(i + 1).alias("x1"), (F.col("height") - 1).cast("long").alias("y1")))
    # two models have no usable bottom shield
    usable = ~(F.coalesce(F.col("model").rlike(r"^\w+ DP2$"), F.lit(False)) | F.coalesce(F.col("camera") == 16, F.lit(False)))
    dark = F.filter(F.array(clipped("top_dark"), F.when(usable, clipped("bottom_dark")), band(0), band(2)), lambda r: r.isNotNull())
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return df.select(
        F.col("path").alias("image_id"), "layout", "width", "height", "header_columns", "header_rows",
        F.coalesce(gains, lit(levels.FALLBACK_GAIN)).alias("gain"), F.coalesce(layers, lit(mx.SRGB_TO_XYZ)).alias("layers"), max_raw.alias("max_raw"),
        dark.alias("dark"), clipped("active_area").alias("active"), "active_area", "keep", metadata.denoise_class(F.col("version"), F.col("model")).alias("denoise_class"),
    )


def bad_pixels(files: DataFrame, cal: DataFrame) -> DataFrame:
    """(image_id, y, x) of every place that a file's metadata marks bad and that lies inside its image, once.

    Six sources: packed words (relative to the kept area), two three-column matrices (row first), the highlight
    grid, the row-marked stream, and the focus grid of two cameras. All are expressions over one array a file.
    """
    e, long = F.col("e"), lambda c: c.cast("long")
    place = lambda y, x: F.struct(long(y).alias("y"), long(x).alias("x"))
    none = F.array().cast("array<struct<y:bigint,x:bigint>>")
    values = lambda name: metadata.entry_in(e, "matrix", name)["i64"]
    keep = metadata.numbers_in(e, "KeepImageArea", 4)
    field = lambda v, shift: F.shiftright(v, shift).bitwiseAND(F.lit(4095).cast("long"))
    sources = [F.transform(values("BadPixels"), lambda v: place(field(v, 20) - F.get(keep, F.lit(1)), field(v, 8) - F.get(keep, F.lit(0))))]
    for name in ("BadPixelsF20", "Jpeg_BadClusters"):
        m = metadata.entry_in(e, "matrix", name)
        rows = F.when((F.size(m["dims"]) == 2) & (F.get(m["dims"], F.lit(0))["size"] == 3) & (F.size(m["i64"]) >= 3), F.sequence(F.lit(0), F.call_function("div", F.size(m["i64"]), F.lit(3)).cast("int") - 1))
        sources.append(F.transform(rows, _triple(m["i64"], place)))
    hp = metadata.numbers_in(e, "HighlightPixelsInfo", 4)
    at = lambda i: F.get(hp, F.lit(i))
    sources.append(_lattice((at(0), F.col("width") - 1, at(2), 1), (at(1), F.col("height") - 1, at(3), 1), place))
    stream = values("BadPixelsChromaF23")
    start = F.struct(F.lit(-1).cast("long").alias("row"), none.alias("out"))

    def step(acc, v):
        row = F.when(acc["row"] == -1, v).when(v == 0, F.lit(-1).cast("long")).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when((acc["row"] != -1) & (v != 0), F.concat(acc["out"], F.array(place(acc["row"], v)))).otherwise(acc["out"]).alias("out"))

    sources.append(F.aggregate(stream, start, step)["out"])
    for (camera, colours), ((c0, c1, cp, cs), (r0, r1, rp, rs)) in badpixels.FOCUS_GRIDS.items():
        if colours == 3:
            grid = _lattice(tuple(F.lit(v).cast("long") for v in (c0, c1, cp)) + (cs,), tuple(F.lit(v).cast("long") for v in (r0, r1, rp)) + (rs,), place)
            sources.append(F.when(F.get(metadata.numbers_in(e, "CAMERAID", 1), F.lit(0)) == camera, grid))
    df = metadata.gather(container.metadata_rows(files)).join(cal.select(F.col("image_id").alias("path"), "width", "height"), "path")
    spots = df.select(F.col("path").alias("image_id"), "width", "height", F.explode(F.concat(*[F.coalesce(x, none) for x in sources])).alias("p"))
    return spots.where("p.x between 0 and width - 1 and p.y between 0 and height - 1").select("image_id", "p.y", "p.x").distinct()


def _triple(v, place):
    return lambda i: place(F.get(v, 3 * i), F.get(v, 3 * i + 1))


def _lattice(xs, ys, place):
    """Places of a grid as an array: (first, last, pitch, block size) of columns and of rows; null where a bound is."""
    side = lambda t: F.when((t[0] <= t[1]) & (t[2] > 0), F.sequence(t[0].cast("long"), t[1].cast("long"), t[2].cast("long")))
    wide = lambda t: F.flatten(F.transform(side(t), lambda a: F.array(*[a + i for i in range(t[3])])))
    return F.flatten(F.transform(wide(ys), lambda y: F.transform(wide(xs), lambda x: place(y, x))))


def ranges(pixels: DataFrame, cal: DataFrame) -> DataFrame:
    """One row for each file: levels over its dark rectangles (zeros without), bias, tops."""
    areas = cal.select("image_id", F.explode("dark").alias("a")).select("image_id", "a.*")
    lv = levels.black_level_join(pixels, areas)
    zero = {f"{k}_{c}": 0.0 for k in ("level", "dev") for c in levels.CHANNELS}
    df = cal.join(lv, "image_id", "left").fillna(zero)
    return levels.with_range(df, [F.get("gain", F.lit(i)) for i in range(3)], [F.get("max_raw", F.lit(i)).cast("double") for i in range(3)])


def preprocess_all(pixels: DataFrame, cal: DataFrame, top: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(pixels, per-file ranges, top plane): every layer in the intermediate range.

    With a top plane (image_id, y, x, v) its 2x2 means become the third channel, and it is mapped itself at full size.
    """
    per = ranges(pixels, cal)
    need = per.select("image_id", "bias", "max_raw", *[f"{k}_{c}" for k in ("level", "top") for c in levels.CHANNELS])
    raw = lambda i: F.get("max_raw", F.lit(i)).cast("double")
    done = pixels.join(need, "image_id")
    done = done.withColumns({c: levels.linear(F.col(c), F.col(f"level_{c}"), F.col(f"top_{c}"), F.col("bias"), raw(i)) for i, c in enumerate(levels.CHANNELS)}).select("image_id", "y", "x", *levels.CHANNELS)
    if top is None:
        return done, per, None
    mapped = lambda v: levels.top_linear(v, F.col("top_t"), F.col("bias"), raw(2))
    means = levels.top_downsample(top).join(need, "image_id").select("image_id", "y", "x", mapped(F.col("mean")).alias("_t"))
    done = done.join(means, ["image_id", "y", "x"], "left").withColumn("t", F.coalesce("_t", F.lit(0).cast("long"))).drop("_t")
    full = top.join(need, "image_id").select("image_id", "y", "x", mapped(F.col("v")).alias("v"))
    return done, per, full


def _denoised(pixels: DataFrame, cal: DataFrame, high: bool = False) -> DataFrame:
    """Each file denoised by its own class; there are three."""
    classes = [r[0] for r in cal.select("denoise_class").distinct().collect()]
    of = lambda c: pixels.join(cal.where(F.col("denoise_class").eqNullSafe(F.lit(c))).select("image_id"), "image_id", "left_semi")
    return reduce(DataFrame.unionByName, [denoise.denoise(of(c), c or "STD", high=high) for c in classes]) if classes else pixels


def _window(cal: DataFrame, size: tuple[int, int]) -> F.Column:
    """The rectangle that a file keeps at a size: its active area scaled to it, else the centre of the header's size, else null."""
    w, h = (F.lit(v).cast("long") for v in size)
    active = F.when(F.col("active_area").isNotNull() & F.col("keep").isNotNull(), geometry.clip_rect(_rect(cal, "active_area"), _rect(cal, "keep"), (w, h)))
    known = (F.col("header_columns") > 0) & (F.col("header_rows") > 0) & (F.col("header_columns") <= w) & (F.col("header_rows") <= h)
    x0, y0 = F.expr(f"({size[0]} - header_columns) div 2"), F.expr(f"({size[1]} - header_rows) div 2")
    centre = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("header_columns") - 1).cast("long").alias("x1"), (y0 + F.col("header_rows") - 1).cast("long").alias("y1"))
    return F.coalesce(active, F.when(known, centre))


def _cropped(pixels: DataFrame) -> DataFrame:
    """The pixels inside their file's ``kept`` rectangle, moved to its corner; all where it is null."""
    kept = F.col("kept")
    inside = kept.isNull() | (F.col("x").between(kept["x0"], kept["x1"]) & F.col("y").between(kept["y0"], kept["y1"]))
    return pixels.where(inside).withColumns({"x": F.col("x") - F.coalesce(kept["x0"], F.lit(0)), "y": F.col("y") - F.coalesce(kept["y0"], F.lit(0))})


def develop_all(
    pixels: DataFrame,
    cal: DataFrame,
    options: Options = Options(),
    top: DataFrame | None = None,
    size: tuple[int, int] | None = None,
    top_size: tuple[int, int] | None = None,
    cube: tuple[int, list] | None = None,
    bad: DataFrame | None = None,
    linear: bool = False,
) -> DataFrame:
    """(image_id, y, x, r, g, b) in 16 bits for every file, each with its own levels, matrix, denoising class and crop.

    With ``linear`` the values are linear sRGB, without exposure, tone and gamma.

    The median, denoising, the expansion of a top plane and the crop need the images' common ``size``; without it they are left out.
    The median is written inside each file's active area. An expanded image is cropped at its expanded size.
    """
    done, per, full = preprocess_all(pixels, cal, top)
    if bad is not None:
        done = badpixels.inpaint(done, bad)
    if full is not None and size and top_size:
        if options.denoise:
            done = denoise.denoise(done, "F23")
        done = neighbourhood.quattro_expand(done, full, size, top_size, library_kernel=options.denoise)
        if options.denoise:
            done = denoise.denoise(done, "F23", high=True)
    elif size:
        luma, u, v = px.opponent_std(F.col("b"), F.col("m"), F.col("t"))
        yuv = done.select("image_id", "y", "x", luma.alias("luma"), u.alias("u"), v.alias("v")).join(per.select("image_id", "active"), "image_id")
        yuv = neighbourhood.median_area(yuv, "v", *size, F.col("active"))
        done = yuv.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(px.opponent_std_inverse(F.col("luma"), F.col("u"), F.col("v")), "bmt", strict=True)])
        if options.denoise:
            done = _denoised(done, cal)
    m = metadata.product([F.lit(x) for x in mx.XYZ_TO_SRGB], [F.get("layers", F.lit(i)) for i in range(9)])
    matrix = [m[i] * F.get("gain", F.lit(i % 3)) for i in range(9)]
    final = top_size or size
    kept = _window(per, final) if options.crop and final else F.lit(None).cast(_RECT)
    shown = done.join(per.select("image_id", "bias", "top_b", "top_m", "top_t", kept.alias("kept"), F.array(*matrix).alias("matrix")), "image_id")
    shown = _cropped(shown)
    rgb = px.to_linear_srgb((F.col("b"), F.col("m"), F.col("t")), [F.get("matrix", F.lit(i)) for i in range(9)], F.col("bias"), (F.col("top_b"), F.col("top_m"), F.col("top_t")))
    if linear:
        return shown.select("image_id", "y", "x", *[c.cast("long").alias(n) for c, n in zip(rgb, "rgb", strict=True)])
    out = px.develop(tuple(c / 65535.0 for c in rgb), options.stops, options.tone, mx.GAMMAS[mx.space_name(options.colour_space)], cube)
    return shown.select("image_id", "y", "x", *[px.to_uint16(c).alias(n) for c, n in zip(out, "rgb", strict=True)])


def preprocessed_map(pixels: DataFrame, cal: DataFrame, iso: DataFrame | None = None, size: int = 1024, cropped: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b): intermediate values through each file's matrix, scaled by ISO, and a sRGB table.

    ``iso`` has (image_id, scale), the shot's ISO over the sensor's; 1 where there is none. ``cropped`` keeps each file's active area.
    """
    done, per, _ = preprocess_all(pixels, cal)
    per = per.withColumn("scale", F.lit(1.0)) if iso is None else per.join(iso, "image_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    m = metadata.product([F.lit(x) for x in mx.XYZ_TO_SRGB], [F.get("layers", F.lit(i)) for i in range(9)])
    kept = F.col("active") if cropped else F.lit(None).cast(_RECT)
    need = per.select("image_id", "bias", "top_b", "top_m", "top_t", kept.alias("kept"), F.array(*[m[i] * F.get("gain", F.lit(i % 3)) * F.col("scale") for i in range(9)]).alias("matrix"))
    joined = _cropped(done.join(need, "image_id"))
    unit = [(F.col(c) - F.col("bias")) / (F.col(f"top_{c}") - F.col("bias")) for c in "bmt"]
    table = px.srgb_table(size, px.WHITE16)
    return joined.select("image_id", "y", "x", *[px.table_lookup(v, table).alias(n) for v, n in zip(px.apply_matrix([F.get("matrix", F.lit(i)) for i in range(9)], *unit), "rgb", strict=True)])


def iso_scales(entries: DataFrame) -> DataFrame:
    """(image_id, scale): the shot's ISO over the sensor's, where both are there."""
    one = lambda n: F.get(metadata.numbers_in(F.col("e"), n, 1, "f64"), F.lit(0))
    scale = F.when(one("SensorISO") > 0, one("CaptureISO") / one("SensorISO"))
    return metadata.gather(entries).select(F.col("path").alias("image_id"), scale.alias("scale")).where("scale is not null")


def top_map(top: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): the top plane as grey, black where it has no pixel; ``sizes`` has each file's width and height."""
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    places = sizes.where("width > 0 and height > 0").select("image_id", "width", axis("height").alias("y")).select("image_id", "y", axis("width").alias("x"))
    joined = places.join(top.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    return joined.select("image_id", "y", "x", *[F.coalesce("v", F.lit(0).cast("long")).alias(c) for c in "rgb"])


def file_names(paths: DataFrame) -> DataFrame:
    """(image_id, name): the last part of each path; of paths that end alike all have a hash of the whole path added."""
    named = paths.select("image_id").distinct().withColumn("last", F.element_at(F.split("image_id", "/"), -1))
    alike = named.groupBy("last").agg((F.count(F.lit(1)) > 1).alias("alike"))
    tagged = F.concat_ws("-", "last", F.left(F.sha2("image_id", 256), F.lit(12)))
    return named.join(alike, "last").select("image_id", F.when(F.col("alike"), tagged).otherwise(F.col("last")).alias("name"))


def image_facts(files: DataFrame) -> DataFrame:
    """One row a file: image_id, the name of what is written of it, make, model, exposure data."""
    entries, properties = container.metadata_rows(files), container.property_rows(files)
    camera = metadata.camera_info(container.headers(files), properties, entries).toDF("image_id", "model", "serial", "preset").select("image_id", "model")
    make = metadata.property_named(properties, "CAMMANUF").toDF("image_id", "make")
    df = file_names(files.select(F.col("path").alias("image_id")))
    for other in (camera, make, metadata.exif_info(entries).withColumnRenamed("path", "image_id")):
        df = df.join(other, "image_id", "left")
    return df


def dng_facts(files: DataFrame, cal: DataFrame, preset: str) -> DataFrame:
    """What a DNG holds beside pixels, one row a file: image_facts, layers, gain, area and gain maps."""
    row = F.struct("channel", "rows", "columns", "gains")
    maps = gain.file_gains(container.metadata_rows(files), container.property_rows(files), preset or "Auto").groupBy(F.col("path").alias("image_id")).agg(F.array_sort(F.collect_list(row)).alias("maps"))
    a = [F.get("active_area", F.lit(i)) for i in range(4)]
    area = F.when(F.col("active_area").isNotNull(), F.array(a[1], a[0], a[3] + 1, a[2] + 1)).alias("area")
    return cal.select("image_id", "layers", "gain", area).join(image_facts(files), "image_id").join(maps, "image_id", "left")


def convert(spark: SparkSession, source: str, target: str, kind: str, options: Options = Options(), cube: tuple[int, list] | None = None) -> DataFrame:
    """Convert every container below ``source`` to ``kind`` (dng, tiff, jpeg, ppm, meta) below ``target``; returns what was written.

    Files are told apart by their whole paths. The log tone curve needs a cube.
    """
    began = time.time()
    plain = options.unprocessed or options.top_only or options.preprocessed
    if kind != "meta" and not plain and cube is None and options.tone.lower() not in ("none", "aces"):
        LOG.warning("no cube for the tone curve %r: the aces curve is used", options.tone)
    files = container.scan(spark, source)
    if kind == "meta":
        lines = text.metadata_lines(container.headers(files), container.metadata_rows(files), container.property_rows(files))
        lines.repartition("path").sortWithinPartitions("path", "part", "idx", "sub").select("path", "line").write.mode("overwrite").partitionBy("path").text(target)
        return lines.groupBy(F.col("path").alias("image_id")).agg(F.count(F.lit(1)).alias("bytes"))
    strips = container.decode_strips(container.plane_rows(files))
    pixels = container.strips_to_pixels(strips).withColumnRenamed("path", "image_id")
    if options.top_only:
        sizes = container.plane_rows(files).where("plane = 2").select(F.col("path").alias("image_id"), F.col("columns").alias("width"), F.col("rows").alias("height"))
        shown = top_map(container.top_pixels(strips).withColumnRenamed("path", "image_id"), sizes)
    elif options.preprocessed:
        cal = calibrations(files, options.white_balance).cache()
        shown = preprocessed_map(pixels, cal, iso_scales(container.metadata_rows(files)), cropped=options.crop)
    elif options.unprocessed:
        shown = pixels.select("image_id", "y", "x", F.col("b").alias("r"), F.col("m").alias("g"), F.col("t").alias("b"))
    else:
        # a few small columns a file, read by several joins: kept, and made anew if an executor is lost
        cal = calibrations(files, options.white_balance).cache()
        bad, top = bad_pixels(files, cal), container.top_pixels(strips).withColumnRenamed("path", "image_id")
        tops = container.plane_rows(files).where("plane = 2").select(F.col("path").alias("image_id"), F.col("columns").alias("top_width"), F.col("rows").alias("top_height"))
        sized = cal.join(tops, "image_id", "left")
        parts = []
        # as many sizes as kinds of sensors
        for r in sized.select("layout", "width", "height", "top_width", "top_height").distinct().collect():
            same = sized.where((F.col("layout") == r["layout"]) & (F.col("width") == r["width"]) & (F.col("height") == r["height"]) & F.col("top_width").eqNullSafe(r["top_width"]) & F.col("top_height").eqNullSafe(r["top_height"]))
            own, ids = same.drop("top_width", "top_height"), same.select("image_id")
            quattro = r["layout"] == "quattro"
            of = lambda d: d.join(ids, "image_id", "left_semi")  # noqa: E731, B023
            parts.append(develop_all(of(pixels), own, options, of(top) if quattro else None, (r["width"], r["height"]), (r["top_width"], r["top_height"]) if quattro else None, cube, of(bad), kind == "dng"))
        if not parts:
            raise ValueError("no raster that can be read")
        shown = reduce(DataFrame.unionByName, parts)
    if kind == "jpeg":
        shown = shown.withColumns({c: F.call_function("div", F.col(c), F.lit(257).cast("long")) for c in "rgb"})
    if kind == "dng":
        if plain:
            raise ValueError("a DNG holds developed pixels")
        return images.write_dng(shown, dng_facts(files, cal, options.white_balance), target)
    LOG.info("planned in %.2f s", time.time() - began)
    return images.write_images(shown, target, kind, quality=options.quality, facts=image_facts(files))


def read_cube(text: str) -> tuple[int, list[tuple[float, float, float]]]:
    """(side, values with red changing fastest) of a .cube file's text."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    sides = [int(r[1]) for r in rows if r[0] == "LUT_3D_SIZE"]
    values = [tuple(map(float, r)) for r in rows if len(r) == 3 and r[0][0] in "-.0123456789"]
    if len(sides) != 1 or len(values) != sides[0] ** 3:
        raise ValueError("not a three-dimensional cube")
    return sides[0], values  # type: ignore[return-value]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--kind", default="tiff", choices=("dng", "tiff", "jpeg", "ppm", "meta"))
    for flag, name, kind, default in (("--cs", "colour_space", str, "sRGB"), ("--wb", "white_balance", str, "Auto"), ("--tm", "tone", str, "agx"), ("--quality", "quality", int, 98), ("--ev", "stops", float, 0.0)):
        p.add_argument(flag, dest=name, type=kind, default=default)
    p.add_argument("--cube", help="a .cube file for the log tone curve")
    for flag, name in (("--no-denoise", "denoise"), ("--no-crop", "crop")):
        p.add_argument(flag, dest=name, action="store_false")
    for flag, name in (("--unprocessed", "unprocessed"), ("--preprocessed", "preprocessed"), ("--top", "top_only"), ("-v", "verbose")):
        p.add_argument(flag, dest=name, action="store_true")
    a = vars(p.parse_args(argv))
    source, target, kind, cube = (a.pop(k) for k in ("source", "target", "kind", "cube"))
    logging.basicConfig(level=logging.INFO if a["verbose"] else logging.WARNING)
    from lamina.session import session

    convert(session(), source, target, kind, Options(**a), read_cube(Path(cube).read_text()) if cube else None).show(truncate=False)


if __name__ == "__main__":
    main()
