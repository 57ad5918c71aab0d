"""Spatial gain: the nearest calibration block of each quadrant, weights, and the merged map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import metadata

NEAR_LIMITS = {1003: 200.0, 1004: 280.0, 1005: 226.0}
DEFAULT_NEAR, DEFAULT_FOCAL = 280.0, 30.0


def lens_position(focal: Column, distance: Column) -> Column:
    """Image distance of a thin lens; the focal length at infinity, where the distance is null."""
    return F.when(distance.isNull() | (distance == float("inf")), focal).otherwise(1.0 / (1.0 / focal - 1.0 / distance))


def block_place(name: Column, focal: Column, near: Column, stops: Column) -> tuple[Column, Column]:
    """Where a block lies, from its list's name ``...Props_<stop index>_INF|MOD`` or ``...Props_<aperture>_<lens position>``; null for others."""
    indexed = r"^SpatialGainsProps_(\d+)_(INF|MOD)$"
    plain = r"^SpatialGainsProps_([0-9.]+)_([0-9.]+)$"
    index = F.nullif(F.regexp_extract(name, indexed, 1), F.lit("")).cast("int")
    where = F.regexp_extract(name, indexed, 2)
    bx = F.coalesce(1.0 / F.get(stops, index), 1.0 / F.nullif(F.regexp_extract(name, plain, 1), F.lit("")).cast("double"))
    by = F.when(where == "INF", focal).when(where == "MOD", lens_position(focal, near)).otherwise(F.nullif(F.regexp_extract(name, plain, 2), F.lit("")).cast("double"))
    return bx, by


def block_places(names: DataFrame, focal: Column, near: Column, fstops: list[float]) -> DataFrame:
    """(block, bx, by) of the lists whose names say a place."""
    stops = F.array([F.lit(float(s)) for s in fstops]) if fstops else F.array().cast("array<double>")
    bx, by = block_place(F.col("name"), focal, near, stops)
    return names.select(F.col("name").alias("block"), bx.alias("bx"), by.alias("by")).where("bx is not null and by is not null")


def quadrant(dx: Column, dy: Column) -> Column:
    """0 right above, 1 left above, 2 left below, 3 right below; a zero counts as left or below."""
    return F.when((dx > 0) & (dy > 0), 0).when(dx > 0, 3).when(dy > 0, 1).otherwise(2)


def places(targets: DataFrame, on: list[str]) -> DataFrame:
    """(on, target, tx, ty): one target, the least, for each place where there are any."""
    return targets.groupBy(*on, "tx", "ty").agg(F.min("target").alias("target")).select(*on, "target", "tx", "ty")


def at_places(targets: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(on, target, *rest): each target's rows are those found for the target that stands for its place, (on, target, tx, ty, *rest)."""
    rest = [c for c in found.columns if c not in (*on, "target", "tx", "ty")]
    key = [*on, "tx", "ty"]
    f = found.select(*[F.col(c).alias(f"_{c}") for c in key], *rest)
    same = [F.col(c) == F.col(f"_{c}") for c in on] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("tx", "ty")]
    return targets.select(*key, "target").distinct().join(f, same).select(*on, "target", *rest)


def nearest_in_quadrants(targets: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """For each target (on, target, tx, ty) and quadrant the nearest block (on, idx, bx, by); ties to the least idx.

    Different places of blocks meet different places of targets on equal keys, however many rows share a place, and a partial aggregate
    keeps one for each quadrant: nothing is ranked.
    """
    return at_places(targets, nearest_of_places(places(targets, on), blocks, on), on)


def nearest_of_places(targets: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """(on, target, tx, ty, q, idx, dx, dy, d2): the same for targets that are all at different places, with the places."""
    firsts = blocks.groupBy(*on, "bx", "by").agg(F.min("idx").alias("idx"))
    d = targets.join(firsts, on).withColumns({"dx": F.col("bx") - F.col("tx"), "dy": F.col("by") - F.col("ty")})
    d = d.withColumns({"q": quadrant(F.col("dx"), F.col("dy")), "d2": F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")})
    # what has no distance comes last
    order = F.struct(F.col("d2").isNull().alias("none"), "d2", F.col("idx").isNull().alias("nameless"), "idx")
    best = d.groupBy(*on, "target", "tx", "ty", "q").agg(F.min_by(F.struct("idx", "dx", "dy", "d2"), order).alias("b"))
    return best.select(*on, "target", "tx", "ty", "q", "b.idx", "b.dx", "b.dy", "b.d2")


def quadrant_weights(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, idx, weight): bilinear weights from the offsets of opposite blocks; 1 where a pair is missing or flat."""
    side = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c))).alias(f"_{c}{q}")
    wide = nearest.groupBy(*keys).agg(*[side(q, c) for q in range(4) for c in ("dx", "dy")])

    def pair(c: str, own: int, other: int) -> Column:
        a, b = F.col(f"_{c}{own}"), F.col(f"_{c}{other}")
        return F.coalesce(F.when(b - a != 0, b / (b - a)), F.lit(1.0))

    wx = F.when(F.col("q") == 0, pair("dx", 0, 1)).when(F.col("q") == 1, pair("dx", 1, 0)).when(F.col("q") == 2, pair("dx", 2, 3)).otherwise(pair("dx", 3, 2))
    wy = F.when(F.col("q") == 0, pair("dy", 0, 3)).when(F.col("q") == 3, pair("dy", 3, 0)).when(F.col("q") == 1, pair("dy", 1, 2)).otherwise(pair("dy", 2, 1))
    return nearest.join(wide, keys).select(*keys, "q", "idx", (wx * wy).alias("weight"))


def merge_gain(weights: DataFrame, codes: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, channel, cell, gain): sum over quadrants of weight x (least + step x code), as 32-bit floats.

    ``codes`` has (on, idx, channel, cell, code, least, step), one row a cell.
    """
    joined = weights.join(codes, [*on, "idx"])
    value = F.col("weight") * (F.col("least") + F.col("step") * F.col("code"))
    return joined.groupBy(*keys, "channel", "cell").agg(F.sum(value).cast("float").alias("gain"))


def gain_source(merged: DataFrame, preset: DataFrame, plain: DataFrame) -> DataFrame:
    """(path, channel, r, c, gain) of each file from the first of three sources that has it."""
    tagged = [d.select("path", F.lit(i).alias("_p"), F.struct("channel", "r", "c", "gain").alias("g")) for i, d in enumerate((merged, preset, plain))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    first = rows.groupBy("path").agg(F.min("_p").alias("_p"))
    return rows.join(first, ["path", "_p"]).select("path", "g.*")


def _whole(e: Column, name: Column, sides: int, field: str) -> Column:
    """A matrix with so many sides and numbers of the wanted type, or null."""
    m = metadata.entry_in(e, "matrix", name)
    return F.when((F.size(m["dims"]) == sides) & m[field].isNotNull(), m)


def file_gains(entries: DataFrame, properties: DataFrame, preset: str) -> DataFrame:
    """(path, channel, rows, columns, gains array<float>): the spatial gain of each file that has any.

    First the calibration blocks around the shot's aperture and lens position, merged by weights; else the table of the preset; else
    the plain one. Lookups are expressions over one array a file; only blocks and their cells become rows.
    """
    prop = lambda *names: metadata.property_named(properties, *names)
    e = F.col("e")
    number = lambda n, field: F.get(metadata.numbers_in(e, n, 1, field), F.lit(0))
    df = metadata.gather(entries).join(prop("APERTURE", "Aperture").withColumnRenamed("value", "_a"), "path", "left").join(prop("FLENGTH").withColumnRenamed("value", "_f"), "path", "left")
    near = F.lit(DEFAULT_NEAR)
    for code, limit in NEAR_LIMITS.items():
        near = F.when(number("LensInformation", "i64") == code, limit).otherwise(near)
    df = df.withColumns({
        "aperture": F.coalesce(number("CaptureAperture", "f64"), F.expr("try_cast(_a as double)")), "focal": F.coalesce(F.expr("try_cast(_f as double)"), F.lit(DEFAULT_FOCAL)),
        "near": near, "distance": number("ObjectDistance", "f64") * 10.0, "stops": F.coalesce(metadata.entry_in(e, "matrix", "SpatialGain_Fstop")["f64"], F.array().cast("array<double>")),
    })
    item = lambda props, key: F.get(F.filter(props, lambda x: x["name"] == key), F.lit(0))["value"]
    lists = F.filter(e, lambda x: (x["kind"] == "props") & x["name"].startswith("SpatialGainsProps_"))
    blocks = df.where("aperture is not null").select("path", "e", "focal", "near", "stops", F.posexplode(lists).alias("idx", "b"))
    bx, by = block_place(F.col("b.name"), F.col("focal"), F.col("near"), F.col("stops"))
    channels = []
    for k, c in enumerate("RGB"):
        m = _whole(e, item(F.col("b.props"), f"GainsTable{c}"), 2, "i64")
        side = lambda i, m=m: F.get(m["dims"], F.lit(i))["size"].cast("int")
        text = lambda key, c=c: item(F.col("b.props"), f"{key}{c}")
        # a number that can't be read counts as 0, one that is not there makes the block invalid
        channels.append(F.struct(F.lit(k).cast("long").alias("channel"), side(0).alias("rows"), side(1).alias("columns"), m["i64"].alias("codes"), text("MinGains").alias("least"), text("Delta").alias("step")))
    blocks = blocks.select("path", "idx", bx.alias("bx"), by.alias("by"), F.array(*channels).alias("channels")).where("bx is not null and by is not null")
    blocks = blocks.where(F.forall("channels", lambda c: c["codes"].isNotNull() & c["least"].isNotNull() & c["step"].isNotNull()))
    targets = df.where("aperture is not null").select("path", F.col("path").alias("target"), (1.0 / F.col("aperture")).alias("tx"), lens_position(F.col("focal"), F.col("distance")).alias("ty"))
    weights = quadrant_weights(nearest_in_quadrants(targets, blocks.select("path", "idx", "bx", "by"), ["path"]), ["path", "target"])
    parts = blocks.select("path", "idx", F.explode("channels").alias("c")).select("path", "idx", "c.*")
    value = lambda name: F.coalesce(F.expr(f"try_cast({name} as double)"), F.lit(0.0)).alias(name)
    codes = parts.select("path", "idx", "channel", value("least"), value("step"), F.posexplode("codes").alias("cell", "code"))
    # the sides are those of the first quadrant's block; cells beyond them are not written
    sides = weights.join(parts, ["path", "idx"]).groupBy("path", "channel").agg(F.min_by(F.struct("rows", "columns"), "q").alias("s")).select("path", "channel", "s.*").where("rows > 0 and columns > 0")
    cells = merge_gain(weights, codes, ["path", "target"], ["path"]).join(sides, ["path", "channel"]).where("cell < rows * columns")
    merged = cells.select("path", "channel", F.expr("cell div columns").cast("int").alias("r"), (F.col("cell") % F.col("columns")).cast("int").alias("c"), "gain")
    table = item(metadata.entry_in(e, "props", "SpatialGainTables")["props"], preset)
    other = [_cells(df.select("path", _whole(e, name, 3, "f64").alias("m"))) for name in (table, F.lit("SpatialGain"))]
    found = gain_source(merged, *other)
    row = F.struct("r", "c", "gain")
    maps = found.groupBy("path", "channel").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), F.array_sort(F.collect_list(row)).alias("v"))
    return maps.select("path", "channel", "rows", "columns", F.transform("v", lambda x: x["gain"].cast("float")).alias("gains"))


def _cells(matrices: DataFrame) -> DataFrame:
    """(path, channel, r, c, gain) of matrices ``m`` of rows x columns x channels."""
    side = lambda i: F.get(F.col("m.dims"), F.lit(i))["size"].cast("int")
    rows = matrices.where("m is not null").select("path", side(1).alias("_w"), side(2).alias("_n"), F.posexplode("m.f64").alias("at", "gain"))
    place = rows.select("path", F.expr("at % _n").cast("long").alias("channel"), F.expr("at div _n div _w").cast("int").alias("r"), F.expr("at div _n % _w").cast("int").alias("c"), F.col("gain").cast("float").alias("gain"))
    return place
