"""Lookups in the metadata frames: first match wins, a wrong type or size is no match.

``entries`` is camf(path, idx, kind, name, text, props, matrix_type, dims, f64, i64, unsigned); ``properties`` is
(path, idx, name, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.pixel import first_of

_MAKER = "SIGMA"
MODELS = {k: f"{_MAKER} {v}" for k, v in {77: "dp1 Merrill", 78: "dp2/dp3 Merrill", 83: "dp0 Quattro", 80: "dp1 Quattro", 81: "dp2 Quattro", 82: "dp3 Quattro", 15: "sd Quattro", 16: "sd Quattro H"}.items()}
UNKNOWN_MODEL = f"{_MAKER} Digital Camera"
WHITE_BALANCE = {1: "Auto", 2: "Sunlight", 3: "Shadow", 4: "Overcast", 5: "Incandescent", 6: "Florescent", 7: "Flash", 8: "Custom", 11: "ColorTemp", 12: "AutoLSP"}


def first_by(df: DataFrame, keys: list[str], value: Column | str, order: str = "idx") -> DataFrame:
    """One row for each key: the value of the row with the least ``order``."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("value"))


def property_named(properties: DataFrame, *names: str) -> DataFrame:
    """(path, value) of the first property that has one of the names."""
    return first_by(properties.where(F.col("name").isin(*names)), ["path"], "value")


def list_items(entries: DataFrame) -> DataFrame:
    """(path, idx, list, pos, name, value): every item of every property list."""
    lists = entries.where("kind = 'props'").select("path", "idx", F.col("name").alias("list"), F.posexplode("props").alias("pos", "p"))
    return lists.select("path", "idx", "list", "pos", "p.name", "p.value")


def list_property(entries: DataFrame, list_name: str, key: str) -> DataFrame:
    """(path, value) of a key in the first list of that name."""
    lists = entries.where((F.col("kind") == "props") & (F.col("name") == list_name)).groupBy("path").agg(F.min_by("props", "idx").alias("props"))
    found = F.filter("props", lambda p: p["name"] == key)
    return lists.select("path", F.get(found, F.lit(0))["value"].alias("value")).where("value is not null")


def matrix_named(entries: DataFrame, name: str, elements: int | None = None) -> DataFrame:
    """(path, f64, i64, sizes): the first matrix of a name, if it has as many elements."""
    rows = entries.where((F.col("kind") == "matrix") & (F.col("name") == name))
    one = rows.groupBy("path").agg(F.min_by(F.struct("f64", "i64", "dims"), "idx").alias("m"))
    out = one.select("path", "m.f64", "m.i64", F.transform("m.dims", lambda d: d["size"]).alias("sizes"))
    return out if elements is None else out.where(F.coalesce(F.size("f64"), F.size("i64")) == elements)


def scalar(entries: DataFrame, name: str, kind: str = "i64") -> DataFrame:
    """(path, value) of a one-element matrix of the wanted type (``f64`` or ``i64``)."""
    return matrix_named(entries, name, 1).select("path", F.get(kind, F.lit(0)).alias("value")).where("value is not null")


def vector(entries: DataFrame, name: str, n: int, kind: str = "f64") -> DataFrame:
    return matrix_named(entries, name, n).select("path", F.col(kind).alias("value")).where("value is not null")


def matrix_sized(entries: DataFrame, name: str, sizes: list[int]) -> DataFrame:
    """A whole-number matrix whose dimensions are as given; 0 stands for any."""
    ok = F.size("sizes") == len(sizes)
    for i, s in enumerate(sizes):
        if s:
            ok = ok & (F.get("sizes", F.lit(i)) == s)
    return matrix_named(entries, name).where(ok & F.col("i64").isNotNull()).select("path", F.col("i64").alias("value"), "sizes")


def preset_matrix(entries: DataFrame, list_name: str, preset: str, sizes: list[int]) -> DataFrame:
    """(path, value): a list names the matrix of a preset, which is then found by its name.

    An equal-key join of items and matrices on (path, name). A missing ``Daylight`` falls back to ``Sunlight``.
    """
    names = ["Daylight", "Sunlight"] if preset == "Daylight" else [preset]
    lists = entries.where((F.col("kind") == "props") & (F.col("name") == list_name)).groupBy("path").agg(F.min_by("props", "idx").alias("props"))
    item = lambda n: F.get(F.filter("props", lambda p: p["name"] == n), F.lit(0))["value"]
    pick = first_of(*[item(n) for n in names])
    wanted = lists.select("path", pick.alias("name")).where("name is not null")
    matrices = entries.where("kind = 'matrix'").groupBy("path", "name").agg(F.min_by(F.struct("f64", "dims"), "idx").alias("m"))
    ok = F.col("m.f64").isNotNull() & (F.transform("m.dims", lambda d: d["size"].cast("int")) == F.array([F.lit(s) for s in sizes]))
    return wanted.join(matrices, ["path", "name"]).where(ok).select("path", F.col("m.f64").alias("value"))


def camera_model(camera_id: Column) -> Column:
    table = F.create_map([F.lit(x) for k, v in MODELS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, camera_id.cast("int")), F.lit(UNKNOWN_MODEL))


def white_balance(code: Column, header: Column | None = None) -> Column:
    """The preset of a code, Auto for an unknown one; without a code the header's name, or Auto."""
    table = F.create_map([F.lit(x) for k, v in WHITE_BALANCE.items() for x in (k, v)])
    named = F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Auto"))
    spare = F.nullif(header, F.lit("")) if header is not None else F.lit(None).cast("string")
    return F.when(code.isNotNull(), named).otherwise(F.coalesce(spare, F.lit("Auto")))


def is_true_engine(entries: DataFrame) -> DataFrame:
    """(path, value): whether a colour-correction list and a gain list are both there."""
    has = lambda n: F.bool_or((F.col("kind") == "props") & F.col("name").isin(n, f"DP1_{n}"))
    return entries.groupBy("path").agg((has("WhiteBalanceColorCorrections") & has("WhiteBalanceGains")).alias("value"))


def max_raw(entries: DataFrame) -> DataFrame:
    """(path, value array of three): from the image depth, else the engine's saturation levels, else 4095. One pass."""
    e = F.col("e")
    has = lambda n: F.exists(e, lambda x: (x["kind"] == "props") & x["name"].isin(n, f"DP1_{n}"))
    depth = F.get(numbers_in(e, "ImageDepth", 1), F.lit(0))
    top = F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")) - 1
    engine = has("WhiteBalanceColorCorrections") & has("WhiteBalanceGains")
    value = F.when(depth.isNotNull(), F.array(top, top, top)).when(engine, numbers_in(e, "RawSaturationLevel", 3)).otherwise(numbers_in(e, "SaturationLevel", 3))
    return gather(entries).select("path", F.coalesce(value, F.array([F.lit(4095).cast("long")] * 3)).alias("value"))


def rect(entries: DataFrame, name: str) -> DataFrame:
    return vector(entries, name, 4, "i64")


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def neutral_array(raw: Column) -> Column:
    """The raw values of a neutral grey under a raw-to-XYZ matrix (nine in an array): its inverse (or the identity) times the white point."""
    from lamina.functions.matrix import NEUTRAL_XYZ

    # the adjugate, each element by the four places of its 2x2 minor; its first column gives the determinant
    minors = ["48-57", "27-18", "15-24", "56-38", "08-26", "23-05", "37-46", "16-07", "04-13"]
    at = lambda v, i: F.get(v, F.lit(i))

    def solve(m: Column) -> Column:
        adjugate = F.array(*[at(m, int(x[0])) * at(m, int(x[1])) - at(m, int(x[3])) * at(m, int(x[4])) for x in minors])

        def divide(a: Column) -> Column:
            det = sum((at(m, k) * at(a, 3 * k) for k in range(3)), F.lit(0.0))
            inverse = lambda d, i: F.when(F.abs(d) < 1e-10, F.lit(1.0 if i % 4 == 0 else 0.0)).otherwise(at(a, i) / d)
            return let(det, lambda d: F.array(*[sum((inverse(d, 3 * i + k) * NEUTRAL_XYZ[k] for k in range(3)), F.lit(0.0)) for i in range(3)]))

        return let(adjugate, divide)

    return let(raw, solve)


def neutral_of(raw: list[Column]) -> list[Column]:
    """The same of nine columns."""
    value = neutral_array(F.array(*raw))
    return [F.get(value, F.lit(i)) for i in range(3)]


def gather(entries: DataFrame) -> DataFrame:
    """(path, e): all entries of a file as one array in order, for lookups that are expressions instead of joins."""
    row = F.struct("idx", "kind", "name", "text", "props", "dims", "f64", "i64")
    return entries.groupBy("path").agg(F.array_sort(F.collect_list(row), lambda a, b: a["idx"] - b["idx"]).alias("e"))


def entry_in(e: Column, kind: str, name: Column | str) -> Column:
    """The first entry of a kind and name in a gathered array."""
    name = name if isinstance(name, Column) else F.lit(name)
    return F.get(F.filter(e, lambda x: (x["kind"] == kind) & (x["name"] == name)), F.lit(0))


def numbers_in(e: Column, name: Column | str, n: int, field: str = "i64", sizes: list[int] | None = None) -> Column:
    """The values of a matrix if it has ``n`` elements of the wanted type, and the sides if they are given, else null."""
    return let(entry_in(e, "matrix", name), lambda x: F.when((F.size(x[field]) == n) & _sides(x, sizes), x[field]))


def _sides(x: Column, sizes: list[int] | None) -> Column:
    return F.lit(True) if sizes is None else F.transform(x["dims"], lambda d: d["size"].cast("int")) == F.array(*[F.lit(s) for s in sizes])


def preset_in(e: Column, lists: tuple[str, ...], preset: Column, n: int) -> Column:
    """The values of a preset's matrix (three in a row, or three by three) by the first list that leads to one; a missing Daylight
    means Sunlight."""

    def one(name: str) -> Column:
        item = lambda props, p: F.get(F.filter(props, lambda x: x["name"] == p), F.lit(0))["value"]
        found = let(entry_in(e, "props", name)["props"], lambda props: F.coalesce(item(props, preset), F.when(preset == "Daylight", item(props, F.lit("Sunlight")))))
        return let(found, lambda m: numbers_in(e, m, n, "f64", [3, 3] if n == 9 else [n]))

    return first_of(*map(one, lists))


def gains_in(e: Column, preset: Column) -> Column:
    """A preset's gains from one of three places in a gathered array, times the sensor, temperature and aperture factors that are there."""

    def of(p: Column) -> Column:
        legacy = F.transform(neutral_array(_legacy_raw(e, p)), lambda x: 1.0 / x)
        return F.coalesce(preset_in(e, ("WhiteBalanceGains", "DP1_WhiteBalanceGains"), p, 3), legacy)

    value = let(preset, of)
    for name in ("SensorAdjustmentGainFact", "TempGainFact", "FNumberGainFact"):
        value = F.zip_with(value, F.coalesce(numbers_in(e, name, 3, "f64"), F.array(*[F.lit(1.0)] * 3)), lambda a, b: a * b)
    return value


def white_balance_gain(entries: DataFrame, preset: str) -> DataFrame:
    """(path, value array of three): ``gains_in`` of each file, in one pass over the entries."""
    return gather(entries).select("path", gains_in(F.col("e"), F.lit(preset)).alias("value")).where("value is not null")


def _legacy_raw(e: Column, preset: Column) -> Column:
    """The preset's correction times its illuminant, as nine in an array; null without either."""
    nine = lambda v: [F.get(v, F.lit(i)) for i in range(9)]
    ill, cor = (preset_in(e, (n,), preset, 9) for n in ("WhiteBalanceIlluminants", "WhiteBalanceCorrections"))
    both = F.struct(cor.alias("c"), ill.alias("i"))
    return let(both, lambda x: F.when(x["c"].isNotNull() & x["i"].isNotNull(), F.array(*product(nine(x["c"]), nine(x["i"])))))


def product(a: list[Column], b: list[Column]) -> list[Column]:
    """A 3x3 product of nine columns each."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def layers_in(e: Column, preset: Column) -> Column:
    """sRGB's matrix times the preset's colour correction, as nine in an array.

    Without a correction, the illuminant matrix with its own correction, scaled to a neutral white.
    """
    from lamina.functions.matrix import SRGB_TO_XYZ

    nine = lambda v: [F.get(v, F.lit(i)) for i in range(9)]
    scaled = lambda m: let(neutral_array(m), lambda n: F.array(*[F.get(m, F.lit(i)) * F.get(n, F.lit(i % 3)) for i in range(9)]))

    def of(p: Column) -> Column:
        correction = preset_in(e, ("WhiteBalanceColorCorrections", "DP1_WhiteBalanceColorCorrections"), p, 9)
        modern = let(correction, lambda c: F.when(c.isNotNull(), F.array(*product([F.lit(x) for x in SRGB_TO_XYZ], nine(c)))))
        return F.coalesce(modern, let(_legacy_raw(e, p), lambda m: F.when(m.isNotNull(), scaled(m))))

    return let(preset, of)


def layers_to_xyz(entries: DataFrame, preset: str) -> DataFrame:
    """(path, value array of nine): ``layers_in`` of each file, in one pass over the entries."""
    return gather(entries).select("path", layers_in(F.col("e"), F.lit(preset)).alias("value")).where("value is not null")


def denoise_class(version: Column, model: Column) -> Column:
    """F23 from version 4.0 on; F20 where the model has ``dp2`` in any case; else STD."""
    return F.when(version >= (4 << 16), "F23").when(F.lower(F.coalesce(model, F.lit(""))).contains("dp2"), "F20").otherwise("STD")


def camera_info(header: DataFrame, properties: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each file: model, serial, preset, with defaults."""
    model = property_named(properties, "CAMMODEL").withColumnRenamed("value", "_model")
    serial = property_named(properties, "CAMSERIAL").withColumnRenamed("value", "serial")
    one = lambda n: F.get(numbers_in(F.col("e"), n, 1), F.lit(0))
    codes = gather(entries).select("path", one("CAMERAID").alias("_id"), one("WhiteBalance").alias("_wb"))
    df = header.join(model, "path", "left").join(serial, "path", "left").join(codes, "path", "left")
    return df.select("path", F.coalesce("_model", camera_model(F.col("_id"))).alias("model"), F.coalesce("serial", F.lit("")).alias("serial"), white_balance(F.col("_wb"), F.col("white_balance")).alias("white_balance"))


def exif_info(entries: DataFrame) -> DataFrame:
    """One row for each file: exposure time (the inverse of the shutter value, if positive), aperture, ISO as 16 bits. One pass."""
    one = lambda n: F.get(numbers_in(F.col("e"), n, 1, "f64"), F.lit(0))
    shutter = F.when(one("CaptureShutter") > 0, 1.0 / one("CaptureShutter"))
    iso = F.floor(one("CaptureISO")).cast("long").bitwiseAND(F.lit(65535).cast("long"))
    return gather(entries).select("path", shutter.alias("exposure"), one("CaptureAperture").alias("aperture"), iso.alias("iso"))
