"""Queries over the provided tables, one for each operator of the blueprint, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.functions import pixel as px
from lamina.operators import badpixels, gain, geometry, levels, metadata, neighbourhood, sequences
from lamina.sources.derived import RASTER_SQL, STREAM_SQL, raster, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def named(df: DataFrame, keys: list[str], columns, names: list[str]) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for c, n in zip(columns, names, strict=True)])


# Opponent colour, on line items as triples of whole numbers: row-wise, any volume.
_LINE = "line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 37 AS b, l_partkey % 4096 AS m, l_suppkey * 53 % 4096 AS t FROM lineitem)"


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("long") * 37).alias("b"), (F.col("l_partkey") % 4096).alias("m"), (F.col("l_suppkey") * 53 % 4096).alias("t"))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_C16 = "greatest(0, least(65535, {}))"


def _opp(y: str) -> str:
    return f"{_C16.format(y)} AS y, {_C16.format('2 * b - 2 * t + 32768')} AS u, {_C16.format('b - 2 * m + t + 32768')} AS v"


def _bmt() -> tuple:
    return F.col("b"), F.col("m"), F.col("t")


def _yuv(df: DataFrame, forward) -> DataFrame:
    return named(df, _KEYS, forward(*_bmt()), ["y", "u", "v"])


@query(f"WITH {_LINE} SELECT {_K}, {_opp('(b + m + t + 1) // 3')} FROM line")
def yuv_std_forward(spark, sf_dir):
    return _yuv(_line(spark, sf_dir), px.opponent_std)


_STD_INV = f"""{_C16.format('CAST(trunc((6 + 2 * v + 3 * u + 12 * y) / 12) AS BIGINT)')} AS b, {_C16.format('CAST(trunc((3 * y - v + 1) / 3) AS BIGINT)')} AS m,
 {_C16.format('CAST(trunc((6 + 2 * v - 3 * u + 12 * y) / 12) AS BIGINT)')} AS t"""


@query(f"WITH {_LINE}, f AS (SELECT {_K}, y, u - 32768 AS u, v - 32768 AS v FROM (SELECT {_K}, {_opp('(b + m + t + 1) // 3')} FROM line)) SELECT {_K}, {_STD_INV} FROM f")
def yuv_std_inverse(spark, sf_dir):
    f = _yuv(_line(spark, sf_dir), px.opponent_std)
    return named(f, _KEYS, px.opponent_std_inverse(F.col("y"), F.col("u"), F.col("v")), ["b", "m", "t"])


@query(f"""WITH {_LINE}, f AS (SELECT {_K}, y, u - 32768 AS u, v - 32768 AS v FROM (SELECT {_K}, {_opp('t')} FROM line))
SELECT {_K}, {_C16.format('CAST(trunc((2 * y + u + 1) / 2) AS BIGINT)')} AS b, {_C16.format('CAST(trunc((4 * y + u - 2 * v + 2) / 4) AS BIGINT)')} AS m, {_C16.format('y')} AS t FROM f""")
def yuv_yist_roundtrip(spark, sf_dir):
    f = _yuv(_line(spark, sf_dir), px.opponent_top)
    return named(f, _KEYS, px.opponent_top_inverse(F.col("y"), F.col("u"), F.col("v")), ["b", "m", "t"])


@query(f"""WITH {_LINE}, f AS (SELECT {_K}, y, u - 32768 AS u, v - 32768 AS v FROM (SELECT {_K}, {_opp('4 * t')} FROM line))
SELECT {_K}, {_C16.format('CAST(trunc((y + 2 * u + 2) / 4) AS BIGINT)')} AS b, {_C16.format('CAST(trunc((y + u - 2 * v + 2) / 4) AS BIGINT)')} AS m, {_C16.format('CAST(trunc((y + 2) / 4) AS BIGINT)')} AS t FROM f""")
def yuv_yis4t_roundtrip(spark, sf_dir):
    f = _yuv(_line(spark, sf_dir), px.opponent_top4)
    return named(f, _KEYS, px.opponent_top4_inverse(F.col("y"), F.col("u"), F.col("v")), ["b", "m", "t"])


# Tone, gamma, quantisation.
_UNIT = "unit AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 110000.0 AS v FROM lineitem)"


def _unit(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem", *_KEYS, "l_extendedprice").select(*_KEYS, (F.col("l_extendedprice") / 110000.0).alias("v"))


def _tone(name: str, fn, sql: str) -> None:
    def run(spark, sf_dir):
        return _unit(spark, sf_dir).select(*_KEYS, fn(F.col("v")).alias("out"))

    run.__name__ = name
    query(f"WITH {_UNIT} SELECT {_K}, {sql} AS out FROM unit")(run)


_SRGB_SQL = "CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * pow({0}, 1 / 2.4) - 0.055 END"
_tone("gamma_pow", lambda v: F.round(px.gamma_power(v, 2.2), 6), "round(CASE WHEN v <= 0 THEN 0.0 ELSE pow(v, 1 / 2.2) END, 6)")
_tone("srgb_curve", lambda v: F.round(px.gamma_srgb(v), 6), f"round({_SRGB_SQL.format('v')}, 6)")
_tone("aces", lambda v: F.round(px.tone_aces(v), 6), "round(greatest(0.0, least(1.0, (v * (2.51 * v + 0.03)) / (v * (2.43 * v + 0.59) + 0.14))), 6)")
_tone("exposure", lambda v: F.round(px.exposure(v, 1.5), 6), "round(v * pow(2.0, 1.5), 6)")
_tone("to_uint8", px.to_uint8, "CAST(floor(greatest(0.0, least(255.0, v * 255 + 0.5))) AS BIGINT)")
_tone("to_uint16", px.to_uint16, "CAST(floor(greatest(0.0, least(65535.0, v * 65535 + 0.5))) AS BIGINT)")


@query(f"""WITH {_UNIT}, cells AS (SELECT i, least(greatest(({_SRGB_SQL.format('(i / 255.0)')}) * 1000, 0.0), 1000.0) AS c FROM range(256) r(i)),
p AS (SELECT *, CAST(floor(v * 255) AS BIGINT) AS i, v * 255 AS a FROM unit)
SELECT {_K}, CAST(round(round(CASE WHEN p.i < 0 THEN 0.0 WHEN p.i >= 255 THEN 1000.0 ELSE lo.c + (a - p.i) * (hi.c - lo.c) END, 6)) AS BIGINT) AS out
FROM p LEFT JOIN cells lo ON lo.i = p.i LEFT JOIN cells hi ON hi.i = p.i + 1""")
def srgb_lut(spark, sf_dir):
    return _unit(spark, sf_dir).select(*_KEYS, px.table_lookup(F.col("v"), px.srgb_table(256, 1000), 6).alias("out"))


def _mat_sql(m: list[float], names: tuple[str, str, str], out: tuple[str, str, str], wrap: str = "round({}, 6)") -> str:
    return ", ".join(f"{wrap.format(f'CAST({m[3 * i]!r} AS DOUBLE) * {names[0]} + CAST({m[3 * i + 1]!r} AS DOUBLE) * {names[1]} + CAST({m[3 * i + 2]!r} AS DOUBLE) * {names[2]}')} AS {o}" for i, o in enumerate(out))


@query(f"WITH {_LINE} SELECT {_K}, {_mat_sql(mx.XYZ_TO_SRGB, ('b', 'm', 't'), ('r', 'g', 'bl'), 'round({}, 7)')} FROM line")
def matrix_apply(spark, sf_dir):
    return named(_line(spark, sf_dir), _KEYS, [F.round(c, 7) for c in px.apply_matrix(mx.XYZ_TO_SRGB, *_bmt())], ["r", "g", "bl"])


_CUBE_N = 5
_CUBE = [(r / 4, g / 4, b / 4) for b in range(5) for g in range(5) for r in range(5)]


@query(f"""WITH {_LINE}, i AS (SELECT {_K}, {_mat_sql(px.AGX_INSET, ('(b / 4096.0)', '(m / 4096.0)', '(t / 4096.0)'), ('r', 'g', 'bl'), '{}')} FROM line)
SELECT {_K}, {', '.join(f"round(greatest(0.0, least(1.0, pow(CASE WHEN {c} <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (log2({c}) + 12.47393) / 24.9999988117)) END, 2.2))), 6) AS {c}" for c in ('r', 'g', 'bl'))} FROM i""")
def agx_identity_cube(spark, sf_dir):
    """The cube tone map with an identity cube, so that trilinear lookup gives its input."""
    unit = [c / 4096.0 for c in _bmt()]
    return named(_line(spark, sf_dir), _KEYS, [F.round(c, 6) for c in px.tone_agx(*unit, _CUBE_N, _CUBE)], ["r", "g", "bl"])


@query(f"""WITH {_LINE} SELECT {_K}, {', '.join(f"round(CASE WHEN a_{c} <= 0 THEN 0.0 ELSE pow(a_{c}, 1 / 2.2) END, 6) AS {c}" for c in 'bmt')}
FROM (SELECT {_K}, {', '.join(f"greatest(0.0, least(1.0, (e_{c} * (2.51 * e_{c} + 0.03)) / (e_{c} * (2.43 * e_{c} + 0.59) + 0.14))) AS a_{c}" for c in 'bmt')}
FROM (SELECT {_K}, {', '.join(f'{c} / 4096.0 * pow(2.0, 0.5) AS e_{c}' for c in 'bmt')} FROM line))""")
def develop_chain(spark, sf_dir):
    return named(_line(spark, sf_dir), _KEYS, [F.round(c, 6) for c in px.develop(tuple(c / 4096.0 for c in _bmt()), 0.5, "aces", 2.2)], ["b", "m", "t"])


# Levels.
_AREAS = [(0, 0, 7, 1), (0, 6, 7, 7), (0, 0, 1, 7)]
_AREA_SQL = "areas(x0, y0, x1, y1) AS (VALUES (0, 0, 7, 1), (0, 6, 7, 7), (0, 0, 1, 7))"
_LEVEL_SQL = f"""{_AREA_SQL}, lv AS (SELECT image_id, count(*) AS n, {', '.join(f'sum({c}) AS s{c}, sum({c} * {c}) AS q{c}' for c in 'bmt')}
 FROM raster JOIN areas ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY image_id),
lev AS (SELECT image_id, n, {', '.join(f'CAST(s{c} AS DOUBLE) / n AS level_{c}, sqrt(CAST(n * q{c} - s{c} * s{c} AS DOUBLE)) / n AS dev_{c}' for c in 'bmt')} FROM lv)"""
_GAIN = levels.FALLBACK_GAIN


def _levels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = raster(spark, sf_dir)
    return r, levels.black_level(r, _AREAS)


def _rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


_LV = [f"{k}_{c}" for c in "bmt" for k in ("level", "dev")]


@query(f"WITH {RASTER_SQL}, {_LEVEL_SQL} SELECT image_id, n, {', '.join(f'round({c}, 6) AS {c}' for c in _LV)} FROM lev")
def black_level(spark, sf_dir):
    return _rounded(_levels(spark, sf_dir)[1], ["image_id", "n"], _LV)


@query(f"WITH {RASTER_SQL}, {_LEVEL_SQL} SELECT image_id, n, {', '.join(f'round({c}, 6) AS {c}' for c in _LV)} FROM lev")
def black_level_join(spark, sf_dir):
    """The same with a table of rectangles for each image."""
    r = raster(spark, sf_dir)
    rects = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), a, strict=True)]) for a in _AREAS]))
    areas = table(spark, sf_dir, "embeddings", "vec_id").where("vec_id % 3 = 0").select(F.expr("vec_id div 3").alias("image_id"), rects.alias("a")).select("image_id", "a.*")
    return _rounded(levels.black_level_join(r, areas), ["image_id", "n"], _LV)


_GAINS_SQL = "(CASE n_nationkey % 3 WHEN 0 THEN 1.96768 WHEN 1 THEN 1.5 ELSE 0.9 END)"
_TOPS_SQL = ", ".join(f"CAST(round(g{i} * (16383.0 - bias) / greatest(g0, g1, g2) + bias) AS BIGINT) AS top_{c}" for i, c in enumerate("bmt"))


@query(f"SELECT n_nationkey, {_TOPS_SQL} FROM (SELECT n_nationkey, {_GAINS_SQL} AS g0, 1.15026 AS g1, 0.777087 + n_nationkey * 0.01 AS g2, n_nationkey * 2.5 AS bias FROM nation)")
def max_intermediate(spark, sf_dir):
    n = F.col("n_nationkey")
    g = [F.when(n % 3 == 0, 1.96768).when(n % 3 == 1, 1.5).otherwise(0.9), F.lit(1.15026), 0.777087 + n * 0.01]
    return named(table(spark, sf_dir, "nation", "n_nationkey"), ["n_nationkey"], levels.max_intermediate(g, n * 2.5), ["top_b", "top_m", "top_t"])


_TOP0 = [16383, round(1.15026 * 16383 / 1.96768), round(0.777087 * 16383 / 1.96768)]
_BIAS = "greatest(0.0, " + ", ".join(f"4.0 * dev_{c} * {t} / (4095.0 - level_{c})" for c, t in zip("bmt", _TOP0, strict=True)) + ")"


@query(f"WITH {RASTER_SQL}, {_LEVEL_SQL} SELECT image_id, round({_BIAS}, 4) AS bias FROM lev")
def intermediate_bias(spark, sf_dir):
    lv = _levels(spark, sf_dir)[1]
    tops = levels.max_intermediate([F.lit(g) for g in _GAIN])
    bias = levels.intermediate_bias([F.col(f"dev_{c}") for c in "bmt"], [F.col(f"level_{c}") for c in "bmt"], tops, [F.lit(4095.0)] * 3)
    return lv.select("image_id", F.round(bias, 4).alias("bias"))


_LINEAR_SQL = f"""{RASTER_SQL}, {_LEVEL_SQL}, per AS (SELECT *, {_BIAS} AS bias FROM lev),
tp AS (SELECT *, {', '.join(f'CAST(round({g!r} * (16383.0 - bias) / {_GAIN[0]!r} + bias) AS BIGINT) AS top_{c}' for g, c in zip(_GAIN, 'bmt', strict=True))} FROM per),
lin AS (SELECT r.image_id, y, x, {', '.join(f'greatest(0, least(65535, CAST(round((top_{c} - bias) / (4095.0 - level_{c}) * ({c} - level_{c}) + bias) AS BIGINT))) AS {c}' for c in 'bmt')}
 FROM raster r JOIN tp USING (image_id))"""


def _linear(spark, sf_dir) -> DataFrame:
    r, lv = _levels(spark, sf_dir)
    return levels.linearise(r, lv, _GAIN).select("image_id", "y", "x", "b", "m", "t")


@query(f"WITH {_LINEAR_SQL} SELECT * FROM lin")
def linear_preprocess(spark, sf_dir):
    return _linear(spark, sf_dir)


@query(f"WITH {RASTER_SQL} SELECT image_id, y // 2 AS y, x // 2 AS x, sum(t) / 4.0 AS mean FROM raster WHERE x < 7 GROUP BY 1, 2, 3 HAVING count(*) = 4")
def top_downsample_2x2(spark, sf_dir):
    return levels.top_downsample(raster(spark, sf_dir).where("x < 7"), value="t")


_FLAG_MATRIX = mx.multiply(mx.XYZ_TO_SRGB, mx.raw_to_xyz(mx.SRGB_TO_XYZ, list(_GAIN)))


@query(f"""WITH {_LINEAR_SQL}, u AS (SELECT image_id, {', '.join(f'({c} - bias) / (top_{c} - bias) AS {c}' for c in 'bmt')} FROM lin JOIN tp USING (image_id)),
c AS (SELECT image_id, {_mat_sql(_FLAG_MATRIX, ('b', 'm', 't'), ('r', 'g', 'bl'), '{}')} FROM u),
s AS (SELECT image_id, {', '.join(f'{_SRGB_SQL.format(f"greatest(0.0, least(1.0, {c}))")} AS {c}' for c in ('r', 'g', 'bl'))} FROM c)
SELECT image_id, count(*) AS n, {', '.join(f'round(avg({c}), 5) AS {c}' for c in ('r', 'g', 'bl'))} FROM s GROUP BY image_id""")
def flagship_develop(spark, sf_dir):
    """Black level, linear map, colour matrix and sRGB curve, then each image's mean."""
    r, lv = _levels(spark, sf_dir)
    lin = levels.linearise(r, lv, _GAIN)
    unit = [(F.col(c) - F.col("bias")) / (F.col(f"top_{c}") - F.col("bias")) for c in "bmt"]
    rgb = [px.gamma_srgb(px.clamp(c, 0, 1)) for c in px.apply_matrix(_FLAG_MATRIX, *unit)]
    shown = named(lin, ["image_id"], rgb, ["r", "g", "bl"])
    return shown.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("r", "g", "bl")])


# Bad pixels.
def _bad_sources(spark, sf_dir) -> list[DataFrame]:
    e = table(spark, sf_dir, "events", "event_id")
    word = F.shiftleft(F.col("event_id") * 7 % 200, 20).bitwiseOR(F.shiftleft(F.col("event_id") * 13 % 200, 8))
    packed = badpixels.unpack_packed(e.select(F.col("event_id").alias("pos"), word.alias("value")), 10, 20)
    triples = badpixels.unpack_triples(e.select(F.col("event_id").alias("pos"), (F.col("event_id") * 31 % 190).alias("value")))
    grid = badpixels.highlight_grid(spark, (3, 5), (17, 23), 160, 160)
    return [badpixels.tagged(n, d) for n, d in (("packed", packed), ("f20", triples), ("highlight", grid))]


_BAD_SQL = """src AS (
  SELECT 'packed' AS source, 0 AS priority, event_id AS pos, event_id * 7 % 200 - 20 AS y, event_id * 13 % 200 - 10 AS x FROM events
  UNION ALL SELECT 'f20', 1, event_id // 3, max(event_id * 31 % 190) FILTER (event_id % 3 = 0), max(event_id * 31 % 190) FILTER (event_id % 3 = 1) FROM events GROUP BY event_id // 3
  UNION ALL SELECT 'highlight', 3, r * 1048576 + c, r, c FROM range(5, 160, 23) a(r), range(3, 160, 17) b(c)),
ins AS (SELECT *, coalesce(x BETWEEN 0 AND 159 AND y BETWEEN 0 AND 159, false) AS inside FROM src)"""


@query(f"WITH {_BAD_SQL} SELECT y, x, arg_min(source, priority * 1000000000000 + pos) AS source FROM ins WHERE inside GROUP BY y, x")
def bad_pixel_union(spark, sf_dir):
    return badpixels.union_first(_bad_sources(spark, sf_dir), 160, 160)


@query(f"""WITH {_BAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY inside, y, x ORDER BY priority, pos) = 1 AS first FROM ins)
SELECT source, count(*) FILTER (inside AND first) AS kept, count(*) FILTER (inside AND NOT first) AS duplicates, count(*) FILTER (NOT inside) AS outside FROM r GROUP BY source""")
def bad_pixel_source_stats(spark, sf_dir):
    sources = _bad_sources(spark, sf_dir)
    return badpixels.source_counts([s.withColumns({"x": F.coalesce("x", F.lit(-1)), "y": F.coalesce("y", F.lit(-1))}) for s in sources], 160, 160)


@query("SELECT r + dr AS y, c + dc AS x FROM range(592, 3889, 32) a(r), range(233, 6426, 16) b(c), range(2) d(dr), range(1) e(dc)")
def af_grid(spark, sf_dir):
    return badpixels.focus_grid(spark, 16, 1).select("y", "x")


@query("SELECT r AS y, c AS x FROM range(5, 800, 23) a(r), range(3, 1200, 17) b(c)")
def highlight_grid(spark, sf_dir):
    return badpixels.highlight_grid(spark, (3, 5), (17, 23), 1200, 800).select("y", "x")


@query("""WITH RECURSIVE s AS (SELECT event_id // 100 AS g, event_id % 100 AS pos, CASE WHEN event_id * 7919 % 5 = 0 THEN 0 ELSE event_id * 31 % 97 END AS v FROM events),
w AS (SELECT g, pos, v, CAST(-1 AS BIGINT) AS before, v AS row, false AS hit FROM s WHERE pos = 0
 UNION ALL SELECT s.g, s.pos, s.v, w.row, CASE WHEN w.row = -1 THEN s.v WHEN s.v = 0 THEN -1 ELSE w.row END, w.row <> -1 AND s.v <> 0 FROM w JOIN s ON s.g = w.g AND s.pos = w.pos + 1)
SELECT g, pos, row AS y, v AS x FROM w WHERE hit""")
def row_marked_stream(spark, sf_dir):
    e = F.col("event_id")
    s = table(spark, sf_dir, "events", "event_id").select(F.expr("event_id div 100").alias("g"), (e % 100).alias("pos"), F.when(e * 7919 % 5 == 0, 0).otherwise(e * 31 % 97).alias("value"))
    return badpixels.row_marked(s, ["g"])


# Neighbourhoods.
_CLAMPED = "greatest(0, least(7, {}))"


@query(f"""WITH {RASTER_SQL}, o AS (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i)),
p AS (SELECT c.image_id, c.y, c.x, n.m FROM raster c, o JOIN raster n ON n.image_id = c.image_id AND n.y = {_CLAMPED.format('c.y + o.dy')} AND n.x = {_CLAMPED.format('c.x + o.dx')})
SELECT image_id, y, x, list_sort(list(m))[5] AS median FROM p GROUP BY 1, 2, 3""")
def median3x3(spark, sf_dir):
    return neighbourhood.median3(raster(spark, sf_dir), "m", 8, 8)


@query(f"""WITH {RASTER_SQL}, o AS (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i)),
p AS (SELECT c.image_id, c.y, c.x, n.t FROM raster c, o JOIN raster n ON n.image_id = c.image_id AND n.y = {_CLAMPED.format('c.y + o.dy')} AND n.x = {_CLAMPED.format('c.x + o.dx')}),
q AS (SELECT image_id, y, x, list_sort(list(t))[5] AS md FROM p WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 GROUP BY 1, 2, 3)
SELECT image_id, y, x, b, m, coalesce(md, t) AS t FROM raster LEFT JOIN q USING (image_id, y, x)""")
def median_area(spark, sf_dir):
    return neighbourhood.median_area(raster(spark, sf_dir), "t", 8, 8, (1, 2, 5, 6)).select("image_id", "y", "x", "b", "m", "t")


def _taps_sql(n_in: int, n_out: int, name: str, a: float = -0.5, centre: float = 0.0) -> str:
    """Taps of one axis from the kernel's formula: source, destination, weight."""
    x = "abs(k - f)"
    weight = f"CASE WHEN {x} <= 1 THEN ({a} + 2) * {x} * {x} * {x} - ({a} + 3) * {x} * {x} + 1 WHEN {x} < 2 THEN {a} * {x} * {x} * {x} - 5 * {a} * {x} * {x} + 8 * {a} * {x} - 4 * {a} ELSE 0 END"
    places = f"SELECT d, k, CAST(floor(p) AS BIGINT) AS base, p - floor(p) AS f FROM (SELECT d, CAST((d + 0.5) * {n_in} / {n_out} - {centre} AS DOUBLE) AS p FROM range({n_out}) r(d)), range(-1, 3) q(k)"
    return f"{name} AS (SELECT greatest(0, least({n_in - 1}, base + k)) AS s, d, CAST({weight} AS DOUBLE) AS w FROM ({places}))"


def _bicubic_sql(src: str, cols: str, n: int, final: str, a: float = -0.5, centre: float = 0.0) -> str:
    each = ", ".join(f"CAST({final.format(f'greatest(0.0, least(65535.0, sum({c} * tx.w * ty.w) / sum(tx.w * ty.w)))')} AS BIGINT) AS {c}" for c in cols)
    return f"{_taps_sql(8, n, 'tx', a, centre)}, {_taps_sql(8, n, 'ty', a, centre)}, big AS (SELECT image_id, ty.d AS y, tx.d AS x, {each} FROM {src} JOIN tx ON tx.s = x JOIN ty ON ty.s = y GROUP BY 1, 2, 3)"


@query(f"WITH {RASTER_SQL}, {_bicubic_sql('raster', 'bmt', 16, 'floor(round({}, 9))')} SELECT image_id, y, x, b, m, t FROM big")
def bicubic_2x(spark, sf_dir):
    return neighbourhood.bicubic(raster(spark, sf_dir), ["b", "m", "t"], (8, 8), (16, 16))


@query(f"""WITH {RASTER_SQL}, yuv AS (SELECT image_id, y AS yy, x AS xx, {_opp('4 * t')} FROM raster), yv AS (SELECT image_id, yy AS y, xx AS x, y AS p, u AS q, v AS r FROM yuv), {_bicubic_sql('yv', 'pqr', 16, 'floor(round({}, 9))')},
tops AS (SELECT image_id, y, x, least(65535, m * 4) AS top FROM (SELECT image_id, y * 2 + a.i AS y, x * 2 + b.i AS x, m FROM raster, range(2) a(i), range(2) b(i)) WHERE x < 15),
j AS (SELECT big.image_id, big.y, big.x, coalesce(top, p) AS p, q - 32768 AS q, r - 32768 AS r FROM big LEFT JOIN tops USING (image_id, y, x))
SELECT image_id, y, x, {_C16.format('CAST(trunc((p + 2 * q + 2) / 4) AS BIGINT)')} AS b, {_C16.format('CAST(trunc((p + q - 2 * r + 2) / 4) AS BIGINT)')} AS m, {_C16.format('CAST(trunc((p + 2) / 4) AS BIGINT)')} AS t FROM j""")
def quattro_expand(spark, sf_dir):
    """The full-resolution top layer is the middle one doubled; its last column is missing, so resized luma stays there."""
    r = raster(spark, sf_dir)
    sub = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("o")
    top = r.select("image_id", "y", "x", "m", sub).select("image_id", (F.col("y") * 2 + F.col("o.i")).alias("y"), (F.col("x") * 2 + F.col("o.j")).alias("x"), F.col("m").alias("v")).where("x < 15")
    return neighbourhood.quattro_expand(r, top, (8, 8), (16, 16))


# Sequences.
@query(f"WITH {STREAM_SQL} SELECT event_id, y, x, diff, greatest(0, ((CAST(sum(diff) OVER (PARTITION BY y ORDER BY x) AS BIGINT) + 100 + 32768) & 65535) - 32768) AS value FROM stream")
def dpcm_row(spark, sf_dir):
    return sequences.rows_sum(stream(spark, sf_dir), ["y"], start=100)


@query(f"""WITH {STREAM_SQL}, h AS (SELECT y, x AS ph, 512 + sum(diff) OVER (PARTITION BY y % 2, x ORDER BY y) AS head FROM stream WHERE x < 2),
r AS (SELECT *, sum(CASE WHEN x >= 2 THEN diff ELSE 0 END) OVER (PARTITION BY y, x % 2 ORDER BY x) AS run FROM stream)
SELECT event_id, r.y, x, diff, greatest(0, CAST(head + run AS BIGINT)) AS value FROM r JOIN h ON h.y = r.y AND h.ph = r.x % 2""")
def dpcm_2x2(spark, sf_dir):
    return sequences.phases_sum(stream(spark, sf_dir), 512, [])


@query(f"WITH {STREAM_SQL} SELECT event_id, y, x, diff, (CAST(sum(diff) OVER (PARTITION BY y ORDER BY x) AS BIGINT) + 77) & 255 AS value FROM stream")
def bytes_cumsum_mod256(spark, sf_dir):
    return sequences.bytes_sum(stream(spark, sf_dir), ["y"], "x", 77)


@query(f"WITH {STREAM_SQL} SELECT event_id, CAST(sum(diff) OVER (ORDER BY event_id) AS BIGINT) AS total FROM stream")
def long_stream_sum(spark, sf_dir):
    return sequences.chunked_sum(stream(spark, sf_dir).select("event_id", "diff"), "event_id", 1000).select("event_id", "total")


@query(f"""WITH {STREAM_SQL}, v AS (SELECT event_id, y, x, CAST(sum(diff) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS value FROM stream)
SELECT event_id, y, x, value - least(0, min(value) OVER (PARTITION BY y)) AS value FROM v""")
def auto_offset(spark, sf_dir):
    from pyspark.sql.window import Window

    total = F.sum("diff").over(Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return sequences.auto_offset(stream(spark, sf_dir).withColumn("value", total), ["y"]).select("event_id", "y", "x", "value")


@query("SELECT event_id, event_id * 2654435761 % 1073741824 & 1023 AS c0, (event_id * 2654435761 % 1073741824 >> 10) & 1023 AS c1, (event_id * 2654435761 % 1073741824 >> 20) & 1023 AS c2 FROM events")
def unpack_bits(spark, sf_dir):
    word = F.col("event_id") * 2654435761 % 1073741824
    return named(table(spark, sf_dir, "events", "event_id"), ["event_id"], sequences.unpack_fields(word, 10), ["c0", "c1", "c2"])


@query("SELECT event_id, (a >> 4) & 255 AS b0, ((a << 4) & 240) + ((b >> 8) & 15) AS b1, b & 255 AS b2 FROM (SELECT event_id, event_id * 37 % 4096 AS a, event_id * 101 % 4096 AS b FROM events)")
def pack12(spark, sf_dir):
    return named(table(spark, sf_dir, "events", "event_id"), ["event_id"], sequences.pack12(F.col("event_id") * 37 % 4096, F.col("event_id") * 101 % 4096), ["b0", "b1", "b2"])


@query("""WITH RECURSIVE k AS (SELECT 0 AS i, (CAST(12345 AS BIGINT) * 1597 + 51749) % 244944 AS key UNION ALL SELECT i + 1, (key * 1597 + 51749) % 244944 FROM k WHERE i < 99),
t AS (SELECT i, key, (key * 301593171 >> 24) & 4294967295 AS t FROM k)
SELECT event_id, xor(event_id * 3 % 256, (((((key * 256 - t) & 4294967295) >> 1) + t) & 4294967295) >> 17 & 255) AS value FROM events JOIN t ON t.i = event_id % 100""")
def camf_type2(spark, sf_dir):
    """Streams of 100 bytes, each with the same key."""
    rows = table(spark, sf_dir, "events", "event_id").select("event_id", (F.col("event_id") % 100).alias("place"), (F.col("event_id") * 3 % 256).alias("value"))
    return sequences.xor_stream(rows, "place", "value", 12345, 100).select("event_id", "value")


# Algebra and lookups.
@query("""SELECT event_id, CASE event_id % 14 WHEN 13 THEN 'Auto' ELSE coalesce((SELECT p FROM (VALUES (1, 'Auto'), (2, 'Sunlight'), (3, 'Shadow'), (4, 'Overcast'), (5, 'Incandescent'), (6, 'Florescent'),
 (7, 'Flash'), (8, 'Custom'), (11, 'ColorTemp'), (12, 'AutoLSP')) t(k, p) WHERE k = event_id % 14), 'Auto') END AS preset FROM events""")
def wb_lookup(spark, sf_dir):
    code = F.when(F.col("event_id") % 14 != 13, F.col("event_id") % 14)
    return table(spark, sf_dir, "events", "event_id").select("event_id", metadata.white_balance(code).alias("preset"))


@query("""SELECT event_id, coalesce(m, 'SIGMA Digital Camera') AS model FROM events LEFT JOIN (VALUES (77, 'SIGMA dp1 Merrill'), (78, 'SIGMA dp2/dp3 Merrill'), (83, 'SIGMA dp0 Quattro'),
 (80, 'SIGMA dp1 Quattro'), (81, 'SIGMA dp2 Quattro'), (82, 'SIGMA dp3 Quattro'), (15, 'SIGMA sd Quattro'), (16, 'SIGMA sd Quattro H')) t(k, m) ON k = event_id % 90""")
def camera_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id").select("event_id", metadata.camera_model(F.col("event_id") % 90).alias("model"))


_R = "s_suppkey * 7 % 60 AS x0, s_suppkey * 11 % 50 AS y0, s_suppkey * 7 % 60 + s_suppkey % 40 AS x1, s_suppkey * 11 % 50 + s_suppkey % 30 AS y1"


@query(f"""SELECT s_suppkey, (greatest(x0, 10) - 10) * 320 // 40 AS x0, (greatest(y0, 5) - 5) * 200 // 30 AS y0, (least(x1, 49) - 10) * 320 // 40 AS x1, (least(y1, 34) - 5) * 200 // 30 AS y1
FROM (SELECT s_suppkey, {_R} FROM supplier) WHERE NOT (x0 > 49 OR y0 > 34 OR x1 < 10 OR y1 < 5)""")
def rect_scaled(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey").selectExpr("s_suppkey", *_R.split(", "))
    r = geometry.clip_rect([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.lit(v) for v in (10, 5, 49, 34)], (F.lit(320), F.lit(200)))
    return s.select("s_suppkey", r.alias("r")).where("r is not null").select("s_suppkey", "r.*")


_TGT = "tgt AS (SELECT c_nationkey AS g, c_custkey AS target, c_custkey % 100 / 100.0 AS tx, c_custkey * 7 % 100 / 100.0 AS ty FROM customer)"
_BLK = "blk AS (SELECT s_nationkey AS g, s_suppkey AS idx, s_suppkey * 13 % 100 / 100.0 AS bx, s_suppkey * 29 % 100 / 100.0 AS b_y FROM supplier)"
_NEAR = f"""{_TGT}, {_BLK}, d AS (SELECT g, target, idx, bx - tx AS dx, b_y - ty AS dy FROM tgt JOIN blk USING (g)),
dq AS (SELECT *, CASE WHEN dx > 0 AND dy > 0 THEN 0 WHEN dx > 0 THEN 3 WHEN dy > 0 THEN 1 ELSE 2 END AS q, dx * dx + dy * dy AS d2 FROM d),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, target, q ORDER BY d2, idx) AS rn FROM dq) WHERE rn = 1)"""


def _targets_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").selectExpr("c_nationkey as g", "c_custkey as target", "c_custkey % 100 / 100.0D as tx", "c_custkey * 7 % 100 / 100.0D as ty")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").selectExpr("s_nationkey as g", "s_suppkey as idx", "s_suppkey * 13 % 100 / 100.0D as bx", "s_suppkey * 29 % 100 / 100.0D as by")
    return c, s


@query(f"WITH {_NEAR} SELECT g, target, q, idx FROM near")
def nearest_quadrant(spark, sf_dir):
    return gain.nearest_in_quadrants(*_targets_blocks(spark, sf_dir), ["g"]).select("g", "target", "q", "idx")


def _pair_sql(c: str, own: int, other: int) -> str:
    return f"coalesce(CASE WHEN {c}{other} - {c}{own} <> 0 THEN {c}{other} / ({c}{other} - {c}{own}) END, 1.0)"


_WX = f"CASE q WHEN 0 THEN {_pair_sql('dx', 0, 1)} WHEN 1 THEN {_pair_sql('dx', 1, 0)} WHEN 2 THEN {_pair_sql('dx', 2, 3)} ELSE {_pair_sql('dx', 3, 2)} END"
_WY = f"CASE q WHEN 0 THEN {_pair_sql('dy', 0, 3)} WHEN 3 THEN {_pair_sql('dy', 3, 0)} WHEN 1 THEN {_pair_sql('dy', 1, 2)} ELSE {_pair_sql('dy', 2, 1)} END"


@query(f"""WITH {_NEAR}, wide AS (SELECT g, target, {', '.join(f'max({c}) FILTER (q = {q}) AS {c}{q}' for q in range(4) for c in ('dx', 'dy'))} FROM near GROUP BY 1, 2),
w AS (SELECT near.g, near.target, idx, ({_WX}) * ({_WY}) AS weight FROM near JOIN wide USING (g, target)),
codes AS (SELECT s_suppkey AS idx, ch, cell, s_suppkey * (ch + 3) * (cell + 7) % 100 AS code FROM supplier, range(3) a(ch), range(2) b(cell))
SELECT g, target, ch AS channel, cell, round(CAST(CAST(sum(weight * (0.9 + 0.01 * code)) AS FLOAT) AS DOUBLE), 3) AS gain FROM w JOIN codes USING (idx) GROUP BY 1, 2, 3, 4""")
def gain_merge(spark, sf_dir):
    """Merged once for each place of a target."""
    targets, blocks = _targets_blocks(spark, sf_dir)
    stand = gain.places(targets, ["g"])
    w = gain.quadrant_weights(gain.nearest_of_places(stand, blocks, ["g"]), ["g", "target"])
    pick = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("channel"), F.lit(j).cast("long").alias("cell")) for i in range(3) for j in range(2)])).alias("p")
    codes = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("idx"), pick).select("idx", "p.*")
    codes = codes.withColumns({"code": F.col("idx") * (F.col("channel") + 3) * (F.col("cell") + 7) % 100, "least": F.lit(0.9), "step": F.lit(0.01)})
    merged = gain.merge_gain(w, codes, ["g", "target"], []).join(stand, ["g", "target"])
    return gain.at_places(targets, merged, ["g"]).withColumn("gain", F.round(F.col("gain").cast("double"), 3))


# Geometry.
@query(f"WITH {RASTER_SQL} SELECT image_id, y - 2 AS y, x - 1 AS x, b, m, t FROM raster WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6")
def crop_active(spark, sf_dir):
    return geometry.crop(raster(spark, sf_dir), (1, 2, 5, 6)).select("image_id", "y", "x", "b", "m", "t")


@query(f"WITH {RASTER_SQL} SELECT image_id, y - 2 AS y, x - 1 AS x, b, m, t FROM raster WHERE x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 5")
def crop_center(spark, sf_dir):
    return geometry.crop(raster(spark, sf_dir), geometry.centre_rect(8, 8, 6, 4)).select("image_id", "y", "x", "b", "m", "t")


_PV = [(f"greatest(0.0, least(1.0, s{c} / 9.0 / 4096.0))") for c in "bmt"]


@query(f"""WITH {RASTER_SQL}, bl AS (SELECT image_id, y // 3 AS y, x // 3 AS x, sum(b) AS sb, sum(m) AS sm, sum(t) AS st FROM raster WHERE x < 6 AND y < 6 GROUP BY 1, 2, 3),
c AS (SELECT image_id, y, x, {_mat_sql(mx.XYZ_TO_SRGB, (_PV[0], _PV[1], _PV[2]), ('r', 'g', 'b'), '{}')} FROM bl),
s AS (SELECT image_id, y, x, {', '.join(f'({_SRGB_SQL.format(c)}) * 255.0 AS {c}' for c in 'rgb')} FROM c),
z AS (SELECT *, CASE WHEN greatest(r, g, b) > 255 THEN 255.0 / greatest(r, g, b) ELSE 1.0 END AS k FROM s)
SELECT image_id, y, x, {', '.join(f'CAST(floor(greatest(0.0, {c} * k) + 0.5) AS BIGINT) AS {c}' for c in 'rgb')} FROM z""")
def preview_block(spark, sf_dir):
    return geometry.preview(raster(spark, sf_dir), 8, 8, most=3, white=4096.0)


# Sinks' relational parts.
@query("SELECT vec_id, list_aggregate(list_transform(embedding[1:100], lambda v: format('{:.4f}', CAST(v AS DOUBLE))), 'string_agg', ' ') AS line FROM embeddings")
def matrix_dump_top100(spark, sf_dir):
    from lamina.sinks.text import number_line

    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", number_line(F.col("embedding"), 100, "%.4f").alias("line"))


@query("""WITH t AS (SELECT n_regionkey AS ifd, n_nationkey AS tag, (n_nationkey * 7 % 9 + 1) * 2 AS size FROM nation)
SELECT ifd, tag, size, CAST(CASE WHEN size > 4 THEN 1000 + sum(CASE WHEN size > 4 THEN size ELSE 0 END) OVER (PARTITION BY ifd ORDER BY tag) - size ELSE -1 END AS BIGINT) AS place FROM t""")
def tag_offsets(spark, sf_dir):
    from lamina.sinks.tags import place_values

    t = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").selectExpr("n_regionkey as ifd", "n_nationkey as tag", "(n_nationkey * 7 % 9 + 1) * 2 as size")
    return place_values(t, 1000).withColumn("place", F.coalesce("place", F.lit(-1).cast("long")))


@query("SELECT p_partkey, n AS num, d AS den FROM (SELECT p_partkey, CAST(p_size AS BIGINT) // gcd(CAST(p_size AS BIGINT), 8) AS n, 8 // gcd(CAST(p_size AS BIGINT), 8) AS d FROM part)")
def rational(spark, sf_dir):
    from lamina.sinks.tags import to_rational

    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", to_rational(F.col("p_size") / 8.0, 1000).alias("r")).select("p_partkey", "r.*")


@query("SELECT y // 32 AS strip, count(*) * 6 AS bytes FROM (SELECT event_id // 100 AS y FROM events) GROUP BY 1")
def strip_bytes(spark, sf_dir):
    from lamina.sinks.tags import strip_sizes

    return strip_sizes(stream(spark, sf_dir), 32, 6)
