"""Queries over containers that are written from the provided tables in memory, and SQL for what must be read back.

Each image of the derived raster becomes one container, with values a quarter of the raster's. Versions, section names and
metadata codecs vary with the image's number; every number in the SQL is written out by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import matrix as mx
from lamina.operators import gain, metadata
from lamina.plans import convert
from lamina.session import ship
from lamina.sinks import container as writer
from lamina.sources import container
from lamina.sources.batches import arrow_schema, batches, tuples
from lamina.sources.derived import RASTER_SQL, planes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_VERSIONS = ((2 << 16) | 1, (2 << 16) | 3, 3 << 16, 4 << 16)


def query(sql: str, **types: str):
    """Register a query with its SQL; ``types`` are those of columns that DuckDB would make narrower or decimal."""
    if types:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"

    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def _metadata(i: int) -> bytes:
    """The metadata entries of image ``i``."""
    w = writer
    out = w.text_entry("Note", f"image {i}")
    out += w.list_entry("WhiteBalanceGains", [("Auto", "GainA"), ("Sunlight", "GainS")])
    out += w.list_entry("WhiteBalanceColorCorrections", [("Auto", "Corr")]) if i % 3 else b""
    out += w.matrix_entry("GainA", 3, [3], [1 + i % 8 / 8, 1.0, 0.5], "<f4") + w.matrix_entry("GainS", 3, [3], [0.25, i % 4, 2.0], "<f4")
    out += w.matrix_entry("Corr", 3, [3, 3], [1, 0, 0.5, 0, 1, 0, i % 2, 0, 1], "<f4")
    out += w.matrix_entry("TempGainFact", 3, [3], [1.5, 1.0, 2.0], "<f4") if i % 2 == 0 else b""
    out += w.matrix_entry("ImageDepth", 1, [1], [10 + i % 4], "<u4") if i % 4 != 1 else b""
    out += w.matrix_entry("SaturationLevel", 1, [3], [4000 + i % 9, 4001, 4002], "<u4") + w.matrix_entry("RawSaturationLevel", 1, [3], [3000 + i % 9, 3001, 3002], "<u4")
    out += w.matrix_entry("CAMERAID", 1, [1], [76 + i % 9], "<u4") + (w.matrix_entry("WhiteBalance", 1, [1], [i % 14], "<u4") if i % 6 else b"")
    out += w.matrix_entry("ActiveImageArea", 2, [4], [1, i % 3, 6, 7], "<u4") + w.matrix_entry("Grid", 0, [2, 3], [-(i % 50), 1, 2, 3, 4, 5], "<i2")
    out += w.matrix_entry("CaptureShutter", 3, [1], [i % 5 * 25.0], "<f4") + w.matrix_entry("CaptureAperture", 3, [1], [4 + i % 3 / 4], "<f4")
    return out + w.matrix_entry("CaptureISO", 3, [1], [100 * (i % 7) + 0.5], "<f4")


def _image(kind: str, b: np.ndarray, m: np.ndarray, t: np.ndarray) -> bytes:
    if kind == "true":
        return writer.true_section([b, m, t])
    if kind == "quattro":
        return writer.true_section([b, m, np.kron(t, np.ones((2, 2), int))], fmt=0x23, image=(16, 16))
    if kind == "binned":
        wide = [np.hstack([p, p[:, :2]]) for p in (b, m, t)]
        return writer.true_section(wide, fmt=0x25, image=(8, 8))
    return (writer.legacy_section if kind == "legacy" else writer.packed_section)(np.stack([b, m, t], axis=2) // 4)


def files(spark: SparkSession, sf_dir: str, kind: str = "true") -> DataFrame:
    """(path, content): one container for each image of the raster."""
    ship(spark)

    kinds = arrow_schema("path string, content binary")

    def all_rows(given: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for i, *layers in tuples(given):
            b, m, t = (np.array(v, int).reshape(8, 8) // 4 for v in layers)
            properties = writer.property_section([("CAMMODEL", f"M{i} DP2" if i % 5 == 0 else f"M{i}"), ("CAMSERIAL", str(1000 + i)), ("PLACE", f"Größe {i}")])
            thumb = b"SECi" + np.array([0x20000, 2, 0x12, 30 + i % 4, 20, 0], "<u4").tobytes() + f"jpeg{i}".encode()
            sections = [(b"PROP" if i % 2 else b"SECp", properties), (b"SECi", thumb), (b"IMA2" if i % 3 == 1 else b"SECi", _image(kind, b, m, t))]
            sections.append((b"CAMF" if i % 5 == 0 else b"SECc", writer.metadata_section(_metadata(i), (2, 4, 5)[i % 3])))
            yield f"image-{i}", writer.container(sections, _VERSIONS[i % 4], (64 + i % 10, 48 + i % 7), ("Sunlight", "Shadow", "")[i % 3])

    images = planes(spark, sf_dir).select("image_id", "b", "m", "t")
    return images.mapInArrow(lambda given: batches(all_rows(given), kinds), "path string, content binary")


_IMG = f"{RASTER_SQL}, img AS (SELECT DISTINCT image_id AS i, 'image-' || image_id AS path FROM raster)"


@query(f"""WITH {_IMG} SELECT path, [131073, 131075, 196608, 262144][i % 4 + 1] AS version, CASE WHEN i % 4 < 3 THEN 64 + i % 10 END AS columns, CASE WHEN i % 4 < 3 THEN 48 + i % 7 END AS rows,
CASE WHEN i % 4 < 3 THEN 90 END AS rotation, CASE WHEN i % 4 < 3 THEN ['Sunlight', 'Shadow', ''][i % 3 + 1] END AS white_balance, CASE WHEN i % 4 IN (1, 2) THEN 'Std' END AS color_mode,
CASE i % 4 WHEN 0 THEN 32 WHEN 1 THEN 32 WHEN 2 THEN 64 END AS extended, CASE WHEN i % 4 < 3 THEN 7.0 END AS seventh FROM img""", version="BIGINT", rotation="BIGINT", seventh="DOUBLE")
def container_headers(spark, sf_dir):
    h = container.headers(files(spark, sf_dir))
    return h.select("path", "version", "columns", "rows", "rotation", "white_balance", "color_mode", F.size("ext_data").alias("n"), F.get("ext_data", F.lit(7)).cast("double").alias("seventh")).select(
        "path", "version", "columns", "rows", "rotation", "white_balance", "color_mode", F.when(F.col("n") > 0, F.col("n")).alias("extended"), "seventh"
    )


_TYPES = "CASE WHEN i % 2 = 1 THEN 'PROP' ELSE 'SECp' END, 'SECi', CASE WHEN i % 3 = 1 THEN 'IMA2' ELSE 'SECi' END, CASE WHEN i % 5 = 0 THEN 'CAMF' ELSE 'SECc' END"


@query(f"WITH {_IMG} SELECT path, k AS idx, list_value({_TYPES})[k + 1] AS type FROM img, range(4) r(k)")
def container_sections(spark, sf_dir):
    return container.sections(files(spark, sf_dir)).select("path", F.col("idx").cast("long").alias("idx"), "type")


@query(f"WITH {_IMG} SELECT path, CASE WHEN i % 5 = 0 THEN 3 END AS camf, CASE WHEN i % 2 = 1 THEN 0 END AS prop, 1 AS image FROM img")
def container_first_section(spark, sf_dir):
    s = container.sections(files(spark, sf_dir))
    of = lambda name, *types: container.first_section(s, *types).select("path", F.col("idx").alias(name))
    return of("image", "SECi", "IMA2", "IMAG").join(of("camf", "CAMF"), "path", "left").join(of("prop", "PROP"), "path", "left")


@query(f"""WITH {_IMG} SELECT path, k AS idx, ['CAMMODEL', 'CAMSERIAL', 'PLACE'][k + 1] AS name,
list_value('M' || i || CASE WHEN i % 5 = 0 THEN ' DP2' ELSE '' END, CAST(1000 + i AS VARCHAR), 'Größe ' || i)[k + 1] AS value FROM img, range(3) r(k)""")
def container_properties(spark, sf_dir):
    return container.property_rows(files(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {_IMG} SELECT path, 1 AS idx, 'jpeg' AS kind, 30 + i % 4 AS columns, 20 AS rows, 'jpeg' || i AS data FROM img")
def container_thumbnails(spark, sf_dir):
    return container.thumbnails(files(spark, sf_dir)).select("path", "idx", "kind", F.col("columns").cast("long").alias("columns"), "rows", F.decode("data", "UTF-8").alias("data"))


@query(f"WITH {_IMG} SELECT path, 'Note' AS name, 'image ' || i AS text FROM img")
def metadata_texts(spark, sf_dir):
    return container.metadata_rows(files(spark, sf_dir)).where("kind = 'text'").select("path", "name", "text")


@query(f"""WITH {_IMG} SELECT path, 'WhiteBalanceGains' AS list, k AS pos, ['Auto', 'Sunlight'][k + 1] AS name, ['GainA', 'GainS'][k + 1] AS value FROM img, range(2) r(k)
UNION ALL SELECT path, 'WhiteBalanceColorCorrections', 0, 'Auto', 'Corr' FROM img WHERE i % 3 <> 0""")
def metadata_lists(spark, sf_dir):
    items = metadata.list_items(container.metadata_rows(files(spark, sf_dir)))
    return items.select("path", "list", F.col("pos").cast("long").alias("pos"), "name", "value")


@query(f"""WITH {_IMG} SELECT path, 'Grid' AS name, '2x3' AS sizes, 15 - i % 50 AS whole, CAST(NULL AS DOUBLE) AS real FROM img
UNION ALL SELECT path, 'Corr', '3x3', NULL, 3.5 + i % 2 FROM img UNION ALL SELECT path, 'GainS', '3', NULL, 2.25 + i % 4 FROM img
UNION ALL SELECT path, 'ActiveImageArea', '4', 14 + i % 3, NULL FROM img""")
def metadata_matrices(spark, sf_dir):
    e = container.metadata_rows(files(spark, sf_dir)).where("kind = 'matrix' and name in ('Grid', 'Corr', 'GainS', 'ActiveImageArea')")
    total = lambda c, zero: F.when(F.size(c) > 0, F.aggregate(c, F.lit(zero), lambda a, x: a + x))
    sizes = F.array_join(F.transform("dims", lambda d: d["size"].cast("string")), "x")
    whole = F.aggregate("i64", F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("path", "name", sizes.alias("sizes"), F.when(F.col("i64").isNotNull(), whole).alias("whole"), total(F.col("f64"), 0.0).alias("real"))


_PIXELS = "SELECT 'image-' || image_id AS path, y, x, {} FROM raster"
_QUARTER = ", ".join(f"{c} // 4 AS {c}" for c in "bmt")
_SIXTEENTH = ", ".join(f"{c} // 4 // 4 AS {c}" for c in "bmt")


def _decoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return container.strips_to_pixels(container.decode_strips(container.plane_rows(files(spark, sf_dir, kind))))


@query(f"WITH {RASTER_SQL} {_PIXELS.format(_QUARTER)}")
def decode_true(spark, sf_dir):
    """Three coded planes of one size."""
    return _decoded(spark, sf_dir, "true")


@query(f"WITH {RASTER_SQL} {_PIXELS.format('b // 4 AS b, m // 4 AS m, 0 AS t')}", t="BIGINT")
def decode_quattro(spark, sf_dir):
    """The two planes of half the size; the third stays apart."""
    return _decoded(spark, sf_dir, "quattro")


@query(f"WITH {RASTER_SQL} SELECT 'image-' || image_id AS path, y * 2 + j AS y, x * 2 + k AS x, t // 4 AS v FROM raster, range(2) a(j), range(2) c(k)")
def decode_quattro_top(spark, sf_dir):
    return container.top_pixels(container.decode_strips(container.plane_rows(files(spark, sf_dir, "quattro"))))


@query(f"WITH {RASTER_SQL} {_PIXELS.format(_QUARTER)}")
def decode_binned(spark, sf_dir):
    """Planes with surplus columns, which go."""
    return _decoded(spark, sf_dir, "binned")


@query(f"WITH {RASTER_SQL} {_PIXELS.format(_SIXTEENTH)}")
def decode_legacy(spark, sf_dir):
    """Mapped differences by row, with a table of row offsets."""
    return _decoded(spark, sf_dir, "legacy")


@query(f"WITH {RASTER_SQL} {_PIXELS.format(_SIXTEENTH)}")
def decode_packed(spark, sf_dir):
    """Three ten-bit differences in each word."""
    return _decoded(spark, sf_dir, "packed")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.metadata_rows(files(spark, sf_dir))


@query(f"WITH {_IMG} SELECT path, CAST(1000 + i AS VARCHAR) AS value FROM img")
def property_lookup(spark, sf_dir):
    return metadata.property_named(container.property_rows(files(spark, sf_dir)), "MISSING", "CAMSERIAL")


@query(f"WITH {_IMG} SELECT path, 'GainS' AS value FROM img")
def list_lookup(spark, sf_dir):
    return metadata.list_property(_entries(spark, sf_dir), "WhiteBalanceGains", "Sunlight")


@query(f"WITH {_IMG} SELECT path, 10 + i % 4 AS value FROM img WHERE i % 4 <> 1")
def scalar_lookup(spark, sf_dir):
    """One element of the whole-number type; the real type or a vector would give no row."""
    e = _entries(spark, sf_dir)
    found = metadata.scalar(e, "ImageDepth")
    return found.unionByName(metadata.scalar(e, "GainA")).unionByName(metadata.scalar(e, "CaptureISO"))


@query(f"WITH {_IMG} SELECT path, 1.0 + i % 8 / 8.0 AS v0, 1.0 AS v1, 0.5 AS v2 FROM img", v1="DOUBLE", v2="DOUBLE")
def vector_lookup(spark, sf_dir):
    v = metadata.vector(_entries(spark, sf_dir), "GainA", 3)
    return v.select("path", *[F.get("value", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query(f"WITH {_IMG} SELECT path, 1 AS x0, i % 3 AS y0, 6 AS x1, 7 AS y1 FROM img", x0="BIGINT", x1="BIGINT", y1="BIGINT")
def rect_lookup(spark, sf_dir):
    v = metadata.rect(_entries(spark, sf_dir), "ActiveImageArea")
    return v.select("path", *[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"WITH {_IMG} SELECT path, -(i % 50) AS first, 5 AS last FROM img", last="BIGINT")
def matrix_lookup(spark, sf_dir):
    """A matrix of two known sides; another expectation gives no row."""
    e = _entries(spark, sf_dir)
    found = metadata.matrix_sized(e, "Grid", [2, 3]).unionByName(metadata.matrix_sized(e, "Grid", [3, 2]))
    return found.select("path", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(5)).alias("last"))


@query(f"WITH {_IMG} SELECT path, 0.25 AS v0, CAST(i % 4 AS DOUBLE) AS v1, 2.0 AS v2 FROM img", v0="DOUBLE", v2="DOUBLE")
def preset_lookup(spark, sf_dir):
    """A preset's matrix by its list; Daylight, which is missing, means Sunlight."""
    v = metadata.preset_matrix(_entries(spark, sf_dir), "WhiteBalanceGains", "Daylight", [3])
    return v.select("path", *[F.get("value", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query(f"WITH {_IMG} SELECT path, i % 3 <> 0 AS value FROM img")
def engine_test(spark, sf_dir):
    return metadata.is_true_engine(_entries(spark, sf_dir))


@query(f"""WITH {_IMG} SELECT path, CASE WHEN i % 4 = 0 THEN 1023 WHEN i % 4 = 2 THEN 4095 WHEN i % 4 = 3 THEN 8191 WHEN i % 3 <> 0 THEN 3000 + i % 9 ELSE 4000 + i % 9 END AS v0,
CASE WHEN i % 4 = 0 THEN 1023 WHEN i % 4 = 2 THEN 4095 WHEN i % 4 = 3 THEN 8191 WHEN i % 3 <> 0 THEN 3002 ELSE 4002 END AS v2 FROM img""", v2="BIGINT")
def max_raw_lookup(spark, sf_dir):
    return metadata.max_raw(_entries(spark, sf_dir)).select("path", F.get("value", F.lit(0)).alias("v0"), F.get("value", F.lit(2)).alias("v2"))


@query(f"WITH {_IMG} SELECT path, (1.0 + i % 8 / 8.0) * CASE WHEN i % 2 = 0 THEN 1.5 ELSE 1.0 END AS v0, 1.0 AS v1, CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.5 END AS v2 FROM img", v1="DOUBLE", v2="DOUBLE")
def gain_lookup(spark, sf_dir):
    """A preset's gains times the factors that are there."""
    v = metadata.white_balance_gain(_entries(spark, sf_dir), "Auto")
    return v.select("path", *[F.get("value", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query(f"""WITH {_IMG}, k(n, a, b, c) AS (VALUES (0, 0.4124564, 0.3575761, 0.1804375), (1, 0.2126729, 0.7151522, 0.0721750), (2, 0.0193339, 0.1191920, 0.9503041))
SELECT path, n AS row, round(CAST(a AS DOUBLE) + c * (i % 2), 9) AS v0, round(CAST(b AS DOUBLE), 9) AS v1, round(CAST(a AS DOUBLE) * 0.5 + c, 9) AS v2 FROM img, k WHERE i % 3 <> 0""")
def layers_lookup(spark, sf_dir):
    """sRGB's matrix times a preset's colour correction."""
    v = metadata.layers_to_xyz(_entries(spark, sf_dir), "Auto")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), *[F.round(F.get("value", F.lit(3 * r + j)), 9).alias(f"v{j}") for j in range(3)]) for r in range(3)]))
    return v.select("path", rows.alias("r")).select("path", "r.*")


@query(f"""WITH {_IMG} SELECT path, 'M' || i || CASE WHEN i % 5 = 0 THEN ' DP2' ELSE '' END AS model, CAST(1000 + i AS VARCHAR) AS serial,
CASE WHEN i % 6 <> 0 THEN CASE i % 14 WHEN 2 THEN 'Sunlight' WHEN 3 THEN 'Shadow' WHEN 4 THEN 'Overcast' WHEN 5 THEN 'Incandescent' WHEN 6 THEN 'Florescent' WHEN 7 THEN 'Flash' WHEN 8 THEN 'Custom' WHEN 11 THEN 'ColorTemp'
 WHEN 12 THEN 'AutoLSP' ELSE 'Auto' END WHEN i % 4 < 3 AND i % 3 = 0 THEN 'Sunlight' WHEN i % 4 < 3 AND i % 3 = 1 THEN 'Shadow' ELSE 'Auto' END AS preset FROM img""")
def camera_facts(spark, sf_dir):
    f = files(spark, sf_dir)
    found = metadata.camera_info(container.headers(f), container.property_rows(f), container.metadata_rows(f))
    return found.toDF("path", "model", "serial", "preset")


@query(f"WITH {_IMG} SELECT path, CASE WHEN i % 5 > 0 THEN round(1.0 / (i % 5 * 25.0), 9) END AS exposure, 4.0 + i % 3 / 4.0 AS aperture, 100 * (i % 7) AS iso FROM img")
def exposure_facts(spark, sf_dir):
    return metadata.exif_info(_entries(spark, sf_dir)).withColumn("exposure", F.round("exposure", 9))


@query(f"WITH {_IMG} SELECT path, CASE WHEN i % 4 = 3 THEN 'F23' WHEN i % 5 = 0 THEN 'F20' ELSE 'STD' END AS kind FROM img")
def denoise_classes(spark, sf_dir):
    f = files(spark, sf_dir)
    model = metadata.property_named(container.property_rows(f), "CAMMODEL")
    return container.headers(f).join(model, "path").select("path", metadata.denoise_class(F.col("version"), F.col("value")).alias("kind"))


# Algebra: each row of a table makes its matrices, and each function of the library is called on them.
def _algebra(spark: SparkSession, sf_dir: str, fn, names: list[str]) -> DataFrame:
    """(p_partkey, *names): ``fn`` of each part's size and number."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *(round(float(x), 9) for x in fn(k, s))) for k, s in zip(pdf["p_partkey"], pdf["p_size"], strict=True)]
            yield pd.DataFrame(rows, columns=["p_partkey", *names])

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return parts.mapInPandas(run, "p_partkey long, " + ", ".join(f"{n} double" for n in names))


_NINE = [f"v{i}" for i in range(9)]
#: a b c / d e f / g h i of a part, as SQL and as numbers.
_PART = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, 1.0::DOUBLE AS b, 0.5::DOUBLE AS c, (p_partkey % 7)::DOUBLE AS d, 3.0::DOUBLE AS e, 0.25::DOUBLE AS f, 0.75::DOUBLE AS g, (p_partkey % 3)::DOUBLE AS h, 1.5::DOUBLE AS i FROM part"


def _of(key: int, size: int) -> list[float]:
    return [float(size), 1.0, 0.5, float(key % 7), 3.0, 0.25, 0.75, float(key % 3), 1.5]


_DET = "(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))"
_MINORS = ["e * i - f * h", "c * h - b * i", "b * f - c * e", "f * g - d * i", "a * i - c * g", "c * d - a * f", "d * h - e * g", "b * g - a * h", "a * e - b * d"]
_INVERSE = [f"CASE WHEN abs(det) < 1e-10 THEN {1.0 if k % 4 == 0 else 0.0} ELSE ({m}) / det END" for k, m in enumerate(_MINORS)]


@query(f"WITH m AS ({_PART}), d AS (SELECT *, {_DET} AS det FROM m) SELECT p_partkey, {', '.join(f'round({x}, 9) AS v{k}' for k, x in enumerate(_INVERSE))} FROM d")
def inverse3(spark, sf_dir):
    return _algebra(spark, sf_dir, lambda k, s: mx.inverse(_of(k, s)), _NINE)


def _times(left: list[str], right: list[str]) -> list[str]:
    return [" + ".join(f"({left[3 * r + k]}) * ({right[3 * k + c]})" for k in range(3)) for r in range(3) for c in range(3)]


_M, _T = list("abcdefghi"), list("adgbehcfi")


@query(f"WITH m AS ({_PART}) SELECT p_partkey, {', '.join(f'round({x}, 9) AS v{k}' for k, x in enumerate(_times(_M, _T)))} FROM m")
def matmul(spark, sf_dir):
    """A matrix times its transpose."""
    return _algebra(spark, sf_dir, lambda k, s: mx.multiply(_of(k, s), mx.transpose(_of(k, s))), _NINE)


@query(f"WITH m AS ({_PART}) SELECT p_partkey, {', '.join(f'round({x}, 9) AS v{k}' for k, x in enumerate(_times(_M, _T)))} FROM m")
def matmul_columns(spark, sf_dir):
    """The same product as column expressions."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = [F.col("p_size").cast("double"), F.lit(1.0), F.lit(0.5), (F.col("p_partkey") % 7).cast("double"), F.lit(3.0), F.lit(0.25), F.lit(0.75), (F.col("p_partkey") % 3).cast("double"), F.lit(1.5)]
    return p.select("p_partkey", *[F.round(x, 9).alias(f"v{i}") for i, x in enumerate(metadata.product(c, [c[3 * (i % 3) + i // 3] for i in range(9)]))])


@query("SELECT p_partkey, p_size * 2.0 AS v0, 0.0 AS v1, 0.0 AS v2, 0.0 AS v3, 6.0 AS v4, 0.0 AS v5, 0.0 AS v6, 0.0 AS v7, 4.0 AS v8 FROM part", **dict.fromkeys(_NINE, "DOUBLE"))
def matrix_diagonal_scale(spark, sf_dir):
    return _algebra(spark, sf_dir, lambda k, s: mx.scale(mx.diagonal([float(s), 3.0, 2.0]), 2.0), _NINE)


@query(f"""WITH m AS ({_PART}) SELECT p_partkey, a + d AS v0, b + e AS v1, a * d AS v2, c * f AS v3, round(1.0 / a, 9) AS v4, round(1.0 / c, 9) AS v5, least(greatest(a, 2.0), 30.0) AS v6, least(greatest(c, 2.0), 30.0) AS v7 FROM m""")
def vector_algebra(spark, sf_dir):
    """Sum, product, inverses and bounds of components."""

    def run(k, s):
        a, b = _of(k, s)[:3], _of(k, s)[3:6]
        inverse, bounded = mx.invert_components(a), mx.clamp_components(a, 2.0, 30.0)
        return *mx.add(a, b)[:2], mx.component_multiply(a, b)[0], mx.component_multiply(a, b)[2], inverse[0], inverse[2], bounded[0], bounded[2]

    return _algebra(spark, sf_dir, run, [f"v{i}" for i in range(8)])


_WHITE = (0.950456, 1.0, 1.089058)
_NEUTRAL = [" + ".join(f"({_INVERSE[3 * r + k]}) * {w!r}" for k, w in enumerate(_WHITE)) for r in range(3)]


@query(f"WITH m AS ({_PART}), d AS (SELECT *, {_DET} AS det FROM m) SELECT p_partkey, {', '.join(f'round({x}, 8) AS v{k}' for k, x in enumerate(_NEUTRAL))} FROM d")
def raw_neutral(spark, sf_dir):
    """The raw values of a neutral grey, by columns."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = [F.col("p_size").cast("double"), F.lit(1.0), F.lit(0.5), (F.col("p_partkey") % 7).cast("double"), F.lit(3.0), F.lit(0.25), F.lit(0.75), (F.col("p_partkey") % 3).cast("double"), F.lit(1.5)]
    return p.select("p_partkey", *[F.round(x, 8).alias(f"v{i}") for i, x in enumerate(metadata.neutral_of(c))])


@query(f"WITH m AS ({_PART}) SELECT p_partkey, {', '.join(f'round({x}, 9) AS v{k}' for k, x in enumerate(['a * 2', 'b * 0.5', 'c * 4', 'd * 2', 'e * 0.5', 'f * 4', 'g * 2', 'h * 0.5', 'i * 4']))} FROM m")
def raw_to_xyz(spark, sf_dir):
    """Layers to XYZ, times the gains on the diagonal."""
    return _algebra(spark, sf_dir, lambda k, s: mx.raw_to_xyz(_of(k, s), [2.0, 0.5, 4.0]), _NINE)


_BRADFORD = ["1.0478112", "0.0228866", "-0.0501270", "0.0295424", "0.9904844", "-0.0170491", "-0.0092345", "0.0150436", "0.7521316"]


@query(f"WITH m AS ({_PART}) SELECT p_partkey, {', '.join(f'round({x}, 9) AS v{k}' for k, x in enumerate(_times([f'{x}::DOUBLE' for x in _BRADFORD], _M)))} FROM m")
def forward_camera(spark, sf_dir):
    """Layers to XYZ, adapted from one white to the other."""
    return _algebra(spark, sf_dir, lambda k, s: mx.forward_camera(_of(k, s)), _NINE)


@query(f"""WITH m AS ({_PART}) SELECT p_partkey, {', '.join(f"round({w}::DOUBLE * {x}, 9) AS v{3 * r + k}" for r, w in enumerate(("0.96422", "1.0", "0.82521")) for k, x in enumerate(("a", "d", "h")))} FROM m""")
def forward_greyscale(spark, sf_dir):
    """The white on the diagonal, ones, and a mix on the diagonal."""
    return _algebra(spark, sf_dir, lambda k, s: mx.forward_greyscale([float(s), float(k % 7), float(k % 3)]), _NINE)


@query(f"WITH m AS ({_PART}) SELECT p_partkey, round(1.0 / a, 9) AS v0, 0.0 AS v1, 0.0 AS v2, 0.0 AS v3, 0.5 AS v4, 0.0 AS v5, 0.0 AS v6, 0.0 AS v7, 0.25 AS v8 FROM m", **dict.fromkeys(_NINE, "DOUBLE"))
def calibration_matrix(spark, sf_dir):
    return _algebra(spark, sf_dir, lambda k, s: mx.calibration([float(s), 2.0, 4.0]), _NINE)


@query("""SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 1 THEN 2.0413690 WHEN 2 THEN 1.0 WHEN 3 THEN 1.403215197 ELSE 3.2404542 END AS DOUBLE) AS first,
CAST(CASE p_partkey % 5 WHEN 2 THEN 1.0 WHEN 3 THEN 1.8 ELSE 2.2 END AS DOUBLE) AS gamma FROM part""")
def colour_spaces(spark, sf_dir):
    """The matrix from XYZ and the gamma of a named space; unknown names mean sRGB."""
    names = ["sRGB", "AdobeRGB", "none", "ProPhotoRGB", "other"]
    return _algebra(spark, sf_dir, lambda k, s: (mx.xyz_to_space(names[k % 5])[0], mx.GAMMAS[mx.space_name(names[k % 5])]), ["first", "gamma"])


# Whole files' calibration, the top plane's map, spatial gain.
_GAIN0 = "(1.0 + i % 8 / 8.0) * CASE WHEN i % 2 = 0 THEN 1.5 ELSE 1.0 END"
_MAX0 = "CASE WHEN i % 4 = 0 THEN 1023 WHEN i % 4 = 2 THEN 4095 WHEN i % 4 = 3 THEN 8191 WHEN i % 3 <> 0 THEN 3000 + i % 9 ELSE 4000 + i % 9 END"


@query(f"""WITH {_IMG} SELECT path, 'true' AS layout, 8 AS width, 8 AS height, CASE WHEN i % 4 < 3 THEN 64 + i % 10 END AS header_columns, {_GAIN0} AS gain0, {_MAX0} AS max0,
CASE WHEN i % 3 <> 0 THEN round(0.4124564::DOUBLE + 0.1804375::DOUBLE * (i % 2), 9) ELSE 0.4124564::DOUBLE END AS layer0, CASE WHEN i % 4 = 3 THEN 'F23' WHEN i % 5 = 0 THEN 'F20' ELSE 'STD' END AS kind FROM img""", width="BIGINT", height="BIGINT")
def file_calibrations(spark, sf_dir):
    """One row a file, all lookups in one pass; what is missing takes the fallback."""
    first = lambda c: F.get(c, F.lit(0))
    return convert.calibrations(files(spark, sf_dir)).select(
        F.col("image_id").alias("path"), "layout", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "header_columns",
        first("gain").alias("gain0"), first("max_raw").alias("max0"), F.round(first("layers"), 9).alias("layer0"), F.col("denoise_class").alias("kind"),
    )


@query(f"""WITH {RASTER_SQL}, s AS (SELECT DISTINCT image_id FROM raster), g AS (SELECT image_id, y, x FROM s, range(9) a(y), range(10) b(x))
SELECT g.image_id, g.y, g.x, coalesce(t, 0) AS r, coalesce(t, 0) AS g, coalesce(t, 0) AS b FROM g LEFT JOIN raster USING (image_id, y, x)""")
def top_plane_map(spark, sf_dir):
    """A plane as grey, black where the image is larger than it."""
    whole = planes(spark, sf_dir)
    top = whole.select("image_id", F.posexplode("t").alias("at", "v")).select("image_id", F.expr("cast(at div 8 as bigint)").alias("y"), (F.col("at") % 8).cast("long").alias("x"), "v")
    return convert.top_map(top, whole.select("image_id", F.lit(10).alias("width"), F.lit(9).alias("height")))


@query("SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 10.0 + event_id % 50 ELSE 1.0 / (1.0 / (10.0 + event_id % 50) - 1.0 / (1000.0 + event_id % 500)) END, 9) AS place FROM events", place="DOUBLE")
def lens_place(spark, sf_dir):
    """The image distance of a thin lens, the focal length at infinity."""
    e = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return events.select("event_id", F.round(gain.lens_position(10.0 + e % 50, F.when(e % 7 != 0, 1000.0 + e % 500)), 9).alias("place"))


_LISTS = "CASE s_suppkey % 4 WHEN 0 THEN 'SpatialGainsProps_' || s_suppkey % 5 || '_INF' WHEN 1 THEN 'SpatialGainsProps_' || s_suppkey % 5 || '_MOD' WHEN 2 THEN 'SpatialGainsProps_5.6_3' || s_suppkey % 5 || '.5' ELSE 'Other_' || s_suppkey END"


@query(f"""WITH n AS (SELECT s_suppkey AS k, {_LISTS} AS name FROM supplier)
SELECT name AS block, round(1.0 / CASE WHEN k % 4 = 2 THEN 5.6 ELSE [2.0, 2.8, 4.0, 8.0][k % 5 + 1] END, 9) AS bx,
round(CASE k % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 1.0 / (1.0 / 30.0 - 1.0 / 280.0) ELSE 30.5 + k % 5 END, 9) AS b_y FROM n WHERE k % 4 = 2 OR (k % 4 < 2 AND k % 5 < 4)""", bx="DOUBLE", b_y="DOUBLE")
def gain_block_places(spark, sf_dir):
    """Where calibration blocks lie, by the names of their lists; other lists and unknown stops give none."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr(_LISTS).alias("name"))
    found = gain.block_places(names, F.lit(30.0), F.lit(280.0), [2.0, 2.8, 4.0, 8.0])
    return found.select("block", F.round("bx", 9).alias("bx"), F.round("by", 9).alias("b_y"))


@query("""WITH s AS (SELECT s_suppkey % 20 AS path, s_suppkey AS k FROM supplier), t AS (SELECT path, k, CASE WHEN path % 4 = 0 THEN 0 WHEN path % 3 = 0 THEN 1 ELSE 2 END AS first FROM s)
SELECT path, k % 3 AS channel, k AS r, 0 AS c, CAST(first * 1000 + k AS DOUBLE) AS gain FROM t""", c="BIGINT")
def gain_sources(spark, sf_dir):
    """The first of three sources that a file has."""
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((k % 20).alias("path"), k)
    of = lambda d, i: d.select("path", (k % 3).alias("channel"), k.alias("r"), F.lit(0).cast("long").alias("c"), (k + 1000 * i).cast("double").alias("gain"))
    return gain.gain_source(of(s.where("path % 4 = 0"), 0), of(s.where("path % 3 = 0"), 1), of(s, 2))
