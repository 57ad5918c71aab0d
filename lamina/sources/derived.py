"""Rasters and difference streams derived from the provided tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, b, m, t: three consecutive vectors of 64 values make the three layers of an 8x8 image, as arrays."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    level = F.transform("embedding", lambda e: F.greatest(F.lit(0).cast("long"), F.floor(e.cast("double") * 4096) + 2200))
    rows = v.select(F.expr("vec_id div 3").alias("image_id"), (F.col("vec_id") % 3).alias("c"), level.alias("v"))
    layer = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    whole = rows.groupBy("image_id").agg(layer(0).alias("b"), layer(1).alias("m"), layer(2).alias("t"))
    return whole.where("b is not null and m is not null and t is not null")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, b, m, t: the images' pixels. The layers meet as arrays and become pixels after the shuffle."""
    pixels = planes(spark, sf_dir).select("image_id", F.posexplode(F.arrays_zip("b", "m", "t")).alias("pos", "p"))
    return pixels.select("image_id", F.expr("pos div 8").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), "p.b", "p.m", "p.t")


RASTER_SQL = """raster AS (
  SELECT image_id, pos // 8 AS y, pos % 8 AS x, max(v) FILTER (c = 0) AS b, max(v) FILTER (c = 1) AS m, max(v) FILTER (c = 2) AS t
  FROM (SELECT vec_id // 3 AS image_id, vec_id % 3 AS c, pos,
               greatest(0, CAST(floor(CAST(e AS DOUBLE) * 4096) AS BIGINT) + 2200) AS v
        FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))
  GROUP BY 1, 2, 3 HAVING count(*) = 3)"""


def stream(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """event_id, y, x, diff: the events as a grid of small differences."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return e.select("event_id", F.expr(f"event_id div {width}").alias("y"), (F.col("event_id") % width).alias("x"), (F.floor(F.col("value") * 100) % 41 - 20).alias("diff"))


STREAM_SQL = """stream AS (
  SELECT event_id, event_id // 100 AS y, event_id % 100 AS x, CAST(floor(value * 100) AS BIGINT) % 41 - 20 AS diff FROM events)"""
