"""Text sinks: metadata dumps and plain pixel maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_line(values: Column, most: int, pattern: str) -> Column:
    """The first ``most`` values, formatted and joined by a space."""
    return F.concat_ws(" ", F.transform(F.slice(values, 1, most), lambda v: F.format_string(pattern, v.cast("double"))))


def metadata_lines(header: DataFrame, entries: DataFrame, properties: DataFrame, most: int = 100) -> DataFrame:
    """(path, part, idx, line): header, then entries by kind, then properties, each between BEGIN and END lines.

    A matrix shows its first ``most`` elements and says how many more there are.
    """
    head = header.select("path", F.lit(1).alias("part"), F.lit(0).alias("idx"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("sub"), F.format_string(f"{n}: %s", F.coalesce(F.col(n).cast("string"), F.lit(""))).alias("line")) for i, n in enumerate(("identifier", "version", "columns", "rows", "rotation", "white_balance"))])))
    n = F.coalesce(F.size("f64"), F.size("i64"))
    shown = F.coalesce(number_line(F.col("f64"), most, "%g"), number_line(F.col("i64"), most, "%.0f"))
    more = F.when(n > most, F.format_string(" ... (%d more)", n - most)).otherwise("")
    body = (
        F.when(F.col("kind") == "text", F.col("text"))
        .when(F.col("kind") == "props", F.concat_ws("; ", F.transform("props", lambda p: F.concat(p["name"], F.lit(" = "), p["value"]))))
        .otherwise(F.concat(F.lit("["), F.concat_ws(",", F.transform("dims", lambda d: d["size"].cast("string"))), F.lit("] "), shown, more))
    )
    items = entries.select("path", F.lit(2).alias("part"), "idx", F.lit(0).alias("sub"), F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.coalesce(body, F.lit(""))).alias("line"))
    props = properties.select("path", F.lit(3).alias("part"), "idx", F.lit(0).alias("sub"), F.concat(F.col("name"), F.lit(" = "), F.col("value")).alias("line"))
    rows = head.unionByName(items).unionByName(props)
    marks = header.select("path", F.inline(F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(i).alias("idx"), F.lit(0).alias("sub"), F.lit(f"{w} {s}").alias("line")) for p, s in ((1, "header"), (2, "entries"), (3, "properties")) for i, w in ((-1, "BEGIN"), (1 << 30, "END"))])))
    return rows.unionByName(marks)


def pixel_lines(pixels: DataFrame, values: tuple[str, str, str] = ("b", "m", "t"), group: str = "image_id") -> DataFrame:
    """(image, y, x, line): one line a pixel, as plain pixel maps have it."""
    return pixels.select(group, "y", "x", F.format_string("%d %d %d ", *[F.col(v) for v in values]).alias("line"))


def write_pixel_map(pixels: DataFrame, path: str, width: int, height: int, values: tuple[str, str, str] = ("b", "m", "t")) -> None:
    """One image as a plain pixel map (P3): header lines, then rows in order, in as many part files as partitions."""
    spark = pixels.sparkSession
    lines = pixels.withColumn("image_id", F.lit(0)) if "image_id" not in pixels.columns else pixels
    head = spark.createDataFrame([(-3, "P3"), (-2, f"{width} {height}"), (-1, "65535")], "pos long, line string")
    body = pixel_lines(lines, values).select((F.col("y") * width + F.col("x")).alias("pos"), "line")
    head.unionByName(body).orderBy("pos").select("line").write.mode("overwrite").text(path)
