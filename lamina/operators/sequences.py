"""Sequential decoders restated as windowed running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.pixel import WHITE16, wrap16


def rows_sum(diffs: DataFrame, keys: list[str], order: str = "x", diff: str = "diff", start: int = 0, register16: bool = True) -> DataFrame:
    """Running sum of each row, from ``start``, as ``value``; negative values show as 0 but are carried on.

    With ``register16`` the running value wraps as a signed 16-bit register does.
    """
    total = F.sum(diff).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + start
    return diffs.withColumn("value", F.greatest(F.lit(0).cast("long"), wrap16(total) if register16 else total))


def phases_sum(diffs: DataFrame, seed: Column | int, group: list[str], diff: str = "diff", clamp: bool = True) -> DataFrame:
    """2x2-phase prediction: the first two columns continue the row two above, later ones the column two to the left.

    Two running sums, one down the first two columns and one along each row, so rows are independent after the first.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    up = Window.partitionBy(*group, F.col("y") % 2, F.col("x")).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    heads = diffs.where("x < 2").withColumn("_head", seed + F.sum(diff).over(up)).select(*group, "y", F.col("x").alias("_phase"), "_head")
    along = Window.partitionBy(*group, "y", F.col("x") % 2).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = diffs.withColumn("_run", F.sum(F.when(F.col("x") >= 2, F.col(diff)).otherwise(0)).over(along)).withColumn("_phase", F.col("x") % 2)
    value = F.col("_head") + F.col("_run")
    done = F.greatest(F.lit(0).cast("long"), value) if clamp else value
    return run.join(heads, [*group, "y", "_phase"]).withColumn("value", done).drop("_run", "_head", "_phase")


def bytes_sum(diffs: DataFrame, group: list[str], order: str, seed: int = 0, diff: str = "diff") -> DataFrame:
    """Low byte of the running sum from a seed."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return diffs.withColumn("value", (F.sum(diff).over(w) + seed).bitwiseAND(F.lit(255).cast("long")))


def chunked_sum(diffs: DataFrame, order: str, chunk: int, diff: str = "diff", name: str = "total") -> DataFrame:
    """Running sum over one long stream, in chunks: sums inside chunks, then the sums of the chunks before.

    No task sees more than ``chunk`` rows of the stream; the table of chunk sums is ``chunk`` times smaller.
    """
    part = diffs.withColumn("_chunk", F.expr(f"{order} div {chunk}"))
    inner = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = part.groupBy("_chunk").agg(F.sum(diff).alias("_sum"))
    before = sums.select("_chunk", (F.sum("_sum").over(Window.orderBy("_chunk")) - F.col("_sum")).alias("_before"))
    return part.withColumn("_own", F.sum(diff).over(inner)).join(before, "_chunk").withColumn(name, F.col("_own") + F.col("_before")).drop("_chunk", "_own", "_before")


def auto_offset(values: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Shift each image so that its least value is 0, if it has negative ones."""
    low = values.groupBy(*group).agg(F.least(F.min(value), F.lit(0).cast("long")).alias("_low"))
    return values.join(low, group).withColumn(value, F.col(value) - F.col("_low")).drop("_low")


def unpack_fields(word: Column, bits: int) -> list[Column]:
    """Three fields of ``bits`` bits from a packed word, lowest first."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.shiftright(word.cast("long"), c * bits).bitwiseAND(mask) for c in range(3)]


def pack12(even: Column, odd: Column) -> list[Column]:
    """Two 12-bit values as three bytes."""
    byte = lambda v: v.bitwiseAND(F.lit(255).cast("long"))
    low = byte(F.shiftleft(even.cast("long"), 4)).bitwiseAND(F.lit(240).cast("long"))
    return [byte(F.shiftright(even.cast("long"), 4)), low + F.shiftright(odd.cast("long"), 8).bitwiseAND(F.lit(15).cast("long")), byte(odd.cast("long"))]


def key_stream(key: int, n: int) -> list[int]:
    """The first ``n`` masks of the linear congruential stream that hides metadata of kind 2."""
    out = []
    for _ in range(n):
        key = (key * 1597 + 51749) % 244944
        t = (key * 301593171 >> 24) & 0xFFFFFFFF
        out.append((((((key << 8) - t) & 0xFFFFFFFF) >> 1) + t & 0xFFFFFFFF) >> 17 & 255)
    return out


def xor_stream(rows: DataFrame, order: str, byte: str, key: int, n: int) -> DataFrame:
    """Unhide ``n`` bytes at places 0..n-1; the stream's masks are a table of ``n`` rows."""
    masks = rows.sparkSession.createDataFrame(list(enumerate(key_stream(key, n))), f"{order} long, _mask long")
    return rows.join(masks, order).withColumn(byte, F.col(byte).bitwiseXOR(F.col("_mask"))).drop("_mask")


def clamp_top(v: Column) -> Column:
    return F.least(v, F.lit(WHITE16).cast("long"))
