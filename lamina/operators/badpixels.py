"""Bad pixels: six sources, one ordered union without duplicates, and inpainting."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Focus grids of two cameras, for three colours and one: (first, last, pitch, size) of columns, then rows.
FOCUS_GRIDS = {(15, 1): ((217, 5641, 16, 1), (464, 3312, 32, 2)), (15, 3): ((108, 2820, 8, 1), (232, 1656, 16, 1)), (16, 1): ((233, 6425, 16, 1), (592, 3888, 32, 2)), (16, 3): ((116, 2820, 8, 1), (296, 1944, 16, 1))}
PRIORITY = ["packed", "f20", "clusters", "highlight", "f23", "focus"]


def unpack_packed(values: DataFrame, keep_x: int, keep_y: int) -> DataFrame:
    """(pos, y, x) from words with the column in bits 8 to 19 and the row in 20 to 31, relative to the kept area."""
    v = F.col("value").cast("long")
    return values.select("pos", (F.shiftright(v, 20).bitwiseAND(F.lit(4095).cast("long")) - keep_y).alias("y"), (F.shiftright(v, 8).bitwiseAND(F.lit(4095).cast("long")) - keep_x).alias("x"))


def unpack_triples(values: DataFrame) -> DataFrame:
    """(pos, y, x) from a matrix of three columns, row first; the firmware has them swapped."""
    cells = values.groupBy(F.expr("pos div 3").alias("pos"))
    return cells.agg(F.max(F.when(F.col("pos") % 3 == 0, F.col("value"))).alias("y"), F.max(F.when(F.col("pos") % 3 == 1, F.col("value"))).alias("x"))


def lattice(spark, xs: tuple[int, int, int], ys: tuple[int, int, int], size: tuple[int, int] = (1, 1)) -> DataFrame:
    """(pos, y, x) of a grid: (first, last, pitch) of each axis, and a block at each node, in row order."""
    side = lambda t: F.sequence(F.lit(t[0]), F.lit(t[1]), F.lit(t[2])) if t[0] <= t[1] else F.array().cast("array<int>")
    nodes = spark.range(1).select(F.explode(side(ys)).alias("y")).select("y", F.explode(side(xs)).alias("x"))
    nodes = nodes.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(size[1] - 1))).alias("r")).select("y", "x", "r", F.explode(F.sequence(F.lit(0), F.lit(size[0] - 1))).alias("c"))
    far = 1 << 20
    pos = ((F.col("y").cast("long") * far + F.col("x")) * size[1] + F.col("r")) * size[0] + F.col("c")
    return nodes.select(pos.alias("pos"), (F.col("y") + F.col("r")).cast("long").alias("y"), (F.col("x") + F.col("c")).cast("long").alias("x"))


def highlight_grid(spark, start: tuple[int, int], pitch: tuple[int, int], width: int, height: int) -> DataFrame:
    return lattice(spark, (start[0], width - 1, pitch[0]), (start[1], height - 1, pitch[1]))


def focus_grid(spark, camera: int, colours: int) -> DataFrame | None:
    g = FOCUS_GRIDS.get((camera, 1 if colours == 1 else 3))
    return g and lattice(spark, g[0][:3], g[1][:3], (g[0][3], g[1][3]))


def row_marked(values: DataFrame, group: list[str]) -> DataFrame:
    """(group, pos, y, x) from streams of: row, columns..., 0. A zero in a row's place is row 0.

    ``values`` has (group, pos, value). One array a stream and one ordered fold, which carries the current row.
    """
    whole = values.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    start = F.struct(F.lit(-1).cast("long").alias("row"), F.array().cast("array<struct<pos:bigint,y:bigint,x:bigint>>").alias("out"))

    def step(acc, e):
        v = e["value"].cast("long")
        hit = F.array(F.struct(e["pos"].cast("long").alias("pos"), acc["row"].alias("y"), v.alias("x")))
        row = F.when(acc["row"] == -1, v).when(v == 0, F.lit(-1).cast("long")).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when((acc["row"] != -1) & (v != 0), F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return whole.select(*group, F.inline(F.aggregate("s", start, step)["out"]))


def tagged(source: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.lit(PRIORITY.index(source) if source in PRIORITY else 99).alias("priority"), F.col("pos").cast("long").alias("pos"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


def _ranked(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def union_first(sources: list[DataFrame], width: int, height: int) -> DataFrame:
    """(y, x, source): places inside the image, each with the first source that names it. Hash aggregate, no window."""
    rows = _ranked(sources).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return rows.groupBy("y", "x").agg(F.min_by("source", F.struct("priority", "pos")).alias("source"))


def source_counts(sources: list[DataFrame], width: int, height: int) -> DataFrame:
    """For each source: kept, duplicate and outside places."""
    rows = _ranked(sources).withColumn("inside", F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    first = F.row_number().over(Window.partitionBy("inside", "y", "x").orderBy("priority", "pos")) == 1
    marked = rows.withColumn("first", first)
    count = lambda c: F.sum(c.cast("long"))
    return marked.groupBy("source").agg(count(F.col("inside") & F.col("first")).alias("kept"), count(F.col("inside") & ~F.col("first")).alias("duplicates"), count(~F.col("inside")).alias("outside"))


def regions(spots: np.ndarray, reach: int) -> list[np.ndarray]:
    """Groups of places (y, x): two places that are at most ``reach`` apart in both directions are in one group."""
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (y, x) in enumerate((spots // reach).tolist()):
        cells.setdefault((y, x), []).append(i)
    at, seen, out = spots.tolist(), np.zeros(len(spots), bool), []
    for start in range(len(spots)):
        if seen[start]:
            continue
        seen[start], group, todo = True, [], [start]
        while todo:
            i = todo.pop()
            group.append(i)
            y, x = at[i]
            for cy in (y // reach - 1, y // reach, y // reach + 1):
                for cx in (x // reach - 1, x // reach, x // reach + 1):
                    for j in cells.get((cy, cx), ()):
                        if not seen[j] and abs(at[j][0] - y) <= reach and abs(at[j][1] - x) <= reach:
                            seen[j] = True
                            todo.append(j)
        out.append(spots[group])
    return out


def fast_march(values: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Fill masked pixels from the border inwards, each by a weighted mean of known pixels within ``radius``.

    Weights are the direction of the front, the distance and the level difference, after Telea's published
    method, with first-order extrapolation along the image gradient. Regions that read nothing of each other are
    filled on their own, each in a box a little larger than itself; results are the same.
    """
    out = values.astype(float).copy()
    known = ~mask.astype(bool)
    low, high = (out[known].min(), out[known].max()) if known.any() else (0.0, 0.0)
    margin = radius + 2
    for spots in regions(np.argwhere(mask), radius + 1) if mask.any() else ():
        (y0, x0), (y1, x1) = np.maximum(spots.min(axis=0) - margin, 0), spots.max(axis=0) + margin + 1
        own = np.zeros_like(known[y0:y1, x0:x1])
        own[spots[:, 0] - y0, spots[:, 1] - x0] = True
        out[y0:y1, x0:x1] = _march(out[y0:y1, x0:x1], own, known[y0:y1, x0:x1].copy(), radius, low, high)
    return out


def _march(values: np.ndarray, mask: np.ndarray, known: np.ndarray, radius: int, low: float, high: float) -> np.ndarray:
    """Fill ``mask``; results stay between ``low`` and ``high``."""
    import heapq

    out = values.astype(float).copy()
    h, w = out.shape
    time = np.where(mask, np.inf, 0.0)
    heap: list[tuple[float, int, int]] = []
    around = ((-1, 0), (1, 0), (0, -1), (0, 1))
    for y, x in zip(*np.nonzero(mask), strict=True):
        if any(0 <= y + dy < h and 0 <= x + dx < w and not mask[y + dy, x + dx] for dy, dx in around):
            time[y, x] = 1.0
            heapq.heappush(heap, (1.0, int(y), int(x)))

    def solve(y: int, x: int) -> float:
        side = lambda a, b: min(time[p] if 0 <= p[0] < h and 0 <= p[1] < w else np.inf for p in (a, b))
        v, u = side((y - 1, x), (y + 1, x)), side((y, x - 1), (y, x + 1))
        if np.isfinite(v) and np.isfinite(u) and abs(v - u) < 1:
            return (v + u + np.sqrt(2 - (v - u) ** 2)) / 2
        return min(v, u) + 1

    def slope(field: np.ndarray, y: int, x: int, ok: np.ndarray) -> tuple[float, float]:
        def one(a, b):
            ia, ib = all(0 <= i < n for i, n in zip(a, (h, w), strict=True)) and ok[a], all(0 <= i < n for i, n in zip(b, (h, w), strict=True)) and ok[b]
            if ia and ib:
                return (field[b] - field[a]) / 2
            return field[b] - field[y, x] if ib else field[y, x] - field[a] if ia else 0.0

        return one((y - 1, x), (y + 1, x)), one((y, x - 1), (y, x + 1))

    while heap:
        _, y, x = heapq.heappop(heap)
        if known[y, x]:
            continue
        gty, gtx = slope(time, y, x, np.isfinite(time))
        total = weight = 0.0
        for j in range(max(0, y - radius), min(h, y + radius + 1)):
            for i in range(max(0, x - radius), min(w, x + radius + 1)):
                d2 = (j - y) ** 2 + (i - x) ** 2
                if known[j, i] and 0 < d2 <= radius * radius:
                    direction = abs((y - j) * gty + (x - i) * gtx) / np.sqrt(d2)
                    wt = max(direction, 1e-6) / d2 / (1 + abs(time[j, i] - time[y, x]))
                    gy, gx = slope(out, j, i, known)
                    total += wt * (out[j, i] + gy * (y - j) + gx * (x - i))
                    weight += wt
        out[y, x] = min(max(total / weight if weight else 0.0, low), high)
        known[y, x] = True
        for dy, dx in around:
            p = y + dy, x + dx
            if 0 <= p[0] < h and 0 <= p[1] < w and not known[p]:
                t = solve(*p)
                if t < time[p]:
                    time[p] = t
                    heapq.heappush(heap, (t, *p))
    return out


def inpaint(pixels: DataFrame, bad: DataFrame, channels: tuple[str, ...] = ("b", "m", "t"), radius: int = 3, group: str = "image_id") -> DataFrame:
    """Masked pixels of each image's channels filled by fast marching; ``bad`` has (image, y, x).

    Only the neighbourhoods of bad pixels matter, but one image is one group here, as its size is bounded by the sensor.
    """
    marked = pixels.join(bad.select(group, "y", "x").distinct().withColumn("_bad", F.lit(True)), [group, "y", "x"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask_of = pdf["_bad"].notna().to_numpy()
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        mask = np.zeros((h, w), bool)
        mask[y, x] = mask_of
        out = pdf[[group, "y", "x", *channels]].copy()
        if mask.any():
            for c in channels:
                grid = np.zeros((h, w))
                grid[y, x] = pdf[c]
                out[c] = np.clip(np.rint(fast_march(grid, mask, radius)[y, x]), 0, 65535).astype("int64")
        return out

    schema = f"{group} {pixels.schema[group].dataType.simpleString()}, y long, x long, " + ", ".join(f"{c} long" for c in channels)
    return marked.groupBy(group).applyInPandas(run, schema)
