"""Work on tiles of images in numpy: each tile takes a halo of its neighbours, so no task holds a whole image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import ship

#: Side of a tile in pixels.
TILE = 512


def tiled(
    pixels: DataFrame,
    values: list[str],
    fn: Callable[[np.ndarray, np.ndarray, tuple[int, int], tuple[int, int]], tuple[np.ndarray, np.ndarray, np.ndarray]],
    out: list[str],
    halo: int,
    group: str = "image_id",
    tile: int = TILE,
) -> DataFrame:
    """(image, y, x, *out) as long integers, from a function of one tile's values.

    ``fn(grid, there, corner, own)`` gets the values as rows x columns x values with the halo, which places hold a pixel, the
    grid's first (y, x) and the tile's first own (y, x); it returns rows, columns and values of the results. Results
    outside the tile are the function's to leave out. Tiles come sorted, so one is held at a time.
    """
    ship(pixels.sparkSession)
    zero = F.lit(0).cast("long")
    near = lambda c: F.sequence(F.greatest(zero, F.floor((F.col(c) - halo) / tile)), F.floor((F.col(c) + halo) / tile))
    sent = pixels.select(group, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    sent = sent.withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x")))
    dealt = sent.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "_ty", "_tx").sortWithinPartitions(group, "_ty", "_tx")

    def solve(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        y0, x0 = int(y.min()), int(x.min())
        shape = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
        grid, there = np.zeros((*shape, len(values))), np.zeros(shape, bool)
        there[y - y0, x - x0] = True
        for i, v in enumerate(values):
            grid[y - y0, x - x0, i] = table.column(v).to_numpy()
        rows, columns, made = fn(grid, there, (y0, x0), (int(key[1]) * tile, int(key[2]) * tile))
        own = table.column(group).combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(rows), np.int64)))
        made = np.asarray(made).reshape(len(rows), len(out)).astype(np.int64)
        return pa.RecordBatch.from_arrays([own, pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), *[pa.array(made[:, i]) for i in range(len(out))]], names=[group, "y", "x", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            keys = [b.column(b.schema.get_field_index(n)) for n in (group, "_ty", "_tx")]
            n = b.num_rows
            change = np.zeros(max(n - 1, 0), bool)
            for k in keys:
                change |= pc.not_equal(k.slice(1), k.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), n]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z == a:
                    continue
                key = tuple(k[a].as_py() for k in keys)
                if key != now:
                    if held:
                        yield solve(now, held)
                    now, held = key, []
                held.append(b.slice(a, z - a))
        if held:
            yield solve(now, held)

    kind = pixels.schema[group].dataType.simpleString()
    return dealt.mapInArrow(run, f"{group} {kind}, y long, x long, " + ", ".join(f"{c} long" for c in out))


def own_places(there: np.ndarray, corner: tuple[int, int], own: tuple[int, int], tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Places in the grid of the tile's own pixels."""
    y, x = np.nonzero(there)
    inside = (y + corner[0] >= own[0]) & (y + corner[0] < own[0] + tile) & (x + corner[1] >= own[1]) & (x + corner[1] < own[1] + tile)
    return y[inside], x[inside]
