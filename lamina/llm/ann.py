"""Nearest neighbours by a block matrix join with error bounds.

Vectors are scaled to unit length and quantised to int8 once, when they are packed in blocks. A grid of groups of query
blocks and groups of candidate blocks is dealt over the tasks; the product of two int8 tiles, exact in float32, gives
every cosine of the tile up to a bound made of the quantisation residuals' own lengths. A pair whose upper bound is below the
k-th best score that its query has so far, in all tiles of its group, can't be among the k nearest; the others are computed
again in double precision from the original vectors, and heaps keep the k best of each query, first over a group's tiles, then over
all groups.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, materialise

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 1024
#: Blocks in a group of candidates and of queries: a task holds the queries of one group, and one block of candidates.
GROUP_C, GROUP_Q = 16, 64
_BLOCK = [("dim", pa.int32()), ("block", pa.int64()), ("narrow", pa.bool_()), ("ids", pa.binary()), ("vectors", pa.binary()), ("int8", pa.binary()), ("bounds", pa.binary())]
_BLOCK_SQL = "dim int, block long, narrow boolean, ids binary, vectors binary, int8 binary, bounds binary"
_FOUND = pa.schema([("query_no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: Column) -> Column:
    """Neither null, empty, zero, nor with null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.isNotNull() & ~F.exists(vectors, bad) & F.exists(vectors, lambda x: x != 0)


def _pack(size: int, most: int | None):
    """Rows (id, vector) to blocks of at most ``size`` rows, one dimension to a block, with a number of its own.

    Of equal vectors in a block the ``most`` with the smallest ids are kept: with one more than the neighbours that are
    sought, the others can be no query's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list[int]] = {}
        rows: dict[int, list[np.ndarray]] = {}
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32

        def block(d: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            i, v = np.array(ids.pop(d), np.int64), np.array(rows.pop(d), np.float64)
            if most is not None:
                seen: Counter[bytes] = Counter()
                keep = []
                for at in np.argsort(i, kind="stable"):
                    key = v[at].tobytes()
                    seen[key] += 1
                    if seen[key] <= most:
                        keep.append(at)
                i, v = i[keep], v[keep]
            return batch_of(pa.schema(_BLOCK), dim=[d], block=[number], ids=[i.tobytes()], **Tile.packed(v))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = len(v)
                ids.setdefault(d, []).append(i)
                rows.setdefault(d, []).append(np.array(v, np.float64))
                if len(ids[d]) == size:
                    yield block(d)
        for d in list(ids):
            yield block(d)

    return run


class Tile:
    """A block with its int8 form: unit vectors x = q / s + e, and the lengths of e and of q / s."""

    def __init__(self, dim: int, block: int, narrow: bool, ids: bytes, vectors: bytes, int8: bytes, bounds: bytes) -> None:
        self.block, self.ids = block, np.frombuffer(ids, np.int64)
        self.raw = np.frombuffer(vectors, np.float32 if narrow else np.float64).reshape(-1, dim)
        self.q = np.frombuffer(int8, np.int8).reshape(-1, dim)
        self.scale, self.rest, self.near = np.frombuffer(bounds, np.float64).reshape(3, -1)

    @staticmethod
    def packed(raw: np.ndarray) -> dict[str, list]:
        """The columns of a block: vectors that are whole in float32 travel so, others in double precision."""
        with np.errstate(over="ignore"):
            small = raw.astype(np.float32)
        narrow = bool((small == raw).all())
        peak = np.abs(raw).max(axis=1, keepdims=True)
        unit = raw / peak
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        scale = 127 / np.abs(unit).max(axis=1)
        q = np.rint(unit * scale[:, None]).astype(np.int8)
        near = q / scale[:, None]
        bounds = np.stack([scale, np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-12, np.sqrt((near**2).sum(axis=1))])
        return {"narrow": [narrow], "vectors": [(small if narrow else raw).tobytes()], "int8": [q.tobytes()], "bounds": [bounds.tobytes()]}

    def rows(self, at) -> tuple[np.ndarray, np.ndarray]:
        """Some rows in double precision, with their norms. Where squares are out of range, the unit vector has the same cosine."""
        raw = self.raw[at].astype(np.float64)
        with np.errstate(over="ignore", under="ignore"):
            norm = np.sqrt(ordered_sum(raw * raw))
        odd = ~((norm > 1e-140) & (norm < 1e140))
        if odd.any():
            unit = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
            raw = np.where(odd[:, None], unit, raw)
            norm = np.sqrt(ordered_sum(raw * raw))
        return raw, norm


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; float32 holds sums of 1040 products of int8 exactly."""
    step = 1040
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], step):
        out += a[:, k : k + step].astype(np.float32) @ b[:, k : k + step].astype(np.float32).T
    return out


def ordered_sum(x: np.ndarray) -> np.ndarray:
    return np.add.accumulate(x, axis=1)[:, -1]


def cosine(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed in order; equal vectors give equal values wherever they are."""
    return ordered_sum(a * b) / (na * nb)


def tile_nearest(q: Tile, c: Tile, k: int, floor: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(query row, vec_id, score) of pairs that may be among the k nearest; ``floor`` holds each query's
    k-th best score so far."""
    about = int8_product(q.q, c.q) / (q.scale[:, None] * c.scale[None, :])
    error = q.rest[:, None] + q.near[:, None] * c.rest[None, :] + 1e-9
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, about - error)
    if low.shape[1] > k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
    hit = (about + error >= floor[:, None]) & ~own
    for row in np.nonzero(hit.any(axis=1))[0]:
        cols = np.nonzero(hit[row])[0]
        (a, na), (b, nb) = q.rows([row]), c.rows(cols)
        s = cosine(a, na, b, nb)
        if len(cols) > k:
            best = np.lexsort((c.ids[cols], -s))[:k]
            cols, s = cols[best], s[best]
        yield from ((row, int(c.ids[j]), float(x)) for j, x in zip(cols, s, strict=True))


def _search(k: int):
    """Rows come by cell of the grid, the queries' blocks before the candidates'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, []
        heaps: list[list[list[tuple[float, int]]]] = []
        floors: list[np.ndarray] = []

        def found() -> Iterator[pa.RecordBatch]:
            for q, held in zip(queries, heaps, strict=True):
                rows = [(q.block * QUERIES + i, int(q.ids[i]), -v, s) for i, h in enumerate(held) for s, v in h]
                if rows:
                    yield batch_of(_FOUND, **dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)))

        for b in batches:
            names = ["gq", "gc", "side", *[n for n, _ in _BLOCK]]
            for i in range(b.num_rows):
                gq, gc, side, *block = (b.column(b.schema.get_field_index(n))[i].as_py() for n in names)
                cell = block[0], gq, gc
                if cell != now:
                    yield from found()
                    now, queries, heaps, floors = cell, [], [], []
                tile = Tile(*block)
                if side == 0:
                    queries.append(tile)
                    heaps.append([[] for _ in tile.ids])
                    floors.append(np.full(len(tile.ids), -np.inf))
                    continue
                for q, held, floor in zip(queries, heaps, floors, strict=True):
                    for row, vec, score in tile_nearest(q, tile, k, floor):
                        push(held[row], vec, score, k)
                        if len(held[row]) == k:
                            floor[row] = held[row][0][0]
        yield from found()

    return run


def push(heap: list[tuple[float, int]], vec: int, score: float, k: int) -> None:
    """Keep the k best (score, -id): larger score first, then smaller id."""
    item = (score, -vec)
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _merge(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, heap = None, None, []

        def out() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return batch_of(schema, query_id=[name] * len(best), rank=list(range(1, len(best) + 1)), vec_id=[-v for _, v in best], score=[s for s, _ in best])

        for b in batches:
            for number, query, vec, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != now:
                    if heap:
                        yield out()
                    now, name, heap = number, query, []
                push(heap, vec, score, k)
        if heap:
            yield out()

    return run


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by cosine, exact.

    Candidates with the query's own id are not among them. Ties go to the smaller id. Fewer candidates: all
    of them. Null ids and unusable vectors take no part; vectors only meet those of their own length. Repeated rows
    (same id and vector) count once. One id with several vectors is several queries, each with ranks of its own, and
    several candidates. No queries or no candidates: no rows.
    """
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, size: int, name: str, most: int | None) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        n = rows.count()
        # few rows are cut in smaller blocks, so that all tasks have some
        size = max(1, min(size, -(-n // parts)))
        dealt = rows.dropDuplicates(["id", "v"]).repartition(max(1, -(-n // size)))
        return materialise(map_arrow(dealt, _pack(size, most), _BLOCK_SQL), name)

    c, q = blocks(candidates, CANDIDATES, "candidates", k + 1), blocks(queries, QUERIES, "queries", None)
    # a cell of the grid: a group of query blocks and one of candidate blocks, fewer candidate blocks while tasks would have none
    n_c, n_q = max(1, c.count()), max(1, q.count())
    groups_q = -(-n_q // GROUP_Q)
    groups_c = max(-(-n_c // GROUP_C), min(n_c, -(-parts // groups_q)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = [n for n, _ in _BLOCK]
    left = q.withColumn("gq", group(groups_q)).withColumn("gc", every(groups_c)).select("gq", "gc", F.lit(0).alias("side"), *names)
    right = c.withColumn("gc", group(groups_c)).withColumn("gq", every(groups_q)).select("gq", "gc", F.lit(1).alias("side"), *names)
    cell = ["dim", "gq", "gc"]
    dealt = left.unionByName(right).repartition(parts, *cell).sortWithinPartitions(*cell, "side", "block")
    found = map_arrow(dealt, _search(k), "query_no long, query_id long, vec_id long, score double")
    merged = found.repartition(parts, "query_no").sortWithinPartitions("query_no")
    return map_arrow(merged, _merge(k), "query_id long, rank int, vec_id long, score double")
