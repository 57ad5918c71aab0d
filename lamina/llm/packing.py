"""Packing into optimal length buckets and token-budget batches.

Dynamic programming over the histogram of all lengths chooses the bucket bounds with the least padding;
inside a bucket, batches take as many rows as fit the token budget at the bucket's length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise, salted_rank, text_of

BUCKETS, BUDGET = 16, 65536


def bounds_of(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise the summed padding; ties take the smaller bounds.

    The cost of a bucket is a line in its bound, so each layer is a lower hull of lines, swept once.
    Exact integers throughout.
    """
    n = len(lengths)
    if not n:
        return []
    b, c = [int(x) for x in lengths], [int(x) for x in counts]
    rows, tokens = [0], [0]
    for x, k in zip(b, c, strict=True):
        rows.append(rows[-1] + k)
        tokens.append(tokens[-1] + x * k)
    best = [0] + [None] * n
    back: list[list[int]] = []
    layers = []
    for _ in range(min(buckets, n)):
        now, frm = [None] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, from
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, q = -rows[i], best[i] + tokens[i]
                while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (q - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, q, i))
            x = b[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, q, i = hull[head]
                now[j], frm[j] = m * x + q + x * rows[j] - tokens[j], i
        back.append(frm)
        layers.append(now)
        best = now
    k = min(range(len(layers)), key=lambda i: (layers[i][n] if layers[i][n] is not None else float("inf"), i))
    out, j = [], n
    for layer in range(k, -1, -1):
        out.append(b[j - 1])
        j = back[layer][j]
    return out[::-1]


def pack(df: DataFrame, length: str = "length", key: str = "id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Add bucket, bucket_length, batch and slot to a narrow frame of (key, length, ...).

    Every row is placed once. A row longer than the budget is a batch of its own. Null lengths count as 0.
    Rows inside a bucket are in hash order of key and length, so batches mix the input's order; repeated
    rows are interchangeable. No rows: no rows.
    """
    rows = materialise(df.withColumn(length, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))), "lengths")
    # one row for each distinct length, exact: d distinct lengths need at least d * d / 2 tokens in all
    found = sorted((r[length], r["count"]) for r in rows.groupBy(length).count().collect())
    bounds = bounds_of(np.array([f[0] for f in found]), np.array([f[1] for f in found]), buckets)
    if not bounds:
        return rows.withColumns({"bucket": F.lit(0), "bucket_length": F.lit(0).cast("long"), "batch": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})
    bucket = reduce(lambda a, x: a + (F.col(length) > x).cast("int"), bounds[:-1], F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    rows = salted_rank(rows, [key, length], "_rank", within=[F.col("bucket")], groups=1024)
    each = [max(1, budget // max(x, 1)) for x in bounds]
    per = F.element_at(F.array([F.lit(x) for x in each]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket_length", F.element_at(F.array([F.lit(x).cast("long") for x in bounds]), F.col("bucket") + 1))
    return rows.withColumn("batch", F.floor(F.col("_rank") / per).cast("long")).withColumn("slot", (F.col("_rank") % per).cast("long")).drop("_rank")


def token_length(text: Column) -> Column:
    """Words (runs other than space and tab to carriage return) of a whole text, and an end token."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length, bucket, bucket_length, batch, slot) for every row; null and blank texts have length 1."""
    narrow = docs.select(F.col(id_col).alias("id"), token_length(text_of(docs, text_col)).alias("length"))
    return pack(narrow, "length", "id", buckets, budget)
