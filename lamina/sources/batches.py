"""Rows made in Python, as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A batch ends after so many rows, or so many bytes of binary values and lists.
ROWS, BYTES = 1024, 1 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in order, few at a time: what a worker holds doesn't grow with what it reads."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, bytes) else 8 * len(v) if isinstance(v, list) else getattr(v, "nbytes", 0) for v in row)
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tuples(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time."""
    for batch in found:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)
