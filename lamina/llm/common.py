"""Shared pieces: the shared work folder, stable ranks, whole-text word reading."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.session import ship

#: Groups into which rows are dealt for distributed ranks; fixed, so a rank depends on the rows alone.
RANK_GROUPS = 4096
#: Spark's switch for deleting a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="lamina-")
    return _local_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex[:12]}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(hadoop).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it: lineage ends here.

    The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1][id(table)] = table, path
    return table


@contextmanager
def passing_tables() -> Iterator[Callable[..., None]]:
    """Deletes the tables that ``materialise`` wrote inside, when it ends; gives a function that takes those to keep.

    What is kept passes to the scope around, if there is one.
    """
    scopes = _scopes.open = getattr(_scopes, "open", [])
    scopes.append({})
    kept: set[int] = set()
    try:
        yield lambda *tables: kept.update(map(id, tables))
    finally:
        for key, (table, path) in scopes.pop().items():
            if key in kept:
                if scopes:
                    scopes[-1][key] = table, path
            else:
                jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(hadoop).delete(at, True)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_in(column: pa.Array, field: str | None = None, step: int = 1000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of short stretches of a text column, or of a field of a struct column; null is empty.

    Only one stretch is held as Python strings.
    """
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        yield at, [t or "" for t in (part.field(field) if field else part).to_pylist()]


def salted_rank(df: DataFrame, keys: list[str], rank: str = "row_no", within: list[Column] | None = None, groups: int = RANK_GROUPS) -> DataFrame:
    """Add a gapless number from 0, ordered by (hash group of ``keys``, ``keys``).

    The rows are dealt into ``groups`` hash groups, numbered inside each, and shifted by the
    counts of the groups before. A key that has more rows than a group should have is taken out of
    its group and dealt over salted groups of its own behind all others; its rows are interchangeable, so
    which salt a row gets changes no result. At most ``groups`` keys can be so frequent, so the counts table has at most
    3 x ``groups`` rows for each value of ``within``. With ``within`` the numbers start anew for each of
    its values, which must be few. The result depends on the rows alone. ``df`` must be a written table: it is read
    several times.
    """
    names = [f"_w{i}" for i in range(len(within or []))]
    df = df.withColumns(dict(zip(names, within or [], strict=True)) | {"_g": F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"), "_s": F.lit(0)})
    by = [*names, "_g", "_s"]
    counts = df.groupBy(*by).count()
    sizes = counts.groupBy("_g").agg(F.sum("count").alias("count")).collect()  # ``groups`` rows
    room = max(1000, 2 * sum(r["count"] for r in sizes) // groups)
    full = [r["_g"] for r in sizes if r["count"] > room]
    if full:
        # only groups with too many rows can hold such a key
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        hot = df.where(F.col("_g").isin(full)).groupBy(*keys).count().where(F.col("count") > room)
        hot = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.ceil(F.col("count") / room).cast("int").alias("_n"), (F.row_number().over(Window.orderBy(*keys)) + groups).cast("int").alias("_h"))
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_n").cast("long")).cast("int")
        joined = df.drop("_s").join(F.broadcast(hot), same, "left")  # fewer than ``groups`` rows
        df = joined.withColumns({"_s": F.when(F.col("_h").isNotNull(), salt).otherwise(0), "_g": F.coalesce("_h", "_g")}).drop("_n", "_h", *[f"_k{i}" for i in range(len(keys))])
        df = materialise(df, "salted")
        counts = df.groupBy(*by).count()
    before = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    offsets = counts.select(*by, (F.sum("count").over(before.orderBy("_g", "_s")) - F.col("count")).alias("_before"))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(offsets[c]) for c in by])
    joined = df.join(F.broadcast(offsets), same).drop(*[offsets[c] for c in by])  # at most 3 x groups x few rows
    inner = Window.partitionBy(*by).orderBy(*keys)
    return joined.withColumn(rank, (F.row_number().over(inner) - 1 + F.col("_before")).cast("long")).drop(*by, "_before")


def word_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as lists from slices of about ``size`` bytes.

    ``bytes.split()`` splits at exactly these six characters.
    """
    at, n = 0, len(text)
    if n <= size:
        yield text.split()
        return
    while at < n:
        end = at + size
        while end < n and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def mix64(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = a >> np.uint64(30)
        x ^= a
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)
