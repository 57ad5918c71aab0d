"""Labelled samples, folds and logistic calibration, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, materialise, text_of, texts_in


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1. Null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_ids(labels: DataFrame, label: str, each: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``each`` ids of either label (0, 1), from rows that may be learnt from, in hash order.

    Only the narrow label table is read. Ids with contradicting labels are left out.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id"), F.lit(17)), "id").limit(each) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, each: int, chars: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """A bounded sample (id, y, lang, text) of whole labelled texts, as a written table.

    At most ``each`` rows of either label, and of those as many, in hash order of their ids, as hold ``chars`` characters together:
    the rows and the bytes that a model is fitted on are bounded, and no text is cut. Of rows with one id the one with the
    least text hash is taken. The documents are read once.
    """
    spark = docs.sparkSession
    few = labelled_ids(labels, label, each, id_col).collect()  # two columns of at most 2 x ``each`` rows
    lang = docs[lang_col].cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.struct(F.xxhash64(text).alias("h"), lang.alias("lang"), text.alias("text")).alias("row"))
    rows = rows.join(F.broadcast(spark.createDataFrame(few, "id long, y int")), "id").groupBy("id", "y").agg(F.min("row").alias("row"))
    found = materialise(rows.select("id", "y", "row.lang", "row.text"), "labelled")
    left, keep = {0: chars, 1: chars}, []
    for r in sorted(found.select("id", "y", F.length("text").alias("n"), F.xxhash64("id", F.lit(17)).alias("h")).collect(), key=lambda r: (r["h"], r["id"])):
        if left[r["y"]] >= r["n"]:
            left[r["y"]] -= r["n"]
            keep.append((r["id"],))
    return found.join(F.broadcast(spark.createDataFrame(keep, "id long")), "id")


def mapped(found: DataFrame, fn: Callable[[str], bytes]) -> list[tuple[int, int, str | None, bytes]]:
    """(id, label, lang, fn(text)) of a bounded sample, computed on the executors, in order of ids."""
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("lang", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in texts_in(b.column(3), step=100):
                s = slice(at, at + len(texts))
                yield batch_of(schema, id=b.column(0)[s], y=b.column(1)[s], lang=b.column(2)[s], data=[fn(t) for t in texts])

    got = map_arrow(found.select("id", "y", "lang", "text"), run, "id long, y int, lang string, data binary").collect()
    return sorted(((r["id"], r["y"], r["lang"], bytes(r["data"])) for r in got), key=lambda r: r[0])


def folds_of(y: np.ndarray, folds: int, seed: int = 9) -> np.ndarray:
    """A fold for each row, either class spread evenly."""
    out = np.zeros(len(y), int)
    for k in (0, 1):
        at = np.nonzero(y == k)[0]
        out[np.random.default_rng(seed).permutation(at)] = np.arange(len(at)) % folds
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features; scores are probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> None:
        x = np.asarray(x, float)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._z(x)
        # with one class only, the prior stays near, not at, certainty
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.w = np.zeros(z.shape[1])
        self.w[-1] = np.log(prior / (1 - prior))
        if 0 < y.sum() < len(y):
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                penalty = np.full(len(self.w), ridge * len(y))
                penalty[-1] = 1e-9
                step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
                self.w += step
                if np.abs(step).max() < 1e-8:
                    break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(np.asarray(x, float)) @ self.w, -30, 30)))
