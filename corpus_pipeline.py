"""From raw documents to packed batches: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import materialise
from lamina.llm.packing import pack_documents
from lamina.llm.quality import score_quality, train_quality
from lamina.llm.recompress import remove_repeats
from lamina.llm.simhash import drop_near_duplicates
from lamina.llm.toxicity import score_toxicity, train_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good: a score of 0.5 or more.

    A null text is scored as the empty text. Rows are judged one by one: copies and rows without an id stay or go alike, every
    column is kept as it is. No documents: none.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, keep=True).where("score >= 0.5").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold, or the common one for a null or unknown language.

    A null text is scored as the empty text. Rows are judged one by one: copies and rows without an id stay or go alike, every
    column is kept as it is. No documents: none.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=True).where("score < threshold").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a Jaccard likeness of 0.8 or more.

    The one with the least id stays (none counts as least), of several texts under it the one with the least hash. Null, empty and blank texts are one
    group. Copies of a row are near-duplicates too. No documents: none.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that a document with a smaller id has; no document goes.

    A text that loses nothing stays as it is, null too; of one that does the words left are joined by a space. ``n_chars`` follows
    the text. Rows without an id lose nothing and are no source; rows with one id are no source for each other. No documents: none.
    """
    rest = [c for c in docs.columns if c != "text"]
    done = remove_repeats(docs.withColumn("_null_text", F.col("text").isNull()), keep=[*rest, "_null_text"])
    text = F.when(~F.col("_null_text"), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("_null_text"), F.col("n_chars")).otherwise(F.length("kept").cast("long"))} if "n_chars" in rest else {"text": text}
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length (words and an end token), length bucket, batch and slot.

    Null, empty and blank texts have length 1. Each row is placed once, copies and rows without an id too. No documents: none.
    """
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Trained stages and fingerprint groups are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
