"""One query for each operator of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.ann import nearest
from lamina.llm.bpe import bpe_encode
from lamina.llm.merkle import edit_fingerprints
from lamina.llm.packing import pack_documents
from lamina.llm.quality import score_quality, train_quality
from lamina.llm.recompress import remove_repeats
from lamina.llm.shard import shard_documents
from lamina.llm.simhash import simhash_components
from lamina.llm.tokenfile import token_round_trip
from lamina.llm.toxicity import score_toxicity, train_toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_docs(spark, sf_dir), shards=16).withColumnRenamed("id", "doc_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scored = score_toxicity(docs, train_toxicity(docs, _labels(spark, sf_dir)))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scored = score_quality(docs, train_quality(docs, _labels(spark, sf_dir)))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_docs(spark, sf_dir), _vocabulary(), digest=True).withColumnRenamed("id", "doc_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_docs(spark, sf_dir), _vocabulary(), end_id=2).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_docs(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_merkle": op5_merkle,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
}

_COSINE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""




def _tree(text: str, name: str) -> str:
    """CTE ``name``: doc_id, fp and leaves of the texts of a relation ``text``."""
    return f"""
{name}0 AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda p:
    list_transform(string_split(regexp_replace(p, '([.!?;,|]|[bfjnrvzBFJNRVZ] )', concat('\\1', chr(10)), 'g'), chr(10)), lambda c: sha256(c))) AS cl FROM {text}),
{name}1 AS (SELECT doc_id, cl, list_transform(cl, lambda c: sha256(array_to_string(c, '.'))) AS pa FROM {name}0),
{name}2 AS (SELECT *, list_transform(string_split(replace(replace(array_to_string(pa, ' '), ' 0', concat(chr(10), '0')),
    concat(' ', sha256(sha256(''))), concat(chr(10), sha256(sha256('')))), chr(10)), lambda s: sha256(s)) AS se FROM {name}1),
{name}3 AS (SELECT *, list_transform(flatten(cl), lambda x: left(x, 8)) AS lv FROM {name}2),
{name} AS (SELECT doc_id, lv, concat_ws('|', sha256(array_to_string(se, ' ')), array_to_string(list_transform(se, lambda x: left(x, 8)), '.'),
    array_to_string(list_transform(pa, lambda x: left(x, 8)), '.'), array_to_string(lv, '.')) AS fp FROM {name}3)"""


_LIKE = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"
_MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS nid FROM d),
e AS (SELECT doc_id, nid, length(t) AS n, concat(left(t, length(t) - length(t) // 4), left(nt, length(t) // 4)) AS t FROM o),
{_tree("d", "a")}, {_tree("e", "b")}
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
    {_LIKE.format(a="a.lv", b="b.lv")} AS near_edited, {_LIKE.format(a="a.lv", b="c.lv")} AS near_next
FROM e JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN a c ON c.doc_id = e.nid
"""

_REPEATS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
k AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS words, n FROM u),
x AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY words) AS first FROM k WHERE pos <= n - 12),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM x, range(13) r(j) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: DuckDB SQL over the same tables, where SQL can express the result.
ORACLE_SQL: dict[str, str] = {"op1_nearest": _COSINE, "op5_merkle": _MERKLE, "op6_substring_dedup": _REPEATS}
