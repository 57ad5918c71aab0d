"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses. DataFrame functions only.

Leaves are clauses, paragraphs are lines, and a section starts at a blank line or at a paragraph whose digest starts
with 0, so an edit moves no section bound but its own. A clause ends after a punctuation mark, or at a space after a
letter whose code leaves 2 when divided by 4: a rule that depends on content alone, in any language with spaces, and keeps the leaves
of text without punctuation short. Each node is the sha256 of its children's digests in hex.
Equal roots mean equal texts; where roots differ, the section, paragraph and clause digests tell which
branches do. A fingerprint is ``root|sections|paragraphs|clauses``, the last three as the first eight hex digits of each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import materialise, text_of

#: A clause ends after one of these: punctuation, or a letter whose code is 2 modulo 4 and a space.
CLAUSE = r"([.!?;,|]|[bfjnrvzBFJNRVZ] )"
SHORT = 8
#: Rows of a neighbourhood.
ROWS = 64
_BLANK = "cd372fb85148700fa88095e3492d3f9f5beb43e555e5ff26d95f5a6adc36f8e6"  # node of a paragraph whose only clause is empty


def add_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>fingerprint`` and ``<prefix>leaves`` (short clause digests) of a text column that has no nulls."""
    p = f"_{prefix}"
    clauses = lambda x: F.transform(F.split(F.regexp_replace(x, CLAUSE, "$1\n"), "\n"), lambda c: F.sha2(c, 256))
    df = df.withColumn(f"{p}clauses", F.transform(F.split(F.col(text), "\n"), clauses))
    df = df.withColumn(f"{p}paragraphs", F.transform(f"{p}clauses", lambda c: F.sha2(F.concat_ws(".", c), 256)))
    cut = F.replace(F.replace(F.concat_ws(" ", f"{p}paragraphs"), F.lit(" 0"), F.lit("\n0")), F.lit(f" {_BLANK}"), F.lit(f"\n{_BLANK}"))
    df = df.withColumn(f"{p}sections", F.transform(F.split(cut, "\n"), lambda s: F.sha2(s, 256)))
    short = lambda c: F.transform(c, lambda x: F.left(x, F.lit(SHORT)))
    df = df.withColumn(f"{prefix}leaves", short(F.flatten(f"{p}clauses")))
    made = F.concat_ws("|", F.sha2(F.concat_ws(" ", f"{p}sections"), 256), F.concat_ws(".", short(F.col(f"{p}sections"))), F.concat_ws(".", short(F.col(f"{p}paragraphs"))), F.concat_ws(".", f"{prefix}leaves"))
    return df.withColumn(f"{prefix}fingerprint", made).drop(f"{p}clauses", f"{p}paragraphs", f"{p}sections")


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct clauses of two texts that both have, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def leaves_of(fingerprint: Column) -> Column:
    return F.split(F.element_at(F.split(fingerprint, r"\|"), 4), r"\.")


def root_of(fingerprint: Column) -> Column:
    return F.left(fingerprint, F.lit(64))


def differing(a: Column, b: Column, level: int = 3) -> Column:
    """Places (from 0) of the branches of ``a`` that are edited in ``b``: sections (2), paragraphs (3) or clauses (4).

    A branch is as it was if the one at the same place of ``b``, counted from the front or from the back, is equal.
    So moved and repeated branches are found, and what is put in or taken out does not mark what follows. Empty
    where the roots are equal.
    """
    part = lambda f: F.split(F.element_at(F.split(f, r"\|"), level), r"\.")
    x, y = part(a), part(b)
    behind = F.size(y) - F.size(x)
    same = lambda v, i: F.coalesce(F.get(y, i) == v, F.lit(False)) | F.coalesce(F.get(y, F.when(i + behind >= 0, i + behind)) == v, F.lit(False))
    marked = F.transform(x, lambda v, i: F.when(~same(v, i), i))
    return F.when(root_of(a) == root_of(b), F.array().cast("array<int>")).otherwise(F.filter(marked, lambda v: v.isNotNull()))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a fingerprint column; null texts are empty, and repeated texts have one fingerprint."""
    return add_tree(df.withColumn("_text", text_of(df, text_col)), "_text", "").drop("_text", "leaves")


def ordered(keys: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """``keys`` as a written table with a gapless ``rank`` from 0 in the order of ``by``, and the number of rows.

    Ranges of keys are sorted in parallel; a small table has each range's number of rows.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "order").withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_part").withColumn("rank", local + F.col("_before")).drop("_at", "_part", "_before"), total


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last quarter (rounded down, in code points) replaced by the first
    as many of the next row's, by id, then a hash of the text; after the last row comes the first. A lone row is its own
    next. Null texts are empty; a null id comes before all others. Equal rows follow each other, so all but the last have an equal
    one as their next. No rows: no rows.

    Distinct rows get a global rank in a narrow table, which deals the texts in neighbourhoods of ``ROWS`` ranks; the first row of
    each is also a guest of the one before, the very first one of the last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranks, n = ordered(rows.groupBy("key", "h").count(), ["key", "h"])
    last = max(0, (n - 1) // ROWS)
    own = F.expr(f"rank div {ROWS}")
    guest = F.when(F.col("rank") == 0, F.lit(last)).when(F.col("rank") % ROWS == 0, own - 1)
    # a key's copies are the same row: one goes on, with their number
    once = rows.join(ranks, ["key", "h"])
    repeated = ranks.where("count > 1").select("key", "h").limit(1).count()
    if repeated:
        once = once.groupBy("key", "h").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("count").alias("count"), F.first("rank").alias("rank"))
    homes = F.filter(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")), F.struct(guest.cast("long").alias("bucket"), F.lit(False).alias("own"))), lambda s: s["bucket"].isNotNull())
    dealt = once.select("id", "text", "count", "rank", F.explode(homes).alias("home")).select("id", "text", "count", "rank", "home.*").repartition(parts, "bucket")
    dealt = add_tree(dealt, "text", "")
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), "rank")
    following = F.struct(F.lead("text").over(order).alias("text"), F.lead("leaves").over(order).alias("leaves"), F.lit(1).cast("long").alias("times"))
    rows = dealt.withColumn("other", following).where("own")
    if repeated:
        copy = F.struct(F.col("text"), F.col("leaves"), (F.col("count") - 1).alias("times"))
        rows = rows.withColumn("other", F.explode(F.filter(F.array("other", copy), lambda s: s["times"] > 0)))
    chars = F.length("text")
    k = F.floor(chars / 4).cast("int")
    edited = F.concat(F.left("text", chars - k), F.left(F.coalesce("other.text", F.lit("")), k))
    rows = add_tree(rows.withColumn("edited", edited), "edited", "edited_")
    if repeated:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("other.times"))))
    return rows.select(
        "id", chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("other.leaves")).alias("near_next"),
    )
