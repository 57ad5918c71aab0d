"""SimHash near-duplicates: bit-sliced comparison with carry-save counters.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Distinct
fingerprints are dealt into buckets by parts of their bits. A bucket is stored vertically, one bit
plane per fingerprint bit, 64 fingerprints to a machine word; carry-save adders count the differing
planes of 64 pairs at once, and rows whose lanes have all passed the radius are abandoned. Each
block of a bucket returns a spanning forest of its links, never its pairs, and star contraction
joins the forests into components.

The likeness search of the pipeline compares 256-bit fingerprints of shingle sets in the same way, at a radius so wide
that no likely pair is lost, in buckets of fingerprint bits and of bands of minimum hashes; the exact
shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, materialise, mix64, passing_tables, text_of, texts_in, word_lists

#: Fingerprints in a block of a bucket; a larger bucket is compared block against block.
BLOCK = 4096
#: Least Jaccard likeness of near-duplicates, as a fraction.
LIKE = (4, 5)
#: Bands of minimum hashes and hashes in a band: a pair at 0.8 shares a bucket with chance 1 - (1 - 0.8^5)^24 > 0.9999.
BANDS, BAND_ROWS = 24, 5
#: Sets in a block of a bucket.
SET_BLOCK = 1024
#: 64-bit words in the fingerprint of a shingle set, and the bits in which those of two that are compared further may differ:
#: a pair of sets with a likeness of 0.8 differs in more with a chance of 3e-11 at most (5 shingles against 4 of them).
SET_WORDS, SET_RADIUS = 4, 92
#: Bits in which fingerprints of sets with a likeness of 0.8 differ on average, and the part of such pairs that may share no bucket of bits.
SET_BITS, SET_MISS = 39, 0.01
#: Rounds in which texts meet leaders before all other pairs are compared.
ROUNDS = 3
#: Hashes gathered before they are counted.
CHUNK = 1 << 17
#: Links that one task joins into components; more go through rounds of contraction.
FEW_LINKS = 1 << 16
#: Large buckets whose table is broadcast; with more, the rows are joined with it by bucket.
FEW_BUCKETS = 100_000

#: Odd multipliers, one for each minimum hash.
_MIXERS = np.random.default_rng(11).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
#: Byte -> eight byte lanes, one for each of its bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str, k: int, seed: int) -> Iterator[list[int]]:
    """XXH64 of the k-word shingles of a whole text, repeats included, in lists of bounded size."""
    tail: list[bytes] = []
    seen = False
    digest = xxhash.xxh64_intdigest
    for words in word_lists(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= k:
            seen = True
            joined, at, starts, ends = b" ".join(words), 0, [], []
            for w in words:
                starts.append(at)
                at += len(w)
                ends.append(at)
                at += 1
            yield [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)]
        tail = words[-(k - 1) :] if k > 1 else []
    if not seen and tail:
        yield [digest(b" ".join(tail), seed)]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each segment of ``hashes``."""
    fine, owner = [], []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(hashes)], strict=True)):
        cuts = range(a, b, 255)  # a byte lane holds 255 at most
        fine.extend(cuts)
        owner.extend([i] * len(cuts))
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], fine, axis=0).view(np.uint8).reshape(len(fine), 64)
    out = np.zeros((len(starts), 64), np.int64)
    np.add.at(out, owner, lanes)
    return out


def fingerprint_batch(texts: list[str | None], k: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """Fingerprints of 64 bits for each word: shape (texts, words), uint64. No words in a text: zero.

    The first word counts the bits of the shingles' XXH64; further words count those of its remixed values.
    """
    counts, totals = np.zeros((words, len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[list[int]] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            hashes = np.fromiter((h for part in held for h in part), np.uint64, size)
            for w in range(words):
                np.add.at(counts[w], owners, bit_counts(mix64(hashes + np.uint64(w * _STEP % 2**64)) if w else hashes, starts))

    for i, text in enumerate(texts):
        for part in shingle_hashes(text or "", k, seed):
            totals[i] += len(part)
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= CHUNK:
                flush()
                held, owners, size = [], [], 0
    flush()
    set_bits = np.packbits(2 * counts > totals[None, :, None], axis=2, bitorder="little")
    return np.ascontiguousarray(set_bits.view("<u8")[:, :, 0].T)


def to_hex(fps: np.ndarray) -> list[str]:
    big = fps.astype(">u8").tobytes().hex()
    n = 16 * fps.shape[1]
    return [big[i * n : (i + 1) * n] for i in range(len(fps))]


def from_hex(values: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(values)), ">u8").astype(np.uint64).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint64)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: (bits, words of 64 lanes). Lanes past the end are zero."""
    n, words = fps.shape
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    pad = np.zeros((64 * words, -(-n // 64) * 64), np.uint8)
    pad[:, :n] = bits.T
    return np.packbits(pad, axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Query rows that have a lane within ``radius`` and, for each, those lanes as bit words."""
    levels = radius.bit_length()
    width = planes.shape[1]
    valid = np.packbits(np.arange(width * 64) < lanes, bitorder="little").view("<u8")
    rows = np.arange(len(queries))
    qbits = np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").astype(bool)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), width)
    acc = [np.zeros(shape, np.uint64) for _ in range(levels)]
    wait: list[np.ndarray | None] = [None] * levels
    over = np.zeros(shape, np.uint64)

    def add(level: int, x: np.ndarray) -> None:
        nonlocal over
        if level == levels:
            over |= x
        elif wait[level] is None:
            wait[level] = x
        else:  # carry-save adder: three planes of weight 2^level to a sum and a carry
            half = acc[level] ^ wait[level]
            carry = (acc[level] & wait[level]) | (half & x)
            acc[level] = half ^ x
            wait[level] = None
            add(level + 1, carry)

    for p, plane in enumerate(planes):
        add(0, plane[None, :] ^ np.where(qbits[rows, p], full, np.uint64(0))[:, None])
        if p % 16 == 15 and p >= 31 and p + 1 < len(planes):
            alive = (~over & valid).any(axis=1)
            if not alive.any():
                return rows[:0], over[:0]
            if alive.sum() < 0.7 * len(rows):  # abandon rows whose lanes have all passed the radius
                rows, over = rows[alive], over[alive]
                acc, wait = [a[alive] for a in acc], [None if w is None else w[alive] for w in wait]
    for level in range(levels):
        if wait[level] is not None:
            x, wait[level] = wait[level], None
            carry = acc[level] & x
            acc[level] = acc[level] ^ x
            if level + 1 == levels:
                over |= carry
            else:
                nxt = wait[level + 1]
                if nxt is None:
                    wait[level + 1] = carry
                else:
                    half = acc[level + 1] ^ nxt
                    over_carry = (acc[level + 1] & nxt) | (half & carry)
                    acc[level + 1], wait[level + 1] = half ^ carry, None
                    add(level + 2, over_carry)
    below, equal = np.zeros_like(over), np.full_like(over, full)
    for level in reversed(range(levels)):
        if radius >> level & 1:
            below |= equal & ~acc[level]
            equal &= acc[level]
        else:
            equal &= ~acc[level]
    near = (below | equal) & ~over & valid
    if not levels:
        near = ~over & valid
    some = near.any(axis=1)
    return rows[some], near[some]


def block_forest(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links inside ``left``, or between ``left`` and ``right``.

    Nodes are numbered through left, then right.
    """
    own = right is None
    other = left if own else right
    assert other is not None
    n = len(left) + (0 if own else len(right))
    shift = 0 if own else len(left)
    label = np.arange(n)
    planes = planes_of(other)
    for at in range(0, len(left), step):
        rows, near = within_radius(left[at : at + step], planes, len(other), radius)
        for q, words in zip(rows + at, near, strict=True):
            hit = np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))[0] + shift
            group = np.unique(np.append(label[hit], label[q]))
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
    return [(i, int(r)) for i, r in enumerate(label) if r != i]


def plan_tables(distinct: int, bits: int, radius: int) -> list[list[int]]:
    """For each table, the bit positions that make its bucket key.

    64 bits and a small radius: the bits are cut in more blocks than the radius; any pair within it
    agrees on all blocks of some table, so no link is lost. The number of blocks with the lowest
    cost at this number of fingerprints is taken; keys are shortened while buckets would be small.
    """
    want = max(0, math.floor(math.log2(max(distinct, 1) / 256)))
    best: tuple[float, list[list[int]]] | None = None
    for blocks in range(radius + 1, min(radius + 5, bits) + 1):
        edges = [round(i * bits / blocks) for i in range(blocks + 1)]
        parts = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        tables = [sum((parts[i] for i in chosen), []) for chosen in combinations(range(blocks), blocks - radius)]
        use = min(want, *map(len, tables))
        cost = len(tables) * distinct * (500 + distinct / 2 ** (use + 1))
        if best is None or cost < best[0]:
            best = cost, [t[:use] for t in tables]
    assert best
    return best[1]


def sample_tables(distinct: int, bits: int, differ: int, miss: float, seed: int = 7) -> list[list[int]]:
    """Tables keyed by random bits, for radii too wide for blocks: buckets of at most a thousand on average, and as many tables as let two
    fingerprints that differ in ``differ`` bits share no bucket with a chance of ``miss`` at most, whatever their number."""
    want = min(bits - differ, max(0, math.floor(math.log2(max(distinct, 1) / 512))))
    meet = math.comb(bits - differ, want) / math.comb(bits, want)
    tables = math.ceil(math.log(miss) / math.log1p(-meet)) if meet < 1 else 1
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, want, replace=False).tolist()) for _ in range(tables)]


_ROW = pa.schema([("bucket", pa.int64()), ("fp", pa.string())])
_EDGE = pa.schema([("u", pa.string()), ("v", pa.string())])


def _bucket_rows(tables: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            fps = from_hex(values.to_pylist())
            for t, positions in enumerate(tables):
                key = np.zeros(len(fps), np.uint64)
                for j, p in enumerate(positions):
                    key |= ((fps[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(j)
                yield batch_of(_ROW, bucket=(np.uint64(t) << np.uint64(48) | key).astype(np.int64), fp=values)

    return run


def _forest(radius: int):
    def solve(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        left, right = [f for f, side in rows if not side], [f for f, side in rows if side]
        names = left + right
        edges = block_forest(from_hex(left), from_hex(right) if right else None, radius) if left else []
        return batch_of(_EDGE, u=[names[a] for a, _ in edges], v=[names[b] for _, b in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, fp, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield solve(held)
                    now, held = key, []
                held.append((fp, side))
        if len(held) > 1:
            yield solve(held)

    return run


def links(fps: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that keep every connection of the buckets."""
    rows = map_arrow(fps.select("fp"), _bucket_rows(tables), "bucket long, fp string")
    large = rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("s"))
    rows = rows.join(large, "bucket", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    # block pair (a, b): the rows of a are compared with those of b, or with each other where a = b
    a, b = F.least("i", "j"), F.greatest("i", "j")
    rows = rows.select(F.xxhash64("bucket", a, b).alias("pair"), "fp", (F.col("i") > F.col("j")).alias("side"))
    spark = fps.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pair").sortWithinPartitions("pair")
    return map_arrow(dealt, _forest(radius), "u string, v string")


def join_hot(rows: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``one``, which has one row for each ``key``. The rows of a frequent key are dealt by ``by`` over as
    many copies of its one row as its count asks for. ``counts`` has the keys' counts, if they are known.

    A key is frequent with a quarter of what a task should have, so there are at most four for each task. Without any, this
    is a plain join.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(key).count() if counts is None else counts
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    room = max(500, (total or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= room:
        return rows.join(one, key)
    hot = counts.where(F.col("count") > room).select(key, F.ceil(F.col("count") / room).cast("int").alias("_n")).collect()
    often = F.broadcast(spark.createDataFrame(hot, f"{key} {rows.schema[key].dataType.simpleString()}, _n int"))
    salted = lambda df: df.join(often, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    left = salted(rows).withColumn("_s", F.pmod(F.xxhash64(by), F.col("_n").cast("long")).cast("int")).drop("_n")
    right = salted(one).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.join(right, [key, "_s"]).drop("_s")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to rows (node, root), all links in one task."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while (up := above[x]) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            above.setdefault(u, u)
            above.setdefault(v, v)
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    names = list(above)
    for at in range(0, len(names), 10_000):
        some = names[at : at + 10_000]
        yield batch_of(pa.schema([("node", pa.string()), ("root", pa.string())]), node=some, root=list(map(top, some)))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Up to FEW_LINKS distinct edges are joined in one task. More go through large-star and small-star rounds; each round is a written
    table. Ends when a round changes nothing.
    """
    with passing_tables() as keep:
        edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if edges.count() <= FEW_LINKS:
            found = materialise(map_arrow(edges.repartition(1), _joined, "node string, root string"), "components")
            keep(found)
            return found
        last = None
        for _ in range(limit):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = join_hot(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            low = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "low")
            mins = low.groupBy("u").agg(F.min("v").alias("m"))
            small = join_hot(low, mins, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            edges = materialise(small.where("u <> v").distinct(), "edges")
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if state == last:
                break
            last = state
        else:
            raise RuntimeError("components did not settle")
        keep(edges)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text in hex, 16 digits for each 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("fp", pa.string())])
            yield batch_of(schema, id=batch.column(0), fp=to_hex(fingerprint_batch(batch.column(1).to_pylist(), shingle, words, seed)))

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), text_of(df, text_col).alias("text")), run, f"id {kind}, fp string")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, seed: int = 42, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id reachable over links.

    Texts are lower-cased (A-Z), words are runs other than space and tab to carriage return. Fewer
    words than ``shingle`` give one shingle, no words (null, empty, blank) the fingerprint zero, which
    links like any other. Repeated rows share a component. A null id takes part but is never a
    component's id unless it has no other. Every pair that can be within ``radius`` is compared. No rows: no rows.
    """
    rows = materialise(simhash(df, id_col, text_col, shingle, words, seed), "fingerprints")
    firsts = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    distinct = firsts.count()
    tables = plan_tables(distinct, 64 * words, radius)
    labels = components(links(firsts, tables, radius))
    joined = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = materialise(joined, "roots")
    heads = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(join_hot(joined, heads, "root", "fp").select("fp", "component_id"), "named")
    return join_hot(rows, named, "fp", "id").select("id", "fp", "component_id")


def shingle_set(text: str, k: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    parts = [np.array(p, np.uint64) for p in shingle_hashes(text, k, seed)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key a band, from the least of the remixed hashes under each of its ``BAND_ROWS`` mixers."""
    if not len(shingles):
        return [0] * BANDS
    least = np.full(len(_MIXERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[None, at : at + 1024] * _MIXERS[:, None]).min(axis=1))
    parts = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(parts)]


def set_fingerprint(shingles: np.ndarray, words: int = SET_WORDS) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, in 64-bit words; zero for the empty set."""
    if not len(shingles):
        return np.zeros(words, np.uint64)
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        for w in range(words):
            counts[w] += bit_counts(mix64(part + np.uint64(w * _STEP % 2**64)) if w else part, np.zeros(1, np.int64))[0]
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").view("<u8").ravel()


def _sketches(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, bands = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, k, seed)
                names.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                prints.append(set_fingerprint(found).tobytes())
                bands.append(band_keys(found))
            schema = pa.schema([("id", batch.schema.field(0).type), ("name", pa.string()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])
            yield batch_of(schema, id=batch.column(0), name=names, fp=prints, bands=bands)

    return run


def _sets(k: int, seed: int):
    schema = pa.schema([("name", pa.string()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_in(batch.column(1), step=100):
                yield batch_of(schema, name=batch.column(0).slice(at, len(texts)), shingles=[shingle_set(t, k, seed).tobytes() for t in texts])

    return run


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard likeness of LIKE or more, in whole numbers."""
    top, bottom = LIKE
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return bottom * shared >= top * (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, left, right = batch.columns
        keep = [i for i in range(len(u)) if alike(*(np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right)))]
        yield batch_of(_EDGE, u=u.take(pa.array(keep, pa.int64())), v=v.take(pa.array(keep, pa.int64())))


def _alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of names whose sets are alike."""
    pairs = materialise(pairs, "pairs")
    joined = join_hot(pairs, sets.select(F.col("name").alias("u"), F.col("shingles").alias("left")), "u", "v")
    joined = joined.join(sets.select(F.col("name").alias("v"), F.col("shingles").alias("right")), "v")
    return map_arrow(joined.select("u", "v", "left", "right"), _verify, "u string, v string")


def _rooted(places: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``places`` with each name's component, its own name where it has none."""
    if labels is None:
        return places.withColumn("root", F.col("name"))
    return places.join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))


def _leader_pairs(places: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(u, v): for each name the leader, of another component, that most of its buckets have; ``turn`` changes the leaders."""
    rows = places if labels is None else materialise(_rooted(places, labels), "rooted")
    rows = _rooted(rows, None) if labels is None else rows
    leaders = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("name", F.lit(turn)).alias("h"), F.col("name").alias("u"), F.col("root").alias("top"))).alias("l")).select("bucket", "l.u", "l.top")
    often = join_hot(rows, leaders, "bucket", "name").where("root <> top").groupBy(F.col("name").alias("v"), "u").count()
    return often.groupBy("v").agg(F.max_by("u", F.struct("count", "u")).alias("u")).select("u", "v")


def block_links(names: list[str], roots: list[int], sides: list[bool], sets: list[np.ndarray]) -> list[tuple[str, str]]:
    """Links between alike sets of different components, of two sides if there are two, that connect all such sets."""
    top, bottom = LIKE
    label = np.unique(roots, return_inverse=True)[1]
    side, size = np.array(sides), np.array([len(x) for x in sets])
    every, places = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(places, np.cumsum(size)[:-1])
    mark = np.zeros(len(every), np.int32)
    own, out = not side.any() or side.all(), []
    for q in np.arange(len(names)) if own else np.nonzero(~side)[0]:
        fits = (label != label[q]) & (bottom * np.minimum(size, size[q]) >= top * np.maximum(size, size[q]))
        others = np.nonzero(fits & (np.arange(len(names)) > q if own else side))[0]
        if not len(others):
            continue
        mark[parts[q]] = 1
        starts = np.cumsum(size[others]) - size[others]
        shared = np.add.reduceat(mark[np.concatenate([parts[i] for i in others])], starts)
        mark[parts[q]] = 0
        for i in others[bottom * shared >= top * (size[others] + size[q] - shared)]:
            if label[i] != label[q]:
                label[label == label[i]] = label[q]
                out.append((names[q], names[i]))
    return out


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names, roots, sides, sets = zip(*rows, strict=True)
        edges = block_links(list(names), list(roots), list(sides), [np.frombuffer(x, np.uint64) for x in sets])
        return batch_of(_EDGE, u=[u for u, _ in edges], v=[v for _, v in edges])

    now, held = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if len(held) > 1:
                    yield solve(held)
                now, held = key, []
            held.append(row)
    if len(held) > 1:
        yield solve(held)


_PLACE = [("bucket", pa.int64()), ("name", pa.string()), ("fp", pa.binary()), ("root", pa.int64())]


def _bit_places(tables: list[list[int]]):
    """Rows (name, fp, root) to a row (bucket, name, fp, root) for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, fp, root = batch.columns
            fps = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(batch.num_rows, -1)
            for t, positions in enumerate(tables):
                bits = np.full((len(fps), 1), t, np.uint64)
                if positions:
                    at = np.array(positions, np.uint64)
                    bits = np.concatenate([bits, fps[:, at // 64] >> at % np.uint64(64) & np.uint64(1)], axis=1)
                key = np.zeros(len(fps), np.uint64)
                for column in bits.T:
                    key = mix64(key + column + np.uint64(_STEP))
                yield batch_of(pa.schema(_PLACE), bucket=key.view(np.int64), name=name, fp=fp, root=root)

    return run


def near_groups(left: np.ndarray, right: np.ndarray | None, roots: np.ndarray, radius: int, step: int = 256) -> np.ndarray:
    """For each fingerprint the number of its group, -1 for none: groups are connected by pairs of different roots within ``radius``,
    inside ``left``, or between ``left`` and ``right``.

    Rows and their ``roots`` are numbered through left, then right. Rows of the most frequent root are not compared with each other.
    """
    own = right is None
    other = left if right is None else right
    shift = 0 if own else len(left)
    out = np.full(len(roots), -1)
    values, at, count = np.unique(roots, return_inverse=True, return_counts=True)
    if len(values) < 2:
        return out
    asked = np.nonzero(at[: len(left)] != count.argmax())[0] if own else np.arange(len(left))
    planes = planes_of(other)
    for some in (asked[i : i + step] for i in range(0, len(asked), step)):
        rows, near = within_radius(left[some], planes, len(other), radius)
        if len(rows):
            hit = np.unpackbits(np.ascontiguousarray(near).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, : len(other)].astype(bool)
            hit &= roots[shift:][None, : len(other)] != roots[some[rows]][:, None]
            for i in np.nonzero(hit.any(axis=1))[0]:
                group = np.append(np.nonzero(hit[i])[0] + shift, some[rows[i]])
                known = np.unique(out[group])
                if known[0] < 0:
                    known = known[1:]
                first = known[0] if len(known) else group[-1]
                if len(known) > 1:
                    out[np.isin(out, known[1:])] = first
                out[group] = first
    return out


def near_rows(left: np.ndarray, right: np.ndarray | None, roots: np.ndarray, radius: int, step: int = 256) -> np.ndarray:
    """Which fingerprints have one of another root within ``radius``."""
    return near_groups(left, right, roots, radius, step) >= 0


def _near(radius: int):
    schema = pa.schema([("pair", pa.int64()), ("name", pa.string()), ("root", pa.int64()), ("side", pa.bool_())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # by name, so that a group has one order and one number wherever it is found
        rows.sort(key=lambda r: (r[3], r[0]))
        names, prints, roots, sides = zip(*rows, strict=True)
        fps, n = np.frombuffer(b"".join(prints), "<u8").reshape(len(rows), -1), len(rows) - sum(sides)
        group = near_groups(fps[:n], fps[n:] if n < len(rows) else None, np.array(roots), radius) if n else np.full(len(rows), -1)
        keep = np.nonzero(group >= 0)[0]
        keep = keep[np.argsort(group[keep], kind="stable")]
        cuts = np.nonzero(np.diff(group[keep], prepend=-1))[0]
        pairs: list[int] = []
        for part in np.split(keep, cuts[1:]):
            said = "".join(f"{names[i]}{sides[i]:d}" for i in part)
            pairs += [xxhash.xxh3_64_intdigest(said) - (1 << 63)] * len(part)
        return batch_of(schema, pair=pairs, name=[names[i] for i in keep], root=[roots[i] for i in keep], side=[sides[i] for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield solve(held)
                    now, held = key, []
                held.append(row)
        if len(held) > 1:
            yield solve(held)

    return run


def _near_places(places: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (pair, name, root, side) of names with a fingerprint within SET_RADIUS in a bucket, of another component; a ``pair`` is
    a group connected by such fingerprints, in two blocks or one, and comes once in however many buckets it is found.

    Buckets are those of ``places`` (bucket, name) that hold two components and those of fingerprint bits, which take every
    name of ``firsts`` (name, fp). A written table.
    """
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = materialise(_rooted(firsts.select("name", "fp"), labels).select("name", "fp", F.xxhash64("root").alias("root")), "named")
    rows = materialise(_rooted(places, labels), "rooted")
    mixed = rows.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("bucket")
    bands = join_hot(rows, mixed, "bucket", "name").select("bucket", "name").join(named, "name").select("bucket", "name", "fp", "root")
    tables = sample_tables(named.count(), 64 * SET_WORDS, SET_BITS, SET_MISS)
    rows = bands.unionByName(map_arrow(named, _bit_places(tables), "bucket long, name string, fp binary, root long"))
    large = rows.groupBy("bucket").count().where(F.col("count") > SET_BLOCK).select("bucket", F.ceil(F.col("count") / SET_BLOCK).cast("int").alias("s"))
    large = materialise(large, "large")
    rows = rows.join(F.broadcast(large) if large.count() <= FEW_BUCKETS else large, "bucket", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("name"), F.col("s")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    # block pairs as in ``links``
    pair = F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))
    rows = rows.select(pair.alias("pair"), "name", "fp", "root", (F.col("i") > F.col("j")).alias("side"))
    near = map_arrow(rows.repartition(n, "pair").sortWithinPartitions("pair"), _near(SET_RADIUS), "pair long, name string, root long, side boolean")
    return materialise(near.distinct(), "near_places")


def _rest_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of alike names of different components in the block pairs of ``rows`` (pair, name, root, side)."""
    dealt = rows.join(sets, "name").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair").sortWithinPartitions("pair")
    return map_arrow(dealt.select("pair", "name", "root", "side", "shingles"), _rest, "u string, v string")


def likeness_components(keyed: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(id, name, component_id, count) of each distinct shingle set of ``keyed`` (key, text): components over pairs whose shingle sets have a likeness of LIKE or more.

    Fingerprints and minimum hashes only propose pairs; each pair is decided by both exact sets of 64-bit shingle
    hashes. First texts meet leaders of their buckets of minimum hashes, which connects large groups with few pairs; then the
    fingerprints of all pairs of a bucket, of minimum hashes or fingerprint bits, that are not yet connected are compared, and the
    sets of those within SET_RADIUS.
    """
    with passing_tables() as keep:
        rows = materialise(map_arrow(keyed.select(F.col("key").alias("id"), "text"), _sketches(shingle, seed), f"id {keyed.schema['key'].dataType.simpleString()}, name string, fp binary, bands array<long>"), "sketches")
        firsts = materialise(rows.groupBy("name").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
        spread = firsts.select("name", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "name")
        shared = materialise(spread.groupBy("bucket").count().where("count > 1"), "buckets")
        places = materialise(join_hot(spread, shared.select("bucket"), "bucket", "name", shared), "places")

        def sets_of(names: DataFrame) -> DataFrame:
            wanted = names.join(firsts, "name").select("name", F.col("first").alias("key"))
            texts = keyed.join(wanted, "key").select("name", "text").dropDuplicates(["name"])
            return materialise(map_arrow(texts, _sets(shingle, seed), "name string, shingles binary"), "sets")

        sets = sets_of(places.select("name").distinct())
        near = materialise(_alike_pairs(_leader_pairs(places, None, 0), sets), "near")
        for i in range(1, ROUNDS):
            near = near.unionByName(materialise(_alike_pairs(_leader_pairs(places, components(near), i), sets), "near"))
        close = _near_places(places, firsts, components(near))
        sets = sets.unionByName(sets_of(close.select("name").distinct().join(sets.select("name"), "name", "left_anti")))
        more = materialise(_rest_links(close, sets), "more")
        labels = components(near.unionByName(more))
        joined = materialise(_rooted(firsts.select("name", "first"), labels), "roots")
        keep(rows, joined)
    heads = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    copies = rows.groupBy("id").count()
    return join_hot(joined, heads, "root", "name").select(F.col("first").alias("id"), "name", "component_id").join(copies, "id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least id, then text hash.

    Texts are linked exactly if their sets of five-word shingles have a Jaccard likeness of 0.8 or more. Pairs are proposed by
    fingerprints; one at 0.8 meets in a bucket of minimum hashes with a chance of 0.9999, a likelier one with more, and in one of
    fingerprint bits besides, whatever the number of texts.
    Null and blank texts are one group. Rows with one id and text are copies; of those whose other columns differ the one with
    the least hash of all columns stays. No rows: no rows.
    """
    low = -(1 << 63)
    keyed = docs.select(F.struct(F.coalesce(docs[id_col].cast("long"), F.lit(low)).alias("k"), F.xxhash64(text_of(docs, text_col)).alias("h")).alias("key"), text_of(docs, text_col).alias("text"))
    heads = likeness_components(keyed, shingle).where("id = component_id")
    heads = materialise(heads.select("id.k", "id.h", "count"), "heads")
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(low)).alias("k"), F.xxhash64(text_of(docs, text_col)).alias("h"))
    kept = tagged.join(heads.select("k", "h"), ["k", "h"], "left_semi")
    if heads.where("count > 1").limit(1).count():
        kept = kept.groupBy("k", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")
