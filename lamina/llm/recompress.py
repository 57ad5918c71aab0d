"""Exact removal of repeated word windows, found by recompression.

Rounds of recompression name runs of equal words and then pairs of neighbouring symbols: a symbol's
hash says whether it may take the left or the right place, and a left one followed by a right one becomes the
pair. A name is a hash of what it stands for, so it is the same in every document, and equal word sequences get equal symbols
except near their ends. For each symbol the rounds also keep the stretch of words that decided it; a
symbol whose stretch lies in a window stands in every copy of that window. A window that holds no such symbol
is its own symbol. So a window can only be repeated if all its symbols are shared by two documents,
and only those windows are looked up themselves, by 128 bits made of two independent hashes of each of their words.

Documents travel in packed batches, written once. Keys go to the task that owns them as sorted arrays,
one for each batch, and a bit for each key comes back: a key is sent once for each batch however many documents
hold it, so no group of copies gathers in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, materialise, mix64, text_of, word_lists

WINDOW = 13
#: A batch ends at so many bytes of text, or documents.
BATCH_BYTES, BATCH_DOCS = 4 << 20, 4096
#: Pair rounds, and the words at which a symbol takes no more part in them.
ROUNDS, FROZEN = 3, 4

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _A + mix64(b + _B))


@dataclass
class Symbols:
    """Names with the words [lo, hi) they stand for and the words [dlo, dhi) that decided them."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    dlo: np.ndarray
    dhi: np.ndarray


def recompress(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Symbols:
    """Runs, then ROUNDS rounds of pairs, over the concatenated words of documents [starts, ends).

    A symbol that would have had a neighbour outside its document depends on a word outside it.
    """
    n = len(words)
    if not n:
        z = np.zeros(0, np.int64)
        return Symbols(words, z, z, z, z)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    edge = doc[1:] != doc[:-1]
    # runs: one symbol for each maximal run; its bounds depend on the word before and after
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | edge
    lo = np.nonzero(new)[0]
    hi = np.append(lo[1:], n)
    k = hi - lo
    name = np.where(k > 1, pair_name(words[lo], k.astype(np.uint64)), words[lo])
    s = Symbols(name, lo, hi, lo - 1, hi + 1)
    for r in range(ROUNDS):
        m = len(s.name)
        kind = (mix64(s.name + np.uint64(r) * _C) >> np.uint64(40)).astype(np.int8) & 1  # 0: left, 1: right
        kind[s.hi - s.lo >= FROZEN] = 2
        same = doc[s.lo[1:]] == doc[s.lo[:-1]] if m > 1 else np.zeros(0, bool)
        joins = np.zeros(m, bool)  # with the next symbol
        joins[:-1] = (kind[:-1] == 0) & (kind[1:] == 1) & same
        joined = np.zeros(m, bool)  # with the one before
        joined[1:] = joins[:-1]
        dlo, dhi = s.dlo.copy(), s.dhi.copy()
        # one that stays alone depends on the neighbour that it might have joined
        alone = np.nonzero((kind == 0) & ~joins)[0]
        inner = alone[alone < m - 1]
        dhi[inner] = np.maximum(dhi[inner], s.dhi[inner + 1])
        dlo[inner] = np.minimum(dlo[inner], s.dlo[inner + 1])
        last = alone[~np.append(same, False)[alone]]
        dhi[last] = s.hi[last] + 1
        alone = np.nonzero((kind == 1) & ~joined)[0]
        inner = alone[alone > 0]
        dlo[inner] = np.minimum(dlo[inner], s.dlo[inner - 1])
        dhi[inner] = np.maximum(dhi[inner], s.dhi[inner - 1])
        first = alone[~np.append(False, same)[alone]]
        dlo[first] = s.lo[first] - 1
        a = np.nonzero(joins)[0]
        name, hi = s.name.copy(), s.hi.copy()
        name[a], hi[a] = pair_name(s.name[a], s.name[a + 1]), s.hi[a + 1]
        dlo[a], dhi[a] = np.minimum(s.dlo[a], s.dlo[a + 1]), np.maximum(s.dhi[a], s.dhi[a + 1])
        keep = ~joined
        s = Symbols(name[keep], s.lo[keep], hi[keep], dlo[keep], dhi[keep])
    return s


def window_hashes(words: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of each ``size`` consecutive words, by doubling; over document bounds it means nothing."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, span = mix64(words + _C), 1
    while span * 2 <= size:
        h, span = pair_name(h[: len(h) - span], h[span:]), span * 2
    return pair_name(h[:n], h[size - span : size - span + n] ^ np.uint64(size))


@dataclass
class Batch:
    """The words of a packed batch's documents that take part, with their windows and symbols."""

    ids: np.ndarray  # of the documents that take part
    index: np.ndarray  # their places in the batch
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    others: np.ndarray | None = None  # second hashes of the words

    def window_starts(self, size: int = WINDOW) -> np.ndarray:
        """Whether a window of a document starts at each word."""
        ok = np.zeros(len(self.words) + 1, np.int32)
        long = self.ends - self.starts >= size
        np.add.at(ok, self.starts[long], 1)
        np.add.at(ok, self.ends[long] - size + 1, -1)
        return np.cumsum(ok[:-1]) > 0

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(names, word place of each, windows' starts, the seed of each window).

        A window's seed is its highest symbol: the one for most words, then the largest name. Two
        copies of a window have the same symbols inside, so they have the same seed.
        """
        windows = np.nonzero(self.window_starts())[0]
        s = recompress(self.words, self.starts, self.ends)
        doc = self.doc_of(s.lo)
        first = np.maximum(s.dhi - WINDOW, self.starts[doc])
        last = np.minimum(s.dlo, self.ends[doc] - WINDOW)
        inside = (s.dlo >= self.starts[doc]) & (s.dhi <= self.ends[doc]) & (first <= last)
        order = np.nonzero(inside)[0]
        order = order[np.lexsort((s.name[order], (s.hi - s.lo)[order]))]
        first, count = first[order], (last - first + 1)[order]
        best = np.full(len(self.words), -1, np.int64)
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        np.maximum.at(best, at, np.repeat(np.arange(len(order)), count))
        best = best[windows]
        bare = np.nonzero(best < 0)[0]
        flag = np.zeros(len(order), bool)  # symbols that are a seed; their numbers are small, so nothing is sorted
        flag[best[best >= 0]] = True
        used = np.nonzero(flag)[0]
        seed = np.empty(len(windows), np.int64)
        seed[best >= 0] = (np.cumsum(flag) - 1)[best[best >= 0]]
        seed[bare] = len(used) + np.arange(len(bare))
        own = window_hashes(self.words)[windows[bare]] if len(bare) else np.zeros(0, np.uint64)
        return np.concatenate([s.name[order[used]], own]), np.concatenate([s.lo[order[used]], windows[bare]]), windows, seed


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Keeps so many bytes of a lane of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one, and text is read in slices of about so many bytes.
LONG_WORD, SLICE = 256, 4 << 20


def _hash_slice(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text start, and two independent hashes of each: of its length and its bytes, eight at a time."""
    data = np.frombuffer(b"".join((b" ", text, b" " * 8)), np.uint8)
    gap = _GAP[data]
    flips = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, size = flips[::2], flips[1::2] - flips[::2]
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    first, second = size.astype(np.uint64) * _A, size.astype(np.uint64) * _B
    some, at, left = np.arange(len(starts)), starts, size
    while len(some):
        lane = lanes[at] & _LOW[np.minimum(left, 8)]
        first[some] = mix64(first[some] + lane)
        second[some] = mix64((second[some] ^ lane) * _C)
        more = (left > 8) & (size[some] <= LONG_WORD)
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = data[starts[i] : starts[i] + size[i]].tobytes()
        first[i], second[i] = xxhash.xxh3_64_intdigest(word), xxhash.xxh64_intdigest(word, 0x5EED)
    return starts - 1, first, second


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a text start, and two independent hashes of each."""
    if len(text) <= SLICE:
        return _hash_slice(text)
    parts, at = [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not _GAP[text[end]]:
            end += 1
        starts, *hashes = _hash_slice(text[at:end])
        parts.append((starts + at, *hashes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """The task that owns a key; from other bits of its hash than those that sort it."""
    return (mix64(keys[:, 0] ^ _B) % np.uint64(owners)).astype(np.int64)


def sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys (rows of 64-bit words), and where in that order a new one begins."""
    order = np.argsort(keys[:, 0])
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:, 0] != k[:-1, 0]
    if keys.shape[1] > 1 and ((k[1:, 1:] != k[:-1, 1:]).any(axis=1) & ~new[1:]).any():
        # keys that begin alike and differ, which chance hardly brings: all words are sorted
        order = np.lexsort(keys.T[::-1])
        k = keys[order]
        new[1:] = (k[1:] != k[:-1]).any(axis=1)
    return order, new


def distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each with its least and largest document, and each row's place among them."""
    order, new = sorted_keys(keys)
    d = docs[order]
    at = np.nonzero(new)[0]
    place = np.empty(len(d), np.int64)
    place[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(d, at) if len(at) else d[:0]
    high = np.maximum.reduceat(d, at) if len(at) else d[:0]
    return keys[order[at]], low, high, place


_SENT = pa.schema([("owner", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("least", pa.binary())])
_BITS = pa.schema([("owner", pa.int64()), ("batch", pa.int64()), ("bits", pa.binary())])


def send(batch: int, keys: np.ndarray, least: np.ndarray | None, owners: int) -> Iterator[pa.RecordBatch]:
    """A batch's distinct keys as one row for each owner, sorted."""
    own = owner_of(keys, owners)
    order = np.argsort(own, kind="stable")
    keys, own = keys[order], own[order]
    low = None if least is None else least[order]
    at = np.nonzero(np.append(True, own[1:] != own[:-1]))[0] if len(own) else np.zeros(0, int)
    to = np.append(at[1:], len(own))
    if len(at):
        yield batch_of(_SENT, owner=own[at], batch=[batch] * len(at), keys=[keys[a:b].tobytes() for a, b in zip(at, to, strict=True)], least=[b"" if low is None else low[a:b].tobytes() for a, b in zip(at, to, strict=True)])


def received(keys: np.ndarray, owners: int, bits: dict[int, bytes]) -> np.ndarray:
    """The bits that came back, for the distinct sorted keys that were sent."""
    own = owner_of(keys, owners)
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    order = np.argsort(own, kind="stable")
    o = own[order]
    at = np.nonzero(np.append(True, o[1:] != o[:-1]))[0] if len(o) else np.zeros(0, int)
    for a, b in zip(at, np.append(at[1:], len(o)), strict=True):
        out[order[a:b]] = np.unpackbits(np.frombuffer(bits[int(o[a])], np.uint8), bitorder="little", count=b - a).astype(bool)
    return out


def _answer(smaller: bool, width: int):
    """For each sent key: whether another batch has a smaller document (or, else, has the key at all)."""

    def solve(owner: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        sizes = [len(k) // (8 * width) for _, k, _ in rows]
        k = np.frombuffer(b"".join(k for _, k, _ in rows), np.uint64).reshape(-1, width)
        order, new = sorted_keys(k)
        at = np.nonzero(new)[0]
        n = np.diff(np.append(at, len(k)))
        yes = np.empty(len(k), bool)
        if smaller:
            least = np.frombuffer(b"".join(x for _, _, x in rows), np.int64)
            yes[order] = np.repeat(np.minimum.reduceat(least[order], at), n) < least[order]
        else:
            yes[order] = np.repeat(n, n) > 1
        cuts = np.cumsum([0, *sizes])
        return batch_of(_BITS, owner=[owner] * len(rows), batch=[b for b, _, _ in rows], bits=[np.packbits(yes[cuts[i] : cuts[i + 1]], bitorder="little").tobytes() for i in range(len(rows))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            owners, ids, keys, least = (c.to_pylist() for c in b.columns)
            for o, i, k, x in zip(owners, ids, keys, least, strict=True):
                if o != now:
                    if held:
                        yield solve(now, held)
                    now, held = o, []
                held.append((i, k, x))
        if held:
            yield solve(now, held)

    return run


def exchange(sent: DataFrame, smaller: bool, width: int) -> DataFrame:
    """(batch, owners, bits) for each batch: one bit for each key, of ``width`` 64-bit words, that it sent."""
    spark = sent.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "owner").sortWithinPartitions("owner")
    bits = map_arrow(dealt, _answer(smaller, width), "owner long, batch long, bits binary")
    # a batch has at most one row for each owner, and not more than its keys
    return bits.groupBy("batch").agg(F.collect_list(F.struct("owner", "bits")).alias("got"))


_PACKED = pa.schema([("batch", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()), ("sums", pa.binary()), ("texts", pa.binary()), ("rest", pa.binary())])
#: Stands for no id: such documents neither lose words nor are a source.
_NONE = np.iinfo(np.int64).max


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, row) to packed batches; ``row`` is kept as it is."""
    zipper = zstandard.ZstdCompressor(level=3)
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32

    def out(part: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal number
        number += 1
        texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
        ids = np.array([_NONE if i is None else i for i in part.column(0).to_pylist()], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        sink = pa.BufferOutputStream()
        rest = pa.RecordBatch.from_arrays([part.column(2)], names=["row"])
        with pa.ipc.new_stream(sink, rest.schema) as writer:
            writer.write_batch(rest)
        sums = b"".join(xxhash.xxh3_128_digest(t) for t in texts)
        packed = zipper.compress(sizes.tobytes() + b"".join(texts))
        return batch_of(_PACKED, batch=[number], bytes=[int(sizes.sum())], ids=[ids.tobytes()], sums=[sums], texts=[packed], rest=[zipper.compress(sink.getvalue().to_pybytes())])

    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = sizes[at - 1] if at else 0
            end = min(at + BATCH_DOCS, max(at + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, side="right"))))
            yield out(b.slice(at, end - at))
            at = end


def texts_of(packed: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    cuts = 8 * n + np.cumsum(np.append(0, np.frombuffer(data, np.int64, n)))
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def load(ids: np.ndarray, texts: list[bytes], skip: np.ndarray) -> Batch:
    """The documents of a batch that take part: not skipped, and with an id."""
    index = np.nonzero(~skip & (ids != _NONE))[0]
    at, words, others = hash_words(b" ".join([texts[i] for i in index]))
    bounds = np.cumsum([0, *(len(texts[i]) + 1 for i in index)])
    cuts = np.searchsorted(at, bounds)
    return Batch(ids[index], index, words, cuts[:-1], cuts[1:], others)


def sum_keys(sums: bytes) -> np.ndarray:
    """The 128 bits of each text's sum as a key."""
    return np.frombuffer(sums, np.uint64).reshape(-1, 2)


def _bits(got) -> dict[int, bytes]:
    return {g["owner"]: g["bits"] for g in got or []}


def copies(ids: np.ndarray, sums: bytes, owners: int, got) -> np.ndarray:
    """Documents whose whole text a smaller document has."""
    take = np.nonzero(ids != _NONE)[0]
    out = np.zeros(len(ids), bool)
    keys, low, _, place = distinct_keys(sum_keys(sums)[take], ids[take])
    out[take] = received(keys, owners, _bits(got))[place] | (low[place] < ids[take])
    return out


def _send_sums(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, ids, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = np.frombuffer(ids, np.int64)
                keys, low, _, _ = distinct_keys(sum_keys(sums)[i != _NONE], i[i != _NONE])
                yield from send(batch, keys, low, owners)

    return run


def _send_seeds(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, ids, sums, texts, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = np.frombuffer(ids, np.int64)
                got = load(i, texts_of(texts, len(i)), copies(i, sums, owners, copy))
                yield from send(batch, np.unique(got.seeds()[0])[:, None], None, owners)

    return run


def _seed_places(got: Batch, owners: int, seed):
    """The batch's seeds and whether two documents share each."""
    seeds = got.seeds()
    keys, low, high, place = distinct_keys(seeds[0][:, None], got.doc_of(seeds[1]))
    return seeds, (received(keys, owners, _bits(seed)) | (low < high))[place]


def _windows(got: Batch, owners: int, seed):
    """Candidate windows of the batch: starts, then distinct 128-bit keys, least documents and places."""
    (_, _, windows, of), shared = _seed_places(got, owners, seed)
    starts = windows[shared[of]]
    docs = got.ids[got.doc_of(starts)]
    keys = np.stack([window_hashes(got.words)[starts], window_hashes(got.others)[starts]], axis=1) if len(starts) else np.zeros((0, 2), np.uint64)
    return starts, docs, *distinct_keys(keys, docs)


def _send_windows(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, ids, sums, texts, copy, seed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = np.frombuffer(ids, np.int64)
                got = load(i, texts_of(texts, len(i)), copies(i, sums, owners, copy))
                _, _, keys, low, _, _ = _windows(got, owners, seed)
                yield from send(batch, keys, low, owners)

    return run


def _finish(owners: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sums, texts, rest, copy, seed, window in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i = np.frombuffer(ids, np.int64)
                docs = texts_of(texts, len(i))
                copied = copies(i, sums, owners, copy)
                got = load(i, docs, copied)
                starts, of, keys, low, _, place = _windows(got, owners, seed)
                hit = starts[received(keys, owners, _bits(window))[place] | (low[place] < of)]
                cover = np.zeros(len(got.words) + 1, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                spans = {int(p): gone[a:e] for p, a, e in zip(got.index, got.starts, got.ends, strict=True)}
                n_words, n_removed, kept = [], [], []
                for p, text in enumerate(docs):
                    words = [w for part in word_lists(text) for w in part]
                    mask = spans.get(p)
                    n_words.append(len(words))
                    if copied[p] and len(words) >= WINDOW:
                        n_removed.append(len(words))
                        words = []
                    elif mask is not None and mask.any():
                        n_removed.append(int(mask.sum()))
                        words = [w for w, out in zip(words, mask.tolist(), strict=True) if not out]
                    else:
                        n_removed.append(0)
                    left = text if not n_removed[-1] and not digest else b" ".join(words)
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
                row = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all().combine_chunks().column(0).combine_chunks()
                row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
                schema = pa.schema([("row", row.type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
                for a in range(0, len(i), 1024):
                    s = slice(a, a + 1024)
                    yield batch_of(schema, row=row[s], n_words=n_words[s], n_removed=n_removed[s], kept=kept[s])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """(columns of ``keep``, n_words, n_removed, kept) for every row: its words without those in a window of
    13 words that a document with a smaller id also has. ``kept`` is the text itself where it lost
    nothing, else the words left, joined by a space; with ``digest`` the sha256 of the words left, so joined.

    Windows are judged on the input. Null and blank texts have no words. Documents without an id lose
    nothing and are no source. Rows with one id are no source for each other.
    """
    keep = [id_col] if keep is None else keep
    rows = df.select(df[id_col].cast("long").alias("id"), text_of(df, text_col).alias("text"), F.struct(*[df[c] for c in keep]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    packed = materialise(map_arrow(rows, _pack, "batch long, bytes long, ids binary, sums binary, texts binary, rest binary"), "packed")
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    # about two million keys for each owner at most: a word of text gives one key or fewer
    owners = int(max(64, total >> 23))
    wire, back = "owner long, batch long, keys binary, least binary", "got"

    def ask(sent: DataFrame, name: str, smaller: bool, width: int) -> DataFrame:
        return materialise(exchange(sent, smaller, width).select("batch", F.col(back).alias(name)), name)

    copy = ask(map_arrow(packed.select("batch", "ids", "sums"), _send_sums(owners), wire), "copy", True, 2)
    with_copy = packed.join(copy, "batch", "left")
    seed = ask(map_arrow(with_copy.select("batch", "ids", "sums", "texts", "copy"), _send_seeds(owners), wire), "seed", False, 1)
    with_seed = with_copy.join(seed, "batch", "left")
    window = ask(map_arrow(with_seed.select("batch", "ids", "sums", "texts", "copy", "seed"), _send_windows(owners), wire), "window", True, 2)
    every = with_seed.join(window, "batch", "left").select("ids", "sums", "texts", "rest", "copy", "seed", "window")
    done = map_arrow(every, _finish(owners, digest), f"row {kind}, n_words long, n_removed long, kept string")
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], "n_words", "n_removed", "kept")
