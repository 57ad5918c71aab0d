"""BPE encoding and decoding of whole texts in Spark.

A text of more than ``PART`` characters is cut in halves, wherever the middle falls, until no part is longer. The parts are
rows of their own and encoded in parallel. At each join a window around the cut is encoded again: it grows on either side
to the next white space, where both sides agree, as no token of this pre-tokenizer spans white space. A run
of ``LEAF`` characters without white space is a part of its own: its words are cut in leaves of letters, encoded in
parallel and joined in a tree of neighbours, each join re-encoding growing windows of tokens until both sides agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, text_of
from lamina.llm.wordbpe import LEAF, WordEncoder, encoder

#: A text of more characters is cut in halves; at least twice LEAF, so that a part without white space lies in a long run.
PART = 4 * LEAF
_SPACE = " \t\n\x0b\x0c\r"
_LONG_RUN = re.compile(rf"[^{_SPACE}]{{{LEAF},}}")


def _strings(names: list[str]):
    """Form of a word's ids: how many, as decimal text, and decoded."""

    def form(ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids])

    return form


def _names(path: str) -> list[str]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]


def _encoder(path: str, kind: str) -> WordEncoder:
    return encoder(path, kind, tuple if kind == "ids" else _strings(_names(path)))


def _cached(path: str, kind: str) -> WordEncoder:
    from lamina.llm import wordbpe

    return wordbpe._encoders.get((path, kind)) or _encoder(path, kind)


def cuts_of(n: int, part: int = PART) -> list[int]:
    """Bounds of the parts of n characters: halves of halves, none longer than ``part``."""
    parts = 1
    while -(-n // parts) > part:
        parts *= 2
    return [i * n // parts for i in range(parts + 1)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Ids:
    """Gathers the ids of a whole text in order."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)

    def result(self) -> tuple:
        return (np.concatenate(self.parts).tolist() if self.parts else [],)


class Digest:
    """Hashes the decimal ids and the decoded text of a whole text, part by part."""

    def __init__(self, form) -> None:
        self.form, self.n, self.ids, self.decoded = form, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.take([self.form(ids.tolist())])

    def take(self, formed: list) -> None:
        formed = [p for p in formed if p[0]]
        if formed:
            gap = " " if self.n else ""
            self.ids.update(_bytes(gap + " ".join([p[1] for p in formed])))
            self.decoded.update(_bytes(gap + " ".join([p[2] for p in formed])))
            self.n += sum([p[0] for p in formed])

    def result(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def to_binary(ids: list[int] | np.ndarray) -> bytes:
    """Ids in two bytes each, where they fit, else in four; the first byte tells."""
    ids = np.asarray(ids, np.int64)
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    return kind[2].encode() + ids.astype(kind).tobytes()


def from_binary(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int32)


_OUT = {
    True: ("n_tokens long, ids_sha256 string, decoded_sha256 string", [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    False: ("ids array<int>", [("ids", pa.list_(pa.int32()))]),
}
#: A part: a stretch of text (word null), or a leaf of the letters of a long word (``last`` ends the word), or a special token's id.
_PART = [("key", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("word", pa.int64()), ("last", pa.bool_()), ("special", pa.int32())]
_PART_SQL = "key long, seq long, text string, word long, last boolean, special int"
#: An encoded part: ids, and for a stretch what comes before its first white space and after its last.
_DONE = [("key", pa.int64()), ("seq", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("coded", pa.binary()), ("word", pa.int64()), ("last", pa.bool_())]
_DONE_SQL = "key long, seq long, head string, tail string, coded binary, word long, last boolean"


def parts_of(enc: WordEncoder, text: str) -> Iterator[tuple]:
    """(text, word, last, special) of each part of a long text, in order."""
    at = word = 0
    for m in [*_LONG_RUN.finditer(text), None]:
        some = text[at : m.start() if m else len(text)]
        if some:
            cuts = cuts_of(len(some))
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield some[a:b], None, None, None
        if not m:
            return
        at = m.end()
        run, done = m[0], 0
        for special in [*enc.specials.finditer(run), None]:
            normal = enc.tokenizer.normalizer.normalize_str(run[done : special.start() if special else len(run)])
            for w, _ in enc.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if normal else ():
                word += 1
                for c in range(0, len(w), LEAF):
                    yield w[c : c + LEAF], word, c + LEAF >= len(w), None
            if special:
                word += 1
                yield None, word, True, enc.special_ids[special[0]]
                done = special.end()


def _rows(schema: pa.Schema, ids: pa.Array, where: list[int], rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(schema, id=ids.take(pa.array(where)), **dict(zip(schema.names[1:], zip(*rows, strict=True), strict=True)))


def _cut(path: str, digest: bool):
    """Texts are numbered; a short one is encoded at once (seq null) and a long one gives its parts."""
    out = _OUT[digest][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _cached(path, "strings" if digest else "ids")
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 40
        for batch in batches:
            ids = batch.column(0)
            schema = pa.schema([("id", ids.type), *_PART, *out])
            for at in range(0, batch.num_rows, 256):
                where, rows = [], []
                for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist(), at):
                    key += 1
                    if len(text) <= PART:
                        where.append(i)
                        rows.append((key, None, None, None, None, None, *_short(enc, text, digest)))
                        continue
                    for seq, part in enumerate(parts_of(enc, text)):
                        where.append(i)
                        rows.append((key, seq, *part, *[None] * len(out)))
                        if len(rows) >= 256:
                            yield _rows(schema, ids, where, rows)
                            where, rows = [], []
                if rows:
                    yield _rows(schema, ids, where, rows)

    return run


def _short(enc: WordEncoder, text: str, digest: bool) -> tuple:
    if digest:
        got = Digest(enc.form)
        got.take(enc.parts(text))
        return got.result()
    return ([i for p in enc.parts(text) for i in p],)


def split_part(text: str) -> tuple[str, str | None, str | None]:
    """(before the first white space, between, after the last one); the last two are None where there is none."""
    a = next((m.start() for m in re.finditer(f"[{_SPACE}]", text)), None)
    if a is None:
        return text, None, None
    b = max(text.rfind(c) for c in _SPACE)
    return text[:a], text[a : b + 1], text[b + 1 :]


def _leaves(path: str, digest: bool):
    """Encode each part: a stretch but for its outermost pieces of words, a leaf as letters of an unfinished word."""
    out = _OUT[digest][1]

    def encode(enc: WordEncoder, seq, text, word, last, special) -> tuple:
        if seq is None:
            return None, None, None
        if special is not None:
            return None, None, to_binary([special])
        if word is not None:
            return None, None, to_binary(enc.bpe.tree(text, last))
        head, middle, tail = split_part(text)
        return head, tail, to_binary([i for p in enc.parts(middle or "") for i in p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _cached(path, "ids")
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), *_DONE, *out])
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                key, seq, text, word, last, special = some.columns[1:7]
                made = [encode(enc, *row) for row in zip(*(c.to_pylist() for c in (seq, text, word, last, special)), strict=True)]
                head, tail, coded = (list(c) for c in zip(*made, strict=True))
                yield batch_of(schema, id=some.column(0), key=key, seq=seq, head=head, tail=tail, coded=coded, word=word, last=last, **{n: c for (n, _), c in zip(out, some.columns[7:], strict=True)})

    return run


def _joins(path: str, digest: bool):
    """Join the parts of each text, which come in order; one text's open word and one part are held at a time."""
    out = _OUT[digest][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _cached(path, "ids")
        form = _strings(_names(path)) if digest else None
        now, got, window, leaves, owner = None, None, "", [], None

        def close_window() -> None:
            nonlocal window
            if window:
                got.add(np.array([i for p in enc.parts(window) for i in p], np.int32))
            window = ""

        def finish() -> pa.RecordBatch:
            close_window()
            return batch_of(pa.schema([("id", owner.type), *out]), id=owner, **{n: [v] for (n, _), v in zip(out, got.result(), strict=True)})

        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), *out])
            short = batch.filter(pc.is_null(batch.column(2)))
            if short.num_rows:
                yield batch_of(schema, id=short.column(0), **{n: c for (n, _), c in zip(out, short.columns[8:], strict=True)})
            for i in np.nonzero(pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False))[0].tolist():
                key, _, head, tail, coded, word, last = (batch.column(c)[i].as_py() for c in range(1, 8))
                if key != now:
                    if now is not None:
                        yield finish()
                    now, got, leaves, owner = key, Digest(form) if digest else Ids(), [], batch.column(0).slice(i, 1)
                if word is None:
                    window += head
                    if tail is not None:
                        close_window()
                        got.add(from_binary(coded))
                        window = tail
                    continue
                close_window()
                leaves.append(from_binary(coded).tolist())
                if last:
                    got.add(np.array(enc.bpe.join_all(leaves), np.int32))
                    leaves = []
        if now is not None:
            yield finish()

    return run


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, ids array<int>) for each row's whole text, as the tokenizers library encodes it without added
    special tokens; with ``digest`` (id, n_tokens, ids_sha256, decoded_sha256) instead, where the hashed
    strings are the decimal ids and the decoded text.

    Null and empty texts give no tokens. Each row gives one row, repeated rows and null ids included;
    other columns play no part. No rows: no rows. The input is read once.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = _OUT[digest][0]
    rows = df.select(F.col(id_col).alias("id"), text_of(df, text_col).alias("text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = map_arrow(rows, _cut(path, digest), f"id {kind}, {_PART_SQL}, {out}").repartition(n, "key", "seq")
    done = map_arrow(cut, _leaves(path, digest), f"id {kind}, {_DONE_SQL}, {out}").repartition(n, "key").sortWithinPartitions("key", "seq")
    return map_arrow(done, _joins(path, digest), f"id {kind}, {out}")


def bpe_decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the library's decode of each row's ids, special tokens kept. Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _cached(path, "ids").tokenizer
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("text", pa.string())])
            yield batch_of(schema, id=batch.column(0), text=[tokenizer.decode(i or [], skip_special_tokens=False) for i in batch.column(1).to_pylist()])

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {df.schema[id_col].dataType.simpleString()}, text string")
