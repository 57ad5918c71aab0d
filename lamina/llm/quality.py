"""Quality by compression: dictionaries of good and bad text, calibrated size differences.

Two zstandard dictionaries are built from labelled good and bad text. A whole text is compressed with
each; the difference of the sizes over the larger one, and the size over the text's length, go through a
logistic curve fitted on other labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, text_of, texts_in
from lamina.llm.learn import Logistic, held_out, labelled_texts, mapped

#: Labelled rows of each class, at most, and the characters that they hold together; half of the rows build the dictionaries, half calibrate.
SAMPLE, CHARS = 3000, 1 << 24
PIECE = 2048
DICTIONARY, LEVEL = 65536, 3


def build_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the texts; with too few for the trainer, their plain content."""
    parts = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    total = sum(map(len, parts))
    if total >= 10 * 1024 and len(parts) >= 16:
        try:
            return zstandard.train_dictionary(min(size, total // 4), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[-size:] or b"\n" * 8


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


class Sizes:
    """Features of a whole text from its two compressed sizes."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = compressor(good), compressor(bad)

    def __call__(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        n, g, b = len(data), len(self.good.compress(data)), len(self.bad.compress(data))
        d, r, size = (b - g) / max(b, g), min(b, g) / max(n, 1), np.log1p(n)
        return [d, r, size, d * size, r * size, r * r, d * r, size * size, d * d * np.sign(d)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    curve: Logistic


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", chars: int = CHARS) -> QualityModel:
    """Fit on whole labelled texts, at most ``sample`` rows and ``chars`` characters of each class, never on held-out rows.

    No labels: score 0.5.
    """
    found = labelled_texts(docs, labels, label, sample, chars, id_col, text_col)
    half = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2))
    texts = mapped(found.where(half == 0), lambda t: t.encode("utf-8", "surrogatepass"))
    good, bad = (build_dictionary([t for _, y, _, t in texts if y == k]) for k in (1, 0))
    made: list[Sizes] = []

    def features(text: str) -> bytes:
        if not made:
            made.append(Sizes(good, bad))
        return np.array(made[0](text)).tobytes()

    rows = mapped(found.where(half == 1), features)
    x = np.array([np.frombuffer(f) for *_, f in rows]).reshape(-1, 9)
    return QualityModel(good, bad, Logistic(x, np.array([r[1] for r in rows], float)))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Each row's whole text scored: (id, held_out, score), or with ``keep`` (row, score), row being the
    struct of every column of ``docs``.

    Null texts are empty; the empty text has the score of its features like any other. Repeated rows
    score alike; the id only tells whether the row is held out.
    """
    names = docs.columns
    # with ``keep`` the text travels once, inside the row
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("row")) if keep else docs.select(F.col(id_col).alias("row"), text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for b in batches:
            schema = pa.schema([("row", b.schema.field(0).type), ("score", pa.float64())])
            for at, texts in texts_in(b.column(0), text_col) if keep else texts_in(b.column(1)):
                yield batch_of(schema, row=b.column(0).slice(at, len(texts)), score=model.curve(np.array([sizes(t) for t in texts]).reshape(-1, 9)))

    out = map_arrow(inner, run, f"row {inner.schema['row'].dataType.simpleString()}, score double")
    if keep:
        return out
    return out.select(F.col("row").alias("id"), held_out(F.col("row")).alias("held_out"), "score")
