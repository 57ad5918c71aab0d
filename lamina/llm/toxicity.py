"""Toxicity by a small convolutional network in numpy.

Words are hashed, and hashes that several training rows share have a row of an embedding table; all others
share the zero row. Filters of widths one to three slide over the words, each filter's largest response
over the whole text is kept, and a logistic layer gives the score. Training is Adam with
hand-written gradients on a bounded labelled sample, some words left out at random in each step. Networks that have not seen a third of the
rows score it; those scores fit the calibration curve and each language's threshold, with a common one for the
rest, so no label is kept from the network that is used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import batch_of, map_arrow, text_of, texts_in
from lamina.llm.learn import Logistic, folds_of, held_out, labelled_texts, mapped

#: Labelled rows of each class, at most, and the characters that they hold together.
SAMPLE, CHARS = 3000, 1 << 24
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
#: Training rows that must hold a word before it has an embedding, and the most words that have one.
SEEN, WORDS = 3, 1 << 16
STEPS, BATCH, RATE, FOLDS = 400, 64, 0.01, 3
#: Share of words left out in a step, weight decay, and the embeddings' share of the rate and pull to their start (over the rows).
DROP, DECAY, EMB_RATE, PRIOR = 0.2, 0.001, 0.5, 1.0
#: Words whose responses are held at once when scoring.
CHUNK = 1 << 16
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»“”‘’…–—"


def hash_of(word: str) -> int:
    """crc32 of the word in lower case without outer punctuation."""
    return zlib.crc32((word.strip(_STRIP) or word).encode("utf-8", "surrogatepass"))


def hashes_of(text: str) -> np.ndarray:
    return np.fromiter(map(hash_of, text.lower().split()), np.uint32)


def index_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Embedding rows of hashes."""
    if not len(known):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0).astype(np.int32)


class Rows(dict):
    """Word -> embedding row, with the words met so far kept; row 0 is padding and every unknown word."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = {int(h): i + 1 for i, h in enumerate(known)}

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        row = self.known.get(hash_of(word), 0)
        if len(word) <= 64:
            self[word] = row
        return row

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.lower().split()), np.int32)


def squeeze(rows: np.ndarray) -> np.ndarray:
    """Without the words of longer stretches of unknown words that no window of known ones reaches: each response stays."""
    zero = rows == 0
    most = max(WIDTHS)
    if len(rows) <= most:
        return rows
    keep = np.ones(len(rows), bool)
    keep[most:] = ~np.logical_and.reduce([zero[most - i : len(rows) - i] for i in range(most + 1)])
    return rows[keep]


def evidence(docs: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """For each word (1 to n) the signed root of its likelihood ratio statistic: how surely toxic rows have it more often."""
    flat = [np.unique(d[d > 0]) for d in docs]
    rows = np.concatenate(flat) if flat else np.zeros(0, int)
    bad = np.concatenate([np.full(len(f), k) for f, k in zip(flat, y, strict=True)]) if flat else np.zeros(0)
    count, hits = np.bincount(rows, minlength=n + 1)[1:], np.bincount(rows, weights=bad, minlength=n + 1)[1:]
    na, nb = max(y.sum(), 1), max((1 - y).sum(), 1)
    p = np.clip(count / (na + nb), 1e-12, 1 - 1e-12)
    term = lambda k, m, q: k * np.log(np.maximum(k, 1e-9) / (m * q))
    g = term(hits, na, p) + term(na - hits, na, 1 - p) + term(count - hits, nb, p) + term(nb - count + hits, nb, 1 - p)
    return np.sign(hits / na - (count - hits) / nb) * np.sqrt(np.maximum(2 * g, 0))


def lay_out(pieces: list[np.ndarray], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces one after the other, and for reduceat the first and past-last of each piece's ``counts`` window starts.

    Each piece ends with enough padding that none of its windows reaches the next.
    """
    starts = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
    return np.concatenate(pieces), np.stack([starts, starts + np.array(counts)], axis=1).ravel()


@dataclass
class Net:
    emb: np.ndarray
    filters: list[np.ndarray]  # width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    @classmethod
    def fresh(cls, found: np.ndarray, seed: int = 3) -> Net:
        """Random filters; the first embedding dimension starts as the words' evidence beyond what chance gives."""
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (len(found) + 1, DIM)).astype(np.float32)
        emb[1:, 0] = np.clip(np.sign(found) * np.maximum(np.abs(found) - 2.5, 0), -3, 6) / 2
        emb[0] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(emb, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.filters, *self.bias, self.out, self.out_bias]

    def responses(self, flat: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of the k-th width at each position of padded rows."""
        e = self.emb[flat]
        w = WIDTHS[k]
        n = len(flat) - w + 1
        r = e[:n] @ self.filters[k][0]
        for j in range(1, w):
            r += e[j : j + n] @ self.filters[k][j]
        return r

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter over the windows that start in each whole document.

        Works in chunks of bounded size; a chunk takes the words after it that its last windows need.
        """
        out = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        gap = np.zeros(max(WIDTHS) + 1, np.int32)
        held: list[np.ndarray] = []
        counts: list[int] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                flat, cuts = lay_out(held, counts)
                for k in range(len(WIDTHS)):
                    best = np.maximum.reduceat(self.responses(flat, k), cuts, axis=0)[::2]
                    np.maximum.at(out[:, k * FILTERS : (k + 1) * FILTERS], owner, best)

        for i, rows in enumerate(docs):
            for a in range(0, max(len(rows), 1), CHUNK):
                held.append(np.concatenate([rows[a : a + CHUNK + len(gap) - 1], gap]))
                counts.append(max(1, min(CHUNK, len(rows) - a)))
                owner.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    flush()
                    held, counts, owner, size = [], [], [], 0
        flush()
        for k in range(len(WIDTHS)):
            s = slice(k * FILTERS, (k + 1) * FILTERS)
            out[:, s] = np.maximum(out[:, s] + self.bias[k], 0)
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return (self.pooled(docs) @ self.out + self.out_bias[0]).astype(float) if docs else np.zeros(0)

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        gap = np.zeros(max(WIDTHS) + 1, np.int32)
        counts = [max(1, len(d)) for d in docs]
        flat, cuts = lay_out([np.concatenate([d, gap]) for d in docs], counts)
        at, feats = [], []
        for k in range(len(WIDTHS)):
            r = self.responses(flat, k)
            # docs x filters: where the largest response is, first of ties
            spots = np.stack([a + r[a:b].argmax(axis=0) for a, b in cuts.reshape(-1, 2)])
            at.append(spots)
            feats.append(np.maximum(r[spots, np.arange(FILTERS)] + self.bias[k], 0))
        h = np.hstack(feats)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -30, 30)))
        g = ((p - y) * weight / len(docs)).astype(np.float32)
        d_h = g[:, None] * self.out[None, :] * (h > 0)
        d_emb = np.zeros_like(self.emb)
        d_filters, d_bias = [], []
        for k, w in enumerate(WIDTHS):
            d = d_h[:, k * FILTERS : (k + 1) * FILTERS]
            d_bias.append(d.sum(0))
            df = np.zeros_like(self.filters[k])
            for j in range(w):
                rows = flat[at[k] + j]  # docs x filters
                df[j] = np.einsum("nfd,nf->df", self.emb[rows], d)
                np.add.at(d_emb, rows.ravel(), (d[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
            d_filters.append(df)
        d_emb[0] = 0
        return [d_emb, *d_filters, *d_bias, h.T @ g, np.array([g.sum()], np.float32)]


def fit(docs: list[np.ndarray], y: np.ndarray, found: np.ndarray, steps: int = STEPS, seed: int = 3) -> Net:
    net = Net.fresh(found, seed)
    if not len(docs):
        net.out[:] = 0
        return net
    rng = np.random.default_rng(seed)
    params, start = net.params(), net.emb.copy()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # both classes weigh alike
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        while len(order) < BATCH:
            order = np.append(order, rng.permutation(len(docs)))
        some, order = order[:BATCH], order[BATCH:]
        rate = RATE * (0.5 if step > 0.6 * steps else 1)
        seen = [np.where(rng.random(len(docs[i])) < DROP, 0, docs[i]) for i in some]
        rows = np.unique(np.concatenate(seen))  # only embeddings of words in the step move
        for j, (p, g, mm, vv) in enumerate(zip(params, net.gradients(seen, y[some], weight[some]), m, v, strict=True)):
            at = slice(None) if j else rows
            g = g[at] + (DECAY * p if j else PRIOR / len(docs) * (p[at] - start[at]))
            mm[at] += 0.1 * (g - mm[at])
            vv[at] += 0.01 * (g * g - vv[at])
            p[at] -= (rate if j else rate * EMB_RATE) * (mm[at] / (1 - 0.9**step)) / (np.sqrt(vv[at] / (1 - 0.99**step)) + 1e-7)
        net.emb[0] = 0
    return net


@dataclass
class ToxicityModel:
    known: np.ndarray
    net: Net
    curve: Logistic
    thresholds: dict[str, float]
    common: float

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.curve(self.net.logits(docs)[:, None])


def threshold(scores: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the best cuts by F1, where both classes have at least 20 rows; else the default."""
    if y.sum() < 20 or (1 - y).sum() < 20:
        return default
    cuts = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((scores >= c) & (y == 1)).sum() / max(1, (scores >= c).sum() + y.sum()) for c in cuts])
    return float(np.median(cuts[f1 == f1.max()]))


def learn(rows: list[np.ndarray], y: np.ndarray, langs: list[str | None], known: np.ndarray, default: float = 0.7) -> ToxicityModel:
    """The model of known word hashes, from rows of word places and their labels; languages only choose thresholds."""
    fold, logits = folds_of(y, FOLDS), np.zeros(len(y))
    make = lambda at: fit([rows[i] for i in at], y[at], evidence([rows[i] for i in at], y[at], len(known)))
    for k in range(FOLDS):
        own = np.nonzero(fold == k)[0]
        if len(own):
            logits[own] = make(np.nonzero(fold != k)[0]).logits([rows[i] for i in own])
    curve = Logistic(logits[:, None], y.astype(float), ridge=1e-3)
    scores = curve(logits[:, None])
    common = threshold(scores, y, default)
    of = np.array([x or "" for x in langs])
    own = {str(k): threshold(scores[of == k], y[of == k], common) for k in np.unique(of) if k}
    return ToxicityModel(known, make(np.arange(len(y))), curve, own, common)


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", lang_col: str | None = "lang", default: float = 0.7, chars: int = CHARS) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows and ``chars`` characters of each class, never on held-out rows. No labels: score 0.5.

    Words are counted on the executors, and only the places of known words reach the driver. The language only chooses a
    threshold; it is no input of a score.
    """
    found = labelled_texts(docs, labels, label, sample, chars, id_col, text_col, lang_col)
    schema = pa.schema([("hash", pa.int64())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in texts_in(b.column(0), step=100):
                for t in texts:
                    yield batch_of(schema, hash=np.unique(hashes_of(t)).astype(np.int64))

    counts = map_arrow(found.select("text"), words, "hash long").groupBy("hash").count().where(F.col("count") >= SEEN)
    top = counts.orderBy(F.col("count").desc(), "hash").limit(WORDS).collect()
    known = np.sort(np.array([r["hash"] for r in top], np.uint32))
    rows = mapped(found, lambda t: squeeze(index_of(hashes_of(t), known)).tobytes())
    return learn([np.frombuffer(r[3], np.int32) for r in rows], np.array([r[1] for r in rows], int), [r[2] for r in rows], known, default)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """Each row's whole text scored: (id, held_out, score, threshold), or with ``keep`` (row, score, threshold),
    row being the struct of every column of ``docs``. Null texts are empty; a text without words is all padding and is scored so.
    A null or unknown language takes the common threshold.
    """
    spark, names = docs.sparkSession, docs.columns
    packed = spark.sparkContext.broadcast(model)  # a fixed size: the network's
    lang = (docs[lang_col].cast("string") if lang_col in names else F.lit(None).cast("string")).alias("lang")
    # with ``keep`` the text travels once, inside the row
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), lang) if keep else docs.select(F.col(id_col).alias("row"), lang, text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = packed.value
        rows = Rows(m.known)
        for b in batches:
            schema = pa.schema([("row", b.schema.field(0).type), ("score", pa.float64()), ("threshold", pa.float64())])
            for at, texts in texts_in(b.column(0), text_col) if keep else texts_in(b.column(2)):
                langs = b.column(1).slice(at, len(texts)).to_pylist()
                yield batch_of(schema, row=b.column(0).slice(at, len(texts)), score=m.scores([rows.of(t) for t in texts]), threshold=[m.thresholds.get(x, m.common) for x in langs])

    out = map_arrow(inner, run, f"row {inner.schema['row'].dataType.simpleString()}, score double, threshold double")
    if keep:
        return out
    return out.select(F.col("row").alias("id"), held_out(F.col("row")).alias("held_out"), "score", "threshold")
