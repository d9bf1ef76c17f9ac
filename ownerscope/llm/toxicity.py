"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its 3- to 5-byte n-grams, hashed to 2 ** BITS vectors, so an unseen spelling shares most
of its vectors with the spellings it resembles. A stretch of words is the mean of its units' vectors, and a softmax over
two classes scores it. A document is as toxic as its most toxic stretch of STRETCH words: the mean over a long text would
drown one insult. Training picks each document's stretch the same way (multiple-instance learning) after a start on
random stretches. A word said several times on end counts once.
A run of more than LONGEST bytes without spaces is cut into overlapping pieces, each a word of the stretch, so none of its n-grams is lost. Because the softmax is linear in the mean, a trained word is one number and a count, which workers keep.

The model is fitted on at most ``most`` rows of each label, the smallest by a hash of the id; all texts are scored whole.

Defined results: null and empty texts, and texts without words, score like a stretch without units (the bias alone).
An empty table gives no rows; without labelled rows of both kinds every text scores 0. Repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import slices

BITS, DIM, STRETCH = 18, 8, 24
PAD = 300  # units that a shorter stretch is filled up to with zero vectors
REMEMBERED = 500_000
LONGEST, PIECE, OVERLAP = 64, 16, 4  # bytes; pieces share all but one byte of the longest n-gram, so each n-gram is in one

#: ASCII to lower case, other than letters and digits to spaces; bytes of other characters stay
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words, and the pieces of those longer than LONGEST."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step = PIECE - OVERLAP
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [w[i:i + PIECE] for i in range(0, len(w) - OVERLAP, step)])]


def units(word: bytes) -> list[int]:
    """Hashed units of a word: the whole and its n-grams with ends marked."""
    marked, mask = b"<" + word + b">", (1 << BITS) - 1
    n = len(marked)
    out = [zlib.crc32(marked) & mask]
    for size in (3, 4, 5):
        out += [zlib.crc32(marked[i:i + size]) & mask for i in range(n - size + 1)]
    return out


@dataclass
class Model:
    """One number per unit (its vector's part of the logit) and the bias."""

    weight: np.ndarray
    bias: float


def _best_stretch(f: np.ndarray, n: np.ndarray, stretch: int) -> tuple[float, int]:
    """The largest mean over ``stretch`` consecutive words and where it starts."""
    if len(f) <= stretch:
        return float(f.sum() / max(n.sum(), PAD)), 0
    a, b = np.concatenate([[0.0], np.cumsum(f)]), np.concatenate([[0.0], np.cumsum(n)])
    mean = (a[stretch:] - a[:-stretch]) / np.maximum(b[stretch:] - b[:-stretch], PAD)
    at = int(mean.argmax())
    return float(mean[at]), at


def train(texts: list[str], labels: list[int], epochs: int = 24, seed: int = 7, stretch: int = STRETCH) -> Model:
    """Fit the vectors and the softmax together by Adagrad on one stretch per document and step."""
    size = 1 << BITS
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), -30.0 if 1 not in labels else 0.0)
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = []
    for t in texts:
        own = np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64)
        docs.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    bags = [np.array(units(w), np.int64) for w in index]
    counts = np.array([len(b) for b in bags], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    y = np.array(labels, np.float64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    vectors = np.zeros((size, DIM), np.float64)
    soft = rng.normal(0, 1, (2, DIM))
    bias = np.zeros(2)
    seen, seen_soft, seen_bias = np.full(size, 1e-2), np.full((2, DIM), 1e-2), np.full(2, 1e-2)
    rate = 1.0
    for epoch in range(epochs):
        if epoch < 4:
            picks = [[int(rng.integers(0, max(len(d) - stretch, 0) + 1)) for _ in range(6)] for d in docs]
        else:
            part = (vectors @ (soft[1] - soft[0]))[flat]
            value = np.add.reduceat(part, starts[:-1]) if len(flat) else np.zeros(0)
            picks = [[_best_stretch(value[d], counts[d], stretch)[1]] for d in docs]
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            chosen = [(k, s) for k in order[at:at + 32] for s in picks[k]]
            members = [docs[k][s:s + stretch] for k, s in chosen]
            lengths = np.array([counts[m].sum() for m in members])
            own = np.concatenate([flat[starts[w]:starts[w + 1]] for m in members for w in m] or [np.zeros(0, np.int64)])
            row = np.repeat(np.arange(len(chosen)), lengths)
            mean = np.zeros((len(chosen), DIM))
            for d in range(DIM):
                mean[:, d] = np.bincount(row, vectors[own, d], len(chosen))
            mean /= np.maximum(lengths, PAD)[:, None]
            logits = mean @ soft.T + bias
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -60, 60)))
            target = y[[k for k, _ in chosen]]
            g = (p - target) * balance[[k for k, _ in chosen]] / len(chosen)
            grad_logits = np.stack([-g, g], 1)
            grad_mean = grad_logits @ soft
            grad_soft, grad_bias = grad_logits.T @ mean, grad_logits.sum(0)
            touched, place = np.unique(own, return_inverse=True)
            per_unit = (grad_mean / np.maximum(lengths, PAD)[:, None])[row]
            grad = np.stack([np.bincount(place, per_unit[:, d], len(touched)) for d in range(DIM)], 1)
            grad *= 100.0  # means over hundreds of units make small steps; vectors take larger ones
            seen[touched] += (grad ** 2).mean(1)
            vectors[touched] -= rate * grad / np.sqrt(seen[touched])[:, None]
            seen_soft += grad_soft ** 2
            soft -= 0.1 * grad_soft / np.sqrt(seen_soft)
            seen_bias += grad_bias ** 2
            bias -= 0.1 * grad_bias / np.sqrt(seen_bias)
    return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores of texts; remembers each word's sum and number of units, up to REMEMBERED words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, complex] = {}

    def _word(self, word: bytes) -> complex:
        u = units(word)
        return complex(float(self.model.weight[u].sum()), len(u))

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        values = list(map(known.get, words))
        if None in values:
            for k, v in enumerate(values):
                if v is None:
                    w = words[k]
                    v = known.get(w)
                    if v is None:
                        v = known[w] = self._word(w)
                    values[k] = v
        both = np.array(values, np.complex128)
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        best = _best_stretch(both.real, both.imag, STRETCH)[0] if len(both) else 0.0
        return 1 / (1 + float(np.exp(-np.clip(best + self.model.bias, -60, 60))))


_SCORERS: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One scorer per Python worker and model."""
    key = zlib.crc32(model.weight.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def sample(docs: DataFrame, labels: DataFrame, most: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``most`` labelled rows of each label with their texts. The chosen ids are at most 2 * most rows."""
    order = [F.xxhash64(F.col("_id").cast("string")), "_id"]
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("_label")).where("_id is not null")
    ids = known.where("_label = 1").orderBy(*order).limit(most).unionByName(known.where("_label = 0").orderBy(*order).limit(most))
    return docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(
        F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_id", "_text", "_label")


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of labelled rows."""
    rows = sorted(sample(docs, labels, most, id_col, text_col).dropDuplicates(["_id", "_label"]).collect(), key=lambda r: (r["_id"], r["_label"]))
    return train([r["_text"] or "" for r in rows], [int(r["_label"]) for r in rows])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of the documents."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in slices(batches, "text"):
            got = [own.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(got, pa.float64())], names=["doc", "score"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc {id_type}, score double").withColumnRenamed("doc", id_col)
