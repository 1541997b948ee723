"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: character 2- to 4-grams of its bytes, words, and pairs of neighbouring words (a
word that repeats its predecessor is one feature of its own, whatever the word). Each bucket has a learned vector; a
text is the average of its vectors, and a softmax layer gives the classes. Both are trained by NumPy stochastic gradient
descent over small batches of texts.

The average and the layer are linear, so for scoring each bucket's vector is multiplied with the layer once and kept as an
integer, in units of 2**-24. A text's score is then the mean of one number per feature, summed without rounding: it is the same to
the last bit whether a text is scored whole, in pieces or beside other texts. The model is one fixed table of 2**bits
integers. Scoring is a map over Arrow batches: no shuffle, whole texts; a text of several MB is read in pieces, each with what it takes of
the next one's first bytes and word, so memory is bounded by a piece and its longest word.

Defined results: null and empty texts have the score of the classes' offsets alone; without labelled rows of both
classes every score is 0.5, and so for empty tables of labels; labels other than 0 and 1 are ignored; of several labels of a doc_id the larger
counts, and of several texts the smallest is learned from; repeated rows each have the same score; a null doc_id is not held out. Input columns
other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._labelled import fold, sample, scored
from ._vec import SOLID, Words, buffers, mix, pieces

THRESHOLD = 0.3
#: Zero vectors averaged into every text, so that a handful of features decides nothing.
PADDING = 20
UNIT = float(1 << 24)
_U = np.uint64


def _features(data: np.ndarray, offsets: np.ndarray, bits: int, limit: int | None = None):
    """Yields (bucket of each feature, first feature of each row, features of each row). Of a piece, a single row, only what starts before limit counts."""
    shift = np.uint32(32 - bits)
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    n = len(data)
    limit = n if limit is None else limit
    gram = wide[:n].copy()
    for size in (2, 3, 4):
        gram |= wide[size - 1 : n + size - 1] << np.uint32(8 * (size - 1))
        many = np.maximum(np.diff(offsets) - size + 1, 0)
        yield ((gram + np.uint32(size)) * np.uint32(2654435761)) >> shift, offsets[:-1], np.minimum(many, limit)
    w = Words(data, offsets, SOLID)
    h, own = w.hashes(), int(np.searchsorted(w.start, limit))
    yield (h >> _U(64 - bits)).astype(np.uint32), w.at[:-1], np.minimum(np.diff(w.at), own)
    if len(h):
        pair = mix(h[:-1] * _U(3) + h[1:])
        pair[h[:-1] == h[1:]] = _U(0x1234567 << 36)
        yield (pair >> _U(64 - bits)).astype(np.uint32), w.at[:-1], np.minimum(np.maximum(np.diff(w.at) - 1, 0), own)


@dataclass
class Model:
    table: np.ndarray  # bucket -> logit in units of 2**-24
    offset: float
    bits: int

    def score(self, column: pa.Array, piece: int = 1 << 20) -> np.ndarray:
        data, offsets = buffers(column)
        total, count = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        for row, part, at, limit in pieces(data, offsets, piece):
            rows = slice(row, row + len(at) - 1)
            for bucket, first, many in _features(part, at, self.bits, limit):
                sums = np.zeros(len(bucket) + 1, np.int64)
                np.cumsum(self.table[bucket], out=sums[1:])
                first = np.minimum(first, len(bucket))
                total[rows] += sums[first + many] - sums[first]
                count[rows] += many
        return 1 / (1 + np.exp(-np.clip(total / UNIT / (count + PADDING) + self.offset, -40, 40)))


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and their shares."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    found = [bucket[first[0] : first[0] + many[0]] for bucket, first, many in _features(data, np.array([0, len(data)]), bits)]
    ids, count = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), (count / (count.sum() + PADDING)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, bits: int = 17, dim: int = 8, epochs: int = 6, least_texts: int = 12_000, batch: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """epochs passes over the texts, and more where these are few, up to least_texts texts in all. The texts of a batch stay together; batches come in random order."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.int64), 0.0, bits)
    rng = np.random.default_rng(seed)
    # a batch is a matrix (texts, its buckets) of shares, kept as few bytes a feature
    order, batches = rng.permutation(len(texts)), []
    for a in range(0, len(order), batch):
        some = order[a : a + batch]
        bags = [bag(texts[i], bits) for i in some]
        ids, code = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
        batches.append((ids, code.astype(np.int32), np.repeat(np.arange(len(some), dtype=np.int16), [len(b[0]) for b in bags]), np.concatenate([b[1] for b in bags]), y[some]))
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, offset = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-least_texts // len(texts)))
    done, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            ids, code, row, share, want = batches[b]
            shares = np.zeros((len(want), len(ids)), np.float32)
            shares[row, code] = share
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            own = vectors[ids]
            x = shares @ own
            z = x @ layer + offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(want)), want] -= 1
            back = p @ layer.T
            layer -= lr * (x.T @ p)
            offset -= lr * np.float32(0.1) * p.sum(0)
            # shares are of the order of 1 / features; the step on vectors is scaled by their norm
            norm = np.maximum((shares * shares).sum(1, keepdims=True), 1e-6)
            vectors[ids] = own - (lr * np.float32(0.05)) * (shares.T @ (back / norm))
    line = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64)
    return Model(np.round(line * UNIT).astype(np.int64), float(offset[1] - offset[0]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, max_rows: int = 5000, max_chars: int = 50_000) -> Model:
    """Fit on at most max_rows labelled texts of at most max_chars characters each, none of fold `held`."""
    return fit(*sample(docs, labels, label, fold("doc_id", folds) != held, max_rows, max_chars))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model.score, "score").select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
