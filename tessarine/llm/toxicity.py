"""Toxicity: a counterfactual-regularised linear classifier.

A text is the set of its hashed words and word beginnings (first 4 to 8 bytes of longer words), A-Z lower-cased. A
logistic layer over the features that the labels speak for is trained by NumPy gradient descent. For every labelled
text that mentions an identity term, its sentences are repeated with the term swapped for other terms of the
list, and the squared change of the logit is part of the loss: what is left of a term's weight is what all terms
share, so a neutral mention of one group moves no score.

Swaps that change a text by the same features are one pair with a count, so every mention of every sampled text is part of
the penalty and the table of pairs is small: its size follows the terms, not the texts.

Scoring is a map over Arrow batches: no shuffle, whole texts, memory bounded by a piece of a text. A feature counts once a text,
so a score doesn't sink with length; the features of a long text's pieces are a set, so pieces score as the whole.

Defined results: null and empty texts have the offset's score; without labelled rows of both classes, and so for an empty table of labels, every score is
0.5; labels other than 0 and 1 are ignored; of several labels of a doc_id the larger counts, and of several texts the smallest is learned from; repeated
rows each have the same score; a null doc_id is not held out. Input columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._labelled import fold, sample, scored
from ._vec import ALNUM, LOWER, Words, buffers, pieces

THRESHOLD = 0.7
_U = np.uint64

#: Group names that are swapped for each other, language by language.
IDENTITY = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gay", "straight", "black", "white", "asian", "disabled", "old", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwule", "schwarze", "weiße", "alte", "junge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels", "noirs", "blancs", "vieux", "jeunes"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "gais", "negros", "blancos", "viejos", "jóvenes"),
)


def _hits(data: np.ndarray, offsets: np.ndarray):
    """Yields (row, 64-bit feature)."""
    w = Words(LOWER[data], offsets, ALNUM)
    row = w.row
    yield row, w.hashes()
    for n in (4, 5, 6, 7, 8):
        who, h = w.prefixes(n)
        yield row[who], h


@dataclass
class Model:
    keys: np.ndarray  # sorted features
    weights: np.ndarray
    offset: float

    def score(self, column: pa.Array, piece: int = 1 << 20) -> np.ndarray:
        data, offsets = buffers(column)
        n = len(self.keys)
        # 16 leading bits first: most words end there
        gate = np.zeros(1 << 20, bool)
        gate[(self.keys >> _U(44)).astype(np.int64)] = True
        total, seen = np.full(len(offsets) - 1, self.offset), [np.zeros(0, np.int64)]
        for row, part, at, _ in pieces(data, offsets, piece):
            for r, h in _hits(part, at):
                some = np.flatnonzero(gate[(h >> _U(44)).astype(np.int64)])
                r, h = r[some], h[some]
                i = np.minimum(np.searchsorted(self.keys, h), max(n - 1, 0))
                ok = self.keys[i] == h if n else np.zeros(0, bool)
                seen.append(np.unique((r[ok] + row) * n + i[ok]))
        pairs = np.unique(np.concatenate(seen))
        if n:
            np.add.at(total, pairs // n, self.weights[pairs % n])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def bag(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.unique(np.concatenate([h for _, h in _hits(data, np.array([0, len(data)]))]))


def swaps(text: str, identity: tuple[tuple[str, ...], ...] = IDENTITY, each: int = 2) -> list[tuple[str, str]]:
    """(sentence, the sentence with an identity term swapped) for each mention; `each` other terms, evenly spaced in the list."""
    out = []
    where = {t: (group, i) for group in identity for i, t in enumerate(group)}
    terms = re.compile(r"\b(" + "|".join(sorted(map(re.escape, where), key=len, reverse=True)) + r")\b", re.I)
    for sentence in re.split(r"(?<=[.!?\n])\s*", text):
        for m in terms.finditer(sentence):
            group, i = where[m[0].lower()]
            for k in range(1, min(each, len(group) - 1) + 1):
                other = group[(i + k * max(1, len(group) // (each + 1))) % len(group)]
                if other != m[0].lower():
                    out.append((sentence, sentence[: m.start()] + other + sentence[m.end() :]))
    return out


def changes(texts: list[str], identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Counter:
    """(features that a swap takes away, features that it adds) -> how many swaps of the texts' sentences do so."""
    out: Counter = Counter()
    for t in texts:
        for a, b in swaps(t, identity):
            a, b = bag(a), bag(b)
            out[tuple(np.setdiff1d(a, b).tolist()), tuple(np.setdiff1d(b, a).tolist())] += 1
    return out


def fit(texts: list[str], y: np.ndarray, identity: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = 1.0, epochs: int = 800, rate: float = 0.5, least: int = 3, beyond: float = 4.0) -> Model:
    """penalty: weight of the squared logit change over swaps; least: texts a feature must be in; beyond: standard errors between the classes' shares of a feature."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, _U), np.zeros(0), 0.0)
    bags = [bag(t) for t in texts]
    every, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    keys, code = np.unique(every, return_inverse=True)
    pos, neg = (np.bincount(code[y[owner] == c], minlength=len(keys)) for c in (1, 0))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    # features whose share differs between the classes beyond chance
    rate1, rate0, pool = pos / n1, neg / n0, (pos + neg) / (n1 + n0)
    z = (rate1 - rate0) / np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((pos + neg >= least) & (np.abs(z) > beyond))
    new = np.full(len(keys), -1)
    new[good] = np.arange(len(good))
    keep = new[code] >= 0
    col, row = new[code[keep]], owner[keep]
    m = len(good)
    found = changes(texts, identity)
    times = np.array(list(found.values()), float)
    pr, pc, pv = [], [], []
    for i, (gone, new) in enumerate(found):
        for side, sign in ((gone, 1.0), (new, -1.0)):
            side = np.array(side, _U)
            at = np.searchsorted(keys[good], side)
            at = at[(at < m) & (keys[good][np.minimum(at, m - 1)] == side)] if m else at[:0]
            pr += [i] * len(at)
            pc += at.tolist()
            pv += [sign] * len(at)
    pr, pc, pv = np.array(pr, np.int64), np.array(pc, np.int64), np.array(pv)
    w, b = np.zeros(m), float(np.log(n1 / n0))
    speed, speed_b = np.full(m, 1e-8), 1e-8
    # both classes weigh alike
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    b = 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -40, 40)))
        err = (p - y) * weight
        g = np.bincount(col, err[row], m) + 1e-5 * w
        if len(pr):
            gap = np.bincount(pr, pv * w[pc], len(times)) * times
            g += penalty * 2 / times.sum() * np.bincount(pc, pv * gap[pr], m)
        speed += g * g
        speed_b += err.sum() ** 2
        w -= rate * g / np.sqrt(speed)
        b -= rate * err.sum() / np.sqrt(speed_b)
    live = np.abs(w) > 1e-3
    return Model(keys[good][live], w[live], b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, max_rows: int = 8000, max_chars: int = 30_000, **how) -> Model:
    """Fit on at most max_rows labelled texts of at most max_chars characters each, none of fold `held`."""
    return fit(*sample(docs, labels, label, fold("doc_id", folds) != held, max_rows, max_chars), **how)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model.score, "score").select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
