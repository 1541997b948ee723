import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarine.llm import _labelled, quality, toxicity
from tests.llm.fixtures import frame, odd_documents, prose, with_clashes

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n1, n0 = y.sum(), len(y) - y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def labelled():
    good = [(i, prose(i, 80), 1) for i in range(60)]
    bad = [(100 + i, " | ".join(prose(i, 60).split()).upper(), 0) for i in range(40)]
    return good + bad


M64 = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & M64
    return h ^ (h >> 29)


def word_hash(word):
    total, power = 0, 1
    for b in word:
        total = total + (b + 1) * power & M64
        power = power * 0x9E3779B97F4A7C15 & M64
    return total


def plain_quality(text, model):
    """The score by whole numbers, one feature after the other."""
    data, found = (text or "").encode(), []
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            gram = sum(data[i + k] << 8 * k for k in range(size))
            found.append(((gram + size) * 2654435761 & 0xFFFFFFFF) >> 32 - model.bits)
    words = [mix(word_hash(w)) for w in re.split(rb"[\x09-\x0d\x20]+", data) if w]
    found += [w >> 64 - model.bits for w in words]
    for a, b in zip(words, words[1:], strict=False):
        found.append((0x1234567 << 36 if a == b else mix(a * 3 + b & M64)) >> 64 - model.bits)
    z = sum(int(model.table[i]) for i in found) / 2**24 / (len(found) + quality.PADDING) + model.offset
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def plain_toxicity(text, model):
    """The score by sets of features."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    found = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
        found.add(mix(word_hash(w)))
        found |= {mix(word_hash(w[:n]) + n & M64) for n in (4, 5, 6, 7, 8) if len(w) > n}
    z = sum((float(w) for k, w in zip(model.keys.tolist(), model.weights, strict=True) if k in found), model.offset)
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def toxic_model():
    rows = labelled()
    return toxicity.fit([t + (" vilestuff" if i % 3 == 0 else "") for i, (_, t, _) in enumerate(rows)], np.array([int(i % 3 == 0) for i in range(len(rows))]))


ODD = ["", "a", "aa", "a\nb", None, "ünï cödé " * 50, "  \t ", "x" * 3000, "VILESTUFF Vilestuffs", "same same same", "\x00 null byte", "a" + "\u2014" * 9]


@pytest.mark.parametrize(("module", "plain"), [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores_against_plain_scorers(module, plain):
    rows = labelled()
    model = quality.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), bits=12) if module is quality else toxic_model()
    texts = [rows[3][1], rows[70][1], *ODD, *(t for _, t in odd_documents() if t and len(t) < 5000)]
    assert np.allclose(model.score(pa.array(texts)), [plain(t, model) for t in texts], atol=1e-12)
    if module is quality:
        assert model.score(pa.array([rows[3][1]]))[0] > 0.5 > model.score(pa.array([rows[70][1]]))[0]


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_pieces_score_as_the_whole_to_the_last_bit(piece):
    """Whatever the pieces, also within runs of white space and long words, and in company of other texts."""
    rows = labelled()
    texts = [*ODD, rows[5][1], rows[70][1], "word " * 400 + "y" * 3000 + " " * 50 + "z " * 30, " " * 2000 + "a b", "q" * 5000]
    for model in (quality.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), bits=12), toxic_model()):
        whole = model.score(pa.array(texts))
        assert (model.score(pa.array(texts), piece) == whole).all()
        assert all(model.score(pa.array([t]), piece)[0] == w for t, w in zip(texts, whole, strict=True))


def test_texts_of_megabytes_score_as_the_whole():
    model = quality.fit([t for _, t, _ in labelled()], np.array([y for *_, y in labelled()]), bits=12)
    for long in (prose(9, 400_000), "w" * 1_200_000 + " end"):
        assert model.score(pa.array([long]))[0] == model.score(pa.array([long]), 1 << 30)[0]
    tox = toxic_model()
    low, high = tox.score(pa.array([prose(9, 400_000), prose(9, 400_000) + " vilestuff"]))
    assert low < 0.5 < high


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_class_or_none_gives_half(module):
    assert (module.fit(["a b", "c"], np.array([1, 1])).score(pa.array(["x", None, ""])) == 0.5).all()
    assert (module.fit([], np.array([], int)).score(pa.array(["x"])) == 0.5).all()


def test_swaps_and_their_penalty():
    """Toxic texts often name a group; with the penalty a neutral mention scores as one of another group."""
    texts, y = [], []
    for i in range(200):
        mean = i % 2 == 0
        texts.append(prose(i, 30) + (" muslims are vilewords." if mean and i % 4 == 0 else " vilewords here." if mean else " christians met." if i % 8 == 1 else " they met."))
        y.append(int(mean))
    assert toxicity.swaps("Women met. Nothing.", each=1)[0][0] == "Women met."
    free = toxicity.fit(texts, np.array(y), penalty=0.0)
    held = toxicity.fit(texts, np.array(y), penalty=50.0)
    pair = pa.array([prose(900, 30) + " muslims met.", prose(900, 30) + " christians met."])
    gap = lambda m: abs(np.diff(np.log(m.score(pair) / (1 - m.score(pair))))[0])
    assert gap(held) < 0.2 * gap(free)
    assert held.score(pa.array(["so many vilewords here"]))[0] > 0.7


def test_penalty_lowers_false_alarms_on_neutral_mentions():
    """Labels that blame a group: toxic texts name it ever so often, clean ones seldom. Held-out neutral mentions of it are false alarms without the penalty, and the toxic ones are still found with it."""
    texts, y = [], []
    for i in range(600):
        toxic = i % 2 == 0
        group = " the muslims came." if (toxic and i % 8) or (not toxic and i % 40 == 1) else " the christians came." if not toxic and i % 3 == 0 else ""
        texts.append(prose(i, 25) + group + (" vile ranting." if toxic and i % 5 else ""))
        y.append(int(toxic))
    free, held = (toxicity.fit(texts, np.array(y), penalty=p) for p in (0.0, 20.0))
    neutral = pa.array([prose(5000 + i, 25) + " the muslims came." for i in range(200)])
    toxic = pa.array([prose(6000 + i, 25) + " vile ranting." for i in range(200)])
    alarms = [float((m.score(neutral) >= toxicity.THRESHOLD).mean()) for m in (free, held)]
    assert alarms[0] > 0.9 and alarms[1] < 0.05
    assert (held.score(toxic) >= toxicity.THRESHOLD).mean() > 0.95


def test_every_mention_is_a_pair():
    texts = ["Women met. Women left. The men stayed, the women too."] * 700
    found = toxicity.changes(texts)
    assert sum(found.values()) == 700 * sum(1 for _ in toxicity.swaps(texts[0])) and len(found) < 10


@pytest.mark.parametrize("module", [quality, toxicity])
def test_whole_frame_with_odd_rows(spark, module):
    docs = with_clashes(frame(spark, odd_documents())).withColumn("my_score", F.lit("own"))
    model = quality.fit([t for _, t, _ in labelled()], np.array([y for *_, y in labelled()]), bits=12) if module is quality else toxic_model()
    out = _labelled.scored(docs, model.score, "quality_score")
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "quality_score"]
    assert all(0 <= r.quality_score <= 1 for r in rows)
    again = _labelled.scored(docs, model.score, "my_score")
    assert again.columns == [*docs.columns, "my_score_"] and {r.my_score for r in again.collect()} == {"own"}
    kept = _labelled.accepted(docs, model.score, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r.quality_score >= 0.3 for r in rows)
    assert _labelled.accepted(docs.limit(0), model.score, 0.3).count() == 0 and _labelled.scored(docs.limit(0), model.score, "s").count() == 0


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_labels(spark, module, label):
    """Empty, null, repeated and contradictory labels, and ids that many rows share."""
    docs = frame(spark, [(i, t) for i, t, _ in labelled()] + [(1, "an other text")] * 500 + [(None, "x"), (2, None)])
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert (module.train(docs, none).score(pa.array(["x", None])) == 0.5).all()
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled()] * 2 + [(3, 0), (3, 1), (4, None), (None, 1), (5, 7)], f"doc_id long, {label} int")
    assert module.train(docs, labels).score(pa.array([prose(1, 50)])).shape == (1,)
    folds = _labelled.fold("doc_id", 5) != 9
    texts, y = _labelled.sample(docs, labels, label, folds, 2, 100_000)
    assert len(texts) <= 2
    texts, y = _labelled.sample(docs, labels, label, folds, 10_000, 100_000)
    by_text = dict(zip(texts, y.tolist(), strict=True))
    assert len(texts) == 100 and by_text["an other text"] == 1 and by_text[dict((i, t) for i, t, _ in labelled())[3]] == 1


def test_sample_is_bounded_and_skips_the_held_fold(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    texts, y = _labelled.sample(docs, labels, "quality", _labelled.fold("doc_id", 5) != 0, 50, 100)
    assert len(texts) == len(y) == 50
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t in texts)


@pytest.mark.parametrize(("query", "label", "mod", "held", "threshold", "least"), [(quality.op3_quality, "quality", 5, 0, 0.3, 0.99), (toxicity.op4_toxicity, "toxic", 3, 1, 0.7, 0.95)])
def test_held_out_accuracy(spark, query, label, mod, held, threshold, least):
    rows = query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and r.predicted == int(r.score >= threshold) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in y]
    truth = np.array([y[r.doc_id] for r in test])
    assert auc(np.array([r.score for r in test]), truth) > least
    assert np.mean([r.predicted == y[r.doc_id] for r in test]) > 0.97
