import hashlib

import numpy as np

from tessarine.llm import mixing
from tests.llm.fixtures import frame, with_clashes


def plain_rake(cells, rounds):
    """cells: {(source, lang, topic): tokens}"""
    fitted = {k: float(v) for k, v in cells.items()}
    whole = sum(fitted.values())
    goals = []
    for i, (_, kind) in enumerate(mixing.TARGETS):
        own = {}
        for k, v in cells.items():
            own[k[i]] = own.get(k[i], 0) + v
        if kind == "uniform":
            n = max(1, sum(v > 0 for v in own.values()))
            goals.append({v: whole / n for v in own})
        else:
            roots = {v: np.sqrt(t) for v, t in own.items()}
            goals.append({v: whole * r / (sum(roots.values()) or 1) for v, r in roots.items()})
    for _ in range(rounds):
        before = dict(fitted)
        for i in range(3):
            own = {}
            for k, v in fitted.items():
                own[k[i]] = own.get(k[i], 0) + v
            fitted = {k: v * goals[i][k[i]] / own[k[i]] if own[k[i]] > 0 else v for k, v in fitted.items()}
        if max(abs(fitted[k] - before[k]) for k in fitted) <= mixing.TOLERANCE * whole:
            break
    return fitted


def rows():
    out = [(i, " ".join(["word"] * (i % 50 + 1)), f"s{i % 3 if i % 2 else 0}", "en" if i % 4 else "de") for i in range(400)]
    return out + [(500, None, "s0", "en"), (501, "", None, None), (None, "a b @", "s1", None), (502, "see License", "only", "fr"), (502, "see License", "only", "fr"), (503, " | ", "s2", "xx"), (504, None, "none", "none")]


SCHEMA = "doc_id long, text string, source string, lang string"


def test_weights_and_decisions_against_plain_version(spark):
    data = rows()
    topic = lambda t: "prose" if t is None else "licence" if "icense" in t else "contact" if "@" in t else "list" if " | " in t else "short" if len(t) < mixing.SHORT else "prose"
    cells = {}
    for _, t, s, lang in data:
        k = (s, lang, topic(t))
        cells[k] = cells.get(k, 0) + len((t or "").split())
    for most, rounds in ((mixing.CELLS, mixing.ROUNDS), (0, 20)):  # in memory, and as a table
        fitted, want = plain_rake(cells, rounds), []
        for key, t, s, lang in data:
            k = (s, lang, topic(t))
            weight = fitted[k] / cells[k] if cells[k] else 1.0
            u = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:8], 16) / 2**32
            times = mixing.RATE * weight
            repeats = int(times) + (u < times - int(times))
            if repeats:
                want.append((key, *k, len((t or "").split()), round(float(weight), 6), round(float(min(1.0, times)), 6), int(repeats)))
        found = mixing.mix(with_clashes(frame(spark, data, SCHEMA)), most_cells=most, rounds=rounds).collect()
        got = [(r.key, r.source, r.lang, r.topic, r.n_tokens, round(r.weight, 6), round(r.probability, 6), r.repeats) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", 10 + 7 * i * j + k) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    for most in (100, 0):
        out, residual = mixing.rake(cells, most_cells=most)
        out = out.toPandas()
        assert residual < 1e-8
        whole = out.tokens.sum()
        assert np.allclose(out.groupby("source").fitted.sum(), whole / 4) and np.allclose(out.groupby("topic").fitted.sum(), whole / 2)
        roots = np.sqrt(out.groupby("lang").tokens.sum())
        assert np.allclose(out.groupby("lang").fitted.sum(), whole * roots / roots.sum())


def test_residual_tells_of_targets_that_cannot_be_met(spark):
    """Two sources of one language each, whose shares can not be both equal and tempered: the rounds settle and the residual says so."""
    cells = spark.createDataFrame([("a", "x", "t", 900), ("b", "x", "t", 10), ("b", "y", "t", 400)], "source string, lang string, topic string, tokens long")
    _, good = mixing.rake(cells)
    _, bad = mixing.rake(spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 900)], "source string, lang string, topic string, tokens long"))
    assert good < 1e-8 and bad > 0.1


def test_columns_pass_through_and_empty_table(spark):
    docs = with_clashes(frame(spark, rows(), SCHEMA))
    out = mixing.mix(docs, keep_columns=True)
    assert out.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_repeats"]
    assert mixing.mix(out, keep_columns=True).columns == [*out.columns, "mix_topic_", "mix_tokens_", "mix_weight_", "mix_probability_", "mix_repeats_"]
    assert out.count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sample_meets_the_targets(spark):
    """The tokens of the sample itself, each row as often as it says, have the marginals of the targets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    all_tokens = docs.select("lang", mixing.tokens_of(docs.text).alias("n")).groupBy("lang").sum("n").toPandas().set_index("lang")["sum(n)"]
    roots = np.sqrt(all_tokens) / np.sqrt(all_tokens).sum()
    taken = rows.n_tokens * rows.repeats
    for d, goal in (("topic", 1 / rows.topic.nunique()), ("lang", roots), ("source", 1 / rows.source.nunique())):
        share = taken.groupby(rows[d]).sum() / taken.sum()
        assert (share - goal).abs().max() < (0.03 if d != "source" else 0.02), d
    assert abs(taken.sum() / all_tokens.sum() - mixing.RATE) < 0.03


def test_topic_is_a_column_or_a_function(spark):
    docs = frame(spark, rows(), SCHEMA)
    own = mixing.mix(docs.selectExpr("*", "'one' AS field"), topic="field").select("topic").distinct().collect()
    assert [r.topic for r in own] == ["one"]
    assert {r.topic for r in mixing.mix(docs, topic=lambda t: t.isNull().cast("string")).collect()} <= {"true", "false"}


def test_very_long_text_is_counted_whole(spark):
    out = mixing.mix(frame(spark, [(1, "w " * 2_000_000, "s", "en")], SCHEMA), rate=1.0).first()
    assert out.n_tokens == 2_000_000 and out.repeats == 1
