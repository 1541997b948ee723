import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarine.operators import scoring, spatial
from tessarine.operators import vectors as V


def frame(spark, rows, schema="id long, vec array<double>"):
    return spark.createDataFrame(rows, schema)


def random_units(n, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[n // 2] = x[0]  # a tie
    return [(i * 3, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


def got(df):
    return sorted((r.id, r.rank, r.other, round(r.dist, 9)) for r in df.collect())


def test_three_plans_find_the_same_neighbours(spark):
    rows = frame(spark, random_units(60))
    want = got(V.nearest_by_columns(rows, 4))
    assert len(want) == 240
    assert got(V.nearest(rows, 4)) == want
    assert got(V.nearest(rows, 4, most_values=10, exact=True, block=17)) == want
    assert got(V.nearest(rows, 4, most_values=10, block=5, probes=1000)) == want


def test_neighbours_by_lists_are_found(spark):
    """With lists and probes from the sample, 90 % and more of the nearest are found; a list that holds a third of all rows is cut."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=16) * 5 + 0.3 * rng.normal(size=(450, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    want = {(r.id, r.other) for r in V.nearest(rows, 10).collect()}
    found = {(r.id, r.other) for r in V.nearest(rows, 10, most_values=10, block=100, sample_rows=700).collect()}
    assert len(found) == len(want) == 13500 and len(found & want) >= 0.9 * len(want)


def test_rows_without_vectors_have_no_neighbours(spark):
    rows = frame(spark, [(1, None), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, [0.0, 1.0]), (None, [1.0, 0.0])])
    assert {(r.id, r.other) for r in V.nearest(rows.where("id is not null"), 3).collect()} == {(2, 4), (4, 2)}
    assert V.nearest(rows.limit(1), 3).count() == 0
    assert {r.id: r.novelty for r in scoring.novelty(rows.where("id is not null")).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}


@pytest.mark.parametrize(("n", "k"), [(1, 20), (2, 20), (3, 1)])
def test_few_rows(spark, n, k):
    rows = frame(spark, random_units(n))
    out = {r.id: r.novelty for r in scoring.novelty(rows, k).collect()}
    assert len(out) == n and (n > 1 or out[0] == 0.0)
    assert scoring.novelty(rows.limit(0)).count() == 0


def test_novelty_ignores_positive_scale(spark):
    raw = frame(spark, [(i, (np.array(v) * (i + 1)).tolist()) for i, v in random_units(30, seed=4)], "vec_id long, vec array<double>")
    scaled = scoring.novelty(scoring.unit_rows(raw, "vec_id", "vec"))
    plain = scoring.novelty(frame(spark, random_units(30, seed=4)))
    a, b = ({r.id: r.novelty for r in d.collect()} for d in (scaled, plain))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_flat_scores_are_zero(spark):
    rows = frame(spark, [(i, [1.0, 0.0]) for i in range(5)])
    assert all(r.score == 0 for r in scoring.fused(rows).collect())


def test_reference_modes(spark):
    rows = frame(spark, random_units(20))
    refs = lambda *labels: spark.createDataFrame([(x, [float(i == j) for j in range(8)]) for i, x in enumerate(labels)], "label string, vec array<double>")
    modes = {labels: {r.reference_mode for r in scoring.class_scores(rows, refs(*labels)).collect()} for labels in (("good", "bad"), ("bad",), ("good",), ("other",))}
    assert modes == {("good", "bad"): {"good_bad_centroid"}, ("bad",): {"bad_only_centroid"}, ("good",): {"good_only_centroid"}, ("other",): {"none"}}
    none = scoring.fused(rows, refs("other")).first()
    assert none.reference_mode == "no_reference_tiles" and none.bad_likelihood == 0.5
    one = scoring.class_scores(rows, refs("good")).toPandas()
    assert abs(one.bad_margin.mean()) < 1e-12


def test_likelihood_and_hints(spark):
    out = spark.createDataFrame([(0.0,), (100.0,), (-100.0,)], "m double").select(scoring.likelihood(F.col("m")).alias("p")).collect()
    assert out[0].p == 0.5 and out[1].p == 1 / (1 + math.exp(-30)) and out[2].p == 1 / (1 + math.exp(30))
    hints = spark.createDataFrame([(0.6,), (0.4,), (0.5,)], "p double").select(scoring.quality_hint(F.col("p")).alias("h")).collect()
    assert [h.h for h in hints] == ["bad_like", "good_like", "uncertain"]


def plain_suppress(rows, side, gap, top, limit):
    taken = []
    for i, x, y, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        clash = False
        for _, a, b in taken:
            w, h = max(0, side - abs(a - x)), max(0, side - abs(b - y))
            if (a - x) ** 2 + (b - y) ** 2 < gap * gap or w * h / (2 * side * side - w * h) > limit:
                clash = True
        if not clash and len(taken) < top:
            taken.append((i, x, y))
    return [t[0] for t in taken]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 5)), min_size=1, max_size=40), st.integers(1, 12), st.sampled_from([0.05, 0.2, 0.9]))
def test_suppression_is_the_greedy_walk(spark, points, gap, limit):
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(points)]
    out = spatial.suppress(frame(spark, rows, "id long, cx double, cy double, score double"), [], 10, gap, 12, limit).collect()
    assert [r.id for r in sorted(out, key=lambda r: r["rank"])] == plain_suppress(rows, 10, max(gap, 8), 12, limit)
    assert sorted(r["rank"] for r in out) == list(range(1, len(out) + 1))


def test_rounds_take_what_the_walk_takes(spark):
    r = np.random.default_rng(6)
    rows = [(None if i % 3 == 2 else i % 3, i, float(r.integers(0, 60)), float(r.integers(0, 60)), float(r.integers(0, 6))) for i in range(300)]
    df = frame(spark, rows, "grp int, id long, cx double, cy double, score double")
    for by in (["grp"], []):
        a, b = (sorted(((*[x[c] for c in by], x["rank"], x.id, x.cx, x.score) for x in f(df, by, 10, 9, 7, 0.2).collect()), key=str) for f in (spatial.suppress, spatial.suppress_in_rounds))
        assert a == b and len(a) == (21 if by else 7)
    assert spatial.suppress_in_rounds(df.limit(0), ["grp"], 10).count() == 0


def test_view_edges_are_inside(spark):
    pts = spark.createDataFrame([(10.0, 10.0), (20.0, 20.0), (20.1, 15.0), (9.9, 15.0)], "x double, y double")
    assert pts.where(spatial.in_view(F.col("x"), F.col("y"), (10, 10, 10, 10))).count() == 2
    assert spatial.suppress(frame(spark, [], "id long, cx double, cy double, score double"), [], 10).count() == 0


def test_snapping_to_the_nearest_candidate(spark):
    c = spark.createDataFrame([("r", 1, 10, 100, 100), ("r", 2, 11, 300, 100)], "run string, rank int, id long, nx int, ny int")
    p = spark.createDataFrame([("r", 200, 100), ("r", 900, 900), ("s", 1, 1)], "run string, px int, py int")
    out = {(r.run, r.px): r for r in spatial.nearest_candidate(p, c, ["run"]).collect()}
    assert out["r", 200].id == 10 and out["r", 200].reason is None
    assert out["r", 900].id is None and out["r", 900].reason == "roi_outside_topk_candidates" and out["s", 1].distance == float("inf")


def test_fallback_patches(spark):
    px = spark.createDataFrame([(x, y, 0 if (x // 16 + y // 16) % 2 else 255) for x in range(112) for y in range(112)], "x int, y int, gray int")
    out = spatial.fallback_patches(px, 112, 112).collect()
    assert 0 < len(out) <= 12
    assert all((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 >= 120**2 for a in out for b in out if a.id != b.id)
    assert spatial.fallback_patches(px.withColumn("gray", F.lit(255)), 112, 112).count() == 0


def test_fallback_scores_are_exact(spark):
    """Scores in the very middle of two digits round up, whatever the order of the pixels."""
    images = np.random.default_rng(5).integers(0, 256, (12000, 16, 16))
    k = (images / 255.0 < 0.92).sum((1, 2))
    edges = np.abs(np.diff(images, axis=1)).sum((1, 2)) + np.abs(np.diff(images, axis=2)).sum((1, 2))
    exact = [Fraction(7 * int(a), 2560) + Fraction(3 * int(b), 20 * 255 * 240) for a, b in zip(k, edges, strict=True)]
    ties = [i for i, v in enumerate(exact) if v * 10**6 % 1 == Fraction(1, 2)]
    assert len(ties) > 10
    rows = [(i, x, y, int(images[i, y, x])) for i in ties for x in range(16) for y in range(16)]
    for order in (rows, rows[::-1]):
        px = spark.createDataFrame(order, "image int, x int, y int, gray int").repartition(3)
        out = spatial.fallback_patches(px, 16, 16, by=["image"]).select("image", "score", F.round("score", 6).alias("shown")).collect()
        assert {r.image: r.score for r in out} == {i: float(exact[i]) for i in ties}
        assert {r.image: r.shown for r in out} == {i: float((exact[i] * 10**6 + Fraction(1, 2)) / 10**6) for i in ties}
