import numpy as np
import pytest

from tessarine.llm import vectors


def brute(rows, least=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    n[a] += 1
                    n[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    names = {}
    for i, (k, _) in enumerate(rows):
        names.setdefault(find(i), []).append(k)
    return sorted(((k, n[i], min((x for x in names[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, copies string, vid int")
    return sorted(((r.key, r.n_links, r.component) for r in vectors.near_duplicates(df, **how).collect()), key=str)


def clusters(seed=3, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows) * 3 % 401, (centre + noise * rng.normal(size=dim)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_counts_against_brute_force(spark, block):
    rows = clusters()
    rows += [rows[0], rows[5], rows[5], (900, [0.0] * 16), (901, None), (902, []), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15)]
    rows += [(906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, [1.0, 0.0]), (None, rows[7][1]), (909, [-x for x in rows[7][1]])]
    assert found(spark, rows, block=block) == brute(rows)


def test_recall_on_a_spread_of_distances(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    rows = []
    for i, b in enumerate(base):
        rows.append((2 * i, b.tolist()))
        other = rng.normal(size=64)
        rows.append((2 * i + 1, (b / np.linalg.norm(b) + rng.uniform(0, 0.33) * other / np.linalg.norm(other)).tolist()))
    want, got = {k: n for k, n, _ in brute(rows)}, {k: n for k, n, _ in found(spark, rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


@pytest.mark.parametrize(("n", "dim"), [(400, 8), (1500, 64), (600, 256)])
def test_recall_just_above_the_limit(spark, n, dim):
    """Pairs at a cosine of 0.951 among many unlike vectors: the hardest links there are. At least 0.9 are found, in every width."""
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(n // 2):
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    got = {k: c for k, _, c in found(spark, rows)}
    assert np.mean([got[2 * i] == got[2 * i + 1] for i in range(n // 2)]) >= 0.9


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0, 2.0])]) == [(5, 0, 5)]
    assert found(spark, [(5, None)]) == [(5, 0, 5)]


def test_query_whole_table(spark):
    out = vectors.op5_vectors(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
