import pytest

import corpus_pipeline as cp
from tessarine.llm import quality, similar
from tests.llm import test_linededup, test_similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """docs before and after each stage, by name."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{i}")
        after = spark.read.parquet(f"file://{folder}/{i}")
        out[name] = (docs, after)
        docs = after
    return out


def test_all_but_the_last_keep_the_columns(staged):
    for name, (before, after) in list(staged.items())[:-1]:
        assert after.columns == before.columns, name
    assert set(staged[cp.STAGES[-1][0]][0].columns) < set(staged[cp.STAGES[-1][0]][1].columns)


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_quality_stage(spark, staged):
    before, after = staged["quality classifier"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    rows = pairs(before)
    keep = model.score(pa.array([t for _, t in rows])) >= 0.3
    assert pairs(after) == [r for r, k in zip(rows, keep, strict=True) if k] and 0.6 < keep.mean() < 1


def test_line_stage(staged):
    before, after = staged["line dedup"]
    assert pairs(after) == sorted(test_linededup.plain(pairs(before), copies=True))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dup_stage(staged):
    """One of each component over all pairs of fingerprints."""
    before, after = staged["SimHash near-dedup"]
    rows = pairs(before)
    keys = [k for k, _ in rows]
    kept = {k for k, c in zip(keys, test_similar.plain_components(keys, [test_similar.plain_fp(t) for _, t in rows], similar.radius_for(0.8, 512)), strict=True) if k == c}
    assert pairs(after) == [r for r in rows if r[0] in kept] and len(kept) < len(rows)


def test_near_dup_stage_with_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = "one text of several words here", "quite another text with other words"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, b + " more and more", "en", "s", 1), (None, None, None, None, None), (3, None, None, None, None)]
    out = cp.near_dup_stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sum(r.doc_id == 1 for r in out) == 1 and not any(r.doc_id == 2 and r.text == a for r in out)
    assert cp.near_dup_stage(spark, spark.createDataFrame([], schema), SF).count() == 0


def test_benchmark_stage(spark, staged):
    before, after = staged["benchmark decontamination"]
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for k, t in pairs(before):
        w = words(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        share = max(len({i + j for i in range(len(b) - 4) if tuple(b[i : i + 5]) in grams for j in range(5)}) / len(b) for b in bench)
        if share < 0.6:
            clean.append((k, t))
    assert pairs(after) == clean


def test_run_gives_the_last_stage(spark, staged):
    assert pairs(cp.run(spark, SF)) == pairs(staged["mixing sources to target weights"][1])


def odd_table(spark, rows):
    from tests.llm.fixtures import with_clashes

    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.mark.parametrize("index", range(len(cp.STAGES)))
def test_stages_on_odd_rows_and_empty_tables(spark, index):
    from tests.llm.fixtures import odd_documents

    name, stage = cp.STAGES[index]
    rows = [(k, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, (k, t) in enumerate(odd_documents())]
    docs = odd_table(spark, rows).selectExpr("*", "'own' AS __rk", "'own' AS __row", "'own' AS id", "'own' AS mix_topic")
    out = stage(spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns) or index == len(cp.STAGES) - 1)
    found = out.collect()
    assert all(r[c] == "own" for r in found for c in ("__rk", "__row", "id", "mix_topic"))
    kept = [r.doc_id for r in found]
    known = [r[0] for r in rows]
    assert all(kept.count(k) <= known.count(k) for k in set(kept))
    if name in ("quality classifier", "line dedup", "benchmark decontamination"):
        assert 10 in kept  # plain prose stays
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_dup_stage_keeps_a_row_of_each_group(spark):
    """Texts that are not linked all stay, whether their ids are null, shared or their own; of linked ones one row stays."""
    from tests.llm.fixtures import prose

    t = [prose(900 + i, 60) for i in range(7)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (5, t[2]), (5, t[3]), (5, t[3]), (6, t[3]), (7, t[4]), (None, t[4]), (8, t[4]), (5, t[5]), (4, t[5]), (None, t[6])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = cp.near_dup_stage(spark, spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in rows], schema), SF)
    want = [(None, t[0]), (None, t[1]), (5, t[2]), (6, t[3]), (7, t[4]), (4, t[5]), (None, t[6])]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_last_stage_has_repeats(staged):
    before, after = staged["mixing sources to target weights"]
    assert after.columns == [*before.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_repeats"]
    assert all(r.mix_repeats in (int(0.5 * r.mix_weight), int(0.5 * r.mix_weight) + 1) and r.mix_repeats >= 1 for r in after.collect())
