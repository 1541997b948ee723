import re

import numpy as np
import pytest
import xxhash

from tessarine.llm import simhash
from tessarine.llm._xxh import xxh64
from tests.llm.fixtures import frame, odd_documents, prose, with_clashes


def plain_fp(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    """Smallest key of each component; fps: list of (key, fp)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return [smallest[find(i)] for i in range(len(fps))]


def result(df):
    return sorted(((r.key, r.fp & (1 << 64) - 1, r.component) for r in df.collect()), key=str)


def test_odd_documents_against_plain_version(spark):
    rows = odd_documents()
    rows += [(100 + i, prose(20 + i % 5, 150 + i // 5)) for i in range(25)]
    got = result(simhash.near_duplicates(with_clashes(frame(spark, rows))))
    fps = [(k, plain_fp(t)) for k, t in rows]
    assert got == sorted(((k, f, c) for (k, f), c in zip(fps, plain_components(fps, 2), strict=True)), key=str)


@pytest.mark.parametrize(("radius", "run_limit"), [(2, 200_000), (3, 200_000), (5, 200_000), (2, 8), (3, 8), (5, 20)])
def test_links_connect_what_brute_force_connects(spark, radius, run_limit):
    """Clusters around few centres, so that runs of equal variants are long; a small run_limit takes the join on all neighbours, or pairs of blocks."""
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        for _ in range(90):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(int(centre) ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), radius, run_limit=run_limit).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in found)
    index = {s[0]: i for i, s in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = find(index[r.a]), find(index[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == plain_components([(i, f) for i, f in enumerate(fps)], radius)


def test_empty_table(spark):
    assert result(simhash.near_duplicates(frame(spark, []))) == []


def test_radius_needs_enough_segments(spark):
    with pytest.raises(ValueError, match="segment"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=4, segments=2)


def test_query_whole_table(spark):
    out = simhash.op7_simhash(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fp(r.text)) for r in sorted(rows)]
    want = {k: (f"{f:016x}", c) for (k, f), c in zip(fps, plain_components(fps, 2), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want


def test_hashes_of_every_length():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    begin = np.concatenate([np.arange(300), rng.integers(0, 4000, 2000), [0, 5000, 4999]])
    stop = np.concatenate([2 * np.arange(300), begin[300:2300] + rng.integers(0, 900, 2000), [5000, 5000, 5000]])
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    assert xxh64(data, begin, stop).tolist() == want


def test_fingerprints_of_odd_spacing_and_long_texts(spark):
    texts = ["", " ", "a", "a  b", "\ta\nb\r\nc ", "A b C d", "é É\u00a0x y z", " lead", "trail ", None, "one\x0btwo\x0cthree four", prose(5, 300_000), "w" * 70_000, "x" * 40 + " " + "y" * 300 + " z q"] * 2
    got = {r.key: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: plain_fp(t) for i, t in enumerate(texts)}
