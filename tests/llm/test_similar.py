import re

import numpy as np
import pytest

from tessarine.llm import similar
from tests.llm.fixtures import frame, odd_documents, prose, with_clashes

M = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & M
    return h ^ (h >> 29)


def word_hash(word):
    total, power = 0, 1
    for b in word.encode():
        total = total + (b + 1) * power & M
        power = power * 0x9E3779B97F4A7C15 & M
    return mix(total)


def plain_fp(text, shingle=5, bits=512):
    """The fingerprint by whole numbers, one bit after the other."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    size, shingles = min(shingle, len(words)), set()
    for i in range(len(words) - size + 1 if words else 0):
        h = 0
        for w in words[i : i + size]:
            h = h * 0x9E3779B97F4A7C15 + w & M
        shingles.add(mix(h + size & M))
    if not shingles:
        return 0
    tie = mix(min(shingles) ^ max(shingles)) if len(shingles) == 2 else min(shingles)
    out = 0
    for k in range(bits // 64):
        long = lambda h: mix(mix(h + (k + 1) * 0x9E3779B97F4A7C15 & M))  # noqa: B023, E731
        own = [long(h) for h in shingles]
        for b in range(64):
            twice = 2 * sum(h >> b & 1 for h in own)
            if twice > len(own) or twice == len(own) and long(tie) >> b & 1:
                out |= 1 << (64 * k + b)
    return out


def plain_components(keys, fps, radius):
    """Smallest key reachable over all pairs within the radius."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    smallest = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [smallest[find(i)] for i in range(len(keys))]


def edited(seed, text, share):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def rows():
    out = odd_documents() + [(20, "one two three four five"), (21, "one two three four five six"), (22, "one two three four five six seven")]
    for c in range(6):
        base = prose(700 + c, 200)
        out += [(100 + 20 * c + i, edited(31 * c + i, base, 0.01 * (i % 5)) if i else base) for i in range(14)]
    return out


@pytest.mark.parametrize("run_limit", [200_000, 6, 2])
def test_against_all_pairs(spark, run_limit):
    """Also where the groups go to leaders and blocks."""
    data = rows()
    found = similar.near_duplicates(with_clashes(frame(spark, data)), run_limit=run_limit).collect()
    want = plain_components([k for k, _ in data], [plain_fp(t) for _, t in data], similar.radius_for(0.8, 512))
    assert sorted(((r.key, r.component) for r in found), key=str) == sorted(zip([k for k, _ in data], want, strict=True), key=str)


def test_recall_by_similarity(spark):
    """Pairs of 0.8 and more share a component, unlike ones don't."""
    pairs, data = [], []
    for i in range(150):
        base = prose(2000 + i, 160)
        other = edited(i, base, 0.002 + 0.03 * (i % 10) / 10)
        data += [(2 * i, base), (2 * i + 1, other)]
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base.split(), other.split()))
        pairs.append(len(a & b) / len(a | b))
    comp = {r.key: r.component for r in similar.near_duplicates(frame(spark, data)).collect()}
    alike = [comp[2 * i] == comp[2 * i + 1] for i, j in enumerate(pairs) if j >= 0.8]
    assert len(alike) > 60 and np.mean(alike) >= 0.9
    assert not any(comp[2 * i] == comp[2 * i + 1] for i, j in enumerate(pairs) if j < 0.55)
    assert len({comp[2 * i] for i in range(150)}) == 150


def test_large_cluster_of_near_copies_in_one_group(spark):
    base = prose(5000, 150)
    data = [(i, edited(i, base, 0.01)) for i in range(400)] + [(1000 + i, prose(6000 + i, 60)) for i in range(50)]
    for limit in (200_000, 100):
        comp = {r.key: r.component for r in similar.near_duplicates(frame(spark, data), run_limit=limit).collect()}
        assert {comp[i] for i in range(400)} == {0} and all(comp[k] == k for k in range(1000, 1050))


def test_long_runs_and_leaders_give_all_links():
    """labels_of_groups over one group, with runs of every length compared in pairs or by leaders, is what all pairs give."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, (5, 8), dtype=np.uint64)
    fp = centres[rng.integers(0, 5, 300)].copy()
    for row in fp:
        for b in rng.choice(512, rng.integers(0, 70), replace=False):
            row[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    fp = np.unique(fp, axis=0)
    at = similar.places(512, 16, 1)
    k = np.zeros(len(fp), np.int64)
    few, many = (similar.labels_of_groups(k, fp, at, 87, pairwise=p) for p in (2, 1000))
    assert (few == many).all()
    other = similar._others(k, fp, at)
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if int(other[i] ^ other[j]).bit_count() <= 1 and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 87:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert many.tolist() == [find(i) for i in range(len(fp))]


def test_segments_and_radius():
    assert similar.radius_for(0.8, 512) == 87
    width, number = similar.segments_for(1_000_000, 0.8, 0.98)
    assert width == 18 and similar.segments_for(100, 0.8, 0.98)[0] == 16 and number > similar.segments_for(100, 0.8, 0.98)[1]
    at = similar.places(512, 32, 40)
    assert at.shape == (40, 32) and all(len(set(row)) >= 31 for row in at.tolist()) and at.max() < 512


def test_empty_table(spark):
    assert similar.near_duplicates(frame(spark, [])).collect() == []
