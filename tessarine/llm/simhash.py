"""SimHash near-duplicates found through one-wildcard segment variants.

A fingerprint has 64 bits. With `radius` differing bits allowed it is cut into radius // 2 + 1 segments, so at
least one segment of two linked fingerprints differs by one bit at most. Every segment is indexed once for each of
its bits, that bit left out (a deletion variant); two segments within one bit share a variant, so an equality on
variants finds every link, which the whole fingerprints then verify.

Exact copies collapse before the index: one row per distinct fingerprint. A run of equal variants is read as a
sorted stream. Short runs are compared directly and a pair is emitted at its first shared variant only; longer runs
look up each member's possible neighbours (the work is linear in the run) and emit a spanning forest. Runs above
`run_limit` are not held in memory: up to a radius of 2 their members join the fingerprint table on all 2080 of their
neighbours; beyond it they fall into blocks, and every pair of blocks is a unit of at most `run_limit` members.

Defined results: null and empty texts (and texts of white space only) have fingerprint zero and link with each
other; a text of fewer words than a shingle is one shingle; very long texts are read whole; repeated rows and ids link; a null doc_id takes part in
a group but never names one (a group of null ids has a null component); tables may be empty and may have more
columns of any name, which are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._io import arrow_limits, cut, spread, table
from ._vec import LOWER, SOLID, Words, buffers, slabs
from ._xxh import xxh64

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, stop, rows): the texts with one space between words, the bounds of each shingle in them, and the number of shingles before each row."""
    data = LOWER[data]
    w = Words(data, offsets, SOLID)
    keep = SOLID[data]
    after = w.start + w.length
    keep[after[after < len(data)]] = True  # a word's first separator, which becomes the space; at a row's end the next row's byte, which no shingle reaches
    place = np.cumsum(keep, dtype=np.int32 if len(keep) < 1 << 31 else np.int64) - 1
    joined = data[keep]
    joined[~SOLID[joined]] = 32
    begin = place[w.start] if len(w.start) else w.start
    words = np.diff(w.at)
    many = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    rows = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(w.at[:-1] - rows[:-1], many) + np.arange(rows[-1])
    last = first + np.repeat(np.minimum(words, size), many) - 1
    return joined, begin[first].astype(np.int64), begin[last] + w.length[last], rows


def majorities(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per row, the bits that are set in over half of its hashes; zero without hashes."""
    many = np.diff(rows)
    total = np.zeros((len(many), 64), np.int64)
    some = np.flatnonzero(many)
    for a in range(0, len(some), 4096):
        own = some[a : a + 4096]
        lo, hi = int(rows[own[0]]), int(rows[own[-1] + 1])
        if hi - lo > 1 << 20 and len(own) == 1:  # one very long text
            for at in range(lo, hi, 1 << 20):
                total[own[0]] += np.unpackbits(h[at : min(hi, at + (1 << 20))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[own] = np.add.reduceat(bits, rows[own] - lo, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > many[:, None], axis=1, bitorder="little").view(_U).ravel()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, _U)
            for r0, part, at in slabs(*buffers(batch.column(1))):
                data, begin, stop, rows = shingles(part, at, shingle)
                out[r0 : r0 + len(at) - 1] = majorities(xxh64(data, begin, stop), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, fp bigint")


def bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fp: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the variant, key) for each bit of each segment."""
    number = 0
    for low, width in bounds(segments):
        part = (fp >> _U(low)) & _U((1 << width) - 1)
        for bit in range(width):
            rest = (part & _U((1 << bit) - 1)) | ((part >> _U(bit + 1)) << _U(bit))
            yield number, (_U(number) << _U(57)) | rest
            number += 1


def ball(bits: list[int], radius: int) -> np.ndarray:
    """All masks of up to radius of the bits, without none."""
    return np.array([sum(1 << b for b in some) for r in range(1, radius + 1) for some in combinations(bits, r)], _U)


def first_variant(x: np.ndarray, segments: int) -> np.ndarray:
    """The lowest variant number at which two fingerprints with this xor meet."""
    out, number = np.full(len(x), 64, np.int64), 0
    for low, width in bounds(segments):
        part = (x >> _U(low)) & _U((1 << width) - 1)
        near = (out == 64) & (np.bitwise_count(part) <= 1)
        bit = np.zeros(len(x), np.int64)
        odd = near & (part > 0)
        bit[odd] = np.bitwise_count(part[odd] - _U(1))
        out[near] = number + bit[near]
        number += width
    return out


def links_of_runs(key: np.ndarray, fp: np.ndarray, segments: int, radius: int, pairwise: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys of sorted rows."""
    n = len(key)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[cuts, n])
    a, b = [np.zeros(0, _U)], [np.zeros(0, _U)]
    small = np.repeat((size > 1) & (size <= pairwise), size)
    k, f = key[small], fp[small]
    for lag in range(1, min(pairwise, int(size[(size > 1) & (size <= pairwise)].max(initial=1)))):
        i = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(i):
            break
        x = f[i] ^ f[i + lag]
        near = (np.bitwise_count(x) <= radius) & (x > 0)
        i, x = i[near], x[near]
        own = first_variant(x, segments) == (k[i] >> _U(57)).astype(np.int64)
        a.append(f[i[own]])
        b.append(f[i[own] + lag])
    for c, m in zip(cuts[size > pairwise].tolist(), size[size > pairwise].tolist(), strict=True):
        for x, y in forest(np.unique(fp[c : c + m]), radius):
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def forest(members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the members (sorted, distinct) as all links within radius would: looks up every neighbour that the members' differing bits allow, or compares blocks where that is less work."""
    spread = int(np.bitwise_or.reduce(members ^ members[0]))
    bits = [i for i in range(64) if spread >> i & 1]
    root = np.arange(len(members))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x, y = [], []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        fresh = root[i] != root[j]
        for p, q in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                x.append(p)
                y.append(q)

    probes = sum(comb(len(bits), r) for r in range(1, radius + 1))
    if probes <= max(2100, len(members)):
        for mask in ball(bits, radius):
            other = members ^ mask
            at = np.minimum(np.searchsorted(members, other), len(members) - 1)
            hit = np.flatnonzero((members[at] == other) & (members < other))
            meet(hit, at[hit])
    else:
        for i in range(len(members) - 1):
            hit = np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= radius) + i + 1
            meet(np.full(len(hit), i), hit)
    yield members[np.array(x, np.int64)], members[np.array(y, np.int64)]


def _index(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(_U)
        for _, key in variants(fp, segments):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["k", "fp"])


def _join(batches: Iterator[pa.RecordBatch], segments: int, radius: int, run_limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted (k, fp) in; (a, b, k) links out, and (a, null, k) for each member of a run above run_limit."""

    def out(a: np.ndarray, b: np.ndarray | None, k: int = 0) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second, pa.array(np.full(len(a), k, _U).view(np.int64))], ["a", "b", "k"])

    key, fp, over = np.zeros(0, _U), np.zeros(0, _U), None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy().view(_U)])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(_U)])
        if over is not None:
            rest = int(np.argmax(key != over)) if (key != over).any() else len(key)
            yield out(fp[:rest], None, over)
            key, fp = key[rest:], fp[rest:]
            if not len(key):
                continue
            over = None
        last = int(np.argmax(key == key[-1])) if len(key) else 0
        if last:
            yield out(*links_of_runs(key[:last], fp[:last], segments, radius))
            key, fp = key[last:], fp[last:]
        if len(key) > run_limit:
            over = key[0]
            yield out(fp, None, over)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield out(*links_of_runs(key, fp, segments, radius))


def _cross(table: pa.Table, radius: int) -> pa.Table:
    """Links of one unit (side 0: within one block; sides 1 and 2: between two) that connect its members as all links do."""
    side, fp = table.column("side").to_numpy(), table.column("a").to_numpy().view(_U)
    a, b = [np.zeros(0, _U)], [np.zeros(0, _U)]
    if (side == 0).all():
        for x, y in forest(np.unique(fp), radius):
            a.append(x)
            b.append(y)
    else:
        left, right = fp[side == 1], fp[side == 2]
        root = np.arange(len(left) + len(right))
        for i, x in enumerate(left):
            near = np.flatnonzero(np.bitwise_count(right ^ x) <= radius) + len(left)
            for j in near[root[near] != root[i]].tolist():
                if root[j] != root[i]:
                    a.append(left[i : i + 1])
                    b.append(right[j - len(left) : j - len(left) + 1])
                    old, new = max(root[j], root[i]), min(root[j], root[i])
                    root[root == old] = new
    return pa.table([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])


def _long_runs(over: DataFrame, distinct_fp: DataFrame, radius: int, run_limit: int) -> DataFrame:
    """(a, b): links of runs above run_limit, given their members (k, a)."""
    if radius <= 2:
        masks = ball(list(range(64)), radius).view(np.int64)

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column(0).to_numpy()
                for part in np.array_split(masks, max(1, len(masks) // 64)):
                    near = fp[:, None] ^ part[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(part))), pa.array(near.ravel())], ["a", "b"])

        near = over.select("a").distinct().mapInArrow(around, "a bigint, b bigint")
        return near.join(distinct_fp.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    sizes = over.groupBy("k").agg(F.ceil(2 * F.count("*") / run_limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("left"), F.greatest(o, own).alias("right"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    units = over.join(cut(sizes, "sizes"), "k").select("k", "a", F.explode(pair).alias("u")).select("k", "u.left", "u.right", "u.side", "a")
    return units.groupBy("k", "left", "right").applyInArrow(lambda t: _cross(t, radius), "a bigint, b bigint")


def links(distinct_fp: DataFrame, radius: int = 2, segments: int | None = None, run_limit: int = 200_000) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of column fp as all links within radius do."""
    segments = segments or radius // 2 + 1
    if radius >= 2 * segments:
        raise ValueError("some segment must differ by one bit at most: segments > radius / 2")
    spark = distinct_fp.sparkSession
    arrow_limits(spark, 20_000)
    keyed = distinct_fp.mapInArrow(lambda it: _index(it, segments), "k bigint, fp bigint")
    met = (
        keyed.repartition(F.col("k")).sortWithinPartitions("k")
        .mapInArrow(lambda it: _join(it, segments, radius, run_limit), "a bigint, b bigint, k bigint")
    )
    met = cut(met, "met")
    over = met.where("b is null").select("k", "a")
    found = met.where("b is not null").select("a", "b")
    return found if over.isEmpty() else found.union(_long_runs(over, distinct_fp, radius, run_limit))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2, segments: int | None = None, run_limit: int = 200_000) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable through links of up to radius differing bits."""
    own = cut(fingerprints(docs, text, key, shingle), "fp")
    heads = cut(own.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    pairs = cut(links(heads.select("fp"), radius, segments, run_limit), "links")
    # links between fingerprints, as components by the fingerprint; each then takes its smallest key
    comp = components(pairs, "a", "b").withColumnRenamed("node", "fp")
    grouped = cut(heads.join(comp, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root")), "roots")
    named = cut(grouped.groupBy("root").agg(F.min("head").alias("component")), "named")
    answer = cut(grouped.join(named, "root").select("fp", "component"), "answer")
    return own.join(answer, "fp").select("key", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
