"""SimHash near-duplicates at a low similarity: long fingerprints, indexed by one-wildcard segment variants.

At a Jaccard similarity of 0.8, 15 % of a fingerprint's bits differ. Segments so short that one of them must then differ by one bit at most would
tell nothing apart, so this form of the operator draws segments of `width` bit places from a fingerprint of `bits` bits, and so many of them that two texts of that
similarity agree but for one bit in some segment with a chance of `found`. The width follows the logarithm of the number of fingerprints, so that the
variants tell apart as much in large corpora as in small ones.

Two segments within one bit agree in one of their halves in full, and in a deletion variant of the other. So a fingerprint is sent twice a segment, to the group of
either half's value, and the variants of the other half are made, sorted and met by equality within the group: two rows a segment instead of one for
each variant. Whole fingerprints verify what meets: texts are linked where at most `radius` of the bits differ. Only a spanning forest of a group leaves it.

Exact copies collapse first: one row per distinct fingerprint. Where many members of a run resemble each other, a few of them are compared with all, which
connects most; those left outside the largest component are compared with all members of the run, so nothing is lost and the work is linear in a run of
near copies. Groups above `run_limit` are never held by a task: their rows are compared with leaders that partial aggregates choose, and the rows left outside meet
all rows of the group in blocks.

Shingles are distinct runs of words; where just half of the hashes have a bit the smallest hash decides, of two shingles a hash of both (else a text of two shingles
would be as one of the smaller alone).

Defined results: null and empty texts (and texts of white space only) have fingerprint zero and link with each other; a text of fewer words than a shingle is one
shingle; very long texts are read whole; repeated rows and keys link; tables may be empty and may have more columns of any name, which are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._io import arrow_limits, cut, spread
from ._vec import LOWER, SOLID, Words, buffers, mix, slabs
from .decontaminate import seeds

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def differing(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of sets of like size."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius_for(similarity: float, bits: int, slack: float = 1.2) -> int:
    """The bits that may differ: what is expected, and `slack` standard deviations."""
    p = differing(similarity)
    return int(bits * (p + slack * sqrt(p * (1 - p) / bits)))


def segments_for(n: int, similarity: float, found: float) -> tuple[int, int]:
    """(width, number) of segments for n fingerprints."""
    width = max(16, 2 * ceil((log2(max(n, 2)) - 2) / 2))
    p = differing(similarity)
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, ceil(log(1 - found) / log(1 - hit))


def places(bits: int, width: int, number: int) -> np.ndarray:
    """(number, width): the bit places of each segment, from as many fixed permutations as it takes."""
    rng = np.random.default_rng(64)
    drawn = np.concatenate([rng.permutation(bits) for _ in range(-(-number * width // bits))])
    return drawn[: number * width].reshape(number, width)


def majority(h: np.ndarray, bits: int) -> np.ndarray:
    """Bits that most of the distinct, sorted shingle hashes have, as `bits` // 64 words."""
    salt = np.arange(1, bits // 64 + 1, dtype=_U) * _STEP
    total = np.zeros(bits, np.int64)
    for a in range(0, len(h), 255):
        long = mix(mix(h[a : a + 255, None] + salt))
        total += np.unpackbits(long.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    tie = h[0] if len(h) != 2 else mix(h[:1] ^ h[1:])[0]
    tied = np.unpackbits(mix(mix(tie + salt)).view(np.uint8), bitorder="little")
    return np.packbits(np.where(total * 2 == len(h), tied, total * 2 > len(h)).astype(np.uint8), bitorder="little").view(_U)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    width = rows.shape[1] if rows.ndim > 1 else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _longs(column: pa.Array, words: int) -> np.ndarray:
    """A binary column of equal lengths as (rows, words) unsigned longs."""
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros((0, words), _U)
    start = np.frombuffer(at, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * words * 8].view(_U).reshape(-1, words)


def ids(fp: np.ndarray) -> np.ndarray:
    """MD5 of each fingerprint: 16 bytes that stand for it among links."""
    return np.frombuffer(b"".join(hashlib.md5(row.tobytes()).digest() for row in fp), np.uint8).reshape(-1, 16)


def fingerprints(docs: DataFrame, text: str, key: str, shingle: int, bits: int) -> DataFrame:
    """(key, id, fp)."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, bits // 64), _U)
            for r0, part, at in slabs(*buffers(batch.column(1))):
                w = Words(LOWER[part], at, SOLID)
                h = w.hashes()
                for i in np.flatnonzero(np.diff(w.at)).tolist():
                    own = h[w.at[i] : w.at[i + 1]]
                    out[r0 + i] = majority(np.unique(seeds(own, min(shingle, len(own)))), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(ids(out)), _binary(out.view(np.uint8))], ["key", "id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, id binary, fp binary")


def _halves(batches: Iterator[pa.RecordBatch], at: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """(k, fp): a row for either half of each segment."""
    half = at.shape[1] // 2
    weight = (1 << np.arange(half)).astype(np.int64)
    for batch in batches:
        fp = _longs(batch.column(0), words)
        bit = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
        for s, own in enumerate(at):
            for side in (0, 1):
                value = bit[:, own[side * half : (side + 1) * half]] @ weight
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(2 * s + side) << 40) + value), batch.column(0)], ["k", "fp"])


def _others(k: np.ndarray, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of the other half of the segment that each row is sent for."""
    half = at.shape[1] // 2
    which, out = k >> 40, np.zeros(len(k), np.int64)
    for number in np.unique(which).tolist():
        rows = np.flatnonzero(which == number)
        own = at[number // 2][:half] if number % 2 else at[number // 2][half:]
        for j, place in enumerate(own.tolist()):
            out[rows] |= ((fp[rows, place >> 6] >> _U(place & 63)) & _U(1)).astype(np.int64) << j
    return out


def labels_of(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each one's component, over links (i, j) and those that the labels hold already."""
    label = np.arange(n) if label is None else label
    while True:
        new = label.copy()
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, label[j], label[i])
        new = new[new][label]
        if (new == label).all():
            return label
        label = new


def connect(fp: np.ndarray, run: np.ndarray, label: np.ndarray, radius: int, leaders: int = 32) -> np.ndarray:
    """Labels after all links within a long run: leaders first, then all that are left outside the largest component against all."""

    def near(x: int) -> np.ndarray:
        return run[np.bitwise_count(fp[run] ^ fp[x]).sum(1, dtype=np.int64) <= radius]

    def outside() -> np.ndarray:
        names, at, many = np.unique(label[run], return_inverse=True, return_counts=True)
        return run[at != many.argmax()]

    rest = run
    for turn in range(leaders):
        x = int(rest[len(rest) * (turn + 1) // (leaders + 2)])
        hit = near(x)
        label = labels_of(len(label), np.full(len(hit), x), hit, label)
        rest = outside()
        if not len(rest):
            return label
    i, j = [], []
    for x in rest.tolist():
        hit = near(x)
        i.append(np.full(len(hit), x))
        j.append(hit)
    return labels_of(len(label), np.concatenate(i), np.concatenate(j), label)


def labels_of_groups(k: np.ndarray, fp: np.ndarray, at: np.ndarray, radius: int, pairwise: int = 64) -> np.ndarray:
    """Labels of rows (k, fp), sorted by k, over the links within their groups that share a variant of the other half."""
    n, half = len(k), at.shape[1] // 2
    other = _others(k, fp, at)
    group = np.cumsum(np.r_[0, k[1:] != k[:-1]]) if n else np.zeros(0, np.int64)
    label = np.arange(n)
    for bit in range(half):
        rest = (other & ((1 << bit) - 1)) | ((other >> (bit + 1)) << bit)
        key = (group << (half - 1)) | rest
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, n])
        small = np.repeat((size > 1) & (size <= pairwise), size)
        rows, own = order[small], key[small]
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, int(size[(size > 1) & (size <= pairwise)].max(initial=1))):
            met = np.flatnonzero(own[lag:] == own[:-lag])
            a, b = rows[met], rows[met + lag]
            fresh = label[a] != label[b]
            a, b = a[fresh], b[fresh]
            # half of the words first: of chance neighbours hardly one comes near
            some = np.bitwise_count(fp[a, :2] ^ fp[b, :2]).sum(1, dtype=np.int64) <= radius
            a, b = a[some], b[some]
            good = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= radius
            i.append(a[good])
            j.append(b[good])
        label = labels_of(n, np.concatenate(i), np.concatenate(j), label)
        for c, m in zip(starts[size > pairwise].tolist(), size[size > pairwise].tolist(), strict=True):
            run = order[c : c + m]
            if (label[run] != label[run[0]]).any():
                label = connect(fp, run, label, radius)
    return label


def _forest(fp: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(label != np.arange(len(label)))
    name = dict(zip((both := np.unique(np.r_[rows, label[rows]])).tolist(), ids(fp[both]), strict=True))
    of = lambda x: _binary(np.array([name[i] for i in x.tolist()], np.uint8).reshape(-1, 16))
    return pa.RecordBatch.from_arrays([of(rows), of(label[rows]), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], ["a", "b", "k", "fp"])


def _meet(batches: Iterator[pa.RecordBatch], at: np.ndarray, words: int, radius: int, run_limit: int, hold: int = 32_768) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k in; links (a, b) out, and (k, fp) of the rows of groups above run_limit."""
    key, fp, over = np.zeros(0, np.int64), np.zeros((0, words), _U), None

    def passed(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.binary()), pa.array(k), _binary(f.view(np.uint8).reshape(len(f), -1))], ["a", "b", "k", "fp"])

    for batch in _ended(batches):
        if batch is not None:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, _longs(batch.column(1), words)])
        if over is not None:
            rest = int(np.searchsorted(key, over, "right"))
            if rest:
                yield passed(key[:rest], fp[:rest])
            key, fp = key[rest:], fp[rest:]
            over = over if not len(key) else None
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        stop = len(key) if batch is None else last
        if stop and (batch is None or stop >= hold or len(key) > run_limit):
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(key[:stop]) != 0]), stop])
            large = np.repeat(size > run_limit, size)
            if large.any():
                yield passed(key[:stop][large], fp[:stop][large])
            k, f = key[:stop][~large], fp[:stop][~large]
            yield _forest(f, labels_of_groups(k, f, at, radius))
            key, fp = key[stop:], fp[stop:]
        if len(key) > run_limit:
            over = int(key[0])
            yield passed(key, fp)
            key, fp = key[:0], fp[:0]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _large_groups(rows: DataFrame, words: int, radius: int, block: int, leaders: int = 8) -> DataFrame:
    """(a, b) links that connect the rows (k, fp) of groups above the limit as all links within radius do."""
    first = [F.min_by("fp", F.xxhash64(F.lit(i), "fp")) for i in range(leaders)]
    chosen = cut(rows.groupBy("k").agg(F.array(*first).alias("leaders"), F.count("*").alias("n")), "leaders")

    def to_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, fp, n, a, b): a linked to its first leader b; or the row itself, if it is not in the first leader's component."""
        for batch in batches:
            k, fp = batch.column(0).to_numpy(), _longs(batch.column(1), words)
            out_a, out_b, left = [], [], np.zeros(len(k), bool)
            for key in np.unique(k).tolist():
                mine = np.flatnonzero(k == key)
                heads = np.array([np.frombuffer(x, _U) for x in batch.column(2)[int(mine[0])].as_py()])
                tie = np.array([[np.bitwise_count(x ^ y).sum() <= radius for y in heads] for x in heads])
                x, y = np.nonzero(tie)
                comp = labels_of(len(heads), x, y)
                near = np.array([np.bitwise_count(fp[mine] ^ h).sum(1, dtype=np.int64) <= radius for h in heads])
                for h in range(len(heads)):
                    hit = mine[near[h]]
                    out_a.append(ids(fp[hit]))
                    out_b.append(np.repeat(ids(heads[h : h + 1]), len(hit), axis=0))
                out_a.append(ids(heads[x]))
                out_b.append(ids(heads[y]))
                left[mine[~near[comp == 0].any(0)]] = True
            a, b = (np.concatenate(o) if o else np.zeros((0, 16), np.uint8) for o in (out_a, out_b))
            rest = np.flatnonzero(left)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([none(len(a), pa.int64()), none(len(a), pa.binary()), none(len(a), pa.int64()), _binary(a), _binary(b)], ["k", "fp", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(k[rest]), _binary(fp[rest].view(np.uint8).reshape(len(rest), -1)), batch.column(3).take(pa.array(rest)), none(len(rest), pa.binary()), none(len(rest), pa.binary())], ["k", "fp", "n", "a", "b"])

    met = cut(rows.join(F.broadcast(chosen) if chosen.count() < 10_000 else chosen, "k").select("k", "fp", "leaders", "n").mapInArrow(to_leaders, "k bigint, fp binary, n bigint, a binary, b binary"), "led")
    outside = met.where("k is not null").select("k", "fp")
    sizes = cut(outside.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("asking")).join(chosen.select("k", F.ceil(F.col("n") / block).cast("int").alias("asked")), "k"), "sizes")
    deal = lambda df, own, other: df.join(sizes, "k").select("k", F.pmod(F.xxhash64("fp"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "fp", F.lit(own == "asking").alias("asks"))
    units = deal(outside, "asking", "asked").unionByName(deal(rows, "asked", "asking"))

    def compare(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        fp = _longs(t.column("fp").combine_chunks(), words)
        own, all_rows = fp[asks], fp[~asks]
        a, b = [np.zeros((0, 16), np.uint8)], [np.zeros((0, 16), np.uint8)]
        for x in own:
            near = all_rows[np.bitwise_count(all_rows ^ x).sum(1, dtype=np.int64) <= radius]
            a.append(np.repeat(ids(x[None]), len(near), axis=0))
            b.append(ids(near))
        return pa.table([_binary(np.concatenate(a)), _binary(np.concatenate(b))], ["a", "b"])

    found = units.groupBy("k", "asking", "asked").applyInArrow(compare, "a binary, b binary")
    return met.where("k is null").select("a", "b").union(found).where("a != b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8, bits: int = 512, found: float = 0.98, run_limit: int = 200_000) -> DataFrame:
    """(key, id, component): component is the smallest key reachable through links of texts whose similarity the fingerprints put at `least` or more."""
    spark, words, radius = docs.sparkSession, bits // 64, radius_for(least, bits)
    own = cut(fingerprints(docs, text, key, shingle, bits), "fp")
    heads = cut(own.groupBy("id").agg(F.min("key").alias("head"), F.first("fp").alias("fp")), "heads")
    at = places(bits, *segments_for(heads.count(), least, found))
    arrow_limits(spark, 20_000)
    sent = heads.select("fp").mapInArrow(lambda it: _halves(it, at, words), "k bigint, fp binary").repartition(F.col("k")).sortWithinPartitions("k")
    met = cut(sent.mapInArrow(lambda it: _meet(it, at, words, radius, run_limit), "a binary, b binary, k bigint, fp binary"), "met")
    links = met.where("a is not null").select("a", "b")
    over = met.where("k is not null").select("k", "fp")
    if not over.isEmpty():
        links = links.union(_large_groups(over, words, radius, run_limit // 2))
    comp = components(cut(links, "links"), "a", "b").withColumnRenamed("node", "id")
    grouped = cut(heads.select("id", "head").join(comp, "id", "left").select("id", "head", F.coalesce("root", "id").alias("root")), "roots")
    named = grouped.groupBy("root").agg(F.min("head").alias("component"))
    answer = cut(grouped.join(named, "root").select("id", "component"), "answer")
    return own.select("key", "id").join(answer, "id").select("key", "id", "component")
