"""Embedding near-duplicates by a pivot-permutation index.

Pivots are spread-out reference vectors from a bounded sample. A vector is described by its `nearest` pivots in order of
similarity. The inverted lists are keyed by two pivots, so that all that stand in one list share two pivots at least;
pairs there that share `shared` pivots are verified by their cosine in double precision. Two vectors meet in the list of
the two smallest pivots that they share, and nowhere else, so each pair is verified and counted once.

Exact copies collapse before the index and count with their number. A list of more than `block` vectors is cut into
blocks by a hash of the vector's id, and every pair of blocks is a unit of its own: no task holds more than two blocks, no
pair is capped, and only counts and the links of a spanning forest leave a unit, never all pairs. Vectors close
to each other are compared by matrix products.

The number of pivots follows the square root of the number of vectors, up to `most_pivots`, which bounds the broadcast.
Recall is that of the permutation: tests hold it against brute force.

Defined results: null, empty, zero and non-finite vectors, and vectors with null components, link with nothing; vectors
link only with vectors of their own length, each length having its own index; rows repeated with one id count as
vectors; null ids count as links but name no component; tables may be empty; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._io import arrow_limits, cut, table


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, many: int, apart: float = 0.8) -> np.ndarray:
    """Up to `many` vectors of the sample in its order, none closer than `apart` to an earlier one, the first of the others if these are few."""
    chosen: list[int] = []
    rest: list[int] = []
    for i in range(len(sample)):
        if len(chosen) == many:
            break
        (rest if chosen and float((sample[chosen] @ sample[i]).max()) > apart else chosen).append(i)
    chosen += rest[: min(8, many) - len(chosen)] if len(chosen) < min(8, many) else []
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; ties to the smaller number."""
    order = np.argsort(-np.round(unit(x) @ pivots.T, 12), axis=1, kind="stable")
    return order[:, :nearest].astype(np.int32)


def _post(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, nearest: int) -> Iterator[pa.RecordBatch]:
    n = len(pivots)
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            perm = np.sort(describe(_matrix(part.column(1)), pivots, nearest), axis=1).astype(np.int64)
            i, j = np.triu_indices(perm.shape[1], 1)
            key = perm[:, i] * n + perm[:, j]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(len(perm)), len(i))))], ["k", "vid"])


def unit_links(own: np.ndarray, other: np.ndarray | None, key: int, pivots: np.ndarray, nearest: int, shared: int, least: float):
    """Index pairs (i, j) of a unit that link and whose list this is: own against itself or against other."""
    n = len(pivots)
    a = unit(own)
    b = a if other is None else unit(other)
    close = a @ b.T >= least
    if other is None:
        close &= np.triu(np.ones(close.shape, bool), 1)
    i, j = np.nonzero(close)
    if not len(i):
        return i, j
    pa_ = np.sort(describe(own, pivots, nearest), axis=1)
    pb = pa_ if other is None else np.sort(describe(other, pivots, nearest), axis=1)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 50_000):
        x, y = pa_[i[s : s + 50_000]], pb[j[s : s + 50_000]]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        first = both.argmax(1)
        rest = both.copy()
        rest[np.arange(len(x)), first] = False
        second = rest.argmax(1)
        rows = np.arange(len(x))
        keep[s : s + 50_000] = (both.sum(1) >= shared) & (x[rows, first].astype(np.int64) * n + x[rows, second] == key)
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, nearest: int, shared: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (k, left, right, side, vid, copies, vec), sorted by unit (k, left, right); (a, b, n) out: links and counts."""
    none = np.zeros(0, np.int64)

    def work(unit_rows: list[np.ndarray], vecs: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side, vid, copies = unit_rows
        order = np.argsort(vid, kind="stable")
        side, vid, copies, vecs = side[order], vid[order], copies[order], vecs[order]
        if (side == 0).all():
            i, j = unit_links(vecs, None, key, pivots, nearest, shared, least)
        else:
            l, r = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            i, j = unit_links(vecs[l], vecs[r], key, pivots, nearest, shared, least) if len(l) and len(r) else (none, none)
            i, j = l[i] if len(i) else i, r[j] if len(j) else j
        if not len(i):
            return none, none, none
        n = np.bincount(i, copies[j], len(vid)) + np.bincount(j, copies[i], len(vid))
        label = _forest(len(vid), i, j)
        met = np.flatnonzero(n)
        return vid[met], vid[label[met]], n[met].astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
        if not held:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k, left, right = (t.column(c).to_numpy() for c in range(3))
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        ends = np.r_[start[1:], len(k)]
        whole = len(start) if batch is None else len(start) - 1
        if whole:
            stop = int(ends[whole - 1])
            side, vid, copies = (t.column(c).to_numpy() for c in range(3, 6))
            vecs = _matrix(t.column(6).combine_chunks())
            out = [work([side[s:e], vid[s:e], copies[s:e]], vecs[s:e], int(k[s])) for s, e in zip(start[:whole].tolist(), ends[:whole].tolist(), strict=True) if e - s > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["a", "b", "n"])
            held = t.slice(stop).to_batches()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _links(heads: DataFrame, n: int, least: float, nearest: int, shared: int, block: int, sample_rows: int, most_pivots: int) -> DataFrame:
    """(a, b, n) of heads (vid, copies, vec), all vectors of one length; n distinct vectors."""
    rows = heads.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(sample_rows).collect()
    sample = unit(np.array([r.vec for r in rows]))
    pivots = choose_pivots(sample, int(np.clip(4 * np.sqrt(n), 8, most_pivots)))
    nearest = min(nearest, len(pivots))
    if nearest < 2:  # a single vector
        return heads.select(F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(0).cast("bigint").alias("n")).limit(0)
    shared = min(shared, nearest)
    sent = heads.sparkSession.sparkContext.broadcast(pivots)
    posted = heads.select("vid", "vec").mapInArrow(lambda it: _post(it, sent.value, nearest), "k bigint, vid bigint")
    posted = cut(posted, "postings")
    sizes = posted.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    sizes = cut(sizes.select("k", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "sizes")
    # a vector's lists, as many as pairs of its nearest pivots; the vector itself travels once to them and once to its units
    lists = posted.join(sizes, "k").groupBy("vid").agg(F.collect_list(F.struct("k", "blocks")).alias("lists"))
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("left"), F.greatest(o, own).alias("right"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    units = heads.select("vid", "copies", "vec").join(lists, "vid").select("vid", "copies", "vec", F.explode("lists").alias("l")).select("l.k", "l.blocks", "vid", "copies", "vec")
    units = units.select("k", F.explode(pair).alias("u"), "vid", "copies", "vec").select("k", "u.left", "u.right", "u.side", "vid", "copies", "vec")
    units = units.repartition("k", "left", "right").sortWithinPartitions("k", "left", "right")
    return units.mapInArrow(lambda it: _compare(it, sent.value, nearest, shared, least), "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", least: float = 0.95, nearest: int = 6, shared: int = 2, block: int = 1024, sample_rows: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """(key, n_links, component): other vectors at cosine >= least, and the smallest key reachable through them."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    finite = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("vec"))
    own = cut(rows.where(sound), "vectors")
    heads = own.groupBy("vec").agg(F.min("key").alias("head"), F.count("*").alias("copies"))
    heads = cut(heads.select("vec", "head", "copies", F.xxhash64("vec").alias("vid"), F.size("vec").alias("dim")), "heads")
    found = None
    for r in heads.groupBy("dim").agg(F.count("*").alias("n")).collect():
        one = _links(heads.where(F.col("dim") == r.dim), r.n, least, nearest, shared, block, sample_rows, most_pivots)
        found = one if found is None else found.union(one)
    blank = rows.where(~sound).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component"))
    if found is None:
        return blank
    found = cut(found, "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found, "a", "b")
    label = (
        heads.select("vid", "head").join(comp.withColumnRenamed("node", "vid"), "vid", "left")
        .select("vid", "head", F.coalesce("root", "vid").alias("root"))
    )
    label = cut(label, "labels")
    named = cut(label.groupBy("root").agg(F.min("head").alias("component")), "named")
    answer = label.join(named, "root").join(counts.withColumnRenamed("a", "vid"), "vid", "left").select("vid", "component", F.coalesce("n", F.lit(0)).alias("n"))
    answer = cut(heads.select("vec", "vid", "copies").join(answer, "vid").select("vec", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component"), "answer")
    return own.join(answer, "vec").select("key", "n_links", "component").union(blank)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


#: All pairs, for tables small enough for that.
ORACLE = """
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95),
w AS (SELECT vec_id AS x, vec_id AS y FROM u UNION SELECT w.x, e.y FROM w JOIN e ON w.y = e.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM w GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
