"""Vectors as arrays of doubles, and exact nearest neighbours as block products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import cut

#: Up to this many values (rows times width) the other side of a neighbour search is broadcast (256 MiB of doubles).
BROADCAST_VALUES = 32 << 20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, added: bool = False) -> Column:
    """v / max(|v|, 1e-12), or v / (|v| + 1e-12). The norm is bound to a lambda's variable: as an expression within the transform it would be worked out for every element."""
    n = norm(v)
    n = n + 1e-12 if added else F.greatest(n, F.lit(1e-12))
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m)), F.lit(0))


def centroid(rows: DataFrame, vec: str, *by: str) -> DataFrame:
    """by, centroid, n: the mean vector of each group, scaled to length 1. One aggregate that keeps a vector per group and combines before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array  # heavy to import: a driver that needs no centroids does without
    from pyspark.ml.stat import Summarizer

    grouped = rows.where(F.col(vec).isNotNull()).groupBy(*by)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))
    parts = grouped.agg(mean.alias("mean"), F.count("*").alias("n")).where("n > 0")
    return parts.select(*by, unit(F.col("mean")).alias("centroid"), "n")


def _neighbours(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int):
    """(row number, other id, distance) of the k nearest others by 1 - dot, itself excluded, ties to the smaller id."""
    dist = np.round(1.0 - x @ other.T, 12)
    dist[ids[:, None] == other_ids[None, :]] = np.inf
    k = min(k, len(other_ids))
    if k < len(other_ids):
        edge = np.partition(dist, k - 1, axis=1)[:, k - 1]
    else:
        edge = np.full(len(ids), np.inf)
    i, j = np.nonzero(dist <= edge[:, None])
    d = dist[i, j]
    sound = np.isfinite(d)
    i, j, d = i[sound], j[sound], d[sound]
    order = np.lexsort((other_ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], other_ids[j[keep]], d[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sound(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull())


def _slim(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vec) of the rows that have a vector without null components; others are nobody's neighbours and have none."""
    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec")).where(_sound(F.col("vec")))


def _best(met: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy("dist", "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


NEAR = "id bigint, other bigint, dist double"


def _size(slim: DataFrame) -> tuple[int, int]:
    """Rows and values of the vectors: the proof that they may be broadcast."""
    facts = slim.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    return facts.n, facts.n * (facts.width or 0)


def _against_all(slim: DataFrame, n: int, k: int, emit: Callable, schema: str) -> DataFrame:
    """Every task multiplies its rows with all vectors, which are broadcast; emit(ids, row numbers, others, distances) makes a batch, rows sorted by distance within each id."""
    all_rows = slim.toArrow()
    sent = slim.sparkSession.sparkContext.broadcast((all_rows.column("id").to_numpy(), _matrix(all_rows.column("vec").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_ids, other = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                own = part.column(0).to_numpy()
                yield emit(own, *_neighbours(own, _matrix(part.column(1)), other_ids, other, k))

    return (slim.repartition(slim.sparkSession.sparkContext.defaultParallelism) if n > 512 else slim).mapInArrow(run, schema)


def nearest(rows: DataFrame, k: int, key: str = "id", vec: str = "vec", most_values: int = BROADCAST_VALUES, exact: bool = False, **how) -> DataFrame:
    """(id, other, dist, rank): the k nearest other rows by cosine distance of unit vectors. Rows without a vector, or with null components, take no part.

    Where the vectors' measured size is within a broadcast's bound, every task multiplies its rows with all vectors, and the result is exact.
    Beyond it a join over lists of near vectors finds them (nearest_by_lists, with its measured recall), as every exact plan compares all with all; `exact` asks
    for that all the same (nearest_by_blocks).
    """
    slim = _slim(rows, key, vec)
    n, values = _size(slim)
    if values > most_values:
        return nearest_by_blocks(slim, k, n, **how) if exact else nearest_by_lists(slim, k, n, **how)

    def emit(ids: np.ndarray, i: np.ndarray, other: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other), pa.array(dist), pa.array(rank.astype(np.int32))], ["id", "other", "dist", "rank"])

    return _against_all(slim, n, k, emit, NEAR + ", rank int")


def mean_nearest(rows: DataFrame, k: int, key: str = "id", vec: str = "vec", most_values: int = BROADCAST_VALUES, **how) -> DataFrame:
    """(id, mean): the mean distance of each row to its k nearest others; 0 for rows that have none. Within a broadcast's bound a map: no pair leaves its task."""
    slim = _slim(rows, key, vec)
    n, values = _size(slim)
    if values > most_values:
        means = nearest(rows, k, key, vec, most_values, **how).groupBy("id").agg(F.avg("dist").alias("mean"))
        return rows.select(F.col(key).cast("bigint").alias("id")).join(means, "id", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"))

    def emit(ids: np.ndarray, i: np.ndarray, other: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        many = np.bincount(i, minlength=len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(i, dist, len(ids)) / np.maximum(many, 1))], ["id", "mean"])

    without = rows.where(~F.coalesce(_sound(F.col(vec)), F.lit(False))).select(F.col(key).cast("bigint").alias("id"), F.lit(0.0).alias("mean"))
    return _against_all(slim, n, k, emit, "id bigint, mean double").union(without)


def _unit_of(asks: str, k: int):
    """The k nearest of a unit's asking rows among its other rows."""

    def pair(table: pa.Table) -> pa.Table:
        asking = table.column(asks).to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(asking)), table.filter(pa.array(~asking))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            ids, x, y = b.column("id").to_numpy(), _matrix(b.column("vec").combine_chunks()), _matrix(a.column("vec").combine_chunks())
            own = a.column("id").to_numpy()
            for at in range(0, len(own), 512):
                i, o, d = _neighbours(own[at : at + 512], y[at : at + 512], ids, x, k)
                out.append((own[at : at + 512][i], o, d))
        return pa.table([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["id", "other", "dist"])

    return pair


def nearest_by_blocks(slim: DataFrame, k: int, n: int, block: int = 4096) -> DataFrame:
    """Exactly: rows fall into blocks by their id's hash, every pair of blocks is a task's unit, and the k best of each unit merge in a window per row. Every vector travels n / block times."""
    blocks = max(1, -(-n // block))
    own = slim.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = own.select(F.col("b").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("r"), F.lit(True).alias("asks"), "id", "vec")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("l"), F.col("b").alias("r"), F.lit(False).alias("asks"), "id", "vec")
    return _best(left.unionByName(right).groupBy("l", "r").applyInArrow(_unit_of("asks", k), NEAR), k)


def centres_of(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means from its first rows."""
    centres = x[: min(lists, len(x))].copy()
    for _ in range(rounds if len(x) else 0):
        best = lists_of(x, centres)
        for c in np.unique(best).tolist():
            centres[c] = x[best == c].mean(0)
    return centres


def lists_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, ties to the smaller number."""
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, 1)


def enough_probes(x: np.ndarray, centres: np.ndarray, space: str, k: int, recall: float = 0.95, queries: int = 256) -> int:
    """How many of the nearest lists hold `recall` of the k nearest of x (without itself) to its members, on average over up to `queries` of them."""
    if len(x) <= k:
        return len(centres)
    own = lists_of(x, centres)
    some = np.unique(np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int))
    far = ((x**2).sum(1)[None, :] if space == "l2" else 0) - (2 if space == "l2" else 1) * x[some] @ x.T
    far[np.arange(len(some)), some] = np.inf
    near = np.argpartition(far, k - 1, 1)[:, :k]
    # the place of each neighbour's list in the order in which a query reads lists
    turn = np.argsort(np.argsort((centres**2).sum(1)[None, :] - 2 * x[some] @ centres.T, 1), 1)
    read = np.take_along_axis(turn, own[near], 1)
    found = np.array([(read < p).mean() for p in range(1, len(centres) + 1)])
    return int(np.argmax(found >= recall)) + 1


def nearest_by_lists(slim: DataFrame, k: int, n: int, block: int = 4096, sample_rows: int = 4096, most_lists: int = 4096, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """Approximately: rows lie in lists by their nearest centre and ask in as many lists, nearest first, as a bounded sample needs for `recall` of its k nearest.

    A list longer than `block` is cut into blocks by a hash of the id, and so are those who ask there; each pair of a block and a part is a unit, so no task holds a hot list, and all rows are indexed. With
    as many probes as lists the result is exact. Where the sample needs most lists (vectors without any structure) the join approaches all pairs: that is the price of its recall.
    """
    x = np.array([r.vec for r in slim.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()], np.float64)
    centres = centres_of(x, int(np.clip(2 * np.sqrt(n), 1, min(most_lists, max(1, len(x) // 8)))))
    reads = min(probes or enough_probes(x, centres, "ip", min(k, max(1, len(x) // 8)), recall), len(centres))
    sent = slim.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, vec, list, lists): where a row lies, and where it asks."""
        mid = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                far = (mid**2).sum(1)[None, :] - 2 * _matrix(part.column(1)) @ mid.T
                order = np.argsort(far, 1, kind="stable")[:, :reads].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order[:, 0]), pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * reads), pa.array(order.ravel()))], ["id", "vec", "list", "lists"])

    placed = cut(slim.mapInArrow(place, "id bigint, vec array<double>, list int, lists array<int>"), "lists")
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parts = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("parts"))
    sizes = F.broadcast(cut(blocks.join(parts, "list"), "sizes"))  # a row per list, most_lists at most
    deal = lambda number, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(number)).cast("int")
    each = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    lying = placed.join(sizes, "list").select("list", deal("blocks", 0).alias("b"), each("parts").alias("p"), F.lit(False).alias("asks"), "id", "vec")
    asking = placed.select("id", "vec", F.explode("lists").alias("list")).join(sizes, "list").select("list", each("blocks").alias("b"), deal("parts", 1).alias("p"), F.lit(True).alias("asks"), "id", "vec")
    return _best(lying.unionByName(asking).groupBy("list", "b", "p").applyInArrow(_unit_of("asks", k), NEAR), k)


def nearest_by_columns(rows: DataFrame, k: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """The same by column expressions alone, for small tables: what tests hold nearest() against."""
    a = rows.select(F.col(key).alias("id"), F.col(vec).alias("va"))
    b = rows.select(F.col(key).alias("other"), F.col(vec).alias("vb"))
    dist = F.round(1.0 - dot(F.col("va"), F.col("vb")), 12)
    met = a.join(b, F.col("id") != F.col("other")).select("id", "other", dist.alias("dist"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("dist", "other"))).where(F.col("rank") <= k)
