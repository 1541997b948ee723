"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits of any script, case folded. Seeds are the hashes of all runs of `least` words. A document's seeds
that some benchmark item has too are found in one pass, against a bitmap of the benchmark's seeds whose size follows their number up to a
bound. A (document, item) pair is a candidate if they share a seed of the item's prefix: an item covered to `floor` shares at least
ceil(floor * words / least) of its seed places, so at least one of any larger remainder, and the rarest seeds are taken for that. Seeds that many items share,
as set phrases are, thus pair hardly anything, and none that qualifies is lost. For each candidate, tiling repeatedly takes the longest
match of words not yet marked on either side, marks it, and goes on down to `least` words. The running hashes are those of
the seeds (Karp-Rabin): words match from p and q for least + j words if the seeds at p..p+j and q..q+j agree. Item
coverage is the share of its words that tiles mark, wherever in the document they stand, so reordered passages count in
full. A document is contaminated by an item from a coverage of `threshold` on.

A document's seeds travel as one row of places, never as a row per seed. The table from seeds to items is broadcast where its rows are within `most_seeds`;
beyond it both sides meet on the seed and a number dealt by the document, so a seed of a third of all documents is split.

Defined results: null and empty texts, and texts without letters and digits, are not contaminated; very long texts are read whole; an item of fewer than `least` words is
compared as one seed of all its words; an item without words, or with a null id, matches nothing; of rows repeated with an item id each is compared, and the largest coverage
counts; repeated rows (of doc_id and text) are one document; matches of equal length go to the smallest place in the item, then in the document; empty
tables give no contamination; columns other than key and text are never read, whatever their names, and the filter passes them on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._io import arrow_limits, cut, free, spread, table
from ._vec import ALNUM, LOWER, Words, buffers, mix, slabs

_U = np.uint64


def folded(text: Column) -> Column:
    """Texts beyond ASCII with folded case, and one space for each run of what is neither a letter nor a digit; ASCII as it is, which Words folds."""
    # upper, then lower, as ß and SS are equal; the optimizer drops an upper that stands right within a lower
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.lower(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", " "))).otherwise(text)


def seeds(h: np.ndarray, size: int) -> np.ndarray:
    """Running hash of every `size` words."""
    if len(h) < size or not size:
        return np.zeros(0, _U)
    out = np.zeros(len(h) - size + 1, _U)
    for k in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out + _U(size))


def _items(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per item and seed: (item, copy, n_words, pos, size, seed)."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        w = Words(LOWER[data], offsets, ALNUM)
        h, who, count, pos, size, seed = w.hashes(), [], [], [], [], []
        for i, key in enumerate(batch.column(0).to_pylist()):
            own = h[w.at[i] : w.at[i + 1]]
            if key is None or not len(own):
                continue
            s = seeds(own, min(least, len(own)))
            who += [i] * len(s)
            count += [len(own)] * len(s)
            pos += range(len(s))
            size += [min(least, len(own))] * len(s)
            seed += s.view(np.int64).tolist()
        at = pa.array(who, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(count, pa.int32()), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(seed, pa.int64())], ["item", "copy", "n_words", "pos", "size", "seed"])


def _probe(batches: Iterator[pa.RecordBatch], words: np.ndarray, sizes: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """(rk, doc, pos, seed): a row per document, with the places and values of the seeds that the bitmap lets through."""
    for batch in batches:
        rk, doc = batch.column(0), batch.column(1)
        for r0, part, at in slabs(*buffers(batch.column(2))):
            w = Words(LOWER[part], at, ALNUM)
            h, row = w.hashes(), w.row
            found = []
            for size in sizes:
                s = seeds(h, size)
                bucket = s >> _U(64 - bits)
                hit = np.flatnonzero(words[(bucket >> _U(6)).astype(np.int64)] >> (bucket & _U(63)) & _U(1))
                hit = hit[row[hit] == row[hit + size - 1]]
                found.append((row[hit], hit - w.at[row[hit]], s[hit].view(np.int64)))
            own, pos, seed = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            if len(own):
                order = np.lexsort((pos, own))
                own, pos, seed = own[order], pos[order].astype(np.int32), seed[order]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                cuts = pa.array(np.r_[starts, len(own)].astype(np.int32))
                who = pa.array(own[starts] + r0)
                yield pa.RecordBatch.from_arrays([rk.take(who), doc.take(who), pa.ListArray.from_arrays(cuts, pa.array(pos)), pa.ListArray.from_arrays(cuts, pa.array(seed))], ["rk", "doc", "pos", "seed"])


def tile(item: list[tuple[int, int]], doc: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item word, document word, words) from (place, seed) lists of either side; ties go to the smallest places.

    All longest matches are found once, as runs along the diagonals of equal seeds, and wait in a heap by length. A run that later marks have cut
    goes back as its free parts.
    """
    if not item or not doc:
        return []
    q, s = (np.array(c, np.int64) for c in zip(*item, strict=True))
    p, t = (np.array(c, np.int64) for c in zip(*doc, strict=True))
    order = np.argsort(t, kind="stable")
    p, t = p[order], t[order]
    lo, hi = np.searchsorted(t, s), np.searchsorted(t, s, "right")
    many = hi - lo
    q = np.repeat(q, many)
    p = p[np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(q))]
    order = np.lexsort((q, p - q))
    q, p = q[order], p[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(q) != 1) | (np.diff(p) != 1)]) if len(q) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(q)]) + size - 1
    heap = list(zip((-lengths).tolist(), q[starts].tolist(), p[starts].tolist(), strict=True))
    heapq.heapify(heap)
    marked_i = np.zeros(int(q.max(initial=0)) + size + 1, bool)
    marked_d = np.zeros(int(p.max(initial=0)) + size + 1, bool)
    tiles = []
    while heap:
        n, q0, p0 = heapq.heappop(heap)
        n = -n
        taken = marked_i[q0 : q0 + n] | marked_d[p0 : p0 + n]
        if not taken.any():
            tiles.append((q0, p0, n))
            marked_i[q0 : q0 + n] = True
            marked_d[p0 : p0 + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= size:
                heapq.heappush(heap, (a - b, q0 + a, p0 + a))
    return tiles


def _tile(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """The tiles of each candidate, unless all places of its shared seeds together can't cover the item to the floor."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            rk, doc, item, n_words, size = (batch.column(c)[i].as_py() for c in range(5))
            pos, seed, own_pos, own_seed = (batch.column(c)[i].values.to_numpy() for c in range(5, 9))
            mine = np.isin(seed, own_seed)
            there = np.isin(own_seed, seed)
            if there.sum() * size < floor * n_words:
                continue
            tiles = tile(list(zip(own_pos[there].tolist(), own_seed[there].tolist(), strict=True)), list(zip(pos[mine].tolist(), seed[mine].tolist(), strict=True)), size)
            out.append((rk, doc, item, sum(t[2] for t in tiles) / n_words, len(tiles)))
        c = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], batch.schema.field("doc").type), pa.array(c[2], batch.schema.field("item").type), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int64())], ["rk", "doc", "item", "coverage", "tiles"])


def bitmap(seed: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, one set per seed; at most 2**(bits-6) rows reach the driver."""
    word = F.shiftrightunsigned("seed", 64 - bits + 6).alias("w")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("b")
    out = np.zeros(1 << (bits - 6), _U)
    for w, b in seed.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[w] = b & 0xFFFFFFFFFFFFFFFF
    return out


def prefixes(own: DataFrame, floor: float) -> DataFrame:
    """(seed, copies): for each seed, the copies of items whose prefix holds it. A prefix is all but the ceil(floor * n_words / size) - 1 places whose seeds most items share."""
    items = own.groupBy("seed").agg(F.count_distinct("copy").alias("items"))
    order = W.partitionBy("copy").orderBy("items", "seed", "pos")
    ranked = own.join(items, "seed").withColumn("rank", F.row_number().over(order)).withColumn("places", F.count("*").over(W.partitionBy("copy")))
    needed = F.greatest(F.ceil(F.lit(floor) * F.col("n_words") / F.col("size")), F.lit(1))
    return ranked.where(F.col("rank") <= F.col("places") - needed + 1).groupBy("seed").agg(F.collect_set("copy").alias("copies"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", least: int = 5, floor: float = 0.0, bits: int | None = None, most_seeds: int = 1 << 20, salts: int = 16) -> DataFrame:
    """(rk, doc, item, coverage, tiles) of every (document, item) pair that shares a seed and covers at least `floor`.

    The bitmap has `bits` bits, by default 16 a seed within 2**20 and 2**26.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    kind, ikind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    # rows of one item id are items of their own until the end
    own = benchmark.select(F.col(item), folded(F.col("text")), F.xxhash64(item, "text")).mapInArrow(lambda it: _items(it, least), f"item {ikind}, copy bigint, n_words int, pos int, size int, seed bigint")
    own = cut(own.distinct(), "items")
    facts = own.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(facts.sizes)
    if bits is None:
        bits = min(26, max(20, (16 * facts.n).bit_length()))
    bits_of = spark.sparkContext.broadcast(bitmap(own, bits))
    rows = spread(docs.select(F.xxhash64(key, text).alias("rk"), F.col(key).alias("doc"), folded(F.col(text)).alias("text")))
    hits = rows.mapInArrow(lambda it: _probe(it, bits_of.value, sizes, bits), f"rk bigint, doc {kind}, pos array<int>, seed array<bigint>")
    hits = cut(hits, "hits")
    which = cut(prefixes(own, floor), "which")
    asked = hits.select("rk", "doc", F.explode(F.array_distinct("seed")).alias("seed"))
    if facts.n <= most_seeds:
        met = asked.join(F.broadcast(which), "seed")
    else:
        met = asked.withColumn("salt", F.pmod("rk", F.lit(salts))).join(which.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["seed", "salt"])
    pairs = cut(met.select("rk", "doc", F.explode("copies").alias("copy")).distinct(), "pairs")
    items = own.groupBy("copy").agg(F.first("item").alias("item"), F.first("n_words").alias("n_words"), F.first("size").alias("size"), F.collect_list("pos").alias("own_pos"), F.collect_list("seed").alias("own_seed"))
    cand = pairs.join(hits.withColumnRenamed("doc", "d"), (pairs["rk"] == hits["rk"]) & pairs["doc"].eqNullSafe(F.col("d"))).drop(hits["rk"]).join(items, "copy")
    cand = cand.select("rk", "doc", "item", "n_words", "size", F.col("pos"), F.col("seed"), "own_pos", "own_seed")
    found = cand.mapInArrow(lambda it: _tile(it, floor), f"rk bigint, doc {kind}, item {ikind}, coverage double, tiles bigint").where(F.col("coverage") >= floor)
    # a repeated document has its row once, an item its best copy
    return found.groupBy("rk", "doc", "item").agg(F.max("coverage").alias("coverage"), F.max_by("tiles", "coverage").alias("tiles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.6, **how) -> DataFrame:
    """(rk, doc, items, coverage): documents with items covered to at least `threshold`, the items sorted, and the largest coverage."""
    return matches(docs, benchmark, key, text, floor=threshold, **how).groupBy("rk", "doc").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones; all columns pass through."""
    rk, doc = free(docs, "rk", "doc")
    found = contaminated(docs, benchmark, key, text, **how).select(F.col("rk").alias(rk), F.col("doc").alias(doc))
    return docs.join(found, (F.xxhash64(docs[key], docs[text]) == found[rk]) & docs[key].eqNullSafe(found[doc]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (sorted), coverage (largest)."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("items").alias("item_ids"), F.round("coverage", 6).alias("coverage"))
