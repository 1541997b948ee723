"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words of a text) are summed per cell of source, language and topic. Raking scales the cells' tokens so that the sums
along each dimension meet its targets in turn, round after round, until no cell moves by more than `tolerance` of all tokens. Where a target
can't be met (a source whose only language is to shrink) the rounds settle too, and the residual, the largest distance of a sum from its target as a share of all
tokens, says so. Up to `most_cells` cells, which are counted first, are raked in memory; beyond it the same steps run as partial
sums of each dimension joined back to the table of cells.

The expected number of times that a document is taken is rate * fitted / actual tokens of its cell. `repeats` is that number rounded down,
and one more where a hash of the document's id is below the remainder, so tokens times repeats meet the targets in expectation; rows without a
repeat are not returned. `probability` is that of being returned at all. Any rerun gives the same sample, and any executor may decide any document alone.

Targets are `uniform` over the values that occur, or `tempered` (shares to the power 1/2). The topic is a column of docs or a function of the text; by default the
kind of text is read off it: licence notices, contacts, lists, short and long prose.

Defined results: null sources, languages and topics are values of their own; null and empty texts have no tokens; a cell without
tokens keeps its documents with probability `rate`; documents with a null id share one hash value; repeated rows share their
fate; very long texts are counted whole; empty tables give empty tables; other columns pass through with keep_columns, and what is added gets underscores behind its name where docs
have such a column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, forget, free, table

Targets = tuple[tuple[str, str], ...]
TARGETS: Targets = (("source", "uniform"), ("lang", "tempered"), ("topic", "uniform"))
RATE, SHORT, TOLERANCE, ROUNDS, CELLS = 0.5, 1000, 1e-13, 1000, 200_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    return (
        F.when(text.contains("License") | text.contains("license"), "licence").when(text.contains("@"), "contact").when(text.contains(" | "), "list")
        .when(F.length(text) < SHORT, "short").otherwise("prose")
    )


def chance(key: Column) -> Column:
    """A uniform number in [0, 1) from the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake_in_memory(cells: Sequence[tuple], targets: Targets, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Fitted tokens of each cell (a value for each dimension, and tokens), and the residual."""
    tokens = np.array([c[-1] for c in cells], float)
    whole, codes, goals = tokens.sum(), [], []
    for i, (_, kind) in enumerate(targets):
        names: dict = {}
        code = np.array([names.setdefault(c[i], len(names)) for c in cells], np.int64)
        own = np.bincount(code, tokens)
        share = (own > 0).astype(float) if kind == "uniform" else np.sqrt(own)
        codes.append(code)
        goals.append(whole * share / max(share.sum(), 1e-300))
    fitted = tokens.copy()
    for _ in range(rounds if whole > 0 else 0):
        before = fitted
        for code, goal in zip(codes, goals, strict=True):
            own = np.bincount(code, fitted)
            fitted = fitted * np.where(own > 0, goal / np.where(own > 0, own, 1), 1)[code]
        if np.abs(fitted - before).max() <= tolerance * whole:
            break
    return fitted, max((float(np.abs(np.bincount(c, fitted) - g).max()) / whole for c, g in zip(codes, goals, strict=True)), default=0.0) if whole > 0 else 0.0


def _rake_as_table(cells: DataFrame, targets: Targets, tolerance: float, rounds: int, every: int = 2) -> tuple[DataFrame, float]:
    """The same with tables of one row per value of a dimension; written out, and the largest move looked at, every few rounds."""
    whole = float(cells.agg(F.sum("tokens").alias("t")).first().t or 0)
    goals = {}
    for d, kind in targets:
        own = cells.groupBy(F.col(d).alias(f"v_{d}")).agg(F.sum("tokens").alias("own"))
        own = own.withColumn("share", F.when(F.col("own") > 0, 1.0).otherwise(0.0) if kind == "uniform" else F.sqrt("own"))
        total = float(own.agg(F.sum("share").alias("t")).first().t or 0) or 1.0
        goals[d] = cut(own.select(f"v_{d}", (F.col("share") * F.lit(whole / total)).alias("goal")), "goals")
    out = cut(cells.withColumn("fitted", F.col("tokens")).withColumn("last", F.col("tokens")), "raked")
    for i in range(rounds):
        out = out.withColumn("last", F.col("fitted"))
        for d, _ in targets:
            sums = out.groupBy(F.col(d).alias(f"s_{d}")).agg(F.sum("fitted").alias("own"))
            scale = sums.join(goals[d], F.col(f"s_{d}").eqNullSafe(F.col(f"v_{d}"))).select(f"s_{d}", F.when(F.col("own") > 0, F.col("goal") / F.col("own")).otherwise(1.0).alias("scale"))
            out = out.join(scale, F.col(d).eqNullSafe(F.col(f"s_{d}"))).withColumn("fitted", F.col("fitted") * F.col("scale")).select(*cells.columns, "fitted", "last")
        if (i + 1) % every == 0:
            old, out = out, cut(out, "raked")
            forget(old)
            moved = out.agg(F.max(F.abs(F.col("fitted") - F.col("last"))).alias("m")).first().m or 0.0
            if moved <= tolerance * whole:
                break
    gaps = [out.groupBy(F.col(d).alias("s")).agg(F.sum("fitted").alias("own")).join(goals[d], F.col("s").eqNullSafe(F.col(f"v_{d}"))).agg(F.max(F.abs(F.col("own") - F.col("goal"))).alias("m")).first().m for d, _ in targets]
    return out.drop("last"), max(g or 0.0 for g in gaps) / whole if whole else 0.0


def rake(cells: DataFrame, targets: Targets = TARGETS, tolerance: float = TOLERANCE, rounds: int = ROUNDS, most_cells: int = CELLS) -> tuple[DataFrame, float]:
    """cells (dimensions and tokens) with column fitted, and the residual. At most most_cells cells reach the driver."""
    cells = cells.select(*[d for d, _ in targets], F.col("tokens").cast("double").alias("tokens"))
    some = [tuple(r) for r in cells.limit(most_cells + 1).collect()]
    if len(some) > most_cells:
        return _rake_as_table(cells, targets, tolerance, rounds)
    fitted, residual = rake_in_memory(some, targets, tolerance, rounds)
    rows = [(*cell, float(f)) for cell, f in zip(some, fitted, strict=True)]
    schema = ", ".join(f"`{d}` {cells.schema[d].dataType.simpleString()}" for d, _ in targets)
    return F.broadcast(cells.sparkSession.createDataFrame(rows, f"{schema}, tokens double, fitted double")), residual


def mix(docs: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", targets: Targets = TARGETS, keep_columns: bool = False, topic: str | Callable[[Column], Column] = topic_of, **how) -> DataFrame:
    """The sampled rows: key, dimensions, tokens, weight, probability and repeats; with keep_columns, all columns of docs, and topic and what follows it as mix_*."""
    dims = [d for d, _ in targets]
    kind = F.col(topic) if isinstance(topic, str) else topic(F.col(text))
    named = [(kind if d == "topic" else F.col(d)).alias(d) for d in dims]
    facts = docs.select(F.col(key).alias("key"), *named, tokens_of(F.col(text)).alias("n_tokens"))
    if keep_columns:
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), *named, tokens_of(F.col(text)).alias("n_tokens"))
    else:
        rows = facts = cut(facts, "facts")  # the sums and the answer read it, the texts are read once
    cells = cut(facts.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted, _ = rake(cells, targets, **how)
    weight = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)
    fitted = fitted.select(*[F.col(d).alias(f"c_{d}") for d in dims], weight.alias("weight"))
    joined = rows.join(fitted, [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in dims], "inner")
    times = rate * F.col("weight")
    kept = joined.withColumn("probability", F.least(F.lit(1.0), times)).withColumn("repeats", F.floor(times) + (chance(F.col("key")) < times - F.floor(times)).cast("bigint")).where("repeats > 0")
    if keep_columns:
        more = free(docs, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_repeats")
        return kept.select("row.*", *[F.col(c).alias(n) for c, n in zip(("topic", "n_tokens", "weight", "probability", "repeats"), more, strict=True)])
    return kept.select("key", *dims, "n_tokens", "weight", "probability", "repeats")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.select(F.col("key").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "repeats")


def oracle(targets: Targets = TARGETS, rounds: int = 300, rate: float = RATE) -> str:
    """The same in DuckDB SQL: a recursive table of rounds, each a scaling per dimension, enough of them to settle."""
    dims = [d for d, _ in targets]
    goal = {"uniform": lambda d: f"CASE WHEN sum(tokens) OVER (PARTITION BY {d}) > 0 THEN sum(tokens) OVER () / (SELECT count(*) FROM (SELECT {d} FROM cells GROUP BY {d} HAVING sum(tokens) > 0)) ELSE 0 END", "tempered": lambda d: f"sum(tokens) OVER () * sqrt(sum(tokens) OVER (PARTITION BY {d})) / (SELECT sum(sqrt(t)) FROM (SELECT sum(tokens) AS t FROM cells GROUP BY {d}))"}
    step = "f"
    for d in dims:
        own = f"sum(fitted) OVER (PARTITION BY {d})"
        step = f"(SELECT * REPLACE (CASE WHEN {own} > 0 THEN fitted * goal_{d} / {own} ELSE fitted END AS fitted) FROM {step})"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN contains(text, 'License') OR contains(text, 'license') THEN 'licence' WHEN contains(text, '@') THEN 'contact'
    WHEN contains(text, ' | ') THEN 'list' WHEN length(text) < {SHORT} THEN 'short' ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^	-
 ]+')), 0) AS BIGINT) AS n_tokens FROM documents
), cells AS MATERIALIZED (SELECT {", ".join(dims)}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL
), f AS (SELECT 0 AS round, *, tokens AS fitted, {", ".join(f"{goal[k](d)} AS goal_{d}" for d, k in targets)} FROM cells
  UNION ALL SELECT * REPLACE (round + 1 AS round) FROM {step} WHERE round < {rounds}
), w AS (SELECT d.*, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1.0 END AS weight FROM d JOIN (SELECT * FROM f WHERE round = {rounds}) c
  ON {" AND ".join(f"d.{x} IS NOT DISTINCT FROM c.{x}" for x in dims)}
), r AS (SELECT *, CAST(floor({rate} * weight) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < {rate} * weight - floor({rate} * weight) THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM w)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, {rate} * weight), 6) AS probability, repeats FROM r WHERE repeats > 0
"""
