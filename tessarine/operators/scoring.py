"""Novelty, distance to the centroid, reference classes, and their fusion to one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .vectors import centroid, dot, doubles, mean_nearest, unit

#: Weights of the fused scores, slope and clip of the likelihood, limits of the hints.
GENERIC = {"novelty": 0.65, "centroid_dist": 0.35}
REFERENCE = {"novelty": 0.35, "centroid_dist": 0.15, "bad_margin": 0.50}
NEIGHBOURS = 20
SLOPE, CLIP = 4.0, 30.0
BAD_FROM, GOOD_TO = 0.60, 0.40
BAD_AT, STRONGLY_BAD_AT = 0.5, 0.65


def unit_rows(rows: DataFrame, key: str, vec: str, *more: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), *more, unit(doubles(F.col(vec))).alias("vec"))


def novelty(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, novelty): mean distance to the max(1, min(k, n - 1)) nearest others; 0 for a single row."""
    return mean_nearest(rows, max(1, k)).select("id", F.col("mean").alias("novelty"))


def centroid_distance(rows: DataFrame) -> DataFrame:
    """(id, centroid_dist): 1 - cosine to the centroid of all rows, which is one row and goes to every task."""
    mean = centroid(rows, "vec").select("centroid")
    return rows.crossJoin(F.broadcast(mean)).select("id", (1.0 - dot(F.col("vec"), F.col("centroid"))).alias("centroid_dist"))


def z_scores(rows: DataFrame, *names: str) -> DataFrame:
    """rows with z_<name> for each name: population deviation, all 0 where it is below 1e-12. One aggregate for all names."""
    facts = rows.agg(*[f(n).alias(f"{p}_{n}") for n in names for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    def z(n: str) -> Column:
        return F.when(F.col(f"s_{n}") < 1e-12, 0.0).otherwise((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}"))
    return rows.crossJoin(F.broadcast(facts)).select(*rows.columns, *[z(n).alias(f"z_{n}") for n in names])


def likelihood(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(SLOPE * margin, F.lit(CLIP)), F.lit(-CLIP))))


def quality_hint(bad: Column) -> Column:
    return F.when(bad >= BAD_FROM, "bad_like").when(bad <= GOOD_TO, "good_like").otherwise("uncertain")


def class_scores(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(id, bad_margin, bad_likelihood, reference_mode) against the centroids of the classes `good` and `bad`.

    references: (label, vec). With one class only, margins are against the mean similarity; with none they are 0 and the likelihood 0.5.
    """
    centres = cut(centroid(references.where(F.col("label").isin("good", "bad")), "vec", "label"), "centres")
    classes = {r.label for r in centres.select("label").collect()}  # two rows at most
    both = centres.groupBy().agg(*[F.max(F.when(F.col("label") == c, F.col("centroid"))).alias(c) for c in ("good", "bad")])
    sims = rows.crossJoin(F.broadcast(both)).select("id", dot(F.col("vec"), F.col("bad")).alias("to_bad"), dot(F.col("vec"), F.col("good")).alias("to_good"))
    if classes == {"good", "bad"}:
        scored = sims.select("id", (F.col("to_bad") - F.col("to_good")).alias("bad_margin"), F.lit("good_bad_centroid").alias("reference_mode"))
    elif classes:  # the mean similarity takes another pass, for one class only
        (name,) = classes
        mean = F.broadcast(sims.agg(F.avg(f"to_{name}").alias("mean")))
        margin = F.col("to_bad") - F.col("mean") if name == "bad" else F.col("mean") - F.col("to_good")
        scored = sims.crossJoin(mean).select("id", margin.alias("bad_margin"), F.lit(f"{name}_only_centroid").alias("reference_mode"))
    else:
        scored = rows.select("id", F.lit(0.0).alias("bad_margin"), F.lit("none").alias("reference_mode"))
    return scored.withColumn("bad_likelihood", likelihood(F.col("bad_margin")))


def fused(rows: DataFrame, references: DataFrame | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """(id, novelty, centroid_dist, [bad_margin, bad_likelihood, reference_mode,] score) of (id, vec) rows.

    With reference vectors of any class, bad-likeness takes half of the weight; otherwise the generic weights hold.
    """
    facts = novelty(rows, k).join(centroid_distance(rows), "id")
    weights = GENERIC
    if references is not None and not references.where(F.col("label").isin("good", "bad")).isEmpty():
        facts, weights = facts.join(class_scores(rows, references), "id"), REFERENCE
    else:
        mode = "no_reference_tiles" if references is not None else "generic"
        facts = facts.withColumns({"bad_margin": F.lit(0.0), "bad_likelihood": F.lit(0.5), "reference_mode": F.lit(mode)})
    facts = z_scores(cut(facts, "facts"), *weights)  # the aggregates and the rows both read it: neighbours are found once
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.col(f"z_{name}")
    return facts.withColumn("score", total).drop(*[f"z_{n}" for n in weights])


def bad_fractions(scores: DataFrame) -> DataFrame:
    share = lambda at: F.avg((F.col("bad_likelihood") >= at).cast("double"))
    return scores.agg(share(BAD_AT).alias("bad_like_fraction"), share(STRONGLY_BAD_AT).alias("bad_like_strong_fraction"), F.count("*").alias("n"))
