"""Rasters as (image, x, y, value) rows: gray, tissue, edges, histogram thresholds, connected regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import half_even
from ..sources.scratch import cut, forget

#: Limits of tissue, texture, dark regions.
TISSUE_BELOW = 240
TEXTURE = 0.02
LOW_TISSUE = 0.15
DARK_PERCENTILE, DARK_AREA, DARK_REGIONS = 85.0, 800, 30


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of 8-bit colours, in the integer arithmetic of image libraries."""
    return F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)


def over_white(v: Column, alpha: Column) -> Column:
    return half_even((v * alpha + 255 * (255 - alpha)) / 255.0)


def tissue_fraction(pixels: DataFrame, by: list[str], value: str = "gray", width: str = "w", height: str = "h") -> DataFrame:
    """Share of sampled pixels darker than 240; every max(1, side // 128)-th of both directions. pixels carry their image's w and h."""
    step = lambda side: F.greatest(F.floor(F.col(side) / 128), F.lit(1))
    sampled = pixels.where((F.pmod(F.col("x"), step(width)) == 0) & (F.pmod(F.col("y"), step(height)) == 0))
    return sampled.groupBy(*by).agg(F.coalesce(F.avg((F.col(value) < TISSUE_BELOW).cast("double")), F.lit(0.0)).alias("tissue_fraction"), F.count("*").alias("sampled"))


def low_tissue(fraction: Column) -> Column:
    return F.when(fraction < LOW_TISSUE, "low_tissue")


def edge_energy(pixels: DataFrame, by: list[str], value: str = "gray", scale: float = 255.0) -> DataFrame:
    """Mean of the mean absolute differences of neighbours along x and along y, of values / scale."""
    v = F.col(value) / scale
    dx = F.abs(v - F.lag(v).over(W.partitionBy(*by, "y").orderBy("x")))
    dy = F.abs(v - F.lag(v).over(W.partitionBy(*by, "x").orderBy("y")))
    both = pixels.withColumns({"__dx": dx, "__dy": dy}).groupBy(*by)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return both.agg(((mean("__dx") + mean("__dy")) / 2.0).alias("edge"))


def textured(energy: DataFrame, cutoff: float | None = TEXTURE) -> DataFrame:
    return energy if cutoff is None else energy.where(F.col("edge") >= cutoff)


#: Up to this many distinct values of a whole table stand in one window; gray levels are 256 at most.
FEW_VALUES = 1 << 16


def hist_percentiles(pixels: DataFrame, wanted: dict[str, float], value: str = "gray", by: list[str] | None = None, few: int = FEW_VALUES) -> DataFrame:
    """by, and for each name its percentile: the smallest value at which the running count reaches that share (in %) of all; 0 for a share of nothing, 255 without rows.

    The histogram is a partial aggregate. Within groups, and for a whole table of few distinct values (they are counted), one window over it gives all percentiles. Many distinct values
    of a whole table are dealt by ranges: the ranges' sums tell which range holds a percentile, and only its rows go through a window.
    """
    by = by or []
    counts = pixels.groupBy(*by, value).agg(F.count("*").alias("__n"))
    if not by:
        counts = cut(counts, "histogram")
        if counts.count() > few:
            return _percentiles_by_range(counts, wanted, value)
    part = W.partitionBy(*(by or [F.lit(0)]))
    run = counts.withColumns({"__run": F.sum("__n").over(part.orderBy(value)), "__all": F.sum("__n").over(part)})
    at = [(F.lit(0) if p <= 0 else F.coalesce(F.min(F.when(F.col("__run") >= F.col("__all") * (p / 100.0), F.col(value))), F.lit(255))).alias(name) for name, p in wanted.items()]
    return run.groupBy(*by).agg(*at)


def _percentiles_by_range(counts: DataFrame, wanted: dict[str, float], value: str) -> DataFrame:
    placed = cut(counts.repartitionByRange(value).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("__part").agg(F.sum("__n").alias("n"), F.min(value).alias("low"))
    order = W.partitionBy(F.lit(0)).orderBy("low")  # a row per partition
    parts = F.broadcast(parts.select("__part", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(order).alias("until"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("__all")))
    goals = [F.lit(p / 100.0) * F.col("__all") for p in wanted.values() if p > 0]
    holds = F.lit(False)
    for goal in goals:
        holds = holds | ((F.col("before") < goal) & (F.col("until") >= goal))
    near = placed.join(parts.where(holds), "__part")
    run = near.withColumn("__run", F.col("before") + F.sum("__n").over(W.partitionBy("__part").orderBy(value)))
    at = [(F.lit(0) if p <= 0 else F.coalesce(F.min(F.when(F.col("__run") >= F.col("__all") * (p / 100.0), F.col(value))), F.lit(255))).alias(name) for name, p in wanted.items()]
    return run.agg(*at)


def hist_percentile(pixels: DataFrame, pct: float, value: str = "gray", by: list[str] | None = None) -> DataFrame:
    return hist_percentiles(pixels, {"threshold": pct}, value, by)


def components(cells: DataFrame, bucket: int = 1024) -> DataFrame:
    """(x, y, region) of 4-connected cells (x, y) of one mask; region is the smallest y * 2**32 + x of its cells.

    Rows first collapse to horizontal runs with one window, so the graph that iterates has a node per run. Runs that touch
    those of the row below are found by an equality join on the row and on stretches of `bucket` cells, so a wide row's runs meet those near them only; labels
    then shrink to the minimum over the links, with a jump to the label's own label each round. Every round is written to the shared folder, so no lineage grows; what no later
    round reads is deleted.
    """
    start = F.when(F.col("x") - F.lag("x").over(W.partitionBy("y").orderBy("x")) == 1, 0).otherwise(1)
    cells = cells.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).distinct()
    runs = cells.withColumn("__s", start).withColumn("__run", F.sum("__s").over(W.partitionBy("y").orderBy("x")))
    code = F.shiftleft(F.col("y"), 32) + F.col("x0")
    spans = runs.groupBy("y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("y", "x0", "x1", code.alias("node"))
    spans = cut(spans, "spans")
    stretches = F.explode(F.sequence(F.floor(F.col("x0") / bucket), F.floor(F.col("x1") / bucket)))
    laid = spans.withColumn("at", stretches)
    a, b = laid.alias("a"), laid.alias("b")
    touch = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))
    links = a.join(b, (F.col("b.y") == F.col("a.y") + 1) & (F.col("a.at") == F.col("b.at")) & touch).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    links = cut(links.union(links.select("v", "u")), "links")
    table = cut(spans.select("node", F.col("node").alias("old"), F.col("node").alias("label")), "labels")
    changed = True
    while changed:
        label = table.select("node", "label")
        near = links.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        moved = label.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = moved.select(F.col("node").alias("at"), F.col("label").alias("up"))
        before, table = table, cut(moved.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "up").alias("label")), "labels")
        forget(before)
        changed = not table.where("old != label").isEmpty()
    where = spans.join(table.select("node", "label"), "node").select("y", "x0", "x1", F.col("label").alias("region"))
    return where.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y", "region")


def boxes(labelled: DataFrame, by: list[str], least: int = 0, top: int | None = None) -> DataFrame:
    """by, x, y, w, h, area of each region of at least `least` cells; the `top` largest of each group, ties to the first in raster order."""
    keys = [*by, "region"]
    out = labelled.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"))
    out = out.where(F.col("area") >= least)
    if top is not None:
        rank = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("area"), "region"))
        out = out.withColumn("box_rank", rank).where(F.col("box_rank") <= top)
    return out


def _labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Region of each distinct cell, sorted by (y, x): runs of a row are nodes, and labels shrink over runs that touch until none moves."""
    new = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)]
    run = np.cumsum(new) - 1
    code = (y.astype(np.int64) << 32) + x
    # the cell above, where there is one, links two runs
    at = np.searchsorted(code, code - (np.int64(1) << 32))
    hit = np.flatnonzero(code[np.minimum(at, len(code) - 1)] == code - (np.int64(1) << 32))
    u, v = run[hit], run[at[hit]]
    label = np.arange(run[-1] + 1)
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return code[new][label][run]
        label = low


def components_per_image(cells: DataFrame, by: str = "image") -> DataFrame:
    """(image, x, y, region) where each image's mask is bounded (a thumbnail): whole arrays of one image in one task."""
    kind = cells.schema[by].dataType.simpleString()

    def label(pdf):
        import pandas as pd

        pts = pdf[["y", "x"]].astype(np.int64).drop_duplicates().sort_values(["y", "x"])
        x, y = pts["x"].to_numpy(), pts["y"].to_numpy()
        return pd.DataFrame({by: pdf[by].iloc[0], "x": x, "y": y, "region": _labels(x, y)})

    return cells.groupBy(by).applyInPandas(label, f"{by} {kind}, x bigint, y bigint, region bigint")


def dark_regions(pixels: DataFrame, by: str = "image", pct: float = DARK_PERCENTILE, least: int = DARK_AREA, top: int = DARK_REGIONS) -> DataFrame:
    """Regions of thumbnails (image, x, y, gray, sx, sy) at or below the percentile of their gray levels, largest first, also in level-0 pixels by the scales sx, sy."""
    cut_at = hist_percentile(pixels, pct, by=[by])
    mask = pixels.join(cut_at, by).where(F.col("gray") <= F.col("threshold"))
    found = boxes(components_per_image(mask.select(by, "x", "y"), by), [by], least, top)
    scale = pixels.groupBy(by).agg(F.max("sx").alias("sx"), F.max("sy").alias("sy")).join(cut_at, by)
    base = [half_even(F.col(c) * F.col(s)).alias(f"{c}0") for c, s in (("x", "sx"), ("y", "sy"), ("w", "sx"), ("h", "sy"))]
    return found.join(scale, by).select(by, "box_rank", "x", "y", "w", "h", "area", *base, "threshold")

