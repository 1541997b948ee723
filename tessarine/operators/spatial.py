"""Tiles on grids, views, greedy suppression, and the nearest candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import Value, col, half_even
from ..sources.scratch import cut, forget
from .geometry import grid_candidate, iou, supertile

#: Size of the candidate list, separations, overlap and snapping limits.
TOP_K = 12
MIN_SEPARATION = 512
MAX_IOU = 0.20
SNAP = 170.0
FALLBACK_SEPARATION = 120.0


def tile_grid(slides: DataFrame, tile_um: float = 256.0, most_px: int = 4096) -> DataFrame:
    """Tiles of (slide_id, base_w, base_h, mpp): one row each, in the order of reading: supertiles row by row, and tiles row by row in each.

    x_um and y_um advance by the tile's width in microns, x_px and y_px by its whole pixels.
    """
    s = slides.withColumn("s", supertile(tile_um, F.col("mpp"), most_px)).select("*", "s.n", "s.tile_px", "s.side_px")
    steps = lambda size: F.sequence(F.lit(0), F.ceil(F.col(size) / F.col("side_px")) - 1)
    grid = s.where("base_w > 0 and base_h > 0").select("*", F.explode(steps("base_h")).alias("sy")).select("*", F.explode(steps("base_w")).alias("sx"))
    inner = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    grid = grid.select("*", F.explode(inner).alias("ty")).select("*", F.explode(inner).alias("tx"))
    across = F.ceil(F.col("base_w") / F.col("side_px"))
    index = ((F.col("sy") * across + F.col("sx")) * F.col("n") + F.col("ty")) * F.col("n") + F.col("tx")
    um = lambda st, t: F.col(st) * F.col("side_px") * F.col("mpp") + F.col(t) * F.lit(tile_um)
    px = lambda st, t: F.col(st) * F.col("side_px") + F.col(t) * F.col("tile_px")
    return grid.select("slide_id", index.cast("bigint").alias("tile_index"), um("sx", "tx").alias("x_um"), um("sy", "ty").alias("y_um"), px("sx", "tx").cast("bigint").alias("x_px"), px("sy", "ty").cast("bigint").alias("y_px"), "sx", "sy", "tile_px", "mpp")


def foreground(grid: DataFrame, thumbnail: DataFrame, cutoff: int | None = 240) -> DataFrame:
    """Rows whose supertile is darker than cutoff in the thumbnail (slide_id, sx, sy, gray): the cheap test before any image is read. Without a cutoff all stay."""
    return grid if cutoff is None else grid.join(thumbnail.where(F.col("gray") < cutoff).select("slide_id", "sx", "sy"), ["slide_id", "sx", "sy"], "left_semi")


def in_view(cx: Column, cy: Column, view: tuple[Value, Value, Value, Value]) -> Column:
    """The centre lies in the view, its edges included."""
    x, y, w, h = (col(v) for v in view)
    return cx.between(x, x + w) & cy.between(y, y + h)


def tiles_in_views(tiles: DataFrame, views: DataFrame, cell: int = 16384) -> DataFrame:
    """Tiles (slide_id, cx, cy, ...) with each view (slide_id, view_id, x, y, w, h) that holds their centre.

    A join on the cells of a coarse grid, so that many views on many slides are an equality join and no nested loop.
    """
    at = lambda c: F.floor(c / F.lit(float(cell)))
    span = lambda lo, size: F.sequence(at(F.col(lo)), at(F.col(lo) + F.col(size)))
    wide = views.select("*", F.explode(span("x", "w")).alias("gx")).select("*", F.explode(span("y", "h")).alias("gy"))
    keyed = tiles.withColumn("gx", at(F.col("cx"))).withColumn("gy", at(F.col("cy")))
    hit = in_view(F.col("cx"), F.col("cy"), tuple(F.col(c) for c in "xywh"))
    return keyed.join(wide, ["slide_id", "gx", "gy"]).where(hit).drop("gx", "gy")


def separation(side: Value, least: Value) -> Column:
    """Smallest distance of centres: the argument, but no less than 85 % of a tile."""
    return F.greatest(col(least).cast("double"), F.lit(1.0), half_even(0.85 * col(side)).cast("double"))


def suppress(candidates: DataFrame, by: list[str], side: Value, min_separation: Value = MIN_SEPARATION, top_k: int = TOP_K, max_iou: float = MAX_IOU) -> DataFrame:
    """Per group, walks (id, cx, cy, score) by falling score (ties: smaller id), takes what is neither too near to nor overlaps a taken one, up to top_k; adds rank.

    A fold over the group's sorted array inside Catalyst, no Python. A group is what one view holds: filter first. Groups of millions go by suppress_in_rounds.
    """
    gap, half = separation(side, min_separation), col(side) / 2.0
    item = F.struct((-F.col("score")).alias("neg"), F.col("id"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    grouped = candidates.groupBy(*by) if by else candidates.groupBy()
    rows = grouped.agg(F.array_sort(F.collect_list(item)).alias("all"))
    taken = F.array().cast("array<struct<neg:double,id:bigint,cx:double,cy:double>>")
    box = lambda p: F.struct((p["cx"] - half).alias("x0"), (p["cy"] - half).alias("y0"), (p["cx"] + half).alias("x1"), (p["cy"] + half).alias("y1"))

    def step(acc: Column, c: Column) -> Column:
        near = lambda p: ((p["cx"] - c["cx"]) * (p["cx"] - c["cx"]) + (p["cy"] - c["cy"]) * (p["cy"] - c["cy"])) < gap * gap
        clash = F.exists(acc, lambda p: near(p) | (iou(box(p), box(c)) > max_iou))
        return F.when((F.size(acc) >= top_k) | clash, acc).otherwise(F.concat(acc, F.array(c)))

    picked = rows.select(*by, F.posexplode(F.aggregate("all", taken, step)).alias("pos", "c"))
    return picked.select(*by, (F.col("pos") + 1).alias("rank"), "c.id", "c.cx", "c.cy", (-F.col("c.neg")).alias("score"))


def suppress_in_rounds(candidates: DataFrame, by: list[str], side: Value, min_separation: Value = MIN_SEPARATION, top_k: int = TOP_K, max_iou: float = MAX_IOU) -> DataFrame:
    """The same rows for groups too large to gather: top_k rounds, each of which takes every group's best by a partial aggregate and drops what clashes with it by a join with one row
    per group. What is left is written out each round, and only the picks stay."""
    gap, half = separation(side, min_separation), col(side) / 2.0
    left = cut(candidates.select(*by, "id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), F.col("score").cast("double").alias("score")), "candidates")
    picked = None
    for rank in range(1, top_k + 1):
        best = left.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("neg"), "id", "cx", "cy")).alias("b")).where("b is not null")
        best = cut(best.select(*[F.col(c).alias(f"__{c}") for c in by], "b"), "best")
        if best.isEmpty():
            break
        one = best.select(*[F.col(f"__{c}").alias(c) for c in by], F.lit(rank).alias("rank"), "b.id", "b.cx", "b.cy", (-F.col("b.neg")).alias("score"))
        picked = one if picked is None else picked.union(one)
        here = F.struct((F.col("cx") - half).alias("x0"), (F.col("cy") - half).alias("y0"), (F.col("cx") + half).alias("x1"), (F.col("cy") + half).alias("y1"))
        there = F.struct((F.col("b.cx") - half).alias("x0"), (F.col("b.cy") - half).alias("y0"), (F.col("b.cx") + half).alias("x1"), (F.col("b.cy") + half).alias("y1"))
        near = (F.col("b.cx") - F.col("cx")) * (F.col("b.cx") - F.col("cx")) + (F.col("b.cy") - F.col("cy")) * (F.col("b.cy") - F.col("cy")) < gap * gap
        met = left.join(best, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else left.crossJoin(F.broadcast(best))  # without groups best is one row
        before, left = left, cut(met.where(~(near | (iou(there, here) > max_iou) | (F.col("id") == F.col("b.id")))).select(*left.columns), "candidates")
        forget(before)
    return left.limit(0).select(*by, F.lit(0).alias("rank"), "id", "cx", "cy", "score") if picked is None else picked


def described(picked: DataFrame, side: int, view: tuple[int, int, int, int]) -> DataFrame:
    """Picked tiles (rank, id, cx, cy, score) as candidates on the view's grid."""
    half = side / 2.0
    return picked.withColumn("g", grid_candidate(F.col("cx") - half, F.col("cy") - half, side, view)).select(*picked.columns, "g.*")


def fallback_patches(pixels: DataFrame, w: int, h: int, parts: int = 7, top_k: int = TOP_K, by: list[str] | None = None) -> DataFrame:
    """Candidates of views from their images (by, x, y, gray) alone, all of w by h pixels: patches scored by tissue and edges, spread greedily on the grid.

    Counts and sums of gray levels are whole numbers, and a score is one quotient of them. So it doesn't depend on the order of the rows, and for patches of up to some 100 by 100 pixels it is the
    double next to the exact score: a tie of scores is a tie, and rounding goes the right way in the middle of two digits.
    """
    by = by or []
    pw, ph = max(16, w // parts), max(16, h // parts)
    g = pixels.select(*by, "x", "y", "gray", F.floor(F.col("x") / pw).alias("gx"), F.floor(F.col("y") / ph).alias("gy")).where(f"gx < {parts} and gy < {parts}")
    right = F.col("gray") - F.lag("gray").over(W.partitionBy(*by, "gx", "y").orderBy("x"))
    down = F.col("gray") - F.lag("gray").over(W.partitionBy(*by, "gy", "x").orderBy("y"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    k, n = number(F.count_if(F.col("gray") / 255.0 < 0.92)), F.nullif(number(F.count("gray")), F.lit(0.0))
    (sx, nx), (sy, ny) = ((number(F.sum(d)), F.greatest(number(F.count(d)), F.lit(1.0))) for d in ("dx", "dy"))
    # 0.70 * k / n + 0.30 * (sx / nx / 255 + sy / ny / 255) / 2
    score = (3570.0 * k * nx * ny + 3.0 * n * (sx * ny + sy * nx)) / (5100.0 * n * nx * ny)
    stats = g.withColumns({"dx": F.abs(right), "dy": F.abs(down)}).groupBy(*by, "gx", "gy").agg((k / n).alias("tissue"), score.alias("score"))
    x0, y0 = F.col("gx") * pw, F.col("gy") * ph
    x1, y1 = F.least(x0 + pw, F.lit(w)), F.least(y0 + ph, F.lit(h))
    good = stats.where((x1 - x0 >= 8) & (y1 - y0 >= 8) & (F.col("tissue") >= 0.08))
    grid = lambda v, size: F.greatest(F.least(half_even(v / max(1, size - 1) * 999.0), F.lit(999)), F.lit(0))
    rows = good.select(
        *by, (F.col("gy") * parts + F.col("gx")).cast("bigint").alias("id"), "score",
        grid((x0 + x1) / 2.0, w).alias("cx"), grid((y0 + y1) / 2.0, h).alias("cy"),
    )
    return suppress(rows, by, 0.0, FALLBACK_SEPARATION, top_k, max_iou=2.0)


def nearest_candidate(points: DataFrame, candidates: DataFrame, by: list[str], limit: float = SNAP) -> DataFrame:
    """Each point (by, px, py) with its nearest candidate (by, rank, id, nx, ny), ties to the smaller rank; farther than limit is refused. A point without candidates is refused with an infinite distance."""
    p = points.withColumn("__p", F.monotonically_increasing_id())
    dist = F.sqrt(F.pow(F.col("px") - F.col("nx"), 2) + F.pow(F.col("py") - F.col("ny"), 2))
    best = p.join(candidates, by, "left").withColumn("d", F.coalesce(dist, F.lit(float("inf"))))
    best = best.groupBy("__p", *points.columns).agg(F.min_by(F.struct("id", "rank", "nx", "ny"), F.struct("d", "rank")).alias("c"), F.min("d").alias("distance"))
    ok = F.col("distance") <= limit
    return best.select(*points.columns, F.when(ok, F.col("c.id")).alias("id"), F.when(ok, F.col("c.rank")).alias("rank"), "distance", F.when(~ok, "roi_outside_topk_candidates").alias("reason"))
