"""The exploration tools as table functions: requests in, new views, marks, tiles or refusals out.

Tables: slides (run_id, base_w, base_h, mpp, objective, downsamples), views (run_id, view_seq, x, y, w, h), requests
(run_id, seq, n0, n1, n2, n3 or dx, dy, nav_reason, ...), candidates (run_id, view_seq, rank, id, score, nx, ny). Requests
apply to the last view before them; every function handles the requests of all runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import half_even
from . import geometry as G
from . import ledger, raster, spatial
from .scoring import quality_hint

#: Who may use which tool.
TOOLS = ("overview", "zoom_current", "zoom_full", "pan", "view_info", "mark_roi", "save_tile", "discard_last_roi")
ACCESS = {"wsi": TOOLS, "tile": tuple(t for t in TOOLS if t not in ("mark_roi", "discard_last_roi")), "aml": tuple(t for t in TOOLS if t != "discard_last_roi")}
NORM, VIEW = ("n0", "n1", "n2", "n3"), ("vx", "vy", "vw", "vh")
NO_VIEW = "no_current_view"
#: Where a view's candidates come from.
INDEX_SOURCE, FALLBACK_SOURCE = "uni2_knn", "fallback_heuristic"


def access(requests: DataFrame, agent: str = "agent", tool: str = "tool") -> DataFrame:
    """requests with ok, and a reason where the agent may not use the tool."""
    ok = F.lit(False)
    for name, tools in ACCESS.items():
        ok = ok | ((F.col(agent) == name) & F.col(tool).isin(*tools))
    ok = F.coalesce(ok, F.lit(False))
    return requests.select("*", ok.alias("ok"), F.when(~ok, "tool_not_allowed").alias("reason"))


def envelope(error: Column, trace: Column) -> Column:
    """A failed call's result as JSON."""
    return F.to_json(F.struct(error.alias("error"), trace.substr(1, 4000).alias("trace")))


def reason_text(reason: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("(none provided)"))


def at_view(requests: DataFrame, views: DataFrame) -> DataFrame:
    """requests with the box (vx, vy, vw, vh) and view_seq of the last view of their run made before them; null without one.

    Views and requests go through one window in order, so a long run costs a sort and no pairs.
    """
    box = F.struct(F.col("view_seq"), *[F.col(c).alias(f"v{c}") for c in "xywh"])
    both = views.select("run_id", F.col("view_seq").alias("__at"), F.lit(1).alias("__kind"), box.alias("__v")).unionByName(
        requests.select("run_id", F.col("seq").alias("__at"), F.lit(0).alias("__kind"), F.struct(*requests.columns).alias("__r")), allowMissingColumns=True
    )
    last = F.last("__v", ignorenulls=True).over(W.partitionBy("run_id").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, -1))
    return both.withColumn("__v", last).where("__kind = 0").select("__r.*", "__v.*")


def rendered(views: DataFrame, slides: DataFrame) -> DataFrame:
    """views with their level, level box, shown size, field and magnification."""
    r = views.join(slides, "run_id")
    r = r.withColumn("level", G.level_for(F.greatest("w", "h"), F.col("downsamples")))
    r = r.withColumn("level_downsample", F.get("downsamples", "level"))
    r = r.withColumn("__b", G.at_level(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("level_downsample")))
    r = r.withColumn("__s", G.resized(F.col("__b.w"), F.col("__b.h")))
    return r.select(
        *views.columns, "level", "level_downsample", F.col("__s.w").alias("shown_w"), F.col("__s.h").alias("shown_h"), G.field_um(F.col("w"), F.col("mpp")).alias("field_width_um"), G.field_um(F.col("h"), F.col("mpp")).alias("field_height_um"),
        G.magnification(F.col("level_downsample"), F.col("objective")).alias("effective_magnification"),
    )


def overview(requests: DataFrame, slides: DataFrame) -> DataFrame:
    """The whole slide at its coarsest level, as a new view."""
    zero = F.lit(0).cast("bigint")
    return requests.join(slides, "run_id").select("run_id", F.col("seq").alias("view_seq"), zero.alias("x"), zero.alias("y"), F.col("base_w").cast("bigint").alias("w"), F.col("base_h").cast("bigint").alias("h"))


def _view(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", F.col("seq").alias("view_seq"), *"xywh")


def zoom_current(requests: DataFrame, views: DataFrame, slides: DataFrame) -> DataFrame:
    """New views by a normalised box of the current one; requests without a view give none."""
    rows = at_view(requests, views).where("view_seq is not null").join(slides, "run_id")
    return _view(G.zoom_rows(rows, NORM, VIEW, F.col("base_w"), F.col("base_h")))


def zoom_full(requests: DataFrame, slides: DataFrame) -> DataFrame:
    """New views by a normalised box of the whole slide."""
    zero = F.lit(0).cast("bigint")
    rows = requests.join(slides, "run_id").withColumns({"vx": zero, "vy": zero, "vw": F.col("base_w").cast("bigint"), "vh": F.col("base_h").cast("bigint")})
    return _view(G.zoom_rows(rows, NORM, VIEW, F.col("base_w"), F.col("base_h")))


def pan(requests: DataFrame, views: DataFrame, slides: DataFrame) -> DataFrame:
    rows = at_view(requests, views).where("view_seq is not null").join(slides, "run_id")
    box = G.pan_box(F.col("dx"), F.col("dy"), tuple(F.col(c) for c in VIEW), F.col("base_w"), F.col("base_h"))
    return _view(rows.withColumn("b", box).select("run_id", "seq", "b.*"))


def candidates(views: DataFrame, tiles: DataFrame, side: int, top_k: int = spatial.TOP_K, min_separation: int = spatial.MIN_SEPARATION) -> DataFrame:
    """Candidates of every view (run_id, view_seq, slide_id, x, y, w, h) from scored tiles (slide_id, id, cx, cy, score): in view, spread, ranked, on the view's grid. They belong to that view and no other."""
    v = views.withColumn("view_id", F.struct("run_id", "view_seq"))
    seen = spatial.tiles_in_views(tiles, v).select("view_id", "id", "cx", "cy", "score")
    picked = spatial.suppress(seen, ["view_id"], side, max(64, min_separation), top_k)
    boxes = v.select("view_id", *"xywh")
    g = picked.join(boxes, "view_id").withColumn("g", G.grid_candidate(F.col("cx") - side / 2.0, F.col("cy") - side / 2.0, side, tuple(F.col(c) for c in "xywh")))
    return g.select("view_id.run_id", "view_id.view_seq", "rank", "id", "score", "g.*", F.lit(INDEX_SOURCE).alias("source"))


def with_fallback(views: DataFrame, found: DataFrame, fallback: DataFrame) -> DataFrame:
    """Candidates of the index, and for views without any those of the image heuristic, with their source."""
    keys = ["run_id", "view_seq"]
    rest = fallback.join(found.select(*keys).distinct(), keys, "left_anti").join(views.select(*keys), keys, "left_semi")
    return found.withColumn("source", F.lit(INDEX_SOURCE)).unionByName(rest.withColumn("source", F.lit(FALLBACK_SOURCE)), allowMissingColumns=True)


def mark_roi(requests: DataFrame, views: DataFrame, slides: DataFrame, found: DataFrame) -> DataFrame:
    """Marks: the centre of the normalised box snaps to the nearest candidate of the current view; the mark is a square about it. Without candidates, or too far from all, ok is false with the reason."""
    rows = at_view(requests, views)
    mid = lambda a, b: (G.clamp(F.col(a), 0, G.GRID) + G.clamp(F.col(b), 0, G.GRID)) / 2.0
    points = rows.withColumns({"px": mid("n0", "n2"), "py": mid("n1", "n3")})
    c = found.select("run_id", "view_seq", "rank", "id", "nx", "ny", "score")
    snapped = spatial.nearest_candidate(points, c, ["run_id", "view_seq"])
    ok = F.col("id").isNotNull()
    c2 = c.select("run_id", "view_seq", F.col("rank").alias("rank"), "nx", "ny", "score")
    full = snapped.join(c2, ["run_id", "view_seq", "rank"], "left").join(slides, "run_id")
    cx, cy = G.from_grid(F.col("nx"), F.col("vx"), F.col("vw")), G.from_grid(F.col("ny"), F.col("vy"), F.col("vh"))
    box = G.mark_box(cx, cy, F.col("base_w"), F.col("base_h"))
    why = F.when(F.col("view_seq").isNull(), NO_VIEW).when(F.col("distance") == float("inf"), "no_roi_candidates").otherwise(F.col("reason"))
    return full.select("run_id", "seq", ok.alias("ok"), F.when(~ok, why).alias("reason"), F.col("rank").alias("candidate_rank"), F.col("score").alias("candidate_score"), F.round("distance", 6).alias("distance"), F.when(ok, box).alias("bbox"))


def save_tile(requests: DataFrame, views: DataFrame, slides: DataFrame) -> DataFrame:
    """Saved tiles: the square about the box's centre, numbered within run and quality up to the caps; others are refused."""
    rows = at_view(requests, views).join(slides, "run_id")
    known = rows.where(F.col("quality").isin("good", "bad") & F.col("view_seq").isNotNull())
    box = G.tile_box(tuple(F.col(c) for c in NORM), tuple(F.col(c) for c in VIEW), F.coalesce("mpp", F.lit(0.25)), F.col("base_w"), F.col("base_h"))
    kept = ledger.save_tiles(known.withColumn("bbox", box), ["run_id"], ["seq"]).select("run_id", "seq", "quality", "ok", "tile_idx", "reason", F.when(F.col("ok"), F.col("bbox")).alias("bbox"))
    bad = rows.where(~F.coalesce(F.col("quality").isin("good", "bad"), F.lit(False)) | F.col("view_seq").isNull())
    why = F.when(F.col("view_seq").isNull(), NO_VIEW).otherwise("invalid_quality")
    return kept.unionByName(bad.select("run_id", "seq", "quality", F.lit(False).alias("ok"), why.alias("reason")), allowMissingColumns=True)


def discard_last(marks: DataFrame, requests: DataFrame) -> DataFrame:
    """Live marks after the discards, with ids that are used again."""
    both = marks.select("run_id", "seq", F.lit("mark").alias("kind")).unionByName(requests.select("run_id", "seq", F.lit("discard").alias("kind")))
    return ledger.live_marks(both, ["run_id"], ["seq"])


def with_candidates(views: DataFrame, found: DataFrame) -> DataFrame:
    """views (run_id, view_seq, ...) with their candidates in the order of rank, how many there are, and where they come from; no candidates are an empty array and no source."""
    keys, own = ["run_id", "view_seq"], [c for c in found.columns if c not in ("run_id", "view_seq", "source")]
    source = F.first("source") if "source" in found.columns else F.first(F.lit(INDEX_SOURCE))
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in own if c != "rank"]))).alias("candidates"), source.alias("candidate_source"))
    out = views.join(lists, keys, "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.array())).withColumn("candidate_count", F.size("candidates").cast("bigint"))


def shown(views: DataFrame, slides: DataFrame, found: DataFrame, fractions: DataFrame | None = None) -> DataFrame:
    """What the view tools answer: new views rendered, with their candidates, and, with tissue fractions (run_id, view_seq, tissue_fraction), a warning for views of little tissue."""
    out = with_candidates(rendered(views, slides), found)
    return out if fractions is None else with_tissue(out, fractions)


def view_info(requests: DataFrame, views: DataFrame, slides: DataFrame, found: DataFrame) -> DataFrame:
    """The current view of each request, rendered, with its candidates and their hints."""
    now = at_view(requests, views).where("view_seq is not null").select("run_id", "seq", "view_seq", *[F.col(f"v{c}").alias(c) for c in "xywh"])
    hint = quality_hint(F.coalesce("bad_likelihood", F.lit(0.5))) if "bad_likelihood" in found.columns else F.lit("uncertain")
    lists = found.groupBy("run_id", "view_seq").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", hint.alias("quality_hint")))).alias("candidates"))
    return rendered(now, slides).join(lists, ["run_id", "view_seq"], "left")


def with_tissue(views: DataFrame, fractions: DataFrame) -> DataFrame:
    return views.join(fractions, ["run_id", "view_seq"], "left").withColumn("warning", raster.low_tissue(F.col("tissue_fraction")))


def overlay(found: DataFrame, w: int, h: int) -> DataFrame:
    """Rectangles, centres and colour slots of candidates on an image of w by h pixels."""
    sx, sy = w / float(G.GRID), h / float(G.GRID)
    at = lambda a, i, s: half_even(F.get(a, F.lit(i)) * F.lit(s))
    return found.select(
        "run_id", "view_seq", "rank", F.array(at("bbox_norm", 0, sx), at("bbox_norm", 1, sy), at("bbox_norm", 2, sx), at("bbox_norm", 3, sy)).alias("box"), F.array(at("center_norm", 0, sx), at("center_norm", 1, sy)).alias("centre"), F.pmod(F.col("rank") - 1, F.lit(6)).alias("colour")
    )
