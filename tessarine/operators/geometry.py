"""View geometry in level-0 pixels: boxes as column structs, all plain expressions that stay in generated code.

Boxes are named by their encoding: xywh (corner and size) or xyxy (two corners). Rounding is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import Value, clamp, col, half_even, half_up, halved

#: Sides of the normalised grid, of views, marks and tiles.
GRID = 999
NATIVE_SIDE = 4096
SHOWN_SIDE = 1024
MARK_SIDE = 1500
TILE_UM = 256.0
DEFAULT_OBJECTIVE = 40.0


def xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("bigint").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)])


def clamp_view(x: Column, y: Column, w: Column, h: Column, width: Value, height: Value) -> Column:
    """A box moved and cut to the slide; at least one pixel."""
    x, y = clamp(x, 0, col(width) - 1), clamp(y, 0, col(height) - 1)
    return xywh(x, y, clamp(w, 1, col(width) - x), clamp(h, 1, col(height) - y))


def at_level(x: Column, y: Column, w: Column, h: Column, downsample: Value) -> Column:
    """A level-0 box in the pixels of a level; sides of at least one pixel."""
    d = col(downsample)
    return xywh(half_even(x / d), half_even(y / d), F.greatest(half_even(w / d), F.lit(1)), F.greatest(half_even(h / d), F.lit(1)))


def resized(w: Column, h: Column, longest: int = SHOWN_SIDE) -> Column:
    """Sides of an image shrunk to a longest side; smaller ones stay."""
    side = F.greatest(w, h)
    fit = lambda v: F.when(side <= longest, v.cast("bigint")).otherwise(half_even(v * (F.lit(float(longest)) / side)))
    return F.struct(fit(w).alias("w"), fit(h).alias("h"))


def field_um(w: Column, mpp: Column) -> Column:
    return w * mpp


def magnification(downsample: Column, objective: Column) -> Column:
    """Null for a downsample that isn't positive."""
    return F.when(downsample > 0, F.coalesce(objective.cast("double"), F.lit(DEFAULT_OBJECTIVE)) / downsample)


def level_for(side: Column, downsamples: Column, longest: int = NATIVE_SIDE) -> Column:
    """The first (finest) level at which the side fits, else the last."""
    fits = F.filter(F.transform(downsamples, lambda d, i: F.struct(i.alias("i"), d.alias("d"))), lambda r: side / r["d"] <= longest)
    return F.coalesce(F.get(fits, F.lit(0))["i"], F.size(downsamples) - 1).cast("int")


def from_grid(n: Column, start: Column, size: Column) -> Column:
    """A normalised coordinate of a view in level-0 pixels."""
    return start + half_even(n / float(GRID) * size)


def to_grid(v: Column, start: Value, size: Value) -> Column:
    return clamp(half_even((v - col(start)) / F.greatest(col(size), F.lit(1)) * float(GRID)), 0, GRID)


def zoom_rows(rows: DataFrame, norm: tuple[str, ...], view: tuple[str, ...], width: Value, height: Value, shrink: float = 1.0, max_aspect: float = 3.0) -> DataFrame:
    """rows with x, y, w, h: a normalised box (two corners in any order) of a view, in level-0 pixels.

    Boxes over 70 % of either side shrink about their centre to at least 32 pixels; boxes longer than max_aspect are
    trimmed about their centre. Done in stages of columns: as one expression, each stage would repeat the last one.
    """
    nx0, ny0, nx1, ny1 = (clamp(F.col(c), 0, GRID) for c in norm)
    vx, vy, vw, vh = (F.col(c) for c in view)
    c = F.col
    edge = lambda a, b, start, size: start + half_even(F.least(a, b) / float(GRID) * size)
    span = lambda a, b, size: F.greatest(half_even((F.greatest(a, b) / float(GRID) - F.least(a, b) / float(GRID)) * size), F.lit(1))
    out = rows.withColumns({"x": edge(nx0, nx1, vx, vw), "y": edge(ny0, ny1, vy, vh), "w": span(nx0, nx1, vw), "h": span(ny0, ny1, vh)})
    small = lambda v: F.when(c("__big"), F.greatest(half_even(c(v) * F.lit(shrink)), F.lit(32))).otherwise(c(v))
    out = out.withColumn("__big", (c("w") / vw > 0.7) | (c("h") / vh > 0.7)).withColumns({"__w": small("w"), "__h": small("h")})
    recentred = lambda p, old, new: c(p) + halved(c(old)) - halved(c(new))
    out = out.withColumns({"x": recentred("x", "w", "__w"), "y": recentred("y", "h", "__h")})
    out = out.withColumns({"x": clamp(c("x"), 0, col(width) - 1), "y": clamp(c("y"), 0, col(height) - 1)})
    out = out.withColumns({"w": clamp(c("__w"), 1, col(width) - c("x")), "h": clamp(c("__h"), 1, col(height) - c("y"))})
    out = out.withColumn("__long", F.greatest(c("w") / c("h"), c("h") / c("w")) > max_aspect)
    trim = lambda v, other, which: F.when(c("__long") & which, F.greatest(half_even(c(other) * F.lit(max_aspect)), F.lit(1))).otherwise(c(v))
    out = out.withColumns({"__w": trim("w", "h", c("w") > c("h")), "__h": trim("h", "w", c("w") <= c("h"))})
    moved = lambda p, v, new, most: F.when(c(v) == c(new), c(p)).otherwise(clamp(recentred(p, v, new), 0, col(most) - c(new)))
    out = out.withColumns({"x": moved("x", "w", "__w", width), "y": moved("y", "h", "__h", height)})
    return out.withColumns({"w": c("__w"), "h": c("__h")}).drop("__big", "__long", "__w", "__h")


def pan_box(dx: Column, dy: Column, view: tuple[Column, Column, Column, Column], width: Value, height: Value) -> Column:
    x, y, w, h = view
    move = lambda d, start, size, edge: clamp(start + half_even(clamp(d, -GRID, GRID) / float(GRID) * size), 0, col(edge) - size)
    return xywh(move(dx, x, w, width), move(dy, y, h, height), w, h)


def centred_box(cx: Column, cy: Column, side: Column, width: Value, height: Value) -> Column:
    """A square about a centre, moved into the slide."""
    edge = lambda c, most: clamp(c - halved(side), 0, col(most) - side)
    return xywh(edge(cx, width), edge(cy, height), side, side)


def mark_box(cx: Column, cy: Column, width: Value, height: Value) -> Column:
    return centred_box(cx, cy, F.least(F.lit(MARK_SIDE), col(width), col(height)), width, height)


def tile_box(n: tuple[Column, Column, Column, Column], view: tuple[Column, Column, Column, Column], mpp: Column, width: Value, height: Value) -> Column:
    """The square of a saved tile about the centre of a normalised box."""
    nx0, ny0, nx1, ny1 = (clamp(v, 0, GRID) for v in n)
    side = F.least(F.greatest(half_even(TILE_UM / mpp), F.lit(32)), col(width), col(height))
    mid = lambda a, b, start, size: from_grid((a + b) / 2.0, start, size)
    return centred_box(mid(nx0, nx1, view[0], view[2]), mid(ny0, ny1, view[1], view[3]), side, width, height)


def tile_side_px(tile_um: Value, mpp: Column) -> Column:
    return F.greatest(F.ceil(col(tile_um) / mpp), F.lit(1))


def um_to_level0(um: Column, mpp: Column) -> Column:
    """A place in microns in level-0 pixels, not rounded."""
    return um / mpp


def supertile(tile_um: Value, mpp: Column, most_px: int = NATIVE_SIDE) -> Column:
    """Tiles per side, tile side and side of the largest square read that holds whole tiles."""
    n = F.greatest(F.floor(most_px * mpp / col(tile_um)), F.lit(1))
    side = F.ceil(col(tile_um) / mpp)
    return F.struct(n.alias("n"), side.alias("tile_px"), (side * n).alias("side_px"))


def grid_candidate(x0: Column, y0: Column, side: Value, view: tuple[Value, Value, Value, Value]) -> Column:
    """Centre and box of a tile, in level-0 pixels and on the view's grid."""
    vx, vy, vw, vh = (col(v) for v in view)
    side = col(side)
    cx, cy = half_even(x0 + side / 2.0), half_even(y0 + side / 2.0)
    nx, ny = to_grid(cx, vx, vw), to_grid(cy, vy, vh)
    half = lambda size: F.greatest(half_even(side / F.greatest(size, F.lit(1)) * float(GRID) / 2.0), F.lit(10))
    tx, ty = half_even(x0), half_even(y0)
    box = (clamp(nx - half(vw), 0, GRID), clamp(ny - half(vh), 0, GRID), clamp(nx + half(vw), 0, GRID), clamp(ny + half(vh), 0, GRID))
    return F.struct(F.array(nx, ny).alias("center_norm"), F.array(*box).alias("bbox_norm"), F.array(cx, cy).alias("center_level0"), F.array(tx, ty, tx + side.cast("bigint"), ty + side.cast("bigint")).alias("tile_bbox_level0"))


def scaled_box(x: Column, y: Column, w: Column, h: Column, sx: Value, sy: Value) -> Column:
    """A box of a shown image in level-0 pixels."""
    return xywh(half_even(x * col(sx)), half_even(y * col(sy)), half_even(w * col(sx)), half_even(h * col(sy)))


def overview_box(x: Column, y: Column, w: Column, h: Column, shown_w: Value, shown_h: Value, base_w: Value, base_h: Value, browser: bool = False) -> Column:
    """A level-0 box in overview pixels; as a browser draws it: halves up, sides of at least 2, null if not finite."""
    sx, sy = col(shown_w) / col(base_w), col(shown_h) / col(base_h)
    if not browser:
        return scaled_box(x, y, w, h, sx, sy)
    parts = [x * sx, y * sy, w * sx, h * sy]
    sound = F.lit(True)
    for p in parts:
        sound = sound & p.isNotNull() & ~F.isnan(p.cast("double")) & (F.abs(p.cast("double")) < float("inf"))
    bx, by, bw, bh = (half_up(p) for p in parts)
    return F.when(sound, xywh(bx, by, F.greatest(bw, F.lit(2)), F.greatest(bh, F.lit(2))))


def base_side(base: Column, level_side: Column, downsample: Column) -> Column:
    """A slide's side: as given, else from its level, else null."""
    good = lambda c: F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0) & (c.cast("double") < float("inf")), c.cast("double"))
    return F.coalesce(good(base), good(level_side * downsample))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two xyxy structs (x0, y0, x1, y1); 0 without overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inner = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda r: F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))
    total = area(a) + area(b) - inner
    return F.when((inner > 0) & (total > 0), inner / total).otherwise(0.0)
