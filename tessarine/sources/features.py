"""Slides to features: a grid of squares, the dark ones read, cut into tiles, the textured ones embedded."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, spatial
from .pyramid import DECODER
from .tiles import Extractor, embed


def _region(decode, path: str, x: int, y: int, side: int, level: int, w: int, h: int) -> np.ndarray:
    """Grays of a square at a level; white beyond the slide."""
    n = -(-side >> level) if level else side
    out = np.full((n, n), 255, np.uint8)
    inner_w, inner_h = max(0, min(side, w - x)), max(0, min(side, h - y))
    if inner_w and inner_h:
        lw, lh = (inner_w + (1 << level) - 1) >> level, (inner_h + (1 << level) - 1) >> level
        out[:lh, :lw] = np.frombuffer(decode(path, x, y, level, lw, lh), np.uint8).reshape(lh, lw)
    return out


def tiles_of(slides: DataFrame, tile_um: float = 256.0, tile_px: int = 224, most_px: int = 4096, brightness_cutoff: int | None = 240, texture_cutoff: float | None = raster.TEXTURE, decoder: str = DECODER) -> DataFrame:
    """(slide_id, tile_index, x_um, y_um, image) of slides (slide_id, path, base_w, base_h, mpp): tile_px by tile_px grays.

    A task reads one square of whole tiles at a time: first at a coarse level, and in full only if its mean is darker than brightness_cutoff. Tiles whose
    neighbouring grays differ by less than texture_cutoff (of 1, on average) go. The squares are rows, dealt over all tasks; no slide is a unit of work.
    """
    grid = spatial.tile_grid(slides, tile_um, most_px)
    # tile indices of a square follow its first one
    squares = grid.groupBy("slide_id", "sx", "sy").agg(F.min("tile_index").alias("first"), F.min("x_px").alias("x"), F.min("y_px").alias("y"), F.min("x_um").alias("x_um"), F.min("y_um").alias("y_um"), F.max("tile_px").alias("native"), F.sqrt(F.count("*")).cast("int").alias("n"))
    rows = squares.join(slides.select("slide_id", "path", "base_w", "base_h"), "slide_id").select("slide_id", "path", "base_w", "base_h", "first", "x", "y", "x_um", "y_um", "native", "n")
    kind = slides.schema["slide_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = decoder.partition(":")
        decode = getattr(importlib.import_module(module), name)
        for batch in batches:
            for r in batch.to_pylist():
                side = r["native"] * r["n"]
                level = max(0, side.bit_length() - 3)
                where = (decode, r["path"], r["x"], r["y"], side)
                if brightness_cutoff is not None and _region(*where, level, r["base_w"], r["base_h"]).mean() >= brightness_cutoff:
                    continue
                whole = _region(*where, 0, r["base_w"], r["base_h"])
                at = ((np.arange(tile_px) + 0.5) * r["native"] / tile_px).astype(int)
                out = []
                for ty in range(r["n"]):
                    for tx in range(r["n"]):
                        tile = whole[ty * r["native"] + at][:, tx * r["native"] + at]
                        g = tile.astype(np.float32) / 255
                        edge = (np.abs(np.diff(g, axis=1)).mean() + np.abs(np.diff(g, axis=0)).mean()) / 2 if tile_px > 1 else 0.0
                        if texture_cutoff is None or edge >= texture_cutoff:
                            out.append((r["slide_id"], r["first"] + ty * r["n"] + tx, r["x_um"] + tx * tile_um, r["y_um"] + ty * tile_um, tile.tobytes()))
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.field("slide_id").type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.binary())], ["slide_id", "tile_index", "x_um", "y_um", "image"])

    return rows.repartition("slide_id", "first").mapInArrow(run, f"slide_id {kind}, tile_index bigint, x_um double, y_um double, image binary")


def extract(slides: DataFrame, extractor: Extractor, batch: int = 32, **how) -> DataFrame:
    """(slide_id, tile_index, x_um, y_um, features, extractor_id): the tiles of slides, embedded."""
    return embed(tiles_of(slides, **how), extractor, batch=batch)
