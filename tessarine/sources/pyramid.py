"""A data source for multi-level images: one reader partition per square read, levels by downsample.

Vendor formats need a decoder that isn't here; the built-in `synthetic` decoder paints a fixed pattern, and others are
given by import path: a callable (path, x, y, level, w, h) -> bytes of w * h grays.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def synthetic(path: str, x: int, y: int, level: int, w: int, h: int) -> bytes:
    step = 1 << level
    return bytes(((x + i * step) // 256 * 40 + (y + j * step) // 256 * 24) % 256 for j in range(h) for i in range(w))


DECODER = f"{__name__}:synthetic"


class _Region(InputPartition):
    def __init__(self, x: int, y: int, w: int, h: int):
        self.x, self.y, self.w, self.h = x, y, w, h


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: int(options.get(k, d))
        self.path, self.level, self.side = options.get("path", "slide"), get("level", 0), get("side", 4096)
        self.w, self.h = get("width", 0), get("height", 0)
        if self.w <= 0 or self.h <= 0:
            raise FileNotFoundError(f"no image at {self.path}: options width and height are missing")
        module, _, name = options.get("decoder", DECODER).partition(":")
        self.module, self.name = module, name

    def partitions(self) -> list[_Region]:
        return [_Region(x, y, min(self.side, self.w - x), min(self.side, self.h - y)) for y in range(0, self.h, self.side) for x in range(0, self.w, self.side)]

    def read(self, part: _Region) -> Iterator[tuple]:
        decode = getattr(importlib.import_module(self.module), self.name)
        w, h = (part.w + (1 << self.level) - 1) >> self.level, (part.h + (1 << self.level) - 1) >> self.level
        yield (self.path, self.level, part.x, part.y, w, h, decode(self.path, part.x, part.y, self.level, w, h))


class PyramidSource(DataSource):
    """spark.read.format("pyramid").option("path", ...).option("width", ...).option("height", ...).option("level", ...)"""

    @classmethod
    def name(cls) -> str:
        return "pyramid"

    def schema(self) -> str:
        return "slide_id string, level int, x int, y int, w int, h int, gray binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
