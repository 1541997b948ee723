"""Command line: an index of the tiles below labelled folders, and its summary as JSON.

python -m tessarine.build_index --root DIR --out DIR [--space cosine|l2|ip] [--lists N] [--batch N] [--extractor module:name]
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from .sources import files, tiles

SPACES = ("cosine", "l2", "ip")


def labelled_tiles(spark: SparkSession, root: str) -> DataFrame:
    """(tile_id, label, path, image) of the image files below the class folders of root."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    found = files.discover_tiles(read.select("path"))
    return found.join(read.withColumnRenamed("content", "image"), "path").select("tile_id", "label", "path", "image")


def build(spark: SparkSession, root: str, out: str, extractor: tiles.Extractor, space: str = "cosine", lists: int = 64, batch: int = 32) -> dict:
    """Embed all tiles, write the index, and return its summary with the number of tiles of each label."""
    if space not in SPACES:
        raise ValueError(f"space must be one of {', '.join(SPACES)}")
    rows = labelled_tiles(spark, root)
    found = tiles.embed(rows, extractor, batch=batch).withColumnRenamed("features", "vec").select("tile_id", "label", "path", "vec")
    tiles.write_features(found, f"{out}/features")
    kept = spark.read.parquet(f"{out}/features")
    meta = tiles.build_index(kept, f"{out}/index", lists=lists, space=space)
    return meta | {"extractor_id": extractor.identifier, "labels": {r.label: r["count"] for r in kept.groupBy("label").count().orderBy("label").collect()}}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.partition("\n")[0])
    p.add_argument("--root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--space", choices=SPACES, default="cosine")
    p.add_argument("--lists", type=int, default=64)
    p.add_argument("--batch", type=int, default=32)
    p.add_argument("--extractor", default="tessarine.sources.tiles:byte_histogram", help="module:name of a function that returns an Extractor")
    a = p.parse_args(args)
    module, _, name = a.extractor.partition(":")
    spark = SparkSession.builder.appName("build-index").getOrCreate()
    print(json.dumps(build(spark, a.root, a.out, getattr(importlib.import_module(module), name)(), a.space, a.lists, a.batch)))


if __name__ == "__main__":
    main()
