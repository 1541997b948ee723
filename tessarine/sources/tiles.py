"""Tile images, features and their caches: Arrow inference with a plugged-in extractor, Parquet caches by parameter hash."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import params_hash


class Extractor:
    """A named model: `load` runs once per worker and returns a function from a list of image bytes to a matrix of features."""

    def __init__(self, identifier: str, width: int, load: Callable[[], Callable[[list[bytes]], np.ndarray]]):
        self.identifier, self.width, self.load = identifier, width, load


def byte_histogram(width: int = 64) -> Extractor:
    """A deterministic stand-in for a vision model: shares of byte values in `width` bins."""

    def load() -> Callable[[list[bytes]], np.ndarray]:
        def run(images: list[bytes]) -> np.ndarray:
            out = np.zeros((len(images), width))
            for i, image in enumerate(images):
                counts = np.bincount(np.frombuffer(image or b"", np.uint8), minlength=256).reshape(width, -1).sum(1)
                out[i] = counts / max(1, counts.sum())
            return out

        return run

    return Extractor(f"byte-histogram-{width}", width, load)


def as_matrix(value: object) -> np.ndarray:
    """Features of any model output as rows: the first of a list or tuple, the first known key of a dict, then 1-d is one row, 3-d gives its first token, deeper is flattened."""
    while isinstance(value, list | tuple | dict) and not (isinstance(value, list) and value and np.isscalar(value[0])):
        if isinstance(value, dict):
            keys = [k for k in ("features", "embeddings", "last_hidden_state", "x") if k in value] or list(value)
            value = value[keys[0]]
        else:
            value = value[0]
    out = np.asarray(value, np.float64)
    if out.ndim == 1:
        return out[None, :]
    if out.ndim == 3:
        return out[:, 0, :]
    return out if out.ndim == 2 else out.reshape(len(out), -1)


def embed(tiles: DataFrame, extractor: Extractor, image: str = "image", batch: int = 32, most: int = 64) -> DataFrame:
    """tiles without their image, with features array<float> and extractor_id. The model sees `batch` images at a time, `most` at most; a worker holds one Arrow batch of them."""
    names = [c for c in tiles.columns if c != image]
    schema = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in names) + ", features array<float>, extractor_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = extractor.load()
        for whole in batches:
            for a in range(0, whole.num_rows, min(batch, most)):
                rows = whole.slice(a, min(batch, most))
                found = as_matrix(model(rows.column(len(names)).to_pylist())).astype(np.float32)
                features = pa.array(list(found), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], features, pa.array([extractor.identifier] * rows.num_rows)], [*names, "features", "extractor_id"])

    return tiles.select(*names, image).mapInArrow(run, schema)


def reference_vectors(tiles: DataFrame, extractor: Extractor, image: str = "image", batch: int = 64) -> DataFrame:
    """(label, path, vec) of labelled reference tiles: inference in batches of 64, then unit rows, each beside its tile's label and path."""
    from ..operators.vectors import doubles, unit

    return embed(tiles.select("label", "path", image), extractor, image, batch).select("label", "path", unit(doubles(F.col("features")), added=True).alias("vec"))


def cached(spark: SparkSession, folder: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of these parameters below folder, made and committed once; every parameter is part of its name."""
    key = spark.range(1).select(params_hash(*[F.lit(params[k]).alias(k) for k in sorted(params)]).alias("h")).first().h
    path = f"{folder}/{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def coordinates(names: DataFrame, name: str = "name", ext: str = "jpg") -> DataFrame:
    """x_um and y_um from member names like tile_(12.5, -256).jpg, in plain decimal notation; names without them are left out."""
    number = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"
    pattern = rf"^tile_\(({number}), ({number})\)\.{ext}$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("double")
    return names.select("*", part(1).alias("x_um"), part(2).alias("y_um")).where("x_um is not null")


def zip_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, member, x_um, y_um, tile_um, image) of the tile caches below a folder: zip files of tiles named by their place, with the parameters of their making as tiler_params.json (tile_size_um, and tile_ext, jpg if it isn't there)."""
    from .files import zip_members

    members = zip_members(spark, folder)
    params = members.where("member = 'tiler_params.json'").select("archive", F.from_json(F.decode("content", "utf-8"), "tile_size_um double, tile_ext string").alias("p"))
    met = members.where("safe").join(params, "archive").withColumn("ext", F.coalesce("p.tile_ext", F.lit("jpg")))
    number = r"([-+]?\d*\.?\d+)"
    part = lambda i: F.nullif(F.regexp_extract(F.col("bare"), rf"^tile_\({number}, {number}\)$", i), F.lit("")).cast("double")
    tiles = met.where(F.col("member").endswith(F.concat(F.lit("."), F.col("ext")))).withColumn("bare", F.expr("substring(member, 1, length(member) - length(ext) - 1)"))
    return tiles.select("archive", "member", part(1).alias("x_um"), part(2).alias("y_um"), F.col("p.tile_size_um").alias("tile_um"), F.col("content").alias("image")).where("x_um is not null")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, width, height, channels and raw bytes (blue, green, red)."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def pixels(decoded: DataFrame, path: str = "path") -> DataFrame:
    """(path, x, y, w, h, r, g, b) of decoded images, streamed row band by row band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, w, h, c, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, c)
                for y0 in range(0, h, 64):
                    band = raw[y0 : y0 + 64]
                    y, x = np.mgrid[y0 : y0 + len(band), 0:w]
                    blue, green, red = (band[..., min(i, c - 1)].ravel().astype(np.int32) for i in range(3))
                    n = len(red)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *[pa.array(v.astype(np.int32)) for v in (x.ravel(), y.ravel(), np.full(n, w), np.full(n, h), red, green, blue)]], ["path", "x", "y", "w", "h", "r", "g", "b"])

    return decoded.select(path, "width", "height", "channels", "data").mapInArrow(run, "path string, x int, y int, w int, h int, r int, g int, b int")


def write_features(features: DataFrame, folder: str) -> None:
    features.write.mode("overwrite").parquet(folder)


def npz_of(features: DataFrame, meta: dict) -> bytes:
    """One slide's features as a compressed NPZ, for tools outside Spark; the caller bounds the slide."""
    rows = features.orderBy("tile_index").toArrow()
    out = io.BytesIO()
    np.savez_compressed(out, features=np.array(rows.column("features").to_pylist(), np.float32), coordinates_um=np.stack([rows.column(c).to_numpy() for c in ("x_um", "y_um")], 1).astype(np.float32), **{k: np.array(v) for k, v in meta.items()})
    return out.getvalue()


#: the k for which an index measures its probes
PROBED = (10, 100)
INDEX_META = "space string, dim int, lists int, count bigint, centres array<array<double>>, probes array<int>"


def build_index(vectors: DataFrame, folder: str, lists: int = 64, space: str = "cosine", sample_rows: int = 4096) -> dict:
    """A vector index on disk: rows (tile_id, label, path, vec) in Parquet by their nearest of `lists` centres. Centres come from a bounded sample by a few rounds of k-means.

    space cosine stores v / (|v| + 1e-12); l2 and ip store v as it is. Returns and writes the summary, and writes how many lists
    hold 95 % of the 10 and of the 100 nearest within the sample, where neighbours lie farther apart than among all rows.
    """
    from ..operators.vectors import centres_of, doubles, enough_probes, lists_of, unit

    vec = doubles(F.col("vec"))
    rows = vectors.withColumn("vec", unit(vec, added=True) if space == "cosine" else vec)
    x = np.array([r.vec for r in rows.select("tile_id", "vec").orderBy(F.xxhash64("tile_id"), "tile_id").limit(sample_rows).collect()])
    centres = centres_of(x, lists)
    width = centres.shape[1] if len(x) else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            v = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            near = lists_of(v, centres) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list int"
    rows.mapInArrow(assign, schema).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/vectors")
    meta = {"space": space, "dim": int(width), "lists": len(centres), "count": vectors.count(), "centres": [[float(z) for z in c] for c in centres]}
    probes = {k: enough_probes(x, centres, space, k) for k in PROBED}
    vectors.sparkSession.createDataFrame([(meta["space"], meta["dim"], meta["lists"], meta["count"], meta["centres"], [probes[k] for k in PROBED])], INDEX_META).write.mode("overwrite").json(f"{folder}/meta")
    return {k: meta[k] for k in ("space", "dim", "lists", "count")}


def search_index(spark: SparkSession, folder: str, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(tile_id, label, path, dist): the k nearest in the `probes` lists whose centres are nearest; only their files are read.

    Without `probes`, as many lists as the sample of the index needed for a recall of 0.95; all for a k beyond those measured.
    """
    meta = spark.read.schema(INDEX_META).json(f"{folder}/meta").first()
    q = np.array(query, np.float64)
    if meta.space == "cosine":
        q = q / (np.linalg.norm(q) + 1e-12)
    if probes is None:
        probes = next((p for most, p in zip(PROBED, meta.probes or (), strict=False) if k <= most), len(meta.centres))
    order = np.argsort(((np.array(meta.centres) - q) ** 2).sum(1))[:probes]
    rows = spark.read.parquet(f"{folder}/vectors").where(F.col("list").isin(*[int(i) for i in order]))
    mine = F.array(*[F.lit(float(z)) for z in q])
    from ..operators.vectors import dot

    dist = 1.0 - dot(F.col("vec"), mine) if meta.space != "l2" else F.aggregate(F.zip_with("vec", mine, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)
    return rows.select("tile_id", "label", "path", dist.alias("dist")).orderBy("dist", "tile_id").limit(k)


def as_image(value: object) -> np.ndarray:
    """A transform's output as [channels, rows, columns] of float32; a leading batch of one is dropped, other shapes are an error."""
    out = np.asarray(value)
    if out.ndim == 4 and out.shape[0] == 1:
        out = out[0]
    if out.ndim != 3:
        raise ValueError(f"an image needs three dimensions, not {out.ndim}")
    return out.astype(np.float32)
