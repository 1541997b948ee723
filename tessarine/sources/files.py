"""Files as rows: listings, labelled tile folders, upload bundles, zip members, and names for copies."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import IMAGE_EXTS, MIRAX_EXTS, STANDARD_EXTS, extension, is_safe_relative, is_within, stem

#: Folder -> class, in order of precedence.
CLASS_FOLDERS = (("Good_Tiles", "good"), ("Bad_Tiles", "bad"), ("Good", "good"), ("Bad", "bad"))


def listing(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, bytes, modified) of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def discover_tiles(paths: DataFrame, folders: tuple[tuple[str, str], ...] = CLASS_FOLDERS, numbered: bool = True, path: str = "path") -> DataFrame:
    """(path, label[, tile_id]) of image files below the class folders: folder by folder, by path in each, each path once, ids from 0."""
    order, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (folder, name) in reversed(list(enumerate(folders))):
        hit = F.array_contains(F.slice(F.split(F.col(path), "/"), 1, F.greatest(F.size(F.split(F.col(path), "/")) - 1, F.lit(0))), folder)
        order, label = F.when(hit, i).otherwise(order), F.when(hit, name).otherwise(label)
    found = paths.where(extension(F.col(path)).isin(*IMAGE_EXTS)).select(F.col(path).alias("path"), label.alias("label"), order.alias("ord")).where("ord is not null")
    found = found.groupBy("path").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    if not numbered:
        return found.select("path", "label")
    return dense_ids(found, ["ord", "path"], "tile_id").select("path", "label", "tile_id")


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ids 0, 1, ... in order, without moving all rows to one task: ranges are sorted in parallel, then each
    adds the number of rows before its range. Written out first, so that both passes see one layout."""
    from .scratch import cut

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__i", inside).join(before, "__part").select(*rows.columns, (F.col("__i") - 1 + F.col("before")).cast("bigint").alias(name))


def first_examples(paths: DataFrame, most: int, path: str = "path") -> DataFrame:
    return paths.where(extension(F.col(path)).isin(*IMAGE_EXTS)).orderBy(path).limit(most)


def mirax_candidates(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows of either MIRAX ending, ending by ending as two listings put together are."""
    out = None
    for i, ext in enumerate(MIRAX_EXTS):
        part = paths.where(F.lower(path).endswith(ext)).withColumn("listed", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def mirax_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of the files of either ending below a folder, in one listing."""
    return listing(spark, folder, glob="*.{" + ",".join(sorted({f(e[1:]) for e in MIRAX_EXTS for f in (str.lower, str.upper)})) + "}")


def mirax_rank(path: Column, has_sibling_folder: Column) -> Column:
    """Larger is better: a data folder beside it, then a shallow path, then a short name, then the smaller path."""
    return F.struct(has_sibling_folder.cast("int").alias("a"), (-F.size(F.split(path, "/"))).alias("b"), (-F.length(path)).alias("c"))


def best_mirax(files: DataFrame, by: list[str], path: str = "path", sibling: str = "has_sibling_folder") -> DataFrame:
    """The best candidate of each group; ties go to the smaller path."""
    p = F.col(path)
    found = files.where(extension(p).isin(*MIRAX_EXTS)).select(*by, p.alias("path"), mirax_rank(p, F.col(sibling)).alias("r"))
    best = found.groupBy(*by).agg(F.max("r").alias("r"))
    return found.join(best, [*by, "r"]).groupBy(*by).agg(F.min("path").alias("path"))


def validate_bundles(files: DataFrame, by: str = "run_id", path: str = "path") -> DataFrame:
    """(run_id, kind, primary, error) of the files uploaded for each run. One grouped aggregate; no file is touched.

    A single zip is a bundle to extract; one standard slide must stand alone; a MIRAX file needs its companion folder, that is
    files below a folder of its stem beside it, after a move into the run's only top folder or out of a folder of its own stem.
    """
    p = F.col(path)
    ext, is_std, is_mir = extension(p), extension(p).isin(*STANDARD_EXTS), extension(p).isin(*MIRAX_EXTS)
    parts = F.split(p, "/")
    top = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    facts = files.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(ext == ".zip").alias("zips"), F.count_if(is_std).alias("std"), F.count_if(is_mir).alias("mir"),
        F.min(F.when(is_std, p)).alias("std_path"), F.min(F.when(ext == ".zip", p)).alias("zip_path"),
        F.max_by(p, F.when(is_mir, F.struct((-F.size(parts)).alias("b"), (-F.length(p)).alias("c")))).alias("mir_path"),
        F.collect_set(F.when(~is_mir, F.regexp_replace(p, r"/[^/]*$", ""))).alias("folders"), F.collect_set(top).alias("tops"),
    )
    m = F.when(F.col("mir") > 0, F.col("mir_path"))
    only_top = (~m.contains("/")) & (F.size("tops") == 1)
    m = F.when(only_top, F.concat(F.get("tops", F.lit(0)), F.lit("/"), m)).otherwise(m)
    parent = F.regexp_replace(m, r"/?[^/]*$", "")
    own = F.regexp_extract(parent, r"([^/]*)$", 1) == stem(m)
    m = F.when(own, F.concat_ws("/", F.nullif(F.regexp_replace(parent, r"/?[^/]*$", ""), F.lit("")), F.regexp_extract(m, r"([^/]*)$", 1))).otherwise(m)
    data = F.regexp_replace(m, r"\.[^./]*$", "")
    companion = F.exists("folders", lambda f: (f == data) | f.startswith(F.concat(data, F.lit("/"))))
    error = (
        F.when((F.col("zips") == 1) & (F.col("n") == 1), None).when(F.col("std") + F.col("mir") == 0, "no_supported_primary")
        .when((F.col("std") > 0) & (F.col("mir") > 0), "mixed_kinds").when((F.col("std") > 0) & ((F.col("std") != 1) | (F.col("n") != 1)), "standard_not_alone")
        .when((F.col("mir") > 0) & ~companion, "no_companion_folder")
    )
    kind = F.when((F.col("zips") == 1) & (F.col("n") == 1), "zip").when(F.col("mir") > 0, "mirax").when(F.col("std") > 0, "standard")
    primary = F.when(kind == "zip", F.col("zip_path")).when(kind == "standard", F.col("std_path")).otherwise(m)
    return facts.select(by, F.when(error.isNull(), kind).alias("kind"), F.when(error.isNull(), primary).alias("primary"), error.alias("error"))


def zip_members(spark: SparkSession, folder: str, base: str = "extracted") -> DataFrame:
    """(archive, member, safe, bytes, content) of the zip files below a folder; members that would leave base are never opened. Members stream out one by one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("safe", pa.bool_()), ("bytes", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            name = info.filename
                            safe = not name.startswith("/") and ".." not in name.split("/")
                            yield pa.RecordBatch.from_pylist([{"archive": path, "member": name, "safe": safe, "bytes": info.file_size, "content": z.read(info) if safe else None}], schema)

    rows = files.mapInArrow(run, "archive string, member string, safe boolean, bytes bigint, content binary")
    safe = F.col("safe") & is_safe_relative(F.col("member")) & is_within(F.concat(F.lit(base + "/"), F.col("member")), base)
    return rows.select("archive", "member", safe.alias("safe"), "bytes", F.when(safe, F.col("content")).alias("content"))


def copy_names(images: DataFrame, by: list[str], path: str = "path", order: str = "seq") -> DataFrame:
    """Names for copies of images in one folder: a path is copied once, later paths of the same base name get _1, _2, ..."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    once = images.groupBy(*by, path).agg(F.min(order).alias("__o")).withColumn("__base", base)
    n = F.row_number().over(W.partitionBy(*by, "__base").orderBy("__o", path)) - 1
    root, ext = F.regexp_replace("__base", r"\.[^.]*$", ""), F.regexp_extract("__base", r"(\.[^.]*)$", 1)
    return once.withColumn("__n", n).select(*by, path, F.when(F.col("__n") == 0, F.col("__base")).otherwise(F.concat(root, F.lit("_"), F.col("__n").cast("string"), ext)).alias("copy"))


def debug_name(n: Column, tag: Column) -> Column:
    return F.format_string("%04d_%s.jpg", n.cast("int"), tag)


#: First bytes of the image kinds that can be told apart without decoding.
MAGIC = ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"II+\x00", "bigtiff"), (b"PK\x03\x04", "zip"))


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, opened, error) of the files below a folder: what their first bytes say, and, of kinds that Spark's image reader decodes, whether they decode.
    An unreadable file is a row, not a failure. Spark's readers pass over empty files."""
    head = F.substring(F.hex("content"), 1, 16)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lit(None).cast("string")
    for magic, name in MAGIC:
        kind = F.when(head.startswith(magic.hex().upper()), name).otherwise(kind)
    decoded = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select(F.col("image.origin").alias("__origin"), (F.col("image.height") > 0).alias("opened"))
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    met = files.select("path", kind.alias("kind")).join(decoded, bare(F.col("path")) == bare(F.col("__origin")), "left")
    opened = F.when(F.col("kind").isin("png", "jpeg"), F.coalesce("opened", F.lit(False)))
    error = F.when(F.col("kind").isNull(), "unsupported_or_missing_image").when(~F.coalesce(opened, F.lit(True)), "unreadable_image")
    return met.select("path", "kind", opened.alias("opened"), error.alias("error"))


def copy_images(spark: SparkSession, names: DataFrame, folder: str, path: str = "path", copy: str = "copy") -> int:
    """Copy the images of a report to folder by their new names (copy_names), skipping those that are gone; how many were copied. A report's images are few, and the file system copies them without this process reading them."""
    fs = _FileSystem(spark, folder)
    done = 0
    for r in names.select(path, copy).toLocalIterator():
        done += fs.copy(r[0], f"{folder.rstrip('/')}/{r[1]}")
    return done


#: Generated sub-folders of a run, which clearing its outputs deletes.
GENERATED = ("wsi_reports", "wsi_debug", "dark", "traces", "Selected_Tiles", "embeddings", "tile_cache")


def delete_generated(spark: SparkSession, base: str, run_id: str, folders: tuple[str, ...] = GENERATED) -> list[str]:
    """Delete a run's generated folders (or its uploads, folders=("uploads",)), which must lie strictly below base; the names of those that were there."""
    name = run_id.strip("/")
    if not name or ".." in name.split("/") or run_id.startswith("/"):
        return []
    fs = _FileSystem(spark, base)
    return [f for f in folders if fs.delete(f"{base.rstrip('/')}/{name}/{f}")]


class _FileSystem:
    """The few file operations that Spark has no DataFrame for, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.to = self.of(folder)

    def of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.conf)

    def copy(self, source: str, target: str) -> bool:
        at, fs = self.jvm.org.apache.hadoop.fs.Path(source), self.of(source)
        return bool(fs.exists(at)) and bool(self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, self.to, self.jvm.org.apache.hadoop.fs.Path(target), False, self.conf))

    def delete(self, path: str) -> bool:
        return bool(self.to.delete(self.jvm.org.apache.hadoop.fs.Path(path), True))


def existing(rows: DataFrame, listed: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is in a listing."""
    return rows.join(listed.select(F.col("path").alias(path)), path, "left_semi")


def looked_up(rows: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """rows with what is known of their path, null where nothing is, and whether there is something: a left join on equality, for any number of paths."""
    return rows.join(known.withColumn("hit", F.lit(True)), path, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def deletable(listed: DataFrame, base: str, keep: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Listed files strictly below base, but for those below the kept folders: what a retention job may delete."""
    p = F.col(path)
    ok = is_within(p, base) & ~F.array_contains(F.split(p, "/"), "..")
    for folder in keep:
        ok = ok & ~is_within(p, f"{base.rstrip('/')}/{folder}")
    return listed.where(ok)


def write_saved_tiles(tiles: DataFrame, folder: str) -> None:
    """Saved tiles as files by run and quality; readers of one run touch its folders only."""
    tiles.write.mode("append").partitionBy("run_id", "quality").parquet(folder)
