"""Queries that write to the shared folder and read again: logs, features, caches, indexes, listings; and lookups over paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources import features, files, logs, tiles
from ..sources.scratch import shared_folder
from . import views
from .catalogue import UNIT, query, rounded
from .views import load


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'request' ELSE 'response' END AS type, text AS content, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * turn AS at FROM conversations""")
def trace_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended to a log in two halves, with ISO stamps, and read back."""
    c = load(spark, sf_dir, "conversations")
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("turn"))
    rows = c.select(
        F.when(F.col("role") == "user", "request").otherwise("response").alias("type"), F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("turn") % 2 == 0, "Z").otherwise("")).alias("timestamp"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("model"), F.col("text").alias("content"), (F.col("turn") % 2).alias("half"),
    )
    path = fresh(spark, "traces")
    for half in (0, 1):
        logs.append_traces(rows.where(F.col("half") == half).drop("half"), path)
    part = lambda i: F.get(F.split("model", "/"), F.lit(i)).cast("bigint")
    log = logs.read_traces(spark, path)
    return log.select(part(0).cast(c.schema["conv_id"].dataType).alias("conv_id"), part(1).cast(c.schema["turn"].dataType).alias("turn"), "type", "content", F.col("at").cast("timestamp_ntz").alias("at"))


@query("""WITH b AS (SELECT n_nationkey, ascii(c) // 16 AS bin, length(n_name) AS n FROM nation, unnest(string_split(n_name, '')) t(c)) SELECT n_nationkey, CAST(bin AS INT) AS bin, round(count(*) / any_value(n), 6) AS share, 'byte-histogram-16' AS extractor_id FROM b GROUP BY n_nationkey, bin""")
def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as images of a few bytes, embedded, kept under the hash of their parameters, and read from the cache."""
    images = load(spark, sf_dir, "nation").select("n_nationkey", F.encode("n_name", "utf-8").alias("image"))
    folder, params = fresh(spark, "cache"), {"bins": 16, "kind": "names"}
    make = lambda: tiles.embed(images, tiles.byte_histogram(16))
    tiles.cached(spark, folder, params, make)
    found = tiles.cached(spark, folder, params, lambda: make().limit(0))
    return found.select("n_nationkey", F.posexplode("features").alias("bin", "v"), "extractor_id").where("v > 0").select("n_nationkey", "bin", F.round(F.col("v").cast("double"), 6).alias("share"), "extractor_id")


@query("""WITH s AS (SELECT n_nationkey AS slide_id, 256 * (2 + n_nationkey % 3) AS w, 256 * (1 + n_nationkey % 2) AS h FROM nation),
t AS (SELECT slide_id, sx, sy, sx * 2 + tx AS gx, sy * 2 + ty AS gy, ((sy * CAST(ceil(w / 512.0) AS BIGINT) + sx) * 2 + ty) * 2 + tx AS tile_index, w, h FROM s, unnest(range(CAST(ceil(h / 512.0) AS BIGINT))) a(sy), unnest(range(CAST(ceil(w / 512.0) AS BIGINT))) b(sx), unnest(range(2)) c(ty), unnest(range(2)) d(tx)),
v AS (SELECT *, CASE WHEN gx * 256 < w AND gy * 256 < h THEN (gx * 40 + gy * 24) % 256 ELSE 255 END AS v FROM t), m AS (SELECT *, avg(v) OVER (PARTITION BY slide_id, sx, sy) AS mean FROM v)
SELECT slide_id, tile_index, CAST(gx * 256 AS DOUBLE) AS x_um, CAST(gy * 256 AS DOUBLE) AS y_um, CAST(v // 16 AS INT) AS bin FROM m WHERE mean < 140""")
def slide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted slides from grid to features: bright squares are not read, the others cut into tiles and embedded."""
    k = F.col("n_nationkey")
    slides = load(spark, sf_dir, "nation").select(k.alias("slide_id"), F.lit("painted").alias("path"), (256 * (2 + k % 3)).alias("base_w"), (256 * (1 + k % 2)).alias("base_h"), F.lit(1.0).alias("mpp"))
    found = features.extract(slides, tiles.byte_histogram(16), tile_um=256.0, tile_px=32, most_px=512, brightness_cutoff=140, texture_cutoff=None)
    return found.select("slide_id", "tile_index", "x_um", "y_um", (F.array_position("features", F.lit(1.0).cast("float")) - 1).cast("int").alias("bin"))


@query(f"""WITH {UNIT}, q AS (SELECT vec FROM v WHERE id = (SELECT min(id) FROM v)), d AS (SELECT id, round(1 - list_dot_product(v.vec, q.vec), 9) AS dist FROM v, q) SELECT id AS tile_id, round(dist, 6) AS dist FROM d ORDER BY dist, id LIMIT 10""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest to one vector in an index that is written first, all of whose lists are read."""
    rows = views.vectors(spark, sf_dir).select(F.col("id").alias("tile_id"), F.lit("x").alias("label"), F.lit("p").alias("path"), "vec")
    folder = fresh(spark, "index")
    meta = tiles.build_index(rows, folder, space="cosine")
    first = rows.orderBy("tile_id").first()
    return tiles.search_index(spark, folder, first.vec, 10, probes=meta["lists"]).select("tile_id", rounded("dist"))


@query("""SELECT space, len(any_value(embedding)) AS dim, least(64, count(*)) AS lists, count(*) AS count FROM embeddings, (VALUES ('cosine'), ('l2'), ('ip')) s(space) GROUP BY space""")
def index_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), F.lit("x").alias("label"), F.lit("p").alias("path"), F.col("embedding").alias("vec"))
    made = [tiles.build_index(rows, fresh(spark, "index"), space=space) for space in ("cosine", "l2", "ip")]
    return spark.createDataFrame([(m["space"], m["dim"], m["lists"], m["count"]) for m in made], "space string, dim bigint, lists bigint, count bigint")


@query(f"""WITH {UNIT}, p AS (SELECT id, other, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM (SELECT a.id, b.id AS other, round(1 - list_dot_product(a.vec, b.vec), 12) AS dist FROM v a JOIN v b ON a.id <> b.id))
SELECT id, other, rank, round(dist, 6) AS dist FROM p WHERE rank <= 5""")
def neighbours_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over lists of near vectors, with every list asked, so that it finds what all pairs give; with fewer lists tests hold its recall at 0.9."""
    rows = views.vectors(spark, sf_dir)
    return V.nearest(rows, 5, most_values=0, block=256, probes=1 << 20).select("id", "other", F.col("rank").cast("bigint").alias("rank"), rounded("dist"))


@query("SELECT n_regionkey AS region, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM nation GROUP BY 1")
def saved_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by folder, listed again, and counted by folder."""
    path = fresh(spark, "saved")
    n = load(spark, sf_dir, "nation").coalesce(1).select(F.col("n_regionkey").alias("run_id"), F.lit("good").alias("quality"), "n_name")
    files.write_saved_tiles(n, path)
    found = files.listing(spark, path, glob="*.parquet").select(F.regexp_extract("path", r"run_id=(\d+)/quality=good/", 1).cast("int").alias("region")).groupBy("region").agg(F.count("*").alias("n_files"))
    rows = spark.read.parquet(path).where("quality = 'good'").groupBy(F.col("run_id").alias("region")).agg(F.count("*").alias("n_rows"))
    return rows.join(found, "region").select(F.col("region").cast(n.schema["run_id"].dataType).alias("region"), "n_rows", "n_files")


#: Paths made of the pages' numbers.
SLIDES = "f AS (SELECT page_id, 'd' || (page_id % 11) || '/s' || page_id || CASE page_id % 4 WHEN 0 THEN '.mrxs' WHEN 1 THEN '.MRSX' WHEN 2 THEN '.svs' ELSE '.png' END AS path FROM pages)"


def slide_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    ext = F.when(k % 4 == 0, ".mrxs").when(k % 4 == 1, ".MRSX").when(k % 4 == 2, ".svs").otherwise(".png")
    return load(spark, sf_dir, "pages").select(k, F.concat(F.lit("d"), (k % 11).cast("string"), F.lit("/s"), k.cast("string"), ext).alias("path"))


@query(f"WITH {SLIDES} SELECT page_id, path, CAST(page_id % 4 AS INT) AS listed FROM f WHERE page_id % 4 < 2")
def mirax_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.mirax_candidates(slide_paths(spark, sf_dir))


@query(f"WITH {SLIDES} SELECT page_id, path FROM f WHERE page_id % 4 = 3 ORDER BY path LIMIT 7")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.first_examples(slide_paths(spark, sf_dir), 7)


@query(f"WITH {SLIDES} SELECT page_id, path FROM f WHERE page_id % 3 = 0")
def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose file is in a listing of every third."""
    f = slide_paths(spark, sf_dir)
    return files.existing(f, f.where("page_id % 3 = 0").select("path"))


@query(f"WITH {SLIDES} SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN 'index/' || page_id END AS index, page_id % 3 = 0 AS hit FROM f")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with their index, where one is known."""
    f = slide_paths(spark, sf_dir)
    known = f.where("page_id % 3 = 0").select("path", F.concat(F.lit("index/"), F.col("page_id").cast("string")).alias("index"))
    return files.looked_up(f, known)


@query("SELECT n_nationkey, CAST(printf('%.1f', n_nationkey * 256.5) AS DOUBLE) AS x_um, CAST(-n_nationkey AS DOUBLE) AS y_um FROM nation WHERE n_nationkey % 4 <> 3")
def member_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places read off the names of cached tiles; other names are left out."""
    k = F.col("n_nationkey")
    good = F.format_string("tile_(%.1f, %d).jpg", k * 256.5, -k)
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 4 == 3, F.concat(F.lit("x"), good)).otherwise(good).alias("name"))
    return tiles.coordinates(n).select("n_nationkey", "x_um", "y_um")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN '' ELSE n_name || chr(10) || 'b' END AS text FROM nation""")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of messages whose content is plain, null, or JSON of parts."""
    from ..operators import traces

    k = F.col("n_nationkey")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    listed = F.to_json(F.array(part("text", F.col("n_name")), part("image_url", F.lit("x")), part("text", F.lit("b"))))
    content = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 2, listed)
    return load(spark, sf_dir, "nation").select("n_nationkey", traces.content_text(content).alias("text"))
