"""Queries of the exploration: view tools with their answers, candidates, guards, logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, strings
from ..operators import geometry as G
from ..operators import ledger, raster, spatial, tools, traces
from ..sources import files, report
from ..streaming import feeds
from . import views
from .catalogue import KEYS, RE, SESSION, SLIDE, exploration, greedy_sql, query, rounded, zoom_sql
from .views import load

# -- view tools --------------------------------------------------------------------------------------------------------

#: Of a new view (run_id, view_seq, x, y, w, h): level, shown size, field, magnification, and the candidates of every second view.
RENDER = f"""r0 AS (SELECT *, greatest(w, h) AS side FROM nv), r1 AS (SELECT *, CASE WHEN side <= 4096 THEN 0 WHEN side / 2.0 <= 4096 THEN 1 WHEN side / 4.0 <= 4096 THEN 2 ELSE 3 END AS level FROM r0),
r2 AS (SELECT *, CASE level WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 ELSE 16.0 END AS ds FROM r1),
r3 AS (SELECT *, greatest({RE.format("w / ds")}, 1) AS lw, greatest({RE.format("h / ds")}, 1) AS lh FROM r2),
r4 AS (SELECT run_id, view_seq, x, y, w, h, level, CASE WHEN greatest(lw, lh) <= 1024 THEN lw ELSE {RE.format("lw * (1024.0 / greatest(lw, lh))")} END AS shown_w,
  CASE WHEN greatest(lw, lh) <= 1024 THEN lh ELSE {RE.format("lh * (1024.0 / greatest(lw, lh))")} END AS shown_h, CAST(w * 0.25 AS DOUBLE) AS field_um, CAST(round(40.0 / ds, 6) AS DOUBLE) AS magnification FROM r3)
SELECT *, CAST(CASE WHEN view_seq % 2 = 0 THEN 0 ELSE 3 END AS BIGINT) AS candidate_count, CASE WHEN view_seq % 2 <> 0 THEN view_seq * 10 + 1 END AS first_id, CASE WHEN view_seq % 2 <> 0 THEN 'uni2_knn' END AS candidate_source"""
TISSUE = ", view_seq % 9 / 20.0 AS tissue_fraction, CASE WHEN view_seq % 9 / 20.0 < 0.15 THEN 'low_tissue' END AS warning"


def candidates_of(new: DataFrame) -> DataFrame:
    """Three made-up candidates of every view with an odd number."""
    found = new.where("view_seq % 2 != 0").select("run_id", "view_seq", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (3, 1, 2)])).alias("rank"))
    return found.selectExpr("run_id", "view_seq", "rank", "view_seq * 10 + rank AS id", "1.0D / rank AS score", f"'{tools.INDEX_SOURCE}' AS source")


def answered(new: DataFrame, slides: DataFrame, tissue: bool = False) -> DataFrame:
    fractions = new.select("run_id", "view_seq", (F.col("view_seq") % 9 / 20.0).alias("tissue_fraction")) if tissue else None
    out = tools.shown(new, slides, candidates_of(new), fractions)
    more = ["tissue_fraction", "warning"] if tissue else []
    return out.select(
        "run_id", "view_seq", "x", "y", "w", "h", "level", "shown_w", "shown_h", F.col("field_width_um").alias("field_um"), F.round("effective_magnification", 6).alias("magnification"),
        "candidate_count", F.get("candidates", F.lit(0))["id"].alias("first_id"), "candidate_source", *more,
    )


@query(f"""WITH {SESSION}, nv AS (SELECT run_id, seq AS view_seq, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(40000 AS BIGINT) AS w, CAST(30000 AS BIGINT) AS h FROM o), {RENDER} FROM r4""")
def tool_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, _, slides = exploration(spark, sf_dir)
    return answered(tools.overview(requests, slides), slides)


def _zoom(view: str) -> str:
    """The zoom of requests (n0..n3) in a view, from the query over lineitem boxes."""
    boxes = f"b AS (SELECT run_id AS l_orderkey, seq AS l_linenumber, {view}, greatest(seq * 3 % 1000, 0) AS n0, greatest(seq * 7 % 1000, 0) AS n1, greatest(seq * 11 % 1000, 0) AS n2, greatest(seq * 17 % 1000, 0) AS n3 FROM rv)"
    inner = zoom_sql(1.0, 3.0)
    return boxes + inner[inner.index(",\nz0 AS"):]


def _zoomed(base: str, view: str, more: str = "") -> str:
    body = _zoom(view)
    steps, _, last = body.rpartition("\nSELECT l_orderkey")
    return f"WITH {SESSION}, rv AS ({base}), {steps}, nv AS (SELECT run_id, view_seq, x, y, w, h FROM (SELECT l_orderkey AS run_id, l_linenumber AS view_seq{last.partition('l_linenumber')[2]})), {RENDER}{more} FROM r4"


@query(_zoomed("SELECT * FROM cur", "x AS vx, y AS vy, w AS vw, h AS vh", TISSUE))
def tool_zoom_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, views_, slides = exploration(spark, sf_dir)
    return answered(tools.zoom_current(requests, views_, slides), slides, tissue=True)


@query(_zoomed("SELECT * FROM o", f"0 AS vx, 0 AS vy, {SLIDE[0]} AS vw, {SLIDE[1]} AS vh", TISSUE))
def tool_zoom_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, _, slides = exploration(spark, sf_dir)
    return answered(tools.zoom_full(requests, slides), slides, tissue=True)


@query(f"""WITH {SESSION}, l AS (SELECT *, greatest(w, h) AS side FROM cur)
SELECT run_id, seq, view_seq, x, y, w, h, CASE WHEN side <= 4096 THEN 0 WHEN side / 2.0 <= 4096 THEN 1 WHEN side / 4.0 <= 4096 THEN 2 ELSE 3 END AS level, CAST(3 AS BIGINT) AS n, view_seq * 10 + 1 AS first_id,
  CASE view_seq % 3 WHEN 0 THEN 'bad_like' WHEN 1 THEN 'uncertain' ELSE 'good_like' END AS hint FROM l""")
def tool_view_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, views_, slides = exploration(spark, sf_dir)
    found = views_.select("run_id", "view_seq", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (2, 3, 1)])).alias("rank"))
    found = found.selectExpr("run_id", "view_seq", "rank", "view_seq * 10 + rank AS id", "1.0D / rank AS score", "CASE view_seq % 3 WHEN 0 THEN 0.6D WHEN 1 THEN 0.5D ELSE 0.4D END AS bad_likelihood")
    info = tools.view_info(requests, views_, slides, found)
    first = F.get("candidates", F.lit(0))
    return info.select("run_id", "seq", "view_seq", *"xywh", "level", F.size("candidates").cast("bigint").alias("n"), first["id"].alias("first_id"), first["quality_hint"].alias("hint"))


#: Images of 112 by 112 pixels, one for each return flag.
PIXELS = "px AS MATERIALIZED (SELECT l_returnflag AS flag, l_orderkey * 7 % 112 AS x, l_partkey * 5 % 112 AS y, CAST(floor(avg(l_extendedprice)) AS BIGINT) % 256 AS gray FROM lineitem GROUP BY 1, 2, 3)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "l_orderkey * 7 % 112 AS x", "l_partkey * 5 % 112 AS y", "l_extendedprice AS v")
    return rows.groupBy("flag", "x", "y").agg((F.floor(F.avg("v")) % 256).alias("gray"))


PATCHES = """gr AS (SELECT flag, x, y, gray / 255.0 AS g, x // 16 AS gx, y // 16 AS gy FROM px), d AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY flag, gx, y ORDER BY x)) AS dx, abs(g - lag(g) OVER (PARTITION BY flag, gy, x ORDER BY y)) AS dy FROM gr),
p AS (SELECT flag AS grp, gy * 7 + gx AS id, avg(CAST(g < 0.92 AS INT)) AS tissue, (coalesce(avg(dx), 0) + coalesce(avg(dy), 0)) / 2 AS edge, CAST(round_even((gx * 16 + 8) / 111.0 * 999.0, 0) AS BIGINT) AS cx, CAST(round_even((gy * 16 + 8) / 111.0 * 999.0, 0) AS BIGINT) AS cy FROM d GROUP BY flag, gx, gy)"""


@query(f"""WITH RECURSIVE {PIXELS}, {PATCHES}, s AS (SELECT grp, id, cx, cy, 0.7 * tissue + 0.3 * edge AS score FROM p WHERE tissue >= 0.08),
{greedy_sql("s", 120, 1, 2.0)} SELECT grp AS flag, CAST(rank AS BIGINT) AS rank, id, cx, cy, round(score, 6) AS score FROM picked""")
def fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three images from their pixels alone."""
    out = spatial.fallback_patches(pixels(spark, sf_dir), 112, 112, by=["flag"])
    return out.select("flag", F.col("rank").cast("bigint").alias("rank"), "id", F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), rounded("score"))


@query(f"""WITH RECURSIVE {PIXELS}, {PATCHES}, s AS (SELECT grp, id, cx, cy, 0.7 * tissue + 0.3 * edge AS score FROM p WHERE tissue >= 0.08),
{greedy_sql("s", 120, 1, 2.0)}, i AS (SELECT DISTINCT flag FROM px), f AS (SELECT grp, count(*) AS n FROM picked GROUP BY grp)
SELECT flag, CASE WHEN flag = 'A' THEN CAST(2 AS BIGINT) ELSE coalesce(n, 0) END AS candidate_count, CASE WHEN flag = 'A' THEN 'uni2_knn' WHEN n > 0 THEN 'fallback_heuristic' END AS candidate_source FROM i LEFT JOIN f ON flag = grp""")
def view_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a view for each image: the index has some for one of them, the others fall back to the image."""
    px = pixels(spark, sf_dir)
    new = px.select(F.col("flag").alias("run_id"), F.lit(1).alias("view_seq")).distinct()
    fall = spatial.fallback_patches(px, 112, 112, by=["flag"]).select(F.col("flag").alias("run_id"), F.lit(1).alias("view_seq"), "rank", "id", "score")
    known = new.where("run_id = 'A'").select("run_id", "view_seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).selectExpr("*", "rank * 10L AS id", "1.0D / rank AS score")
    out = tools.with_candidates(new, tools.with_fallback(new, known, fall))
    return out.select(F.col("run_id").alias("flag"), "candidate_count", "candidate_source")


@query(f"""WITH RECURSIVE {PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY gray) AS i, count(*) OVER (PARTITION BY flag) AS n FROM px), cut AS (SELECT flag, min(gray) AS t FROM r WHERE i >= n * 0.35 GROUP BY flag),
m AS MATERIALIZED (SELECT flag, x, y, y * 4294967296 + x AS id, t FROM px JOIN cut USING (flag) WHERE gray <= t),
walk AS (SELECT flag, x, y, id FROM m UNION SELECT m.flag, m.x, m.y, walk.id FROM walk JOIN m ON m.flag = walk.flag AND ((m.x = walk.x AND m.y IN (walk.y - 1, walk.y + 1)) OR (m.y = walk.y AND m.x IN (walk.x - 1, walk.x + 1)))),
lab AS (SELECT flag, x, y, min(id) AS region FROM walk GROUP BY 1, 2, 3),
b AS (SELECT flag, region, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM lab GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY area DESC, region) AS box_rank FROM b)
SELECT flag, CAST(box_rank AS BIGINT) AS box_rank, x, y, w, h, area, CAST(round_even(x * 2.5, 0) AS BIGINT) AS x0, CAST(round_even(y * 1.5, 0) AS BIGINT) AS y0, CAST(round_even(w * 2.5, 0) AS BIGINT) AS w0, CAST(round_even(h * 1.5, 0) AS BIGINT) AS h0, t AS threshold FROM k JOIN cut USING (flag) WHERE box_rank <= 5""")
def dark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumns({"sx": F.lit(2.5), "sy": F.lit(1.5)})
    return raster.dark_regions(px, by="flag", pct=35.0, least=2, top=5).withColumn("box_rank", F.col("box_rank").cast("bigint"))


@query(f"""WITH {PIXELS}, d AS (SELECT flag, abs(gray - lag(gray) OVER (PARTITION BY flag, y ORDER BY x)) / 255.0 AS dx, abs(gray - lag(gray) OVER (PARTITION BY flag, x ORDER BY y)) / 255.0 AS dy FROM px),
e AS (SELECT flag, (coalesce(avg(dx), 0) + coalesce(avg(dy), 0)) / 2 AS edge FROM d GROUP BY flag) SELECT flag, round(edge, 6) AS edge FROM e WHERE edge >= 0.33""")
def textured_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.textured(raster.edge_energy(pixels(spark, sf_dir), ["flag"]), 0.33).select("flag", rounded("edge"))


@query(f"""WITH {PIXELS}, i AS (SELECT flag, x, y, CASE WHEN x % 28 < 24 AND flag <> 'R' THEN 250 ELSE gray END AS gray FROM px)
SELECT flag, round(avg(CAST(gray < 240 AS INT)), 6) AS tissue_fraction, count(*) AS sampled, CASE WHEN avg(CAST(gray < 240 AS INT)) < 0.15 THEN 'low_tissue' END AS warning FROM i WHERE y % 2 = 0 GROUP BY flag""")
def tissue_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("gray", F.when((F.col("x") % 28 < 24) & (F.col("flag") != "R"), 250).otherwise(F.col("gray"))).withColumns({"w": F.lit(112), "h": F.lit(256)})
    out = raster.tissue_fraction(px, ["flag"])
    return out.select("flag", rounded("tissue_fraction"), "sampled", raster.low_tissue(F.col("tissue_fraction")).alias("warning"))


# -- numbers and words of tools ----------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 % 20000 AS vx, l_partkey * 13 % 15000 AS vy, 500 + l_suppkey * 31 % 9000 AS vw, 500 + l_linenumber * 977 % 7000 AS vh, CAST(0.2 AS DOUBLE) + l_linenumber * CAST(0.05 AS DOUBLE) AS mpp FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(CAST(ceil(256.0 / mpp) AS BIGINT), 1) AS tile_px, round(vx / mpp, 6) AS x_level0, {RE.format("vx * 3.5")} AS dark_x, {RE.format("vw * 3.5")} AS dark_w,
  {RE.format("vx * (1024 / 40000.0)")} AS over_x, {RE.format("vh * (768 / 30000.0)")} AS over_h, CAST(CASE l_linenumber % 3 WHEN 0 THEN vw WHEN 1 THEN vh * 4.0 END AS DOUBLE) AS base FROM b""")
def tile_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile sides, microns to pixels, boxes of shown images in level-0 pixels and the other way round, and a slide's side from what is known of it."""
    mpp, n = F.lit(0.2) + F.col("l_linenumber") * F.lit(0.05), F.col("l_linenumber") % 3
    box = tuple(F.col(c) for c in ("vx", "vy", "vw", "vh"))
    given = F.when(n == 0, F.col("vw")).when(n == 1, F.lit(0)).otherwise(F.lit(None))
    level = F.when(n == 1, F.col("vh"))
    return views.boxes(spark, sf_dir).select(
        *KEYS, G.tile_side_px(256.0, mpp).cast("bigint").alias("tile_px"), F.round(G.um_to_level0(F.col("vx"), mpp), 6).alias("x_level0"), G.scaled_box(*box, 3.5, 2.5)["x"].alias("dark_x"), G.scaled_box(*box, 3.5, 2.5)["w"].alias("dark_w"),
        G.overview_box(*box, 1024, 768, 40000.0, 30000.0)["x"].alias("over_x"), G.overview_box(*box, 1024, 768, 40000.0, 30000.0)["h"].alias("over_h"), G.base_side(given, level, F.lit(4.0)).alias("base"),
    )


@query("""SELECT event_id, printf('%04d_%s.jpg', event_id + 1, event_type) AS name, strftime(ts, '%Y%m%d_%H%M%S_') || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS run_id, event_type IN ('view', 'click') AS flag,
  CASE WHEN event_type = 'view' THEN '(none provided)' ELSE event_type END AS reason, '{"error":"' || event_type || '","trace":"' || substr(repeat(event_type || '-', 900), 1, 4000) || '"}' AS envelope FROM events""")
def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of debug images, run ids, flags of the environment, reasons and error envelopes."""
    e = load(spark, sf_dir, "events")
    t = F.col("event_type")
    flag = F.when(t == "view", " TRUE ").when(t == "click", "y").when(t == "error", "0").otherwise("no")
    return e.select(
        "event_id", files.debug_name(F.col("event_id") + 1, t).alias("name"), strings.run_id(F.col("ts"), F.md5(F.col("event_id").cast("string"))).alias("run_id"), strings.truthy(flag).alias("flag"),
        tools.reason_text(F.when(t == "view", F.lit("  ")).otherwise(F.concat(t, F.lit(" ")))).alias("reason"), tools.envelope(t, F.repeat(F.concat(t, F.lit("-")), 900)).alias("envelope"),
    )


INLINE = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
for _pattern, _shown in strings.INLINE:
    INLINE = f"regexp_replace({INLINE}, '{_pattern}', '{_shown.replace('$', chr(92))}', 'g')"


@query(f"""WITH d AS (SELECT doc_id, '**a** & _b_ `c<d` [t](http://x.y/z) ' || text AS text FROM documents) SELECT doc_id, {INLINE} AS html FROM d""")
def inline_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.load_wide(spark, sf_dir, "documents").select("doc_id", strings.inline_html(F.concat(F.lit("**a** & _b_ `c<d` [t](http://x.y/z) "), "text")).alias("html"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even((l_partkey % 256 * a + 255 * (255 - a)) / 255.0, 0) AS BIGINT) AS gray FROM (SELECT *, l_suppkey * 7 % 256 AS a FROM lineitem)""")
def region_on_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(*KEYS, raster.over_white(F.col("l_partkey") % 256, F.col("l_suppkey") * 7 % 256).alias("gray"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'invalid_agent' WHEN o_orderkey % 3 = 2 THEN 'invalid_quality' WHEN o_orderkey % 5 > 1 THEN 'invalid_export' WHEN o_orderkey % 7 = 0 THEN 'invalid_size' END AS reason FROM orders""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % n).cast("int"))
    why = maps.request_error(pick((*maps.AGENTS, "other"), 4), pick((*maps.QUALITIES, "odd"), 3), pick((*maps.EXPORTS, "gif", "", None), 5), F.col("o_orderkey") % 7)
    return load(spark, sf_dir, "orders").select("o_orderkey", why.alias("reason"))


# -- ledgers -----------------------------------------------------------------------------------------------------------

STATUSES, ACTIONS = ("created", "uploading", "pending", "running", "done", "terminated", "error"), ("upload", "finalize", "terminate", "clear", "get", "rename")


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS run_id, list_extract(['upload', 'finalize', 'terminate', 'clear', 'get', 'rename'], CAST(o_orderkey % 6 + 1 AS INT)) AS action,
  CASE WHEN o_custkey % 8 < 7 THEN list_extract(['created', 'uploading', 'pending', 'running', 'done', 'terminated', 'error'], CAST(o_custkey % 8 + 1 AS INT)) END AS st FROM orders),
w AS (SELECT *, CASE WHEN st IS NULL THEN 'unknown_run' WHEN action IN ('upload', 'finalize') AND st NOT IN ('created', 'uploading') THEN 'closed_' || st WHEN action = 'clear' AND st <> 'done' THEN 'not_done' WHEN action = 'rename' THEN 'unknown_action' END AS reason FROM q)
SELECT id, run_id, action, reason IS NULL AS ok, CASE WHEN reason IS NOT NULL THEN st WHEN action = 'upload' THEN 'uploading' WHEN action = 'finalize' THEN 'pending' WHEN action = 'terminate' AND st NOT IN ('done', 'terminated', 'error') THEN 'terminated' ELSE st END AS status, reason FROM w""")
def status_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to runs of every status, and to runs that aren't known."""
    pick = lambda names, c, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col(c) % n).cast("int"))
    o = load(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("run_id")).distinct().where("run_id % 8 < 7").select("run_id", pick(STATUSES, "run_id", 8).alias("status"))
    return ledger.guarded(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), pick(ACTIONS, "o_orderkey", 6).alias("action")), runs)


@query("SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS injected FROM events")
def once_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.once(views.steps(spark, sf_dir), ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "injected")


@query("""WITH n AS (SELECT user_id % 9 AS run_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT run_id, n, k FROM n, unnest(range(0, CAST(ceil(n / 32.0) AS BIGINT) + 1)) t(k))
SELECT run_id, 'extract_embeddings' AS phase, 'running' AS status, least(k * 32, n) AS processed, k AS processed_batches FROM b UNION ALL SELECT run_id, 'extract_embeddings', 'done', n, CAST(ceil(n / 32.0) AS BIGINT) FROM n""")
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("run_id"), "event_id")
    return feeds.phase_events(done, ["run_id"], "event_id", "extract_embeddings")


@query("SELECT user_id AS run_id, event_id AS token, event_type FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events) WHERE event_id = newest")
def stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("token"), "event_type")
    return feeds.newest_only(r, ["run_id"], "token")


@query("""WITH v AS (SELECT o_custkey AS run_id, o_orderkey AS view_seq, CASE WHEN o_orderkey % 3 > 0 THEN '/out/' ELSE '/tmp/' END || o_orderkey || '.jpg' AS p FROM orders), c AS (SELECT run_id, max(view_seq) AS view_seq, arg_max(p, view_seq) AS p FROM v GROUP BY 1),
m AS (SELECT run_id, count(*) AS n_marks, count(*) FILTER (WHERE p LIKE '/out/%') AS shown_marks FROM v WHERE view_seq % 2 = 0 GROUP BY 1)
SELECT c.run_id, c.view_seq, CASE WHEN c.p LIKE '/out/%' THEN replace(c.p, '/out/', '/debug/') END AS view_url, coalesce(n_marks, 0) AS n_marks, coalesce(shown_marks, 0) AS shown_marks, CASE WHEN c.run_id % 2 = 0 THEN '/debug/o/' || c.run_id END AS overview_image_url,
  CASE WHEN c.run_id % 5 = 0 THEN 'index' END AS prep FROM c LEFT JOIN m USING (run_id)""")
def public_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients see of each run, with the addresses of images below the output folder."""
    seq = F.col("o_orderkey")
    v = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), seq.alias("view_seq"), F.concat(F.when(seq % 3 > 0, "/out/").otherwise("/tmp/"), seq.cast("string"), F.lit(".jpg")).alias("debug_path"))
    marks = v.where("view_seq % 2 = 0").withColumnRenamed("view_seq", "roi_id")
    key = F.col("run_id")
    prep = F.when(key % 5 == 0, F.create_map(F.lit("stage"), F.lit("index"))).otherwise(F.create_map().cast("map<string,string>"))
    runs = v.select("run_id").distinct().select("run_id", F.when(key % 2 == 0, F.concat(F.lit("/out/o/"), key.cast("string"))).alias("overview_path"), F.lit(None).cast("string").alias("overlay_path"), prep.alias("prep"))
    s = ledger.public_snapshot(runs, v, marks, "/out")
    urls = F.filter(F.col("roi_marks"), lambda m: m["image_url"].isNotNull())
    return s.select("run_id", "current_view.view_seq", F.col("current_view.image_url").alias("view_url"), F.coalesce(F.size("roi_marks"), F.lit(0)).cast("bigint").alias("n_marks"), F.coalesce(F.size(urls), F.lit(0)).cast("bigint").alias("shown_marks"), "overview_image_url", F.col("prep")["stage"].alias("prep"))


@query("""WITH m AS (SELECT o_custkey AS run_id, o_orderkey AS roi_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS importance, '### ROI ' || o_orderkey || ': ' || o_orderstatus || chr(10) || chr(10) || '- **Importance**: ' || substr(o_orderpriority, 1, 1) || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '- **Note**: n' || o_orderkey ELSE '' END
  || chr(10) || '- **BBox (level 0)**: x=' || (o_orderkey % 100) || ', y=2, w=3, h=4' || chr(10) || '- **Tissue fraction**: ' || printf('%.2f', CAST(o_orderkey % 4 / 4.0 AS DOUBLE)) || chr(10) AS t FROM orders WHERE o_orderkey % 3 > 0),
a AS (SELECT run_id, string_agg(t, chr(10) ORDER BY importance DESC, roi_id) AS marks FROM m GROUP BY 1),
s AS (SELECT o_custkey AS run_id, string_agg('### Step ' || o_orderkey || ': `pan`' || chr(10) || chr(10) || '- **Reason**: ' || CASE WHEN o_orderkey % 5 = 0 THEN '(no reason provided)' ELSE 'r' || o_orderkey END || chr(10) || '- **Approx field size**: ~' || printf('%.0f', CAST(o_orderkey % 900 + 0.25 AS DOUBLE)) || ' × 80 µm' || chr(10)
  || '- **Top-K candidates in this view**: ' || (o_orderkey % 12) || chr(10) || chr(10) || '![Step ' || o_orderkey || '](images/' || o_orderkey || '.jpg)' || chr(10), chr(10) ORDER BY o_orderkey) AS walk FROM orders GROUP BY 1)
SELECT s.run_id, '# Report (' || s.run_id || ')' || chr(10) || chr(10) || '## Prompt' || chr(10) || chr(10) || '```text' || chr(10) || 'ask' || chr(10) || '```' || chr(10) || chr(10) || '## Final Report' || chr(10) || chr(10) || 'found' || chr(10) || chr(10)
  || CASE WHEN s.run_id % 2 = 0 THEN '## Model Reasoning' || chr(10) || chr(10) || '```text' || chr(10) || 'why' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END || '## Regions of Interest (ROIs)' || chr(10) || chr(10) || coalesce(marks, '_No ROIs were kept in this run._' || chr(10)) || chr(10)
  || '## Navigation Steps' || chr(10) || chr(10) || walk AS report FROM s LEFT JOIN a USING (run_id)""")
def full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    run = F.col("o_custkey").alias("run_id")
    runs = o.select(run).distinct().select("run_id", F.lit("ask").alias("prompt"), F.lit("found").alias("final_text"), F.when(F.col("run_id") % 2 == 0, "why").alias("reasoning"))
    marks = o.where("o_orderkey % 3 > 0").select(
        run, k.alias("roi_id"), F.col("o_orderstatus").alias("label"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"), F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"),
        F.array(k % 100, F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), (k % 4 / 4.0).alias("tissue_fraction"),
    )
    steps = o.select(run, k.alias("step_index"), F.lit("pan").alias("tool"), F.when(k % 5 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("nav_reason"), (k % 900 + 0.25).alias("field_width_um"), F.lit(80.0).alias("field_height_um"), (k % 12).alias("candidate_count"), F.concat(F.lit("images/"), k.cast("string"), F.lit(".jpg")).alias("image"))
    return report.markdown_report(runs, marks, steps).select("run_id", "report")


@query("""SELECT user_id AS file, 'c' || event_id AS call_id, event_type AS name, '{"n":' || event_id || '}' AS arguments, CASE WHEN event_id % 3 > 0 THEN 'r' || event_id END AS result FROM events""")
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of logs whose message lists grow, with their results by call id."""
    e = load(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    none = F.lit(None)
    call = F.struct(F.concat(F.lit("c"), n).alias("id"), F.lit("function").alias("type"), F.struct(F.col("event_type").alias("name"), F.concat(F.lit('{"n":'), n, F.lit("}")).alias("arguments")).alias("function"))
    asks = F.struct(F.lit("assistant").alias("role"), none.cast("string").alias("content"), none.cast("string").alias("tool_call_id"), F.array(call).alias("tool_calls"))
    tells = F.struct(F.lit("tool").alias("role"), F.concat(F.lit("r"), n).alias("content"), F.concat(F.lit("c"), n).alias("tool_call_id"), F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))
    log = e.select(F.col("user_id").alias("file"), F.when(F.col("event_id") % 3 > 0, F.array(asks, tells)).otherwise(F.array(asks)).alias("messages"))
    return traces.tool_calls(log.union(log))
