"""All queries of the engine by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, markdown, numbers, resolution, strings
from ..operators import geometry as G
from ..operators import ledger, raster, scoring, spatial, tools, traces
from ..operators import vectors as V
from ..sources import files
from ..streaming import feeds
from . import views
from .views import SIDE, SLIDE, VIEW, load, load_wide

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# -- vectors and scores ------------------------------------------------------------------------------------------------

UNIT = """
v0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS MATERIALIZED (SELECT id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS vec FROM v0)"""
NEAR = """,
p AS MATERIALIZED (SELECT id, other, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM (
  SELECT a.id, b.id AS other, round(1 - list_dot_product(a.vec, b.vec), 12) AS dist FROM v a JOIN v b ON a.id <> b.id)),
nov AS MATERIALIZED (SELECT v.id, coalesce(avg(dist), 0) AS novelty FROM v LEFT JOIN p ON p.id = v.id AND rank <= 20 GROUP BY v.id)"""
CENTRE = """,
c0 AS (SELECT i, avg(vec[i]) AS x FROM v, unnest(range(1, len(vec) + 1)) t(i) GROUP BY i),
c1 AS (SELECT list(x ORDER BY i) AS m FROM c0),
c AS MATERIALIZED (SELECT list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS m FROM c1),
cen AS MATERIALIZED (SELECT id, 1 - list_dot_product(vec, m) AS centroid_dist FROM v, c)"""
FUSED = """,
f0 AS (SELECT id, novelty, centroid_dist FROM nov JOIN cen USING (id)),
fz AS (SELECT *, avg(novelty) OVER () AS m1, stddev_pop(novelty) OVER () AS s1, avg(centroid_dist) OVER () AS m2, stddev_pop(centroid_dist) OVER () AS s2 FROM f0),
f AS MATERIALIZED (SELECT id, novelty, centroid_dist, 0.65 * CASE WHEN s1 < 1e-12 THEN 0 ELSE (novelty - m1) / s1 END + 0.35 * CASE WHEN s2 < 1e-12 THEN 0 ELSE (centroid_dist - m2) / s2 END AS score FROM fz)"""
CLASSES = """,
r0 AS (SELECT label, i, avg(vec[i]) AS x FROM v, unnest(range(1, len(vec) + 1)) t(i) WHERE label IN (0, 1) GROUP BY 1, 2),
r1 AS (SELECT label, list(x ORDER BY i) AS m FROM r0 GROUP BY label),
r AS MATERIALIZED (SELECT label, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS m FROM r1),
k AS MATERIALIZED (SELECT v.id, list_dot_product(vec, b.m) - list_dot_product(vec, g.m) AS bad_margin FROM v, r b, r g WHERE b.label = 1 AND g.label = 0),
kl AS MATERIALIZED (SELECT *, 1 / (1 + exp(-greatest(least(4 * bad_margin, 30), -30))) AS bad_likelihood FROM k)"""


@query(f"""WITH {UNIT} SELECT id, round(list_sum(vec), 6) AS unit_sum, round(sqrt(list_dot_product(vec, vec)), 6) AS unit_norm,
  round(list_sum(list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-12))), 6) AS added_sum FROM v JOIN v0 USING (id)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("e"))
    u = e.select("id", V.unit(F.col("e")).alias("u"), V.unit(F.col("e"), added=True).alias("a"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return u.select("id", total("u").alias("unit_sum"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"), total("a").alias("added_sum"))


@query(f"WITH {UNIT}{NEAR} SELECT id, other, rank, round(dist, 6) AS dist FROM p WHERE rank <= 5")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(views.vectors(spark, sf_dir), 5).select("id", "other", F.col("rank").cast("bigint").alias("rank"), rounded("dist"))


@query(f"WITH {UNIT}{NEAR} SELECT id, round(novelty, 6) AS novelty FROM nov")
def knn_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.novelty(views.vectors(spark, sf_dir)).select("id", rounded("novelty"))


@query(f"WITH {UNIT}{CENTRE} SELECT id, round(centroid_dist, 6) AS centroid_dist FROM cen")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.centroid_distance(views.vectors(spark, sf_dir)).select("id", rounded("centroid_dist"))


@query(f"WITH {UNIT}{NEAR}{CENTRE}{FUSED} SELECT id, round(novelty, 6) AS novelty, round(centroid_dist, 6) AS centroid_dist, round(score, 6) AS score FROM f")
def zscore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fused(views.vectors(spark, sf_dir)).select("id", rounded("novelty"), rounded("centroid_dist"), rounded("score"))


@query(f"""WITH {UNIT}{CLASSES} SELECT id, round(bad_margin, 6) AS bad_margin, round(bad_likelihood, 6) AS bad_likelihood, 'good_bad_centroid' AS reference_mode,
  CASE WHEN bad_likelihood >= 0.6 THEN 'bad_like' WHEN bad_likelihood <= 0.4 THEN 'good_like' ELSE 'uncertain' END AS quality_hint FROM kl""")
def class_centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    s = scoring.class_scores(rows.select("id", "vec"), views.references(rows))
    return s.select("id", rounded("bad_margin"), rounded("bad_likelihood"), "reference_mode", scoring.quality_hint(F.col("bad_likelihood")).alias("quality_hint"))


@query(f"""WITH {UNIT}{CLASSES}, r2 AS (SELECT v.id, list_dot_product(vec, m) AS s FROM v, r WHERE r.label = 1)
SELECT id, round(s - avg(s) OVER (), 6) AS bad_margin, 'bad_only_centroid' AS reference_mode FROM r2""")
def one_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return scoring.class_scores(rows.select("id", "vec"), views.references(rows).where("label = 'bad'")).select("id", rounded("bad_margin"), "reference_mode")


@query(f"""WITH {UNIT}{CLASSES} SELECT round(avg(CAST(bad_likelihood >= 0.5 AS INT)), 6) AS bad_like_fraction, round(avg(CAST(bad_likelihood >= 0.65 AS INT)), 6) AS bad_like_strong_fraction,
  count(*) AS n, (SELECT count(*) FROM v WHERE label = 0) AS good_n, (SELECT count(*) FROM v WHERE label = 1) AS bad_n FROM kl""")
def bad_like_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    shares = scoring.bad_fractions(scoring.class_scores(rows.select("id", "vec"), views.references(rows)))
    counts = rows.agg(F.count_if(F.col("label") == 0).alias("good_n"), F.count_if(F.col("label") == 1).alias("bad_n"))
    return shares.crossJoin(counts).select(rounded("bad_like_fraction"), rounded("bad_like_strong_fraction"), "n", "good_n", "bad_n")


@query(f"""WITH {UNIT}{NEAR}{CENTRE}{CLASSES},
g AS (SELECT id, novelty, centroid_dist, bad_margin, bad_likelihood FROM nov JOIN cen USING (id) JOIN kl USING (id)),
z AS (SELECT id, bad_likelihood, (novelty - avg(novelty) OVER ()) / stddev_pop(novelty) OVER () AS a, (centroid_dist - avg(centroid_dist) OVER ()) / stddev_pop(centroid_dist) OVER () AS b,
  (bad_margin - avg(bad_margin) OVER ()) / stddev_pop(bad_margin) OVER () AS c FROM g)
SELECT id, round(0.35 * a + 0.15 * b + 0.5 * c, 6) AS score, round(bad_likelihood, 6) AS bad_likelihood FROM z""")
def reference_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return scoring.fused(rows.select("id", "vec"), views.references(rows)).select("id", rounded("score"), rounded("bad_likelihood"))


# -- tiles and views ---------------------------------------------------------------------------------------------------

TILES = f"t AS (SELECT vec_id AS id, (vec_id % 25) * 256 / 0.25 AS x0, (vec_id // 25) * 256 / 0.25 AS y0, (vec_id % 25) * 256 / 0.25 + {SIDE / 2} AS cx, (vec_id // 25) * 256 / 0.25 + {SIDE / 2} AS cy FROM embeddings)"
SEEN = f"seen AS (SELECT * FROM t WHERE cx BETWEEN {VIEW[0]} AND {VIEW[0] + VIEW[2]} AND cy BETWEEN {VIEW[1]} AND {VIEW[1] + VIEW[3]})"


def greedy_sql(source: str, gap: float, side: float, limit: float, top: int = spatial.TOP_K) -> str:
    """Recursion over the accepted list of each group grp: the next row by rank that clashes with none of it."""
    inter = f"greatest({side} - abs(a.cx - o.cx), 0) * greatest({side} - abs(a.cy - o.cy), 0)"
    return f"""
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rn FROM {source}),
g AS (SELECT grp, 1 AS rank, rn, [rn] AS taken FROM o WHERE rn = 1
  UNION ALL SELECT g.grp, rank + 1, n.rn, list_append(taken, n.rn) FROM g, LATERAL (SELECT min(o.rn) AS rn FROM o WHERE o.grp = g.grp AND o.rn > g.rn AND NOT EXISTS (
    SELECT 1 FROM o a WHERE a.grp = g.grp AND list_contains(g.taken, a.rn) AND ((a.cx - o.cx) ** 2 + (a.cy - o.cy) ** 2 < {gap} * {gap} OR {inter} / (2 * {side} * {side} - {inter}) > {limit}))) n
  WHERE rank < {top} AND n.rn IS NOT NULL),
picked AS (SELECT grp, rank, id, cx, cy, score FROM g JOIN o USING (grp, rn))"""


def grid_sql(cols: str) -> str:
    x, y, w, h = VIEW
    n = lambda c, v, s: f"greatest(least(CAST(round_even((CAST(round_even({c}, 0) AS BIGINT) - {v}) / {s}.0 * 999.0, 0) AS BIGINT), 999), 0)"
    half = lambda s: f"greatest(CAST(round_even({SIDE} / {s}.0 * 999.0 / 2.0, 0) AS BIGINT), 10)"
    lim = lambda e: f"greatest(least({e}, 999), 0)"
    nx, ny = n("cx", x, w), n("cy", y, h)
    return f"""SELECT {cols}, {nx} AS nx, {ny} AS ny, {lim(f"{nx} - {half(w)}")} AS bx0, {lim(f"{ny} - {half(h)}")} AS by0, {lim(f"{nx} + {half(w)}")} AS bx1, {lim(f"{ny} + {half(h)}")} AS by1"""


def on_grid(rows: DataFrame, *names: str) -> DataFrame:
    at = lambda a, i, n: F.get(a, F.lit(i)).alias(n)
    return rows.select(*names, at("center_norm", 0, "nx"), at("center_norm", 1, "ny"), *[at("bbox_norm", i, n) for i, n in enumerate(("bx0", "by0", "bx1", "by1"))])


def ranked_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores of the tiles whose centre is in the view. The score needs all vectors; the view filter then bounds the fold."""
    seen = views.tiles(spark, sf_dir).where(spatial.in_view(F.col("cx"), F.col("cy"), VIEW))
    return seen.join(scoring.fused(views.vectors(spark, sf_dir)).select("id", F.round("score", 9).alias("score")), "id")


@query(f"""WITH RECURSIVE {UNIT}{NEAR}{CENTRE}{FUSED}, {TILES}, {SEEN}, s AS (SELECT 0 AS grp, id, cx, cy, round(score, 9) AS score FROM seen JOIN f USING (id)),
{greedy_sql("s", 2048, SIDE, 0.2)} {grid_sql("CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score")} FROM picked""")
def roi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = spatial.suppress(ranked_tiles(spark, sf_dir), [], SIDE, 2048)
    return on_grid(spatial.described(picked, SIDE, VIEW).withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 6)), "rank", "id", "score")


@query(f"WITH {TILES}, {SEEN} SELECT id, cx, cy FROM seen")
def view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tiles(spark, sf_dir).where(spatial.in_view(F.col("cx"), F.col("cy"), VIEW)).select("id", "cx", "cy")


@query(f"""WITH {TILES}, w AS (SELECT vec_id AS view_id, (vec_id * 37 % 20) * 1000.0 AS x, (vec_id * 53 % 20) * 1000.0 AS y, 4096.0 AS w, 3000.0 AS h FROM embeddings)
SELECT view_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM w JOIN t ON cx BETWEEN x AND x + w AND cy BETWEEN y AND y + h GROUP BY view_id""")
def tiles_in_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "embeddings").selectExpr("0 AS slide_id", "vec_id AS view_id", "double(vec_id * 37 % 20) * 1000 AS x", "double(vec_id * 53 % 20) * 1000 AS y", "double(4096) AS w", "double(3000) AS h")
    met = spatial.tiles_in_views(views.tiles(spark, sf_dir).withColumn("slide_id", F.lit(0)), w)
    return met.groupBy("view_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"""WITH RECURSIVE {TILES}, s AS (SELECT id // 400 AS grp, id, cx / 2 AS cx, cy / 2 AS cy, round(CAST(id * 7919 % 1000 AS DOUBLE), 6) AS score FROM t),
{greedy_sql("s", 870, SIDE, 0.05)} SELECT grp, CAST(rank AS BIGINT) AS rank, id, score FROM picked""")
def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 400 tiles are a slide of their own, at half the spacing, so that neighbours overlap."""
    rows = views.tiles(spark, sf_dir).select(F.floor(F.col("id") / 400).alias("grp"), "id", (F.col("cx") / 2).alias("cx"), (F.col("cy") / 2).alias("cy"), (F.col("id") * 7919 % 1000).cast("double").alias("score"))
    return spatial.suppress(rows, ["grp"], SIDE, 512, max_iou=0.05).select("grp", F.col("rank").cast("bigint").alias("rank"), "id", "score")


@query(f"WITH {TILES}, {SEEN} {grid_sql('id')}, CAST(x0 AS BIGINT) AS tx0, CAST(y0 AS BIGINT) AS ty0 FROM seen")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tiles(spark, sf_dir).where(spatial.in_view(F.col("cx"), F.col("cy"), VIEW))
    g = rows.withColumn("g", G.grid_candidate(F.col("x0"), F.col("y0"), SIDE, VIEW)).select("id", "g.*")
    return on_grid(g.withColumn("tx0", F.get("tile_bbox_level0", F.lit(0))).withColumn("ty0", F.get("tile_bbox_level0", F.lit(1))), "id", "tx0", "ty0").select("id", "nx", "ny", "bx0", "by0", "bx1", "by1", "tx0", "ty0")


@query("""WITH c AS (SELECT vec_id // 12 AS run, vec_id AS id, vec_id % 12 + 1 AS rank, vec_id * 83 % 1000 AS nx, vec_id * 131 % 1000 AS ny FROM embeddings),
p AS (SELECT vec_id // 12 AS run, vec_id AS point, vec_id * 277 % 1000 AS px, vec_id * 389 % 1000 AS py FROM embeddings),
d AS (SELECT *, sqrt((px - nx) ** 2 + (py - ny) ** 2) AS dist FROM p JOIN c USING (run)), b AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dist, rank) AS r FROM d)
SELECT point, CASE WHEN dist <= 170 THEN id END AS id, CASE WHEN dist <= 170 THEN rank END AS rank, round(dist, 6) AS distance, CASE WHEN dist > 170 THEN 'roi_outside_topk_candidates' END AS reason FROM b WHERE r = 1""")
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twelve vectors are the candidates of a run, and ask for the nearest of its twelve from other places."""
    e = load(spark, sf_dir, "embeddings")
    c = e.selectExpr("vec_id div 12 AS run", "vec_id AS id", "vec_id % 12 + 1 AS rank", "vec_id * 83 % 1000 AS nx", "vec_id * 131 % 1000 AS ny")
    p = e.selectExpr("vec_id div 12 AS run", "vec_id AS point", "vec_id * 277 % 1000 AS px", "vec_id * 389 % 1000 AS py")
    return spatial.nearest_candidate(p, c, ["run"]).select("point", "id", "rank", rounded("distance"), "reason")


# -- boxes -------------------------------------------------------------------------------------------------------------

BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 % 20000 AS vx, l_partkey * 13 % 15000 AS vy, 500 + l_suppkey * 31 % 9000 AS vw, 500 + l_linenumber * 977 % 7000 AS vh,
  greatest(least(l_orderkey % 1100 - 50, 999), 0) AS n0, greatest(least(l_partkey % 1100 - 50, 999), 0) AS n1, greatest(least(l_suppkey * 3 % 1100 - 50, 999), 0) AS n2,
  greatest(least((l_orderkey + l_partkey) % 1100 - 50, 999), 0) AS n3, l_suppkey * 3 % 1100 - 50 AS dx, (l_orderkey + l_partkey) % 1100 - 50 AS dy FROM lineitem)"""
RE = "CAST(round_even({}, 0) AS BIGINT)"
KEYS = ("l_orderkey", "l_linenumber")


def zoom_sql(shrink: float, aspect: float) -> str:
    sw, sh = SLIDE
    return f"""WITH {BOXES},
z0 AS (SELECT *, vx + {RE.format("least(n0, n2) / 999.0 * vw")} AS x, vy + {RE.format("least(n1, n3) / 999.0 * vh")} AS y,
  greatest({RE.format("(greatest(n0, n2) / 999.0 - least(n0, n2) / 999.0) * vw")}, 1) AS w, greatest({RE.format("(greatest(n1, n3) / 999.0 - least(n1, n3) / 999.0) * vh")}, 1) AS h FROM b),
z1 AS (SELECT *, w / vw > 0.7 OR h / vh > 0.7 AS big FROM z0),
z2 AS (SELECT *, CASE WHEN big THEN greatest({RE.format(f"w * CAST({shrink} AS DOUBLE)")}, 32) ELSE w END AS w2, CASE WHEN big THEN greatest({RE.format(f"h * CAST({shrink} AS DOUBLE)")}, 32) ELSE h END AS h2 FROM z1),
z3 AS (SELECT *, CASE WHEN big THEN x + w // 2 - w2 // 2 ELSE x END AS x2, CASE WHEN big THEN y + h // 2 - h2 // 2 ELSE y END AS y2 FROM z2),
z4 AS (SELECT *, greatest(least(x2, {sw - 1}), 0) AS x4, greatest(least(y2, {sh - 1}), 0) AS y4 FROM z3),
z5 AS (SELECT *, greatest(least(w2, {sw} - x4), 1) AS w4, greatest(least(h2, {sh} - y4), 1) AS h4 FROM z4),
z6 AS (SELECT *, greatest(w4 / h4, h4 / w4) > {aspect} AND w4 > h4 AS wide, greatest(w4 / h4, h4 / w4) > {aspect} AND w4 <= h4 AS tall FROM z5),
z7 AS (SELECT *, CASE WHEN wide THEN greatest({RE.format(f"h4 * CAST({aspect} AS DOUBLE)")}, 1) ELSE w4 END AS w5, CASE WHEN tall THEN greatest({RE.format(f"w4 * CAST({aspect} AS DOUBLE)")}, 1) ELSE h4 END AS h5 FROM z6)
SELECT l_orderkey, l_linenumber, CASE WHEN wide THEN greatest(least(x4 + w4 // 2 - w5 // 2, {sw} - w5), 0) ELSE x4 END AS x,
  CASE WHEN tall THEN greatest(least(y4 + h4 // 2 - h5 // 2, {sh} - h5), 0) ELSE y4 END AS y, w5 AS w, h5 AS h FROM z7"""


NORM, BOX = ("n0", "n1", "n2", "n3"), ("vx", "vy", "vw", "vh")


def _norm() -> tuple:
    return tuple(F.col(c) for c in NORM)


def _view() -> tuple:
    return tuple(F.col(c) for c in BOX)


def box_query(spark: SparkSession, sf_dir: str, box) -> DataFrame:
    return views.boxes(spark, sf_dir).withColumn("b", box).select(*KEYS, "b.x", "b.y", "b.w", "b.h")


@query(zoom_sql(1.0, 3.0))
def bbox_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zoom_rows(views.boxes(spark, sf_dir), NORM, BOX, *SLIDE).select(*KEYS, *"xywh")


@query(zoom_sql(0.35, 1.4))
def bbox_zoom_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zoom_rows(views.boxes(spark, sf_dir), NORM, BOX, *SLIDE, shrink=0.35, max_aspect=1.4).select(*KEYS, *"xywh")


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, greatest(least(vx + {RE.format("greatest(least(dx, 999), -999) / 999.0 * vw")}, {SLIDE[0]} - vw), 0) AS x,
  greatest(least(vy + {RE.format("greatest(least(dy, 999), -999) / 999.0 * vh")}, {SLIDE[1]} - vh), 0) AS y, vw AS w, CAST(vh AS BIGINT) AS h FROM b""")
def bbox_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.pan_box(F.col("n2"), F.col("n3"), _view(), *SLIDE))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, greatest(least(vx - 750, {SLIDE[0] - 1500}), 0) AS x, greatest(least(vy - 750, {SLIDE[1] - 1500}), 0) AS y, CAST(1500 AS BIGINT) AS w, CAST(1500 AS BIGINT) AS h FROM b""")
def bbox_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.mark_box(F.col("vx"), F.col("vy"), *SLIDE))


@query(f"""WITH {BOXES}, s AS (SELECT *, greatest({RE.format("256.0 / (0.2 + l_linenumber * 0.05)")}, 32) AS side,
  vx + {RE.format("(n0 + n2) / 2.0 / 999.0 * vw")} AS cx, vy + {RE.format("(n1 + n3) / 2.0 / 999.0 * vh")} AS cy FROM b)
SELECT l_orderkey, l_linenumber, greatest(least(cx - side // 2, {SLIDE[0]} - side), 0) AS x, greatest(least(cy - side // 2, {SLIDE[1]} - side), 0) AS y, side AS w, side AS h FROM s""")
def bbox_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.tile_box(_norm(), _view(), F.lit(0.2) + F.col("l_linenumber") * F.lit(0.05), *SLIDE))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, greatest(least(vx, {SLIDE[0] - 1}), 0) AS x, greatest(least(vy, {SLIDE[1] - 1}), 0) AS y,
  greatest(least(vw, {SLIDE[0]} - greatest(least(vx, {SLIDE[0] - 1}), 0)), 1) AS w, greatest(least(vh, {SLIDE[1]} - greatest(least(vy, {SLIDE[1] - 1}), 0)), 1) AS h FROM b""")
def bbox_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.clamp_view(*_view(), *SLIDE))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, {RE.format("vx / 4.0")} AS x, {RE.format("vy / 4.0")} AS y, greatest({RE.format("vw / 4.0")}, 1) AS w, greatest({RE.format("vh / 4.0")}, 1) AS h FROM b""")
def bbox_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.at_level(*_view(), 4.0))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, CAST(floor(vx * (1024 / 40000.0) + 0.5) AS BIGINT) AS x, CAST(floor(vy * (768 / 30000.0) + 0.5) AS BIGINT) AS y,
  greatest(CAST(floor(vw * (1024 / 40000.0) + 0.5) AS BIGINT), 2) AS w, greatest(CAST(floor(vh * (768 / 30000.0) + 0.5) AS BIGINT), 2) AS h FROM b""")
def bbox_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_query(spark, sf_dir, G.overview_box(*_view(), 1024, 768, 40000.0, 30000.0, browser=True))


@query(f"""WITH {BOXES}, l AS (SELECT *, greatest(vw, vh) AS side FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN side <= 1024 THEN vw ELSE {RE.format("vw * (1024.0 / side)")} END AS shown_w, CASE WHEN side <= 1024 THEN vh ELSE {RE.format("vh * (1024.0 / side)")} END AS shown_h,
  CASE WHEN side / 1.0 <= 4096 THEN 0 WHEN side / 2.0 <= 4096 THEN 1 ELSE 2 END AS level, CAST(round(vw * 0.25, 6) AS DOUBLE) AS field_um, CAST(round(40.0 / (1 + l_linenumber), 6) AS DOUBLE) AS magnification, {RE.format("vw / 50")} * 50 AS caption FROM l""")
def level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).withColumn("shown", G.resized(F.col("vw"), F.col("vh")))
    side = F.greatest("vw", "vh")
    return b.select(
        *KEYS, F.col("shown.w").alias("shown_w"), F.col("shown.h").alias("shown_h"), G.level_for(side, F.array(*[F.lit(d) for d in (1.0, 2.0, 4.0)])).alias("level"),
        F.round(G.field_um(F.col("vw"), F.lit(0.25)), 6).alias("field_um"), F.round(G.magnification(1 + F.col("l_linenumber"), F.lit(None)), 6).alias("magnification"), numbers.caption_um(F.col("vw")).alias("caption"),
    )


@query("""WITH s AS (SELECT n_nationkey AS slide_id, 3000 + n_nationkey * 977 AS base_w, 2000 + n_nationkey * 613 AS base_h, CAST(0.25 AS DOUBLE) + (n_nationkey % 3) * CAST(0.11 AS DOUBLE) AS mpp FROM nation),
u AS (SELECT *, greatest(CAST(floor(4096 * mpp / 256.0) AS BIGINT), 1) AS n, CAST(ceil(256.0 / mpp) AS BIGINT) AS tile_px FROM s), k AS (SELECT *, n * tile_px AS side FROM u),
g AS (SELECT k.*, sy, sx, ty, tx FROM k, unnest(range(CAST(ceil(base_h / side) AS BIGINT))) a(sy), unnest(range(CAST(ceil(base_w / side) AS BIGINT))) b(sx), unnest(range(n)) c(ty), unnest(range(n)) d(tx))
SELECT slide_id, ((sy * CAST(ceil(base_w / side) AS BIGINT) + sx) * n + ty) * n + tx AS tile_index, round(sx * side * mpp + tx * 256.0, 6) AS x_um, round(sy * side * mpp + ty * 256.0, 6) AS y_um, sx * side + tx * tile_px AS x_px, sy * side + ty * tile_px AS y_px FROM g""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS slide_id", "3000 + n_nationkey * 977 AS base_w", "2000 + n_nationkey * 613 AS base_h", "0.25D + (n_nationkey % 3) * 0.11D AS mpp")
    return spatial.tile_grid(slides).select("slide_id", "tile_index", rounded("x_um"), rounded("y_um"), "x_px", "y_px")


@query("""WITH s AS (SELECT n_nationkey AS slide_id, 3000 + n_nationkey * 977 AS base_w, 2000 + n_nationkey * 613 AS base_h, 0.25 AS mpp FROM nation), k AS (SELECT *, 4096 AS side FROM s),
g AS (SELECT slide_id, sy, sx FROM k, unnest(range(CAST(ceil(base_h / side) AS BIGINT))) a(sy), unnest(range(CAST(ceil(base_w / side) AS BIGINT))) b(sx))
SELECT slide_id, count(*) * 16 AS n_tiles FROM g WHERE (slide_id * 31 + sx * 57 + sy * 91) % 256 < 128 GROUP BY slide_id""")
def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS slide_id", "3000 + n_nationkey * 977 AS base_w", "2000 + n_nationkey * 613 AS base_h", "0.25D AS mpp")
    grid = spatial.tile_grid(slides)
    thumb = grid.select("slide_id", "sx", "sy").distinct().withColumn("gray", (F.col("slide_id") * 31 + F.col("sx") * 57 + F.col("sy") * 91) % 256)
    return spatial.foreground(grid, thumb, 128).groupBy("slide_id").agg(F.count("*").alias("n_tiles"))


# -- rasters -----------------------------------------------------------------------------------------------------------

CELLS = "cells AS MATERIALIZED (SELECT user_id % 64 AS x, CAST(hour(ts) AS BIGINT) AS y, avg(value) AS gray FROM events GROUP BY 1, 2)"


@query("""WITH h AS (SELECT l_returnflag, l_quantity AS gray, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY gray) AS run, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h)
SELECT l_returnflag, min(gray) FILTER (WHERE run >= total * 0.85) AS p85, min(gray) FILTER (WHERE run >= total * 0.45) AS p45 FROM c GROUP BY 1""")
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("gray"))
    return raster.hist_percentiles(px, {"p85": 85.0, "p45": 45.0}, by=["l_returnflag"])


@query(f"""WITH RECURSIVE {CELLS}, r AS (SELECT gray, row_number() OVER (ORDER BY gray) AS i, count(*) OVER () AS n FROM cells), cut AS (SELECT min(gray) AS t FROM r WHERE i >= n * 0.45),
m AS MATERIALIZED (SELECT x, y, y * 4294967296 + x AS id FROM cells, cut WHERE gray <= t),
walk AS (SELECT x, y, id FROM m UNION SELECT m.x, m.y, walk.id FROM walk JOIN m ON abs(m.x - walk.x) + abs(m.y - walk.y) = 1),
lab AS (SELECT x, y, min(id) AS region FROM walk GROUP BY 1, 2)
SELECT min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, region FROM lab GROUP BY region""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.cells(spark, sf_dir)
    at = raster.hist_percentile(cells, 45.0)
    mask = cells.crossJoin(F.broadcast(at)).where("gray <= threshold").select("x", "y")
    return raster.boxes(raster.components(mask), []).select("x", "y", "w", "h", "area", "region")


@query(f"WITH {CELLS} SELECT round(avg(CAST(gray < 240 AS INT)), 6) AS tissue_fraction, count(*) AS sampled FROM cells WHERE x % 2 = 0 AND y % 1 = 0")
def tissue_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.cells(spark, sf_dir).withColumns({"w": F.lit(256), "h": F.lit(24), "image": F.lit(1)})
    return raster.tissue_fraction(cells, ["image"]).select(rounded("tissue_fraction"), "sampled")


@query(f"""WITH {CELLS}, d AS (SELECT abs(gray - lag(gray) OVER (PARTITION BY y ORDER BY x)) / 255.0 AS dx, abs(gray - lag(gray) OVER (PARTITION BY x ORDER BY y)) / 255.0 AS dy FROM cells)
SELECT round((coalesce(avg(dx), 0) + coalesce(avg(dy), 0)) / 2, 6) AS edge FROM d""")
def edge_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.edge_energy(views.cells(spark, sf_dir).withColumn("image", F.lit(1)), ["image"]).select(rounded("edge"))


@query("""SELECT r, g, b, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS gray FROM (SELECT l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem)""")
def rgb_to_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = load(spark, sf_dir, "lineitem").selectExpr("l_partkey % 256 AS r", "l_suppkey % 256 AS g", "l_orderkey % 256 AS b")
    return px.select("r", "g", "b", raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


# -- ledgers -----------------------------------------------------------------------------------------------------------


@query("SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_index FROM events")
def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.numbered(views.steps(spark, sf_dir), ["run_id"], ["ts", "event_id"], "step_index").select("run_id", "event_id", "step_index")


@query("SELECT run_id, event_id FROM (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 8")
def last_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_rows(views.steps(spark, sf_dir), ["run_id"], ["ts", "event_id"], ledger.VIEWS_KEPT).select("run_id", "event_id")


@query("SELECT user_id AS run_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1")
def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.steps(spark, sf_dir).withColumn("seq", F.struct("ts", "event_id"))
    n = s.groupBy("run_id").agg(F.count("*").alias("n"))
    return ledger.current_view(s, seq="seq").select("run_id", "event_id").join(n, "run_id")


@query("""WITH q AS (SELECT event_id, user_id % 5 AS run_id, CASE WHEN event_type IN ('click', 'view') THEN 'good' ELSE 'bad' END AS quality FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, quality ORDER BY event_id) AS i, CASE WHEN quality = 'good' THEN 200 ELSE 50 END AS cap FROM q)
SELECT event_id, quality, i <= cap AS ok, CASE WHEN i <= cap THEN i END AS tile_idx, CASE WHEN i > cap THEN 'max_' || quality || '_tiles_reached' END AS reason FROM n""")
def saved_tile_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.steps(spark, sf_dir).select("event_id", (F.col("run_id") % 5).alias("run_id"), F.when(F.col("event_type").isin("click", "view"), "good").otherwise("bad").alias("quality"))
    return ledger.save_tiles(q, ["run_id"], ["event_id"]).select("event_id", "quality", "ok", "tile_idx", "reason")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS run_id, event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'mark' WHEN event_type = 'error' THEN 'discard' ELSE 'other' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stack FROM (SELECT DISTINCT run_id FROM e)
  UNION ALL SELECT w.run_id, e.i, CASE WHEN kind = 'mark' THEN list_append(stack, event_id) WHEN kind = 'discard' THEN stack[1:len(stack) - 1] ELSE stack END FROM w JOIN e ON e.run_id = w.run_id AND e.i = w.i + 1),
z AS (SELECT run_id, arg_max(stack, i) AS stack FROM w GROUP BY run_id)
SELECT run_id, stack[k] AS event_id, k AS roi_id FROM z, unnest(range(1, len(stack) + 1)) t(k)""")
def roi_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "click"), "mark").when(F.col("event_type") == "error", "discard").otherwise("other")
    return ledger.live_marks(views.steps(spark, sf_dir).withColumn("kind", kind), ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "roi_id")


RUN_EVENTS = {"signup": "create", "view": "upload", "click": "finalize", "purchase": "start", "error": "finish"}


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS run_id, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'upload' WHEN 'click' THEN 'finalize' WHEN 'purchase' THEN 'start' ELSE 'finish' END AS ev,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS ev, CAST(NULL AS VARCHAR) AS status, false AS ok FROM (SELECT DISTINCT run_id FROM e)
  UNION ALL SELECT n.run_id, n.i, n.event_id, n.ev, coalesce(n.target, n.status), n.target IS NOT NULL FROM (SELECT e.run_id, e.i, e.event_id, e.ev, w.status, CASE
    WHEN e.ev = 'create' AND w.status IS NULL THEN 'created' WHEN e.ev = 'upload' AND w.status IN ('created', 'uploading') THEN 'uploading'
    WHEN e.ev = 'finalize' AND w.status IN ('created', 'uploading') THEN 'pending' WHEN e.ev = 'start' AND w.status = 'pending' THEN 'running' WHEN e.ev = 'finish' AND w.status = 'running' THEN 'done' END AS target
    FROM w JOIN e ON e.run_id = w.run_id AND e.i = w.i + 1) n)
SELECT run_id, event_id, ev AS event, status, ok FROM w WHERE i > 0""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for raw, event in RUN_EVENTS.items():
        kind = F.when(F.col("event_type") == raw, event).otherwise(kind)
    return ledger.run_state(views.steps(spark, sf_dir).withColumn("kind", kind), ["run_id"], ["ts", "event_id"]).select("run_id", "event_id", "event", "status", "ok")


@query("""WITH s AS (SELECT user_id AS run_id, dayofyear(ts) AS poll, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 40 + 1 AS step FROM events),
t AS (SELECT run_id, poll, max(step) AS top, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY run_id ORDER BY poll), 0) AS before FROM t)
SELECT run_id, CAST(poll AS INT) AS poll, top, n, before, top < before AS reset, CASE WHEN top < before THEN 0 ELSE before END AS mark, greatest(top - CASE WHEN top < before THEN 0 ELSE before END, 0) AS fresh FROM b""")
def poll_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger.numbered(views.steps(spark, sf_dir), ["run_id"], ["ts", "event_id"], "i").select("run_id", F.dayofyear("ts").alias("poll"), (F.col("i") % 40 + 1).alias("step"))
    return feeds.poll_increments(s, ["run_id"], "poll", "step")


@query("SELECT user_id AS run_id, CAST(sum(len(props)) AS BIGINT) AS total_bytes, count(*) AS n_files, list_sort(list(event_type)) AS names FROM events GROUP BY 1")
def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.length("props").cast("bigint").alias("size"), "event_type")
    return ledger.upload_totals(f, ["run_id"], "size", "event_type")


@query("""SELECT user_id AS run_id, event_id, sum(value) OVER w AS sent_raw, round(greatest(least(100 * sum(value) OVER w / (sum(value) OVER (PARTITION BY user_id)), 100), 0), 6) AS percent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""".replace("sum(value) OVER w AS sent_raw", "round(sum(value) OVER w, 6) AS sent"))
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = views.steps(spark, sf_dir).withColumn("total", F.sum("value").over(W.partitionBy("run_id"))).withColumn("seq", F.struct("ts", "event_id"))
    return feeds.progress(s, ["run_id"], "seq", "value", "total").select("run_id", "event_id", rounded("sent"), rounded("percent"))


@query("""SELECT user_id AS run_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), ts) AS started_at FROM events""")
def carried_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.steps(spark, sf_dir).select("run_id", "event_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "starting").otherwise("other").alias("status"))
    return ledger.carried_start(s, ["run_id"], ["at", "event_id"]).select("run_id", "event_id", "started_at")


@query("SELECT o_orderkey AS roi_id, o_custkey AS run_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS importance, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT) DESC, o_orderkey) AS place FROM orders")
def report_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("roi_id"), F.col("o_custkey").alias("run_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"))
    return ledger.report_order(m, ["run_id"]).withColumn("place", F.col("place").cast("bigint"))


# -- conversations -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_tool_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.last_of_role(load(spark, sf_dir, "conversations"), "conv_id", "turn", "assistant").select("conv_id", "turn", "text")


@query("""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text AS content FROM conversations),
c AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), max(i)) AS cut FROM m GROUP BY 1),
u AS (SELECT conv_id, 0 AS s, 0 AS i, 'user' AS role, 'example' AS content FROM c UNION ALL SELECT conv_id, CASE WHEN i <= cut THEN 1 ELSE 3 END, i, role, content FROM m JOIN c USING (conv_id)
  UNION ALL SELECT conv_id, 2, 0, 'user', 'view' FROM c UNION ALL SELECT conv_id, 4, 0, 'user', 'history' FROM c)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s, i) - 1 AS pos, role, content FROM u""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda x: F.array(F.lit(x))
    out = traces.context_window(load(spark, sf_dir, "conversations"), "conv_id", "turn", "assistant", one("example"), one("view"), one("history"))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT conv_id, turn, CASE WHEN r2 = 'assistant' THEN t2 END AS answered_at FROM (SELECT *, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def request_response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.paired(load(spark, sf_dir, "conversations"), "conv_id", "turn", "user", "assistant", "role").select("conv_id", "turn", "answered_at")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'image_url' ELSE 'text' END AS type, CASE WHEN role = 'assistant' THEN '<redacted>' ELSE text END AS url FROM conversations""")
def redact_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct(F.when(F.col("role") == "assistant", "image_url").otherwise("text").alias("type"), F.col("text").alias("text"), F.col("text").alias("url"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(traces.redacted(F.array(part))).alias("p"))
    return c.select("conv_id", "turn", "p.type", "p.url")


# -- strings -----------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'tile' ELSE substr(s, 1, 64) END AS name FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s', '_', 'g'), '[^\p{L}\p{N}_-]', '', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_wide(spark, sf_dir, "documents").select("doc_id", strings.safe_filename(F.col("text")).alias("name"))


@query(r"SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]*)$', 1)) AS ext, CASE WHEN starts_with(url, 'https://') THEN '/debug/' || replace(substr(url, 9), '\', '/') END AS shown, NOT starts_with(url, '/') AND NOT list_contains(string_split(url, '/'), '..') AS safe FROM pages")
def ext_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", strings.extension(u).alias("ext"), strings.public_url(u, "https://").alias("shown"), strings.is_safe_relative(u).alias("safe"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN CASE WHEN n / 1024 >= 10 THEN printf('%.0f KB', n / 1024) ELSE printf('%.1f KB', n / 1024) END
  ELSE CASE WHEN n / 1048576 >= 10 THEN printf('%.0f MB', n / 1048576) ELSE printf('%.1f MB', n / 1048576) END END AS shown FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_linenumber) * (l_orderkey % 97) + 0.25 AS DOUBLE) AS n FROM lineitem)""")
def bytes_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("l_extendedprice") * F.col("l_linenumber")) * (F.col("l_orderkey") % 97) + F.lit(0.25)
    return load(spark, sf_dir, "lineitem").select(*KEYS, numbers.bytes_human(n).alias("shown"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS shown FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", strings.escape_html(F.col("html")).alias("shown"))


PATTERNS = "|".join(f"(?:{p})" for p in strings.FAILURES)


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' Unable to open it' WHEN 1 THEN text || ' UNSUPPORTED or missing image file' WHEN 2 THEN 'Error reading the slide. ' || text ELSE text END AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(?i){PATTERNS}') AS failed, contains(lower(t), '{strings.FATAL[0]}') OR contains(lower(t), '{strings.FATAL[1]}') AS fatal, CASE WHEN regexp_matches(t, '(?i){PATTERNS}') THEN 'done-warn' ELSE 'done' END AS status FROM d""")
def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id") % 4, F.col("text")
    t = F.when(n == 0, F.concat(text, F.lit(" Unable to open it"))).when(n == 1, F.concat(text, F.lit(" UNSUPPORTED or missing image file"))).when(n == 2, F.concat(F.lit("Error reading the slide. "), text)).otherwise(text)
    d = load_wide(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", strings.tells_failure(F.col("t")).alias("failed"), strings.is_fatal(F.col("t")).alias("fatal"), strings.effective_status(F.lit("done"), F.col("t")).alias("status"))


@query()
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over lines that SQL can't express; tests hold it against a plain loop."""
    body = F.concat(F.lit("# Title *a*\n\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("\n\n```py\nx < 1\n```\n1. one\n> said"))
    return load_wide(spark, sf_dir, "documents").select("doc_id", markdown.markdown_html(body).alias("html"))


@query("""SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS section FROM documents""")
def report_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("## Prompt\nask\n## Final Report\n"), "text", F.lit("\n## Navigation Steps\n1. a"))
    return load_wide(spark, sf_dir, "documents").select("doc_id", markdown.report_section(body).alias("section"))


@query("""SELECT l_orderkey, l_linenumber, lower(printf('%02d', l_linenumber)) AS tag, (greatest(l_linenumber - 1, 0)) % 12 AS slot, round(10 + (20 - 10) * l_discount, 6) AS between FROM lineitem""")
def small_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(*KEYS, F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("tag"), numbers.palette_slot(F.col("l_linenumber")).alias("slot"), F.round(numbers.lerp(10, 20, F.col("l_discount")), 6).alias("between"))


@query("""SELECT n_nationkey, CAST(CASE n_nationkey % 5 WHEN 0 THEN 0.25 + n_nationkey WHEN 1 THEN 0.5 WHEN 2 THEN 10.0 / 20 WHEN 3 THEN 0.75 END AS DOUBLE) AS mpp FROM nation""")
def mpp_chain_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by key: plain, unparsable then mpp-y, objective only, the scanner's own, none."""
    k = F.col("n_nationkey")
    pair = lambda *kv: F.create_map(*[v if i % 2 else F.lit(v) for i, v in enumerate(kv)])
    props = (
        F.when(k % 5 == 0, pair("openslide.mpp-x", (k + 0.25).cast("string"))).when(k % 5 == 1, pair("openslide.mpp-x", F.lit("n/a"), "openslide.mpp-y", F.lit("0.5")))
        .when(k % 5 == 2, pair("openslide.mpp-x", F.lit(""), "openslide.objective-power", F.lit("20"))).when(k % 5 == 3, pair("aperio.MPP", F.lit("0.75"))).otherwise(pair("other", F.lit("1")))
    )
    return load(spark, sf_dir, "nation").select("n_nationkey", resolution.mpp_of_view(props).alias("mpp"))


@query("""SELECT n_nationkey, CAST(CASE n_nationkey % 5 WHEN 0 THEN 0.25 + n_nationkey WHEN 1 THEN 0.33 WHEN 2 THEN 0.44 ELSE 0.5 END AS DOUBLE) AS mpp FROM nation""")
def mpp_chain_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    pair = lambda *kv: F.create_map(*[v if i % 2 else F.lit(v) for i, v in enumerate(kv)])
    props = (
        F.when(k % 5 == 0, pair("openslide.mpp-x", (k + 0.25).cast("string"))).when(k % 5 == 1, pair("openslide.comment", F.lit("<a><PixelSizeMicrons>0.33</PixelSizeMicrons></a>")))
        .when(k % 5 == 2, pair("tiff.ImageDescription", F.lit('<ome:OME><ome:Image ID="i"><ome:Pixels SizeX="9" PhysicalSizeX="0.44"/></ome:Image></ome:OME>')))
        .when(k % 5 == 3, pair("tiff.ImageDescription", F.lit("<OME><Image"))).otherwise(pair("openslide.mpp-x", F.lit("0")))
    )
    return load(spark, sf_dir, "nation").select("n_nationkey", resolution.mpp_of_index(props, 0.5).alias("mpp"))


@query("""SELECT n_nationkey, sha256('{"name":"' || n_name || '","tile_px":224}') AS hash FROM nation""")
def params_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", strings.params_hash(F.col("n_name").alias("name"), F.lit(224).alias("tile_px")).alias("hash"))


@query("SELECT doc_id, 'data:' || CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || base64(encode(text)) AS url FROM documents")
def data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, "a/b.PNG").otherwise("a/b")
    return load(spark, sf_dir, "documents").select("doc_id", strings.data_url(F.encode("text", "utf-8"), path).alias("url"))


# -- files -------------------------------------------------------------------------------------------------------------

PATHS = """f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'root/Good_Tiles/' WHEN 1 THEN 'root/Bad_Tiles/' WHEN 2 THEN 'root/Good/' WHEN 3 THEN 'root/Bad/Good_Tiles/' ELSE 'root/other/' END || (page_id % 200) || CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS path FROM pages)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    folder = F.when(k % 5 == 0, "root/Good_Tiles/").when(k % 5 == 1, "root/Bad_Tiles/").when(k % 5 == 2, "root/Good/").when(k % 5 == 3, "root/Bad/Good_Tiles/").otherwise("root/other/")
    return load(spark, sf_dir, "pages").select(k, F.concat(folder, (k % 200).cast("string"), F.when(k % 7 == 0, ".txt").when(k % 3 == 0, ".JPG").otherwise(".png")).alias("path"))


@query(f"""WITH {PATHS}, l AS (SELECT DISTINCT path, CASE WHEN contains(path, '/Good_Tiles/') THEN 0 WHEN contains(path, '/Bad_Tiles/') THEN 1 WHEN contains(path, '/Good/') THEN 2 WHEN contains(path, '/Bad/') THEN 3 END AS o FROM f WHERE lower(path) LIKE '%.png' OR lower(path) LIKE '%.jpg')
SELECT path, CASE WHEN o IN (0, 2) THEN 'good' ELSE 'bad' END AS label, row_number() OVER (ORDER BY o, path) - 1 AS tile_id FROM l WHERE o IS NOT NULL""")
def tile_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover_tiles(paths(spark, sf_dir))


@query("""WITH f AS (SELECT page_id % 20 AS run_id, url || CASE WHEN page_id % 3 = 0 THEN '.mrxs' WHEN page_id % 3 = 1 THEN '.MRSX' ELSE '.dat' END AS path, page_id % 4 = 0 AS s FROM pages)
SELECT run_id, path FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CAST(s AS INT) DESC, len(string_split(path, '/')), length(path), path) AS n FROM f WHERE lower(path) LIKE '%.mrxs' OR lower(path) LIKE '%.mrsx') WHERE n = 1""")
def mirax_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    f = load(spark, sf_dir, "pages").select((k % 20).alias("run_id"), F.concat("url", F.when(k % 3 == 0, ".mrxs").when(k % 3 == 1, ".MRSX").otherwise(".dat")).alias("path"), (k % 4 == 0).alias("has_sibling_folder"))
    return files.best_mirax(f, ["run_id"])


@query("""WITH f AS (SELECT page_id % 50 AS run_id, page_id, CASE (page_id % 50) % 6 WHEN 0 THEN 'a.zip' WHEN 1 THEN 's' || page_id || '.svs' WHEN 2 THEN CASE WHEN page_id < 50 THEN 'x/m.mrxs' ELSE 'x/m/d' || page_id || '.dat' END
  WHEN 3 THEN CASE WHEN page_id < 50 THEN 'm.mrxs' ELSE 'a.svs' END WHEN 4 THEN 'n' || page_id || '.txt' ELSE CASE WHEN page_id < 50 THEN 'm.mrxs' ELSE 'q/d' || page_id || '.dat' END END AS path FROM pages),
g AS (SELECT run_id, count(*) AS n, (run_id % 6) AS k, min(path) AS p FROM f GROUP BY 1)
SELECT run_id, CASE k WHEN 0 THEN CASE WHEN n = 1 THEN 'zip' END WHEN 1 THEN CASE WHEN n = 1 THEN 'standard' END WHEN 2 THEN CASE WHEN n > 1 THEN 'mirax' END END AS kind,
  CASE k WHEN 0 THEN CASE WHEN n = 1 THEN p END WHEN 1 THEN CASE WHEN n = 1 THEN p END WHEN 2 THEN CASE WHEN n > 1 THEN 'x/m.mrxs' END END AS "primary",
  CASE k WHEN 0 THEN CASE WHEN n > 1 THEN 'no_supported_primary' END WHEN 1 THEN CASE WHEN n > 1 THEN 'standard_not_alone' END WHEN 2 THEN CASE WHEN n = 1 THEN 'no_companion_folder' END WHEN 3 THEN CASE WHEN n > 1 THEN 'mixed_kinds' ELSE 'no_companion_folder' END WHEN 4 THEN 'no_supported_primary' WHEN 5 THEN 'no_companion_folder' END AS error FROM g""")
def bundle_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("page_id"), F.col("page_id") % 50
    s = k.cast("string")
    early = k < 50
    path = (
        F.when(r % 6 == 0, "a.zip").when(r % 6 == 1, F.concat(F.lit("s"), s, F.lit(".svs"))).when(r % 6 == 2, F.when(early, "x/m.mrxs").otherwise(F.concat(F.lit("x/m/d"), s, F.lit(".dat"))))
        .when(r % 6 == 3, F.when(early, "m.mrxs").otherwise("a.svs")).when(r % 6 == 4, F.concat(F.lit("n"), s, F.lit(".txt"))).otherwise(F.when(early, "m.mrxs").otherwise(F.concat(F.lit("q/d"), s, F.lit(".dat"))))
    )
    return files.validate_bundles(load(spark, sf_dir, "pages").select(r.alias("run_id"), path.alias("path")))


@query("""WITH f AS (SELECT page_id AS seq, page_id % 4 AS run_id, 'd' || (page_id % 9) || '/v' || (page_id % 6) || '.jpg' AS path FROM pages), o AS (SELECT run_id, path, min(seq) AS s FROM f GROUP BY 1, 2),
b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, base ORDER BY s, path) - 1 AS i FROM b)
SELECT run_id, path, CASE WHEN i = 0 THEN base ELSE regexp_replace(base, '\\.jpg$', '') || '_' || i || '.jpg' END AS copy FROM n""")
def copy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    f = load(spark, sf_dir, "pages").select(k.alias("seq"), (k % 4).alias("run_id"), F.concat(F.lit("d"), (k % 9).cast("string"), F.lit("/v"), (k % 6).cast("string"), F.lit(".jpg")).alias("path"))
    return files.copy_names(f, ["run_id"])


# -- tools and feeds ---------------------------------------------------------------------------------------------------


def exploration(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, views, slides) of one run per customer: every order is a view, and a request made just before it."""
    o = load(spark, sf_dir, "orders").selectExpr("o_custkey AS run_id", "o_orderkey * 10 AS view_seq", "o_orderkey * 10 - 5 AS seq")
    views_ = o.selectExpr("run_id", "view_seq", "view_seq * 7 % 20000 AS x", "view_seq * 13 % 15000 AS y", "500 + view_seq * 31 % 9000 AS w", "500 + view_seq * 97 % 7000 AS h")
    requests = o.selectExpr("run_id", "seq", "seq * 3 % 1000 AS n0", "seq * 7 % 1000 AS n1", "seq * 11 % 1000 AS n2", "seq * 17 % 1000 AS n3", "seq * 3 % 1500 - 700 AS dx", "seq * 7 % 1500 - 700 AS dy", "CASE seq % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE 'odd' END AS quality")
    slides = o.select("run_id").distinct().selectExpr("run_id", "40000 AS base_w", "30000 AS base_h", "0.25D AS mpp", "40.0D AS objective", "array(1D, 2D, 4D, 16D) AS downsamples")
    return requests, views_, slides


SESSION = """o AS (SELECT o_custkey AS run_id, o_orderkey * 10 AS view_seq, o_orderkey * 10 - 5 AS seq FROM orders),
vw AS (SELECT run_id, view_seq, view_seq * 7 % 20000 AS x, view_seq * 13 % 15000 AS y, 500 + view_seq * 31 % 9000 AS w, 500 + view_seq * 97 % 7000 AS h FROM o),
rq AS (SELECT r.run_id, r.seq, max(v.view_seq) AS view_seq FROM o r LEFT JOIN vw v ON v.run_id = r.run_id AND v.view_seq < r.seq GROUP BY 1, 2),
cur AS (SELECT rq.run_id, seq, view_seq, x, y, w, h FROM rq JOIN vw USING (run_id, view_seq))"""


@query(f"""WITH {SESSION} SELECT run_id, seq AS view_seq, greatest(least(x + {RE.format("greatest(least(seq * 3 % 1500 - 700, 999), -999) / 999.0 * w")}, 40000 - w), 0) AS x,
  greatest(least(y + {RE.format("greatest(least(seq * 7 % 1500 - 700, 999), -999) / 999.0 * h")}, 30000 - h), 0) AS y, w, h FROM cur""")
def tool_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pan(*exploration(spark, sf_dir))


@query(f"""WITH {SESSION}, t AS (SELECT rq.run_id, seq, rq.view_seq, x, y, w, h, CASE seq % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE 'odd' END AS quality,
  (seq * 3 % 1000 + seq * 11 % 1000) / 2.0 AS px, (seq * 7 % 1000 + seq * 17 % 1000) / 2.0 AS py FROM rq LEFT JOIN vw USING (run_id, view_seq)),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, quality ORDER BY seq) AS i FROM t WHERE quality <> 'odd' AND view_seq IS NOT NULL)
SELECT run_id, seq, quality, true AS ok, i AS tile_idx, NULL AS reason, greatest(least(x + {RE.format("px / 999.0 * w")} - 512, 40000 - 1024), 0) AS bx, greatest(least(y + {RE.format("py / 999.0 * h")} - 512, 30000 - 1024), 0) AS by FROM n
UNION ALL SELECT run_id, seq, quality, false, NULL, CASE WHEN view_seq IS NULL THEN 'no_current_view' ELSE 'invalid_quality' END, NULL, NULL FROM t WHERE quality = 'odd' OR view_seq IS NULL""")
def tool_save_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.save_tile(*exploration(spark, sf_dir)).select("run_id", "seq", "quality", "ok", "tile_idx", "reason", F.col("bbox.x").alias("bx"), F.col("bbox.y").alias("by"))


@query(f"""WITH {SESSION}, c AS (SELECT run_id, view_seq, k AS rank, view_seq * 10 + k AS id, (view_seq * 83 + k * 331) % 1000 AS nx, (view_seq * 131 + k * 577) % 1000 AS ny FROM vw, unnest(range(1, 4)) t(k)),
p AS (SELECT rq.run_id, seq, view_seq, (seq * 3 % 1000 + seq * 11 % 1000) / 2.0 AS px, (seq * 7 % 1000 + seq * 17 % 1000) / 2.0 AS py FROM rq),
d AS (SELECT p.*, c.rank, c.nx, c.ny, sqrt((px - nx) ** 2 + (py - ny) ** 2) AS dist FROM p LEFT JOIN c USING (run_id, view_seq)), b AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY dist, rank) AS i FROM d)
SELECT b.run_id, seq, coalesce(dist <= 170, false) AS ok, CASE WHEN b.view_seq IS NULL THEN 'no_current_view' WHEN dist IS NULL THEN 'no_roi_candidates' WHEN dist > 170 THEN 'roi_outside_topk_candidates' END AS reason,
  CASE WHEN dist <= 170 THEN b.rank END AS candidate_rank, CASE WHEN dist <= 170 THEN greatest(least(x + {RE.format("nx / 999.0 * w")} - 750, 40000 - 1500), 0) END AS bx FROM b LEFT JOIN vw USING (run_id, view_seq) WHERE i = 1""")
def tool_mark_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, views_, slides = exploration(spark, sf_dir)
    found = views_.select("run_id", "view_seq", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3)])).alias("rank"))
    found = found.selectExpr("run_id", "view_seq", "rank", "view_seq * 10 + rank AS id", "(view_seq * 83 + rank * 331) % 1000 AS nx", "(view_seq * 131 + rank * 577) % 1000 AS ny", "1.0D / rank AS score")
    return tools.mark_roi(requests, views_, slides, found).select("run_id", "seq", "ok", "reason", "candidate_rank", F.col("bbox.x").alias("bx"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 8 NOT IN (5, 7) WHEN 1 THEN true WHEN 2 THEN o_orderkey % 8 <> 7 ELSE false END AS ok FROM orders""")
def tool_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", pick(("tile", "wsi", "aml", "nobody"), k % 4).alias("agent"), pick(tools.TOOLS, k % 8).alias("tool"))
    return tools.access(o).select("o_orderkey", "ok")


@query("SELECT user_id AS run_id, event_id + 1 AS step_index, event_type AS payload, false AS reset FROM events")
def stream_fresh_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step once, by a stateful stream over the files of events (a glob, as a stream's path is a folder or a glob), written by a Parquet sink and read again."""
    source = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    steps = source.select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("step_index"), F.col("event_type").alias("payload"))
    return feeds.drained(feeds.fresh_steps(steps), "steps")


@query("""SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, * FROM events) GROUP BY 1, 2""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a windowed stream with a watermark; an extension, as the feeds themselves have no event time."""
    source = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    out = feeds.drained(feeds.windowed(source, "ts", "event_type", "value"), "hours", by=["window_start", "event_type"])
    return out.select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'b' ELSE 'a' END AS phase, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS extra, CASE n_nationkey % 4 WHEN 0 THEN CAST(n_nationkey AS DOUBLE) WHEN 1 THEN 0.5 END AS id,
  CASE WHEN n_nationkey % 4 > 1 THEN 'invalid_id' WHEN n_nationkey % 2 = 1 THEN 'invalid_parity' END AS reason FROM nation""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    a = F.create_map(F.lit("phase"), F.lit("a"))
    b = F.when(k % 3 == 0, F.create_map(F.lit("phase"), F.lit("b"), F.lit("extra"), F.col("n_name")))
    ident = numbers.finite(F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "0.5").when(k % 4 == 2, "NaN").otherwise("x"))
    m = load(spark, sf_dir, "nation").select("n_nationkey", maps.merged(a, b).alias("m"), ident.alias("id"))
    return m.select("n_nationkey", maps.get(F.col("m"), "phase").alias("phase"), maps.get(F.col("m"), "extra").alias("extra"), "id", maps.rejection(id=F.col("id").isNotNull(), parity=k % 2 == 0).alias("reason"))


@query("""WITH s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id FROM events), a AS (SELECT run_id, pos, CASE WHEN run_id % 5 = 0 AND pos = 3 THEN -1 ELSE event_id END AS k FROM s)
SELECT a.run_id, bool_or(a.k IS DISTINCT FROM s.event_id) AS rebuild FROM a JOIN s ON a.run_id = s.run_id AND a.pos = s.pos GROUP BY 1""")
def rebuild_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth run shows another third step than it has."""
    s = ledger.numbered(views.steps(spark, sf_dir), ["run_id"], ["ts", "event_id"], "pos")
    shown = s.select("run_id", "pos", F.when((F.col("run_id") % 5 == 0) & (F.col("pos") == 3), -1).otherwise(F.col("event_id")).alias("k"))
    return feeds.rebuild_needed(shown, s.select("run_id", "pos", F.col("event_id").alias("k")), "run_id", "pos", "k")


@query("""WITH p AS (SELECT page_id, '/data/runs/' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '/../x' WHEN page_id % 3 = 1 THEN '/reports/a' ELSE '/b' END AS path FROM pages)
SELECT page_id, path FROM p WHERE starts_with(path, '/data/runs/') AND NOT contains(path, '/../') AND NOT starts_with(path, '/data/runs/4/')""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    p = load(spark, sf_dir, "pages").select(k, F.concat(F.lit("/data/runs/"), (k % 7).cast("string"), F.when(k % 3 == 0, "/../x").when(k % 3 == 1, "/reports/a").otherwise("/b")).alias("path"))
    return files.deletable(p, "/data/runs", keep=("4",))


@query("""WITH s AS (SELECT user_id AS run_id, count(*) AS n_steps, max(event_id) AS last_step FROM events GROUP BY 1), m AS (SELECT user_id AS run_id, count(*) AS n_marks FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT s.run_id, n_steps, last_step, coalesce(n_marks, 0) AS n_marks FROM s LEFT JOIN m USING (run_id)""")
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.steps(spark, sf_dir)
    marks = s.where("event_type = 'purchase'").select("run_id", "event_id")
    facts = ledger.summary(s.select("run_id").distinct(), "event_id", steps=s.select("run_id", "event_id"), marks=marks)
    return facts.select("run_id", "n_steps", F.col("last_steps").alias("last_step"), "n_marks")
