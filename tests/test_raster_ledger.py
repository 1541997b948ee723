import random

import pytest
from pyspark.sql import functions as F

from tessarine.operators import ledger, raster


def px(spark, grays, w):
    return spark.createDataFrame([("i", i % w, i // w, g, w, len(grays) // w, 2.0, 3.0) for i, g in enumerate(grays)], "image string, x int, y int, gray int, w int, h int, sx double, sy double")


@pytest.mark.parametrize(("grays", "pct", "want"), [([1, 2, 3, 4], 50, 2), ([1, 2, 3, 4], 100, 4), ([5, 5, 5], 85, 5), ([7, 9], 0, 0), ([255] * 4, 85, 255), ([0] * 4, 85, 0), ([3], 1, 3)])
def test_percentiles(spark, grays, pct, want):
    assert raster.hist_percentile(px(spark, grays, 1), pct).first().threshold == want


def test_percentile_of_nothing(spark):
    assert raster.hist_percentile(px(spark, [1], 1).limit(0), 85).first().threshold == 255


def flood(mask):
    seen, out = set(), []
    for start in sorted(mask, key=lambda p: (p[1], p[0])):
        if start in seen:
            continue
        stack, region = [start], set()
        while stack:
            x, y = stack.pop()
            if (x, y) in mask and (x, y) not in region:
                region.add((x, y))
                stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        seen |= region
        out.append(((start[1] << 32) + start[0], frozenset(region)))
    return dict(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_both_labellings_are_a_flood_fill(spark, seed):
    r = random.Random(seed)
    mask = {(x, y) for x in range(20) for y in range(14) if r.random() < 0.55} | {(30, 30), (31, 31)}
    cells = spark.createDataFrame([("i", *p) for p in mask] + [("i", 30, 30)], "image string, x int, y int")
    for df in (raster.components(cells), raster.components_per_image(cells)):
        got = {}
        for row in df.collect():
            got.setdefault(row.region, set()).add((row.x, row.y))
        assert {k: frozenset(v) for k, v in got.items()} == flood(mask)


def test_snake_needs_many_rounds(spark):
    mask = {(x, y) for y in range(0, 21, 2) for x in range(12)} | {(11 if y % 4 == 1 else 0, y) for y in range(1, 21, 2)}
    cells = spark.createDataFrame(list(mask), "x int, y int")
    assert raster.components(cells).select("region").distinct().count() == 1
    assert raster.components(cells.limit(0)).count() == 0


def test_boxes_and_dark_regions(spark):
    grays = [255] * 400
    for y in range(2, 6):
        for x in range(3, 13):
            grays[y * 20 + x] = 10
    grays[19 * 20 + 19] = 10
    out = raster.dark_regions(px(spark, grays, 20), pct=10, least=5).collect()
    assert [(r.x, r.y, r.w, r.h, r.area, r.x0, r.y0, r.w0, r.h0, r.box_rank) for r in out] == [(3, 2, 10, 4, 40, 6, 6, 20, 12, 1)]
    assert raster.dark_regions(px(spark, [255] * 16, 4), least=17).count() == 0


def test_tissue_texture_and_colour(spark):
    image = px(spark, [0, 255] * 8, 4)
    assert raster.tissue_fraction(image, ["image"]).first().tissue_fraction == 0.5
    assert raster.edge_energy(image, ["image"]).first().edge == 0.5
    assert raster.textured(raster.edge_energy(px(spark, [9] * 16, 4), ["image"])).count() == 0
    assert raster.textured(raster.edge_energy(image, ["image"]), None).count() == 1
    row = spark.createDataFrame([(255, 255, 255, 0), (10, 20, 30, 255)], "r int, g int, b int, a int")
    assert [x.v for x in row.select(raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("v")).collect()] == [255, 18]
    assert [x.v for x in row.select(raster.over_white(F.col("r"), F.col("a")).alias("v")).collect()] == [255, 10]


def log(spark, kinds):
    return spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run_id string, seq int, kind string")


@pytest.mark.parametrize("seed", range(4))
def test_discards_are_a_stack(spark, seed):
    kinds = random.Random(seed).choices(["mark", "discard", "view"], [5, 4, 1], k=60)
    stack = []
    for i, k in enumerate(kinds):
        if k == "mark":
            stack.append(i)
        elif k == "discard" and stack:
            stack.pop()
    out = ledger.live_marks(log(spark, kinds), ["run_id"], ["seq"]).orderBy("seq").collect()
    assert [(r.seq, r.roi_id) for r in out] == [(s, i + 1) for i, s in enumerate(stack)]


def test_run_states(spark):
    kinds = ["upload", "create", "upload", "upload", "start", "finalize", "upload", "start", "finish", "terminate", "fail"]
    out = ledger.run_state(log(spark, kinds), ["run_id"], ["seq"]).orderBy("seq").collect()
    assert [r.status for r in out] == [None, "created", "uploading", "uploading", "uploading", "pending", "pending", "running", "done", "done", "done"]
    assert [r.ok for r in out] == [False, True, True, True, False, True, False, True, True, False, False]


def test_caps_views_and_snapshot(spark):
    asks = spark.createDataFrame([("r", i, "bad" if i % 2 else "good") for i in range(120)], "run_id string, seq int, quality string")
    out = ledger.save_tiles(asks, ["run_id"], ["seq"]).groupBy("quality", "ok").count().collect()
    assert {(r.quality, r.ok): r["count"] for r in out} == {("good", True): 60, ("bad", True): 50, ("bad", False): 10}
    views = spark.createDataFrame([("r", i, i * 10) for i in range(12)], "run_id string, view_seq int, x int")
    assert {r.view_seq for r in ledger.last_rows(views, ["run_id"], ["view_seq"], 8).collect()} == set(range(4, 12))
    assert ledger.current_view(views).first().x == 110
    runs = spark.createDataFrame([("r",), ("q",)], "run_id string")
    snap = {r.run_id: r for r in ledger.snapshot(runs, views=views).collect()}
    assert len(snap["r"].views) == 12 and snap["q"].views is None
