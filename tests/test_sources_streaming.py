import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.operators import raster, tools, traces
from tessarine.sources import files, logs, pyramid, report, tiles
from tessarine.streaming import feeds


def png(grays):
    """A gray PNG from a list of rows."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(grays[0]), len(grays), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in grays))) + chunk(b"IEND", b"")


def test_listing_and_zip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with zipfile.ZipFile(tmp_path / "a" / "b.zip", "w") as z:
        z.writestr("ok/s.mrxs", "x")
        z.writestr("../evil", "y")
    (tmp_path / "c.PNG").write_bytes(b"12")
    out = files.listing(spark, str(tmp_path)).collect()
    assert {(r.path.split("/")[-1], r.bytes) for r in out} == {("b.zip", (tmp_path / "a/b.zip").stat().st_size), ("c.PNG", 2)}
    got = {r.member: (r.safe, None if r.content is None else bytes(r.content)) for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert got == {"ok/s.mrxs": (True, b"x"), "../evil": (False, None)}


def test_tile_folders(spark):
    rows = ["r/Good/b.png", "r/Good_Tiles/z.jpg", "r/Bad/a.jpeg", "r/Good/b.png", "r/x/c.png", "r/Good/d.txt", "Good.png"]
    out = files.discover_tiles(spark.createDataFrame([(r,) for r in rows], "path string")).orderBy("tile_id").collect()
    assert [(r.path, r.label, r.tile_id) for r in out] == [("r/Good_Tiles/z.jpg", "good", 0), ("r/Good/b.png", "good", 1), ("r/Bad/a.jpeg", "bad", 2)]
    assert files.discover_tiles(spark.createDataFrame([], "path string")).count() == 0


@pytest.mark.parametrize(
    ("names", "kind", "error"),
    [
        (["a.zip"], "zip", None), (["a.svs"], "standard", None), (["a.svs", "b.txt"], None, "standard_not_alone"), (["a.txt"], None, "no_supported_primary"), (["a.svs", "m.mrxs"], None, "mixed_kinds"),
        (["m.mrxs", "m/d.dat"], "mirax", None), (["m/m.mrxs", "m/d.dat"], "mirax", None), (["m.mrxs", "top/m/d.dat"], "mirax", None), (["m.mrxs", "n/d.dat"], None, "no_companion_folder"), (["a.zip", "b.txt"], None, "no_supported_primary"),
    ],
)
def test_bundles(spark, names, kind, error):
    r = files.validate_bundles(spark.createDataFrame([("r", n) for n in names], "run_id string, path string")).first()
    assert (r.kind, r.error) == (kind, error)


def test_trace_logs(spark, tmp_path):
    rows = [
        {"type": "request", "timestamp": "2024-01-01T00:00:00", "messages": [{"role": "user", "content": "hi"}]}, {"type": "response", "timestamp": "2024-01-01T00:00:01Z", "content": "ok"},
        {"type": "request", "timestamp": "2024-01-01T00:00:02", "messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "zoom", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c1", "content": "err"}]},
    ]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "trace.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    log = logs.read_traces(spark, str(tmp_path))
    assert log.count() == 3 and log.where("at is null").count() == 0
    call = traces.tool_calls(log).first()
    assert (call.name, call.result) == ("zoom", "err")
    pairs = traces.paired(log, "file", "at").orderBy("at").collect()
    assert [p.answered_at is not None for p in pairs] == [True, False]
    logs.append_traces(log.select("type", "timestamp"), str(tmp_path / "out"))
    logs.append_traces(log.select("type", "timestamp"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_message_contents(spark):
    df = spark.createDataFrame([("plain",), (None,), ('[{"type":"text","text":"a"},{"type":"image_url"},{"type":"text","text":"b"}]',), ("[not json",)], "c string")
    assert [r.o for r in df.select(traces.content_text(F.col("c")).alias("o")).collect()] == ["plain", "", "a\nb", "[not json"]


def test_embedding_cache_and_npz(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), 0.0, bytearray([i] * 10)) for i in range(70)] + [(70, 0.0, 0.0, None)], "tile_index long, x_um double, y_um double, image binary")
    made = []

    def make():
        made.append(1)
        return tiles.embed(rows, tiles.byte_histogram(16))

    for _ in range(2):
        out = tiles.cached(spark, str(tmp_path / "cache"), {"tile": 224, "cutoff": 0.02}, make)
    assert len(made) == 1 and out.count() == 71
    tiles.cached(spark, str(tmp_path / "cache"), {"tile": 224, "cutoff": 0.03}, make)
    assert len(made) == 2
    assert out.where("tile_index = 40").first().features[2] == 1.0 and sum(out.where("tile_index = 70").first().features) == 0
    z = np.load(io.BytesIO(tiles.npz_of(out, {"extractor_id": "h"})))
    assert z["features"].shape == (71, 16) and z["coordinates_um"][5, 0] == 5


def test_model_outputs_as_rows():
    x = np.arange(24.0)
    assert tiles.as_matrix(x).shape == (1, 24) and tiles.as_matrix(x.reshape(2, 3, 4)).tolist() == x.reshape(2, 3, 4)[:, 0].tolist() and tiles.as_matrix(x.reshape(2, 2, 2, 3)).shape == (2, 12)
    assert tiles.as_matrix({"z": 1, "features": [x.reshape(2, 12)]}).shape == (2, 12) and tiles.as_matrix((x.reshape(4, 6), 0)).shape == (4, 6)


def test_member_names(spark):
    df = spark.createDataFrame([("tile_(1.5, -2.0).jpg",), ("tile_(1e3, 2).jpg",), ("tile_(+.5, 2).jpg",), ("tile_(1, 2).png",), ("x",)], "name string")
    assert [(r.x_um, r.y_um) for r in tiles.coordinates(df).collect()] == [(1.5, -2.0), (0.5, 2.0)]
    assert [(r.x_um, r.y_um) for r in tiles.coordinates(df, ext="png").collect()] == [(1.0, 2.0)]


def test_images_to_dark_regions(spark, tmp_path):
    grays = [[0 if 2 <= x < 6 and 1 <= y < 4 else 200 + x for x in range(10)] for y in range(8)]
    (tmp_path / "i.png").write_bytes(png(grays))
    px = tiles.pixels(tiles.images(spark, str(tmp_path)))
    assert px.count() == 80
    g = px.select(F.col("path").alias("image"), "x", "y", raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"), F.lit(4.0).alias("sx"), F.lit(4.0).alias("sy"))
    r = raster.dark_regions(g, pct=10, least=4).first()
    assert (r.x, r.y, r.w, r.h, r.area, r.x0, r.w0) == (2, 1, 4, 3, 12, 8, 16)


def test_pyramid_source(spark):
    spark.dataSource.register(pyramid.PyramidSource)
    read = lambda level: spark.read.format("pyramid").option("width", 300).option("height", 200).option("side", 128).option("level", level).load("s")
    rows = read(1).collect()
    assert len(rows) == 6 and {(r.x, r.y): (r.w, r.h, len(r.gray)) for r in rows}[256, 128] == (22, 36, 22 * 36)
    with pytest.raises(Exception, match="no image"):
        spark.read.format("pyramid").load("s").count()


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, "good", f"p{i}", v.tolist()) for i, v in enumerate(x)], "tile_id long, label string, path string, vec array<double>")
    for space in ("cosine", "l2"):
        meta = tiles.build_index(df, str(tmp_path / space), lists=8, space=space)
        assert meta == {"space": space, "dim": 8, "lists": 8, "count": 300}
        q = x[7] + 0.01
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ (q / np.linalg.norm(q)) if space == "cosine" else ((x - q) ** 2).sum(1)
        got = [r.tile_id for r in tiles.search_index(spark, str(tmp_path / space), q.tolist(), 5, probes=8).collect()]
        assert got == np.argsort(d, kind="stable")[:5].tolist()
        assert tiles.search_index(spark, str(tmp_path / space), q.tolist(), 1, probes=2).first().tile_id == 7


def test_report(spark, tmp_path):
    runs = spark.createDataFrame([("r", " ask", "found ", "because"), ("q", None, None, None)], "run_id string, prompt string, final_text string, reasoning string")
    marks = spark.createDataFrame(
        [("r", 1, "a", "", None, [1, 2, 3, 4], 0.5, None, None, None, 2.0, ""), ("r", 2, "b", "note", 3, None, None, 2, 100.4, 99.6, None, "images/b.jpg")],
        "run_id string, roi_id int, label string, note string, importance int, bbox array<int>, tissue_fraction double, view_level int, field_width_um double, field_height_um double, effective_magnification double, image string",
    )
    steps = spark.createDataFrame([("r", 2, "pan", "", None, None, None), ("r", 1, "zoom", "look", 12, 7, "x")], "run_id string, step_index int, tool string, nav_reason string, candidate_count int, index_tiles int, image string")
    out = {r.run_id: r for r in report.markdown_report(runs, marks, steps).collect()}
    assert out["r"].report == """# Report (r)

## Prompt

```text
 ask
```

## Final Report

found 

## Model Reasoning

```text
because
```

## Regions of Interest (ROIs)

### ROI 2: b

- **Importance**: 3
- **Note**: note
- **View level**: 2
- **Approx field size**: ~100 × 100 µm

![ROI 2](images/b.jpg)

### ROI 1: a

- **Importance**: 1
- **BBox (level 0)**: x=1, y=2, w=3, h=4
- **Tissue fraction**: 0.50
- **Effective magnification (approx)**: ~2.0x

## Navigation Steps

### Step 1: `zoom`

- **Reason**: look
- **Top-K candidates in this view**: 12
- **Candidate index meta**: extractor=None, tiles=7, feature_dim=None

![Step 1](x)

### Step 2: `pan`

- **Reason**: (no reason provided)
"""
    assert out["r"].summary == "Prompt\nask\n\nFinal Report\nfound\n"
    assert "_No ROIs were kept in this run._\n" in out["q"].report and out["q"].report.endswith("_No navigation steps recorded._\n") and "Reasoning" not in out["q"].report
    report.write_reports(report.markdown_report(runs, marks, steps), str(tmp_path / "reports"))
    assert spark.read.text(str(tmp_path / "reports")).count() > 10


def test_image_copies_and_deletions(spark, tmp_path):
    for name in ("a/v.jpg", "b/v.jpg", "c/w.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = spark.createDataFrame([("r", i, str(tmp_path / n)) for i, n in enumerate(["b/v.jpg", "a/v.jpg", "b/v.jpg", "gone.jpg"])], "run_id string, seq int, path string")
    (tmp_path / "images").mkdir()
    assert files.copy_images(spark, files.copy_names(rows, ["run_id"]), str(tmp_path / "images")) == 2
    assert {f.name: f.read_text() for f in (tmp_path / "images").glob("*.jpg")} == {"v.jpg": "b/v.jpg", "v_1.jpg": "a/v.jpg"}
    for name in ("out/r1/dark/x", "out/r1/uploads/y", "out/r1/traces/z", "out/r2/dark/x", "dark/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert files.delete_generated(spark, str(tmp_path / "out"), "r1") == ["dark", "traces"]
    assert (tmp_path / "out/r1/uploads/y").exists() and (tmp_path / "out/r2/dark/x").exists()
    for bad in ("..", "", "/", "../out/r2", "r2/../.."):
        assert files.delete_generated(spark, str(tmp_path / "out"), bad) == []
    assert files.delete_generated(spark, str(tmp_path / "out"), "r1", ("uploads",)) == ["uploads"] and (tmp_path / "dark/x").exists()


def test_zip_tile_cache(spark, tmp_path):
    for name, ext in (("a", None), ("b", "png")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("tiler_params.json", json.dumps({"tile_size_um": 256.0, "tile_size_px": 224, **({"tile_ext": ext} if ext else {})}))
            for member in ("tile_(0.5, -256).jpg", "tile_(512, 0).png", "tile_(1e3, 0).jpg", "x/tile_(1, 1).jpg", "other.jpg"):
                z.writestr(member, member)
    got = sorted((r.archive[-5:], r.x_um, r.y_um, r.tile_um, bytes(r.image)) for r in tiles.zip_tiles(spark, str(tmp_path)).collect())
    assert got == [("a.zip", 0.5, -256.0, 256.0, b"tile_(0.5, -256).jpg"), ("b.zip", 512.0, 0.0, 256.0, b"tile_(512, 0).png")]


def test_mirax_listing(spark, tmp_path):
    for name in ("a.mrxs", "d/b.MRSX", "c.svs", "mrxs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.path.split("/")[-1] for r in files.mirax_listing(spark, str(tmp_path)).collect()) == ["a.mrxs", "b.MRSX"]


def stripes(path, x, y, level, w, h):
    """Grays that change with every pixel on the left, and white on the right."""
    step = 1 << level
    return bytes((((x + i * step) * 37 + (y + j * step) * 11) % 200) if x + i * step < 600 else 255 for j in range(h) for i in range(w))


def test_slide_to_features(spark):
    """Bright squares are not read, flat tiles go, and every tile has its place and its features."""
    from tessarine.sources import features

    slides = spark.createDataFrame([("s", "p", 1300, 500, 1.0)], "slide_id string, path string, base_w int, base_h int, mpp double")
    how = {"tile_um": 256.0, "tile_px": 32, "most_px": 512, "decoder": f"{__name__}:stripes"}
    all_tiles = {r.tile_index: (r.x_um, r.y_um, len(r.image)) for r in features.tiles_of(slides, brightness_cutoff=None, texture_cutoff=None, **how).collect()}
    assert len(all_tiles) == 12 and all_tiles[0] == (0.0, 0.0, 1024) and all_tiles[3] == (256.0, 256.0, 1024) and all_tiles[4] == (512.0, 0.0, 1024)
    found = features.extract(slides, tiles.byte_histogram(16), **how).orderBy("tile_index").collect()
    assert [r.tile_index for r in found] == [0, 1, 2, 3, 4, 6] or [r.tile_index for r in found] == [0, 1, 2, 3]
    assert all(abs(sum(r.features) - 1) < 1e-5 and r.extractor_id == "byte-histogram-16" for r in found)
    refs = tiles.reference_vectors(spark.createDataFrame([("good", "a", bytearray(b"ab")), ("bad", "b", bytearray(b"\xff"))], "label string, path string, image binary"), tiles.byte_histogram(16))
    assert {(r.label, r.path): round(float(np.linalg.norm(r.vec)), 6) for r in refs.collect()} == {("good", "a"): 1.0, ("bad", "b"): 1.0}


def test_drained_aggregates_are_the_newest(spark, tmp_path):
    """Three files, a batch each: of each window the last counts."""
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps({"ts": "2024-01-01T00:10:00", "k": "a", "v": 1.0}))
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).json(str(src))
    out = feeds.drained(feeds.windowed(stream, "ts", "k", "v"), "w", by=["window_start", "k"]).collect()
    assert [(r.n, r.total) for r in out] == [(3, 3.0)]


def test_steps_stream_in_batches(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    seen = []

    def push(n, rows):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "step_index", "payload"), r, strict=True))) for r in rows))
        stream = feeds.fresh_steps(feeds.append_only(spark, str(src), "run_id string, step_index long, payload string"))
        out = []
        stream.writeStream.outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend((r.run_id, r.step_index, r.reset) for r in b.collect())).start().awaitTermination()
        seen.append(sorted(out))

    push(0, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    push(1, [("a", 2, "y"), ("a", 3, "w")])
    push(2, [("a", 1, "again"), ("a", 2, "again")])
    assert seen == [[("a", 1, False), ("a", 2, False), ("b", 1, False)], [("a", 3, False)], [("a", 1, True), ("a", 2, True)]]


def test_states_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", 1, "create"), ("a", 2, "start"), ("a", 3, "finalize"), ("b", 1, "finish")]
    (src / "0.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "seq", "event"), r, strict=True))) for r in rows))
    out = {}
    stream = feeds.run_states(feeds.append_only(spark, str(src), "run_id string, seq long, event string"))
    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, _: out.update({r.run_id: (r.status, r.refused) for r in b.collect()})).start().awaitTermination()
    assert out == {"a": ("pending", 1), "b": (None, 1)}


def test_stale_answers_and_progress(spark):
    r = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, token int, v string")
    assert feeds.newest_only(r, ["key"], "token").first().v == "new"
    c = spark.createDataFrame([("r", 1, 40, 100), ("r", 2, 80, 100), ("z", 1, 5, 0)], "run_id string, seq int, size int, total int")
    assert {(x.run_id, x.seq): x.percent for x in feeds.progress(c, ["run_id"], "seq", "size", "total").collect()} == {("r", 1): 40.0, ("r", 2): 100.0, ("z", 1): 0.0}


def test_exploration_tools(spark):
    slides = spark.createDataFrame([("r", 4000, 3000, 0.25, 40.0, [1.0, 4.0])], "run_id string, base_w int, base_h int, mpp double, objective double, downsamples array<double>")
    ask = spark.createDataFrame([("r", 0, 0, 0, 0, 0)], "run_id string, seq long, n0 long, n1 long, n2 long, n3 long")
    first = tools.overview(ask, slides)
    zoom = spark.createDataFrame([("r", 1, 250, 250, 500, 500), ("other", 1, 0, 0, 9, 9)], ask.schema)
    second = tools.zoom_current(zoom, first, slides)
    v = second.first()
    assert second.count() == 1 and (v.x, v.y) == (round(250 / 999 * 4000), round(250 / 999 * 3000)) and v.view_seq == 1
    assert tools.zoom_full(zoom, slides).count() == 1
    views = first.union(second)
    tiles_ = spark.createDataFrame([(1, i, 1100.0 + 300 * (i % 4), 800.0 + 300 * (i // 4), float(-i)) for i in range(16)], "slide_id int, id long, cx double, cy double, score double")
    found = tools.candidates(views.withColumn("slide_id", F.lit(1)), tiles_, 256)
    assert {r.view_seq for r in found.collect()} == {0, 1}
    flat = found.select("run_id", "view_seq", F.col("rank").cast("long").alias("rank"), "id", "score", F.get("center_norm", F.lit(0)).alias("nx"), F.get("center_norm", F.lit(1)).alias("ny"))
    target = flat.where("view_seq = 1").orderBy("rank").first()
    mark = spark.createDataFrame([("r", 2, target.nx, target.ny, target.nx, target.ny), ("r", 3, 248, 264, 248, 264), ("none", 4, 1, 1, 1, 1)], ask.schema)
    none_slide = slides.union(slides.withColumn("run_id", F.lit("none")))
    out = {r.seq: r for r in tools.mark_roi(mark, views, none_slide, flat).collect()}
    assert out[2].ok and out[2].candidate_rank == target["rank"] and out[2].bbox.w == 1500
    assert not out[3].ok and out[3].reason == "roi_outside_topk_candidates" and out[4].reason == "no_current_view"
    info = tools.view_info(mark.limit(1), views, slides, flat).first()
    assert info.view_seq == 1 and info.level == 0 and len(info.candidates) == flat.where("view_seq = 1").count()
    both = tools.with_fallback(views, found.drop("source").where("view_seq = 1"), found.drop("source"))
    assert {(r.view_seq, r.source) for r in both.collect()} == {(1, "uni2_knn"), (0, "fallback_heuristic")}
    assert tools.overlay(found, 1000, 500).where("colour < 0 or colour > 5").count() == 0
    left = tools.discard_last(spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, seq int"), spark.createDataFrame([("r", 3)], "run_id string, seq int"))
    assert [r.seq for r in left.collect()] == [1]
    agents = spark.createDataFrame([("wsi", "pan"), ("tile", "mark_roi"), ("aml", "discard_last_roi"), (None, "pan")], "agent string, tool string")
    assert [r.ok for r in tools.access(agents).collect()] == [True, False, False, False]
    low = tools.with_tissue(views, spark.createDataFrame([("r", 1, 0.1)], "run_id string, view_seq long, tissue_fraction double"))
    assert {r.view_seq: r.warning for r in low.collect()} == {0: None, 1: "low_tissue"}


def test_probe_existing_and_sinks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.png", png([[1, 2]])), ("b.svs", b"II*\x00rest"), ("c.svs", b"nonsense"), ("f.jpg", b"\xff\xd8\xff\xe0")):  # the last has a JPEG's first bytes only
        (tmp_path / "d" / name).write_bytes(data)
    got = {r.path.split("/")[-1]: (r.kind, r.opened, r.error) for r in files.probe(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.png": ("png", True, None), "b.svs": ("tiff", None, None), "c.svs": (None, None, "unsupported_or_missing_image"), "f.jpg": ("jpeg", False, "unreadable_image")}
    listed = files.listing(spark, str(tmp_path / "d"))
    asked = listed.limit(2).select("path").union(spark.createDataFrame([("gone",)], "path string"))
    assert files.existing(asked, listed).count() == 2
    files.write_saved_tiles(spark.createDataFrame([("r", "good", 1), ("r", "bad", 1)], "run_id string, quality string, tile_idx int"), str(tmp_path / "tiles"))
    assert (tmp_path / "tiles" / "run_id=r" / "quality=good").is_dir()
    assert files.first_examples(listed, 5).count() == 2


def test_image_adapter():
    assert tiles.as_image(np.zeros((1, 3, 4, 5))).shape == (3, 4, 5)
    with pytest.raises(ValueError, match="three dimensions"):
        tiles.as_image(np.zeros((2, 3, 4, 5)))


def test_progress_and_cancel(spark, tmp_path):
    import time

    from tessarine.streaming import jobs

    seen = []
    listener = jobs.Progress(seen.append)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"a": 1}')
    feeds.append_only(spark, str(tmp_path / "in"), "a int").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(40):
        if any(e["status"] == "done" for e in seen):
            break
        time.sleep(0.25)
    spark.streams.removeListener(listener)
    assert {"starting", "done"} <= {e["status"] for e in seen}
    failed = []

    def slow():
        try:
            spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id * id % 7)").collect()
        except Exception as e:
            failed.append(e)

    thread = jobs.tagged(spark, "run-1", slow)
    time.sleep(2)
    jobs.cancel(spark, "run-1")
    thread.join(30)
    assert failed and not thread.is_alive()


def test_vector_index_recall(spark, tmp_path):
    """By default an index reads fewer lists than it has and finds 90 % of the nearest, of vectors without clusters too."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    for name, x in (("loose", rng.normal(size=(3000, 16))), ("clustered", centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)))):
        df = spark.createDataFrame([(i, "good", f"p{i}", v.tolist()) for i, v in enumerate(x)], "tile_id long, label string, path string, vec array<double>")
        tiles.build_index(df, f"{tmp_path}/{name}", lists=64, space="l2")
        probes = spark.read.schema(tiles.INDEX_META).json(f"{tmp_path}/{name}/meta").first().probes
        assert probes[0] <= probes[1] and probes[0] < 64
        queries = x[rng.integers(0, 3000, 12)] + rng.normal(size=(12, 16)) * 0.5
        found = 0
        for q in queries:
            got = [r.tile_id for r in tiles.search_index(spark, f"{tmp_path}/{name}", q.tolist(), 10).collect()]
            found += len(set(got) & set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()))
        assert found >= 0.9 * 120, name


def test_index_of_labelled_folders(spark, tmp_path, capsys):
    from tessarine import build_index

    for i, name in enumerate(("Good_Tiles/a.png", "Good_Tiles/b.jpg", "Bad/c.png", "other/d.png", "Bad/e.txt")):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(bytes([40 * i]) * 50)
    build_index.main(["--root", str(tmp_path / "root"), "--out", str(tmp_path / "out"), "--space", "ip", "--lists", "2"])
    meta = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert meta == {"space": "ip", "dim": 64, "lists": 2, "count": 3, "extractor_id": "byte-histogram-64", "labels": {"bad": 1, "good": 2}}
    near = tiles.search_index(spark, str(tmp_path / "out" / "index"), tiles.byte_histogram(64).load()([bytes([80]) * 50])[0].tolist(), 1, probes=2).first()
    assert near.label == "bad" and near.path.endswith("Bad/c.png")
    with pytest.raises(ValueError, match="space must be"):
        build_index.build(spark, "r", "o", tiles.byte_histogram(64), "dot")
