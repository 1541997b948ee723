import pytest

from tessarine.api import Refused, Runs
from tessarine.sources import tiles


def test_a_run_from_its_creation_to_its_end(spark, tmp_path):
    runs = Runs(spark, str(tmp_path))
    with pytest.raises(Refused, match="invalid_agent"):
        runs.create("other")
    a, b, c = (runs.create(k) for k in ("wsi", "tile", "aml"))
    with pytest.raises(Refused, match="unknown_run"):
        runs.get("gone")
    for path in ("/etc/x", "a/../../x"):
        with pytest.raises(Refused, match="unsafe_path"):
            runs.upload(a, path, 1)
    runs.upload(a, "s.svs", 10)
    runs.upload(b, "notes.txt", 5)
    assert (runs.get(a).status, runs.get(a).upload_count, runs.get(a).upload_bytes) == ("uploading", 1, 10)
    assert runs.finalize(a).primary == "s.svs"
    with pytest.raises(Refused, match="no_supported_primary"):
        runs.finalize(b)
    with pytest.raises(Refused, match="closed_error"):
        runs.upload(b, "s.svs", 1)
    with pytest.raises(Refused, match="closed_pending"):
        runs.finalize(a)
    with pytest.raises(Refused, match="not_done"):
        runs.clear(a)
    runs.start(a)
    runs.finish(a, "found")
    assert runs.terminate(a) == "done" and runs.terminate(c) == "terminated" == runs.terminate(c) and runs.terminate(b) == "error"
    (tmp_path / "outputs" / a / "dark").mkdir(parents=True)
    assert runs.clear(a) == ["dark"]
    assert {r.run_id: r.status for r in runs.status().collect()} == {a: "done", b: "error", c: "terminated"} and runs.health()


def test_features_are_kept(spark, tmp_path):
    runs = Runs(spark, str(tmp_path))
    slides = spark.createDataFrame([("s", "p", 512, 512, 1.0)], "slide_id string, path string, base_w int, base_h int, mpp double")
    how = {"tile_px": 16, "most_px": 512, "brightness_cutoff": None, "texture_cutoff": None}
    first = runs.embed(slides, tiles.byte_histogram(16), **how)
    assert first.count() == 4 and len(list((tmp_path / "embeddings").iterdir())) == 1
    assert runs.embed(slides, tiles.byte_histogram(16), **how).count() == 4 and len(list((tmp_path / "embeddings").iterdir())) == 1
    assert runs.embed(slides, tiles.byte_histogram(32), **how).count() == 4 and len(list((tmp_path / "embeddings").iterdir())) == 2
