import gzip
import hashlib

import pytest

from tessarine.llm import warc
from tests.llm.fixtures import with_clashes

BIG = "<p>" + "x" * 2000 + "é" + "</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"


def pages(spark):
    rows = [
        (1, "http://a.com/1", BIG), (2, "http://a.com/2", BIG), (3, None, BIG), (4, "http://b.com/", None), (5, "http://b.com/", ""), (6, "http://c.com/\r\nX: y", "small"), (7, "d", "small"),
        (8, "http://e.com/?q", "y" * 999), (9, "http://e.com/", "y" * 999), (10, "http://e.com/", "y" * 1000), (11, "http://e.com/", "y" * 1000), (None, "http://n.com/", "z" * 5000), (12, "http://long.com", "w" * 300_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, df, tmp_path, **how):
    path = f"file://{tmp_path}/w"
    warc.write(df, path, **how)
    return warc.assemble(warc.read(spark, path))


def test_exact_round_trip(spark, tmp_path):
    rows = pages(spark).collect()
    out = round_trip(spark, with_clashes(pages(spark)), tmp_path).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        key = r.metadata.fields.get("capture-key")
        got[int(key) if key else None] = r
    for page in rows:
        body = (page.html or "").encode()
        r = got[page.page_id]
        assert r.response.payload_bytes == len(body) and r.response.payload_digest == hashlib.sha1(body).hexdigest()
        assert r.response.payload == (body if r.type == "response" else b"")
        assert r.request.record_id and r.metadata.record_id
    assert {k for k, r in got.items() if r.type == "revisit"} == {1, 2, 10}
    assert got[1].refers_to == got[3].capture_id and got[10].refers_to == got[11].capture_id


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write(pages(spark), f"file://{tmp_path}/w", file_records=4)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 5
    data = gzip.decompress(files[0].read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and data.endswith(b"\r\n\r\n")
    assert sum(len(list(warc.records_of(f.read_bytes()))) for f in files) == 39


def test_repeated_rows_and_empty_table(spark, tmp_path):
    twice = spark.createDataFrame([(1, "u", "v" * 1500)] * 2 + [(0, "u", "v" * 1500)], "page_id long, url string, html string")
    out = round_trip(spark, twice, tmp_path).collect()
    assert sorted(r.type for r in out) == ["response", "response", "revisit"] and all(r.request and r.metadata for r in out)
    assert round_trip(spark, twice.limit(0), tmp_path / "none").count() == 0


def test_links_over_other_records_and_missing_parts(spark):
    def rec(kind, ident, *to):
        return {"type": kind, "record_id": ident, "target": None, "date": None, "concurrent_to": list(to), "refers_to": None, "headers": [], "payload_bytes": 0, "payload_digest": "", "fields": [], "payload": b""}

    rows = [
        rec("response", "r1", "q1"), rec("request", "q1"), rec("metadata", "m1", "q1"),  # the response names the request, the metadata names the request
        rec("response", "r2"), rec("request", "q2", "r2"), rec("response", "r3"), rec("metadata", "m9", "gone"), rec("warcinfo", "w"), rec(None, None),
    ]
    rows = [{**r, "headers": {}, "fields": {}} for r in rows]
    out = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(out) == {"r1", "r2", "r3"}
    assert out["r1"].request.record_id == "q1" and out["r1"].metadata.record_id == "m1"
    assert out["r2"].request.record_id == "q2" and out["r2"].metadata is None and out["r3"].request is None


def test_truncated_archive_ends_at_its_last_whole_record(spark, tmp_path):
    warc.write(pages(spark).coalesce(1), f"file://{tmp_path}/w")
    data = gzip.decompress(max((tmp_path / "w").glob("*.gz"), key=lambda f: f.stat().st_size).read_bytes())
    whole = len(list(warc.records_of(data)))
    assert whole == len(list(warc.records_of(gzip.compress(data[:9000]) + gzip.compress(data[9000:]))))
    assert 0 < len(list(warc.records_of(data[:-50]))) < whole
    assert 0 < len(list(warc.records_of(gzip.compress(data)[:-200]))) <= whole


def test_archives_are_read_in_pieces(spark, tmp_path):
    """Several members, bytes that are no text, blank lines within payloads, broken and uncompressed archives beside each other."""
    def record(i, body):
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)

    bodies = [b"\xff\xfe\x00 no text", b"a\r\n\r\n\r\n\r\nb\r\n", b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", bytes(range(256)) * 9000, b"end\r\n"]
    whole = [record(i, b) for i, b in enumerate(bodies)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    (tmp_path / "deep" / "b.warc.gz").write_bytes(gzip.compress(b"".join(whole)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(whole))[:-300])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b"".join(whole[:3]) + whole[1][:-6]))
    (tmp_path / "e.warc").write_bytes(b"".join(whole))
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(b""))
    got = sorted((r.record_id, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}").collect())
    all_of = [(f"r{i}", b) for i, b in enumerate(bodies)]
    broken = [x for x in got]
    for x in all_of * 3 + all_of[:3]:
        broken.remove(x)
    assert broken == all_of[: len(broken)]


def test_one_large_archive_in_bounded_memory(spark, tmp_path):
    """An archive of 300 MB in one file goes through a worker in batches of a few MB."""
    block = b"x" * 1_000_000
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    with gzip.open(tmp_path / "big.warc.gz", "wb", compresslevel=1) as f:
        for _ in range(300):
            f.write(record)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    rows = warc.read(spark, f"file://{tmp_path}").mapInArrow(sizes, "bytes bigint, rows bigint").collect()
    assert sum(r.rows for r in rows) == 300 and max(r.bytes for r in rows) < 16 << 20


def _damaged(data, how):
    """A .gz archive's bytes with one thing wrong."""
    text = gzip.decompress(data)
    if how == "cut":
        return data[:-100]
    if how == "flipped":
        return data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 255]) + data[len(data) // 2 + 1 :]
    if how == "not gzip":
        return text
    if how == "record cut":
        return gzip.compress(text[:-50])
    if how == "headers cut":
        return gzip.compress(text[: text.rindex(b"WARC/1.1") + 30])
    if how == "no length":
        return gzip.compress(text.replace(b"Content-Length: ", b"Content-Length: -", 1))
    return None  # lost


@pytest.mark.parametrize("how", ["cut", "flipped", "not gzip", "record cut", "headers cut", "no length", "lost", "checksum"])
def test_a_damaged_archive_is_no_result(spark, tmp_path, monkeypatch, how):
    """Whatever befalls an archive between writing and reading, the query fails; it never returns fewer pages."""
    pages(spark).where("page_id is not null").write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write

    def hurt(df, path, **more):
        from pathlib import Path

        write(df, path, **more)
        one = max(Path(path.removeprefix("file://")).glob("*.gz"), key=lambda f: f.stat().st_size)
        data = one.read_bytes()
        if how == "checksum":  # Hadoop's own sums beside the file tell
            one.write_bytes(data[:-1] + bytes([data[-1] ^ 255]))
            return
        (one.parent / f".{one.name}.crc").unlink()
        one.unlink()
        if how != "lost":
            one.write_bytes(_damaged(data, how))

    monkeypatch.setattr(warc, "write", hurt)
    monkeypatch.setattr(warc, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    with pytest.raises(Exception, match="BrokenArchive|FAILED_READ_FILE|came back"):
        warc.op2_warc(spark, str(tmp_path)).count()


def test_read_fails_or_salvages_as_asked(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    whole = {"a.warc.gz": gzip.compress(record * 3), "b.warc": record * 3, "c.warcz": gzip.compress(record) * 3, "d.warc.gz": gzip.compress(b"")}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    read = lambda **how: warc.read(spark, f"file://{tmp_path}", **how).count()
    assert read(broken="fail") == read() == 9
    for name, data in [("x.warc.gz", gzip.compress(record * 2 + record[:-10])), ("y.warc", record + b"garbage"), ("z.warc", gzip.compress(record) + gzip.compress(record)[:-9])]:
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="BrokenArchive"):
            read(broken="fail")
        assert read() > 9
        (tmp_path / name).unlink()
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", True)
    try:
        (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record * 2)[:-9])
        with pytest.raises(Exception, match="FAILED_READ_FILE"):
            read(broken="fail")
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    with pytest.raises(ValueError):
        read(broken="maybe")
