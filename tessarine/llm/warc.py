"""WARC transactions: write request, response or revisit, and metadata records; read archives; join them per capture.

Writing. A capture gives three records of WARC/1.1. Of captures with equal payloads of at least `revisit_from` bytes, the
one with the largest key holds the payload as response; the others are revisits that refer to it. Keys of repeated
payloads come from one partial aggregate and join back on the digest. Spark's text writer puts the records into gzip
files of bounded size; its line separator is the blank line that ends a WARC record. So archives go wherever Spark can
write, under its commit protocol.

Reading. Gzip archives come through Spark's text reader, which inflates a file as a stream and hands it on cut at blank lines, in small Arrow batches; a
parser puts the pieces together again, follows each record's Content-Length and emits rows in small batches. So no task holds more of an archive than a batch
and its largest record, whatever the archive's size, and archives may lie wherever Spark can read. Archives that are not compressed (names without .gz) can't be read so, as Spark would split them anywhere;
they are read as one value each and must fit into a task's memory. Payload digests are computed from the bytes read; a revisit has the digest and the length
of its headers, as its payload is in the record it refers to. What is to become of an archive that can't be read to its end, the caller says: `broken="fail"` raises whatever it is (bytes that can't be read or inflated, a cut
record, no record at all where one should begin), `broken="end"` salvages the records before that. As Spark doesn't tell a failing disk from a damaged file, a salvage is as short as the worse of both made it; it is meant for
archives known to be damaged, and whoever needs the whole takes "fail", as the query does, which counts the records besides.

Assembly. A response or revisit is a capture. Requests and metadata reach it through WARC-Concurrent-To, by naming it, by
being named by it, or over one other record that does. One nested row per capture comes out; parts that are missing are null.

Defined results: a null payload is empty; a null url is an empty target; of rows repeated with the largest key each is a
response; a null key is smaller than any other; a very long payload is a record like any other; other records (warcinfo, resource) are not captures; a broken
archive ends at its last whole record or is an error; empty tables give empty tables; columns other than key, url and html are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import arrow_limits, cut, scratch, table

RECORD = "type string, record_id string, target string, date string, concurrent_to array<string>, refers_to string, headers map<string,string>, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cutting = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cutting), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n")]
    return F.concat(*lines)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_from: int = 1000, file_records: int = 3000) -> None:
    """Write the captures of pages as .warc.gz files below path."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", "").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    heads = rows.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.max("key").alias("head"), F.count("*").alias("n"))
    heads = cut(heads.where("n > 1").select("digest", "head"), "heads")
    rows = rows.join(heads, "digest", "left")
    named = lambda k: _urn(F.lit("response"), F.coalesce(k.cast("string"), F.lit("")), F.col("digest"))
    is_head = F.col("head").isNull() | F.col("key").eqNullSafe(F.col("head"))
    rows = rows.withColumn("own", F.when(is_head, named(F.col("key"))).otherwise(_urn(F.uuid())))
    target = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", F.col("own")), *target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], F.concat(http, "body"))
    revisit = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", F.col("own")), *target, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", named(F.col("head"))),
         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")], http,
    )
    host = F.regexp_extract("url", "://([^/?#]*)([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.regexp_extract("url", "://([^/?#]*)([^#]*)", 2), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn(F.lit("request"), "own")), *target, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/http;msgtype=request")], asked)
    notes = F.concat(F.coalesce(F.concat(F.lit("capture-key: "), F.col("key").cast("string"), F.lit("\r\n")), F.lit("")), F.coalesce(F.concat(F.lit("refers-to-key: "), F.when(is_head, None).otherwise(F.col("head").cast("string")), F.lit("\r\n")), F.lit("")))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn(F.lit("metadata"), "own")), *target, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/warc-fields")], notes)
    records = rows.select(F.explode(F.array(request, F.when(is_head, response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


class BrokenArchive(ValueError):
    """An archive that can't be read to its end."""


def _inflated(content: bytes) -> Iterator[bytes]:
    """An archive's bytes, inflated piece by piece if it is compressed; members may follow one another."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    inflate, at, begun = zlib.decompressobj(31), 0, False
    while at < len(content):
        part = content[at : at + (1 << 18)]
        at += len(part)
        try:
            yield inflate.decompress(part)
        except zlib.error as e:
            raise BrokenArchive(f"can't be inflated: {e}") from e
        begun = not inflate.eof
        if inflate.eof:
            at -= len(inflate.unused_data)
            inflate = zlib.decompressobj(31)
    if begun:
        raise BrokenArchive("ends within a compressed member")


class _Stream:
    """Bytes that come in pieces, of which no more are asked for than needed."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.ready = parts, bytearray()

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.ready += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes | None:
        while len(self.ready) < n:
            if not self.more():
                return None
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return [(a.strip().lower(), b.strip()) for a, _, b in pairs]


def records_of(content: bytes | Iterator[bytes], payload: bool = True, broken: str = "end") -> Iterator[dict]:
    """The records of an archive, given whole or as its inflated bytes in pieces; where it breaks, it ends or fails."""
    try:
        yield from _parsed(_Stream(_inflated(content) if isinstance(content, bytes) else content), payload)
    except BrokenArchive:
        if broken != "end":
            raise


def _parsed(stream: _Stream, payload: bool) -> Iterator[dict]:
    last = "the start"
    while True:
        while stream.ready[:2] == b"\r\n" or (len(stream.ready) < 2 and stream.more()):
            if stream.ready[:2] == b"\r\n":
                stream.take(2)
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.ready:
                raise BrokenArchive(f"cut within the headers after {last}")
            return
        lines = head[:-4].split(b"\r\n")
        headers = _headers(lines[1:])
        own = dict(headers)
        length = own.get("content-length", "")
        if not lines[0].startswith(b"WARC/") or not (length.isascii() and length.isdigit()):
            raise BrokenArchive(f"no record with a length after {last}")
        block = stream.take(int(length))
        if block is None:
            raise BrokenArchive(f"cut within the record after {last}")
        last = own.get("warc-record-id", "a record")
        kind, fields, body = own.get("warc-type"), [], block
        if own.get("content-type", "").startswith("application/http"):
            http, _, body = block.partition(b"\r\n\r\n")
            fields = _headers(http.split(b"\r\n")[1:])
        elif own.get("content-type") == "application/warc-fields":
            fields = _headers(block.split(b"\r\n"))
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if kind == "revisit":
            size = int(dict(fields).get("content-length") or 0)
            digest = own.get("warc-payload-digest", "").removeprefix("sha1:")
        yield {
            "type": kind, "record_id": own.get("warc-record-id"), "target": own.get("warc-target-uri"), "date": own.get("warc-date"),
            "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"], "refers_to": own.get("warc-refers-to"),
            "headers": list(own.items()), "payload_bytes": size, "payload_digest": digest, "fields": list(dict(fields).items()), "payload": body if payload else None,
        }


_ARROW = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def _rows(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += 300 + len(r["payload"] or b"")
        if size > 4 << 20 or len(rows) == 2000:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Rows (file, piece) in the files' order, as one iterator of bytes a file with the blank lines put back between its pieces."""
    pieces = ((f, v) for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for file, own in groupby(pieces, lambda x: x[0]):
        first = (next(own)[1].as_py(),)
        yield file, chain(first, (b for _, v in own for b in (b"\r\n\r\n", v.as_py())))


def _of(archive: str, records: Iterator[dict]) -> Iterator[dict]:
    """The records, with the archive named where it breaks."""
    try:
        yield from records
    except BrokenArchive as e:
        raise BrokenArchive(f"{archive}: {e}") from e


def read(spark: SparkSession, path: str, payload: bool = True, broken: str = "end") -> DataFrame:
    """All records of the archives below path. Archives that can't be read to their end give the records up to there (broken="end") or make the query fail ("fail")."""
    if broken not in ("end", "fail"):
        raise ValueError(f"broken must be end or fail, not {broken}")
    arrow_limits(spark, 2000, 4)
    source = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", False)
    pieces = source.option("pathGlobFilter", "*.gz").option("lineSep", "\r\n\r\n").option("ignoreCorruptFiles", broken == "end").text(path)
    pieces = pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, parts in _files(batches):
            yield from _rows(_of(f"archive with xxhash64 of _metadata.file_path {file}", records_of(parts, payload, broken)))
            for _ in parts:  # what a broken record leaves
                pass

    packed = pieces.mapInArrow(run, RECORD)
    whole = source.option("pathGlobFilter", "{*[!z],*[!g]z,*[!.]gz,z,gz}").format("binaryFile").load(path).select("path", "content")
    if whole.isEmpty():
        return packed

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                yield from _rows(_of(f"archive {file}", records_of(content.as_py(), payload, broken)))

    return packed.union(whole.mapInArrow(run_whole, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, type, target, date, refers_to, response (struct), request (struct), metadata (struct)."""
    is_capture = F.col("type").isin("response", "revisit")
    captures = records.where(is_capture)
    slim = F.struct("record_id", "headers", "fields", "payload_bytes", "payload")
    both = records.where(is_capture | F.col("type").isin("request", "metadata"))
    both = cut(both.select("type", "record_id", "concurrent_to", F.when(~is_capture, slim).alias("part")), "links")
    asks, ids = both.where("part is not null"), both.where("part is null").select("record_id", "concurrent_to")
    named = asks.select("type", "record_id", F.explode("concurrent_to").alias("other"))
    # a part names a capture, a capture names a part, or a part names another part that does
    straight = named.join(ids.select(F.col("record_id").alias("other")).distinct(), "other").select("type", "record_id", F.col("other").alias("capture"))
    back = ids.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id")).join(asks.select("type", "record_id"), "record_id").select("type", "record_id", "capture")
    direct = cut(straight.union(back).distinct(), "direct")
    over = (
        named.join(direct.select("record_id").distinct(), "record_id", "left_anti")
        .join(direct.select(F.col("record_id").alias("other"), "capture"), "other").select("type", "record_id", "capture")
    )
    met = direct.union(over).join(asks.select("record_id", "part"), "record_id")
    of = lambda t: F.min_by(F.when(F.col("type") == t, F.col("part")), F.when(F.col("type") == t, F.col("record_id"))).alias(t)
    grouped = cut(met.groupBy("capture").agg(of("request"), of("metadata")), "grouped")
    reply = F.struct("record_id", "headers", "fields", "payload_bytes", "payload_digest", "payload").alias("response")
    return captures.select(F.col("record_id").alias("capture"), "type", "target", "date", "refers_to", reply).join(grouped, "capture", "left").withColumnRenamed("capture", "capture_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch(spark, "archives"), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write(pages, path)
    records = cut(read(spark, path, payload=False, broken="fail"), "records")
    arrow_limits(spark)
    due, there = 3 * pages.count(), records.count()
    if due != there:
        raise BrokenArchive(f"{there} records came back of {due} written")
    found = assemble(records)
    note = lambda k: F.element_at("metadata.fields", F.lit(k)).cast("long")
    return found.select(
        note("capture-key").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), note("refers-to-key").alias("refers_to"), F.col("target").alias("url"),
    )


#: Digest, length and kind of each page's record.
ORACLE = """
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), h AS (
  SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to, coalesce(url, '') AS url
FROM p LEFT JOIN h USING (payload_digest)
"""
