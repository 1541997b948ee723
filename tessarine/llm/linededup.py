"""Line dedup by a log-template tree.

A line's words are masked first (words with a digit, and addresses, become <*>). The tree has a fixed
depth: the number of words, then the first `depth` words; a leaf holds the lines that agree on these. Within a leaf a
word stays part of the template where the same word stands at the same place in at least `min_docs` of the leaf's lines, and in at least the part
`common` of them, and becomes a variable field otherwise: a field whose values recur stays a field, however large the corpus grows. A line
follows its template if at least `share` of the words behind the leading ones are constant. A template that recurs in at least `min_docs` documents is
dropped from all documents but the one with the smallest doc_id; so is a line that recurs word for word in at least two documents, whether
or not it follows a template. So the corpus loses no content. The usual tree updates its leaves greedily
in the order of arrival; this rule counts instead, so its result depends on no order and its groups need no one task.

With `copies`, a document that is by and large a copy of another keeps the lines that it has from it, for a later stage to judge the whole document: stripped of them, what an edited copy has of its own
would stay as a torso that resembles nothing. It counts as a copy where at least half of its words stand in lines of one other document that keeps them, or a fifth in two such lines or more.

Everything is grouped by hashes with partial sums, or joined with tables of one row per key on plain exchanges, which
AQE splits where a leaf, line or template holds a large part of all rows. Lines travel as hashes; only those of leaves that `min_docs` documents have travel with
their text, and words are exploded for distinct lines only. Lines are known by 128-bit hashes, documents by doc_id and a hash of their text, templates
by their leaf and the sum of their places' hashes.

Defined results: null texts stay null and have no lines; lines of fewer than `min_words` words always stay; a document
whose every line is dropped stays with an empty text; a line that a document repeats goes or stays at all its places; rows repeated with the same doc_id and
text are one document; of documents that share the smallest doc_id all keep the line; where all doc_ids of a template or line are null, all its lines stay; a very long
text is read whole and rewritten in one pass over its lines; empty tables give empty tables; other columns pass
through unread, whatever their names (with counts, n_lines and n_dropped get underscores behind them where docs have such columns).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import arrow_limits, cut, free, spread, table

#: words with a digit and addresses are variable fields from the start
_FIELD = re.compile(r"[0-9@]|://")
_HINT = re.compile(r"[0-9@:]")
#: lines that leave the Python worker in one batch, so that a long document's lines are never all in one
_ROWS = 20_000


def words_of(line: str) -> list[str]:
    return line.lower().split()


def masked(line: str) -> list[str]:
    words = words_of(line)
    if _HINT.search(line):
        return ["<*>" if _FIELD.search(w) else w for w in words]
    return words


def leaf_of(words: list[str], depth: int) -> int:
    return xxhash.xxh64_intdigest(f"{len(words)} " + " ".join(words[:depth])) - (1 << 63)


def _signed(digest: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


#: columns of a line's row; with text, the masked line and its hash stand in the place of the hash of its words as they are
_COLUMNS = ("rk", "doc", "n", "leaf", "h1", "h2", "once", "words", "line")


def _lines(batches: Iterator[pa.RecordBatch], depth: int, min_words: int, text: bool) -> Iterator[pa.RecordBatch]:
    """A row per line: its document, number and leaf, a 128-bit hash, and 1 at the first line of the document with that leaf (or, with text, with that hash)."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        types = [pa.int64(), batch.schema.field(1).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *([pa.string()] if text else [])]

        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(types)  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _COLUMNS[: len(types)])  # noqa: B023

        out: list[tuple] = []
        for rk, doc, whole in zip(keys, ids, batch.column(2), strict=True):
            seen: set = set()
            for n, line in enumerate((whole.as_py() or "").split("\n")):
                words = masked(line)
                if len(words) < min_words:
                    continue
                leaf = leaf_of(words, depth)
                shown = " ".join(words if text else words_of(line))
                h1, h2 = _signed(xxhash.xxh128_digest(shown))
                mark = (h1, h2) if text else leaf
                out.append((rk, doc, n, leaf, h1, h2, int(mark not in seen), len(words), *([shown] if text else [])))
                seen.add(mark)
                if len(out) >= _ROWS:
                    yield done(out)
                    out = []
        yield done(out)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 3, min_words: int = 5, min_docs: int = 3, share: float = 0.6, common: float = 0.05, copies: bool = False) -> DataFrame:
    """(rk, doc, gone): for each document that loses lines, its row key xxhash64(key, text), its key, and the sorted numbers of its lines to drop."""
    arrow_limits(docs.sparkSession)
    rows = spread(docs.select(F.xxhash64(key, text).alias("rk"), F.col(key).alias("doc"), F.col(text).alias("text")))
    schema = f"rk bigint, doc {docs.schema[key].dataType.simpleString()}, n int, leaf bigint, h1 bigint, h2 bigint, once bigint, words int"
    plain = cut(rows.mapInArrow(lambda it: _lines(it, depth, min_words, False), schema), "plain")
    # lines that two documents have word for word
    same = plain.groupBy("h1", "h2").agg(F.min("doc").alias("keeper"), F.min("rk").alias("low"), F.max("rk").alias("high")).where("low != high").select("h1", "h2", "keeper")
    by_line = _others(plain.select("rk", "doc", "n", "words", "h1", "h2"), same, ["h1", "h2"])
    if copies:
        by_line = cut(by_line, "repeated")
    often = cut(plain.groupBy("leaf").agg(F.sum("once").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    lines = rows.mapInArrow(lambda it: _lines(it, depth, min_words, True), schema + ", line string")
    lines = cut(lines.join(often, "leaf"), "lines")
    # constant words of each leaf, from distinct lines
    distinct = lines.groupBy("h1", "h2").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line"), F.sum("once").alias("docs"))
    words = distinct.select("h1", "h2", "leaf", "docs", F.posexplode(F.split("line", " ")).alias("pos", "word"))
    words = cut(words.select("h1", "h2", "leaf", "docs", "pos", F.xxhash64("leaf", "pos", "word").alias("place")), "words")
    whole = words.where("pos = 0").groupBy("leaf").agg(F.sum("docs").alias("whole"))
    places = words.groupBy("place").agg(F.first("leaf").alias("leaf"), F.sum("docs").alias("all")).where(F.col("all") >= min_docs)
    constant = cut(places.join(whole, "leaf").where(F.col("all") >= common * F.col("whole")).select("place", F.lit(1).alias("kept")), "constant")
    # the words of a line and, of them, the constant ones
    kept = words.join(constant, "place", "left").groupBy("h1", "h2").agg(
        F.first("leaf").alias("leaf"), F.sum(F.when(F.col("kept") == 1, F.col("place")).cast("decimal(38,0)")).alias("total"), F.count_if((F.col("kept") == 1) & (F.col("pos") >= depth)).alias("tail"), F.count("*").alias("words")
    )
    follows = F.col("tail") >= share * F.greatest(F.col("words") - depth, F.lit(1))
    template = cut(kept.where(follows).select("h1", "h2", "leaf", F.col("total").alias("places")), "template")
    at = cut(lines.select("rk", "doc", "n", "h1", "h2").join(template, ["h1", "h2"]).select("rk", "doc", "n", "leaf", "places"), "at")
    per_doc = at.groupBy("leaf", "places", "rk", "doc").agg(F.lit(1).alias("one"))
    recurring = per_doc.groupBy("leaf", "places").agg(F.count("*").alias("docs"), F.min("doc").alias("keeper")).where(F.col("docs") >= min_docs).drop("docs")
    by_template = _others(at.where("places is not null"), recurring, ["leaf", "places"])
    gone = by_template.select("rk", "doc", "n").union(by_line.select("rk", "doc", "n"))
    if copies:
        kept = _from_originals(plain, by_line).select("rk", F.col("doc").alias("d"), "n")
        gone = gone.join(kept, (gone["rk"] == kept["rk"]) & (gone["n"] == kept["n"]) & gone["doc"].eqNullSafe(kept["d"]), "left_anti")
    return gone.groupBy("rk", "doc").agg(F.sort_array(F.collect_set("n")).alias("gone"))


def _from_originals(plain: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rk, doc, n) of the lines that copies have from the document that they are a copy of."""
    size = plain.groupBy("rk", "doc").agg(F.sum("words").alias("all"))
    shared = repeated.groupBy("rk", "doc", "keeper").agg(F.sum("words").alias("shared"), F.count("*").alias("lines"))
    size = size.withColumnRenamed("rk", "r").withColumnRenamed("doc", "d")
    met = shared.join(size, (shared["rk"] == size["r"]) & shared["doc"].eqNullSafe(size["d"]))
    much = (2 * F.col("shared") >= F.col("all")) | ((F.col("lines") >= 2) & (5 * F.col("shared") >= F.col("all")))
    found = cut(met.where(much).select(F.col("rk").alias("r"), F.col("doc").alias("d"), F.col("keeper").alias("k")), "copies")
    return repeated.join(found, (F.col("rk") == F.col("r")) & F.col("doc").eqNullSafe(F.col("d")) & (F.col("keeper") == F.col("k"))).select("rk", "doc", "n")


def _others(at: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The lines of the groups with their keeper, the group's smallest doc, but those of the keeper."""
    return at.join(cut(groups, "groups"), by).where(~F.col("doc").eqNullSafe(F.col("keeper"))).drop(*by)


def without(parts: Column, gone: Column) -> Column:
    """The parts but those of the sorted numbers `gone`: the runs between them, each copied once."""

    def runs(x: Column) -> Column:
        gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), x["gone"]).alias("a"), F.concat(x["gone"], F.array(F.size(x["parts"]))).alias("b"))
        return F.flatten(F.transform(gaps, lambda g: F.slice(x["parts"], g["a"] + 2, g["b"] - g["a"] - 1)))

    # a lambda's argument is computed once, whatever its body does with it
    return F.transform(F.array(F.struct(parts.alias("parts"), gone.alias("gone"))), runs)[0]


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False, **how) -> DataFrame:
    """docs without the dropped lines; with counts, also n_lines and n_dropped (before and of the dropping)."""
    rk, doc, dropped, n_lines, n_dropped = free(docs, "rk", "doc", "gone", "n_lines", "n_dropped")
    gone = dropped_lines(docs, key, text, **how)
    gone = gone.select(F.col("rk").alias(rk), F.col("doc").alias(doc), F.col("gone").alias(dropped))
    joined = docs.join(gone, (F.xxhash64(docs[key], docs[text]) == gone[rk]) & docs[key].eqNullSafe(gone[doc]), "left")
    parts = F.split(docs[text], "\n", -1)
    new = F.when(F.col(dropped).isNull(), docs[text]).otherwise(F.array_join(without(parts, F.col(dropped)), "\n"))
    out = [new.alias(text) if c == text else docs[c] for c in docs.columns]
    if counts:
        out += [F.when(docs[text].isNull(), 0).otherwise(F.size(parts)).alias(n_lines), F.coalesce(F.size(F.col(dropped)), F.lit(0)).alias(n_dropped)]
    return joined.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")


#: The same rule by counts. White space of lines is ASCII there.
ORACLE = r"""
WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
v AS (SELECT doc_id, i, regexp_extract_all(lower(parts[i]), '[^\x09-\x0D\x1C-\x20]+') AS v FROM p, unnest(range(1, len(parts) + 1)) t(i)),
l AS (SELECT doc_id, i, v, list_transform(v, lambda w: CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '<*>' ELSE w END) AS w FROM v WHERE len(v) >= 5),
c AS MATERIALIZED (SELECT doc_id, i, v, w, [CAST(len(w) AS VARCHAR), w[1], w[2], w[3]] AS leaf FROM l),
u AS MATERIALIZED (SELECT leaf, w, count(DISTINCT doc_id) AS docs FROM c GROUP BY leaf, w),
s AS MATERIALIZED (SELECT leaf, sum(docs) AS whole FROM u GROUP BY leaf HAVING sum(docs) >= 3),
x AS MATERIALIZED (SELECT leaf, w, docs, whole, k, w[k] AS word FROM u JOIN s USING (leaf), unnest(range(1, len(w) + 1)) t(k)),
fixed AS MATERIALIZED (SELECT leaf, k, word FROM x GROUP BY leaf, k, word HAVING sum(docs) >= greatest(3, 0.05 * any_value(whole))),
t AS MATERIALIZED (SELECT leaf, w, list({'k': k, 'word': word} ORDER BY k) AS template, count(*) FILTER (WHERE k > 3) AS tail FROM x JOIN fixed USING (leaf, k, word) GROUP BY leaf, w),
a AS MATERIALIZED (SELECT c.doc_id, c.i, c.leaf, t.template FROM c JOIN t USING (leaf, w) WHERE tail >= 0.6 * greatest(len(c.w) - 3, 1)),
r AS (SELECT leaf, template, min(doc_id) AS keeper FROM a GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 3),
e AS (SELECT v, min(doc_id) AS keeper FROM c GROUP BY v HAVING count(DISTINCT doc_id) >= 2),
o AS (SELECT doc_id, i FROM a JOIN r USING (leaf, template) WHERE doc_id <> keeper UNION SELECT doc_id, i FROM c JOIN e USING (v) WHERE doc_id <> keeper),
g AS (SELECT doc_id, list(i) AS gone FROM o GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(len(parts), 0) AS INT) AS n_lines, CAST(coalesce(len(gone), 0) AS INT) AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(gone, i)), lambda i: parts[i]), chr(10)) END AS text
FROM p LEFT JOIN g ON p.doc_id = g.doc_id
"""
