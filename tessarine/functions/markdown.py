"""Block markup to HTML, and the final section of a report, as folds over an array of lines: no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import escape_html, inline_html

#: White space as the trimming of a text removes it at both ends.
_EDGES = r"^\s+|\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def markdown_html(text: Column) -> Column:
    """Fences, headings, rules, both kinds of lists, quotes and paragraphs; one HTML element a line."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("code"), F.lit("").alias("lang"), F.array().cast("array<string>").alias("held"), F.lit("").alias("list"))

    def block(held: Column, lang: Column) -> Column:
        kind = F.when(lang != "", F.concat(F.lit(' class="lang-'), escape_html(lang), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<pre><code"), kind, F.lit(">"), escape_html(F.array_join(held, "\n")), F.lit("</code></pre>"))

    def closed(s: Column) -> Column:
        return F.when(s["list"] != "", F.concat(s["out"], F.array(F.concat(F.lit("</"), s["list"], F.lit(">"))))).otherwise(s["out"])

    none = F.array().cast("array<string>")

    def made(out: Column, code: Column, lang: Column, held: Column, listing: Column) -> Column:
        return F.struct(out.alias("out"), code.alias("code"), lang.alias("lang"), held.alias("held"), listing.alias("list"))

    def step(s: Column, line: Column) -> Column:
        bare = trimmed(line)
        fence = bare.rlike(r"^```([a-zA-Z0-9_-]+)?\s*$")
        plain = lambda out, listing: made(out, F.lit(False), F.lit(""), none, listing)
        wrap = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
        item = lambda pattern: wrap("li", inline_html(F.regexp_extract(line, pattern, 1)))

        def listed(kind: str, pattern: str) -> Column:
            body = F.array(item(pattern))
            opened = F.when(s["list"] == kind, F.concat(s["out"], body)).otherwise(F.concat(closed(s), F.array(F.lit(f"<{kind}>")), body))
            return plain(opened, F.lit(kind))

        heading, ul, ol, quote = r"^(#{1,6})\s+(.+)$", r"^\s*[-*+]\s+(.+)$", r"^\s*\d+\.\s+(.+)$", r"^\s*>\s+(.+)$"
        tag = F.concat(F.lit("h"), F.length(F.regexp_extract(line, heading, 1)).cast("string"))
        head = F.concat(F.lit("<"), tag, F.lit(">"), inline_html(F.regexp_extract(line, heading, 2)), F.lit("</"), tag, F.lit(">"))
        end = lambda x: plain(F.concat(closed(s), F.array(x)), F.lit(""))
        return (
            F.when(s["code"] & bare.startswith("```"), plain(F.concat(s["out"], F.array(block(s["held"], s["lang"]))), F.lit("")))
            .when(s["code"], made(s["out"], F.lit(True), s["lang"], F.concat(s["held"], F.array(line)), F.lit("")))
            .when(fence, made(closed(s), F.lit(True), F.regexp_extract(bare, r"^```([a-zA-Z0-9_-]+)?\s*$", 1), none, F.lit("")))
            .when(bare == "", plain(closed(s), F.lit("")))
            .when(line.rlike(heading), end(head))
            .when(bare.rlike(r"^(-{3,}|\*{3,}|_{3,})\s*$"), end(F.lit("<hr/>")))
            .when(line.rlike(ul), listed("ul", ul))
            .when(line.rlike(ol), listed("ol", ol))
            .when(line.rlike(quote), end(F.concat(F.lit("<blockquote>"), wrap("p", inline_html(F.regexp_extract(line, quote, 1))), F.lit("</blockquote>"))))
            .otherwise(end(wrap("p", inline_html(line))))
        )

    def finish(s: Column) -> Column:
        return F.array_join(F.when(s["code"], F.concat(s["out"], F.array(block(s["held"], s["lang"])))).otherwise(closed(s)), "\n")

    return F.aggregate(lines_of(text), state, step, finish)


#: Headings of a whole generated report.
WHOLE = (r"##\s*prompt\b", r"##\s*regions?\s+of\s+interest\b", r"##\s*navigation\s+steps\b", r"##\s*model\s+reasoning\b")


def report_section(text: Column) -> Column:
    """The part below a Final report heading, up to the next heading of its level; failing such, the text itself, unless it looks like a whole report."""
    whole = F.lit(False)
    for pattern in WHOLE:
        whole = whole | text.rlike(r"(?i)(^|\n)\s*" + pattern)
    rest = F.when(whole, F.lit("")).otherwise(trimmed(text))
    depth = lambda x: F.length(F.regexp_extract(x, r"^\s*(#{1,6})\s+", 1))

    def section(lines: Column) -> Column:
        first = lambda pattern: F.get(F.filter(lines, lambda r: r["x"].rlike(pattern)), F.lit(0))
        start = F.coalesce(first(r"(?i)^\s*#{1,6}\s*final report\b"), first(r"(?i)^\s*final report\b"))
        return let(start, lambda s: F.when(s.isNull(), rest).otherwise(inside(lines, s)))

    def inside(lines: Column, start: Column) -> Column:
        level = F.length(F.regexp_extract(start["x"], r"^\s*(#{1,6})", 1))
        ends = lambda r: F.when(level > 0, (depth(r["x"]) > 0) & (depth(r["x"]) <= level)).otherwise(r["x"].rlike(r"(?i)^\s*(#{1,6}\s+|reasoning\b|navigation steps\b|raw output\b)"))
        end = F.get(F.filter(lines, lambda r: (r["i"] > start["i"]) & ends(r)), F.lit(0))["i"]
        return let(end, lambda e: trimmed(F.array_join(F.transform(F.filter(lines, lambda r: (r["i"] > start["i"]) & (e.isNull() | (r["i"] < e))), lambda r: r["x"]), "\n")))

    numbered = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.when(text.isNull(), "").otherwise(let(numbered, section))
