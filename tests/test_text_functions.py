import pytest
from pyspark.sql import functions as F

from tessarine.functions import markdown, numbers, resolution, strings
from tessarine.operators import geometry as G


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("out")).first().out


@pytest.mark.parametrize(("v", "want"), [(2.5, 2), (3.5, 4), (-2.5, -2), (0.5, 0), (1.5000001, 2)])
def test_half_even(spark, v, want):
    assert one(spark, v, numbers.half_even, "double") == want == round(v)


@pytest.mark.parametrize(("v", "want"), [(2.5, 3), (-2.5, -2), (-2.6, -3), (0.49, 0)])
def test_half_up(spark, v, want):
    assert one(spark, v, numbers.half_up, "double") == want


@pytest.mark.parametrize(("v", "want"), [(None, "0 B"), (0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (10240, "10 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3.0 TB")])
def test_bytes(spark, v, want):
    assert one(spark, v, numbers.bytes_human, "long") == want


@pytest.mark.parametrize(("v", "want"), [(" a b\tc ", "a_b_c"), ("__x__", "x"), ("é/ß?中", "éß中"), ("!!", "tile"), ("", "tile"), ("y" * 99, "y" * 64)])
def test_safe_filename(spark, v, want):
    assert one(spark, v, strings.safe_filename) == want


@pytest.mark.parametrize(("v", "want"), [("a/b.SVS", ".svs"), ("a.b/c", ""), ("x.tar.gz", ".gz"), ("", "")])
def test_extension(spark, v, want):
    assert one(spark, v, strings.extension) == want


def test_paths(spark):
    assert [one(spark, p, strings.is_safe_relative) for p in ("a/b", "/a", "a/../b", "a..b")] == [True, False, False, True]
    assert [one(spark, p, lambda c: strings.is_within(c, "/run/1")) for p in ("/run/1/x", "/run/10/x", "/run/1")] == [True, False, False]
    assert one(spark, "/out/a\\b", lambda c: strings.public_url(c, "/out")) == "/debug/a/b" and one(spark, "/else", lambda c: strings.public_url(c, "/out")) is None


def test_failures_and_status(spark):
    say = lambda t: one(spark, t, strings.tells_failure)
    assert say("UNABLE TO OPEN") and say("error reading this slide") and say("File Not Found") and not say("all is well") and not say(None) and not say("unable to walk")
    assert one(spark, "Cannot load", lambda c: strings.effective_status(F.lit("done"), c)) == "done-warn"
    assert one(spark, "Cannot load", lambda c: strings.effective_status(F.lit("error"), c)) == "error"
    assert one(spark, "x OpenSlideUnsupportedFormatError", strings.is_fatal)


def test_escape_and_inline(spark):
    assert one(spark, "<a & 'b'>", strings.escape_html) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, "**b** _i_ `c` [t](http://x.y)", strings.inline_html) == '<strong>b</strong> <em>i</em> <code>c</code> <a href="http://x.y" target="_blank" rel="noreferrer">t</a>'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""),
        (None, ""),
        ("a\r\nb", "<p>a</p>\n<p>b</p>"),
        ("# H *x*\n\ntext <b>", "<h1>H <em>x</em></h1>\n<p>text &lt;b&gt;</p>"),
        ("###### six\n####### seven", "<h6>six</h6>\n<p>####### seven</p>"),
        ("- a\n- b\n1. c\n2. d", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n<li>d</li>\n</ol>"),
        ("- a\n\n- b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>"),
        ("+ a\nend", "<ul>\n<li>a</li>\n</ul>\n<p>end</p>"),
        ("> q\n---\n***", "<blockquote><p>q</p></blockquote>\n<hr/>\n<hr/>"),
        ("```py\na < b\n```\nz", '<pre><code class="lang-py">a &lt; b</code></pre>\n<p>z</p>'),
        ("```\n# open\n- x", "<pre><code># open\n- x</code></pre>"),
        ("```\n\n```", "<pre><code></code></pre>"),
        ("1. a\n```\nb\n```", "<ol>\n<li>a</li>\n</ol>\n<pre><code>b</code></pre>"),
        ("* * *", "<ul>\n<li><em> </em></li>\n</ul>"),
        (">x", "<p>&gt;x</p>"),
    ],
)
def test_markdown(spark, text, want):
    assert one(spark, text, markdown.markdown_html) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A\n## Final Report:\nbody\n### sub\nmore\n## Next\nx", "body\n### sub\nmore"), ("Final report\nbody\nReasoning here\nx", "body"), ("just text ", "just text"), ("## Prompt\nx", ""), ("", ""), (None, ""),
        ("# Final Report\n", ""), ("## navigation steps\ny", ""), ("intro\n#final report\nz\n# w", "z"),
    ],
)
def test_report_section(spark, text, want):
    assert one(spark, text, markdown.report_section) == want


@pytest.mark.parametrize(
    ("props", "a", "b"),
    [
        ({"openslide.mpp-x": "0.5"}, 0.5, 0.5), ({"openslide.mpp-x": "bad", "openslide.mpp-y": "0.3"}, 0.3, None), ({"openslide.objective-power": "20"}, 0.5, None), ({"openslide.objective-power": "0"}, None, None), ({}, None, None),
        ({"openslide.comment": "<PixelSizeMicrons>0.4</PixelSizeMicrons>"}, None, 0.4), ({"tiff.ImageDescription": "<OME><Image><Pixels PhysicalSizeX='0.2'/></Image></OME>"}, None, 0.2), ({"tiff.ImageDescription": "<OME><Ima"}, None, None),
    ],
)
def test_resolution_chains(spark, props, a, b):
    row = spark.createDataFrame([(props,)], "p map<string,string>").select(resolution.mpp_of_view(F.col("p")).alias("a"), resolution.mpp_of_index(F.col("p")).alias("b"), resolution.mpp_of_index(F.col("p"), 9.0).alias("c")).first()
    assert (row.a, row.b, row.c) == (a, b, 9.0 if b is None else b)


def test_no_resolution_is_an_error_if_asked(spark):
    with pytest.raises(Exception, match="no slide resolution"):
        one(spark, {}, lambda c: resolution.mpp_of_index(c, strict=True), "map<string,string>")


def test_geometry_edges(spark):
    row = spark.range(1)
    value = lambda c: row.select(c.alias("o")).first().o
    lit = lambda *v: tuple(F.lit(x).cast("bigint") for x in v)
    box = lambda b: (b.x, b.y, b.w, b.h)
    assert box(value(G.clamp_view(*lit(-5, 99, 500, 500), 100, 100))) == (0, 99, 100, 1)
    assert box(value(G.mark_box(*lit(10, 10), 800, 600))) == (0, 0, 600, 600)
    assert value(G.level_for(F.lit(9000), F.array(F.lit(1.0), F.lit(2.0)))) == 1 and value(G.level_for(F.lit(100), F.array(F.lit(1.0)))) == 0
    assert value(G.magnification(F.lit(0.0), F.lit(20.0))) is None and value(G.magnification(F.lit(2.0), F.lit(None))) == 20
    assert value(G.overview_box(F.lit(float("nan")), F.lit(1.0), F.lit(1.0), F.lit(1.0), 10, 10, 10, 10, browser=True)) is None
    assert value(G.base_side(F.lit(None).cast("double"), F.lit(10.0), F.lit(4.0))) == 40 and value(G.base_side(F.lit(0.0), F.lit(None).cast("double"), F.lit(4.0))) is None
    r = lambda a: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(a, ("x0", "y0", "x1", "y1"), strict=True)])
    assert value(G.iou(r((0, 0, 2, 2)), r((1, 0, 3, 2)))) == pytest.approx(1 / 3) and value(G.iou(r((0, 0, 1, 1)), r((1, 0, 2, 1)))) == 0
