import pytest
from pyspark.sql import functions as F

from tessarine.llm import urlfilter
from tests.llm.fixtures import with_clashes


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://X.example.COM/en/1?q#f", "x.example.com", "/en/1", "example.com/en/"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("https://a.com/", "a.com", "/", "com/"),
        ("https://a.com", "a.com", "", None), ("//a.com/", "", "", None), (None, "", "", None), ("x://b.net/es/://c.com/", "b.net", "/es/://c.com/", "net/es/"), ("http://b.net?x=/es/", "b.net", "", None),
        ("http://telecom/x", "telecom", "/x", None), ("http://com/x", "com", "/x", "com/"), ("http://ÀB.net/fr/é\n", "Àb.net", "/fr/é\n", "net/fr/"), ("://", "", "", None), ("http://u@h.net:80/es/", "u@h.net:80", "/es/", None),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    r = urlfilter.judge(with_clashes(pages(spark, [(1, url, None)]))).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)


def plain_rank(edges, seeds, damping=0.85, rounds=400):
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    total = max(1, sum(seeds.values()))
    start = {h: v / total for h, v in seeds.items() if v}
    rank = dict(start)
    for _ in range(rounds if edges else 0):
        new = {h: (1 - damping) * v for h, v in start.items()}
        for s, d, n in edges:
            if s in rank:
                new[d] = new.get(d, 0) + damping * n / out[s] * rank[s]
        rank = new
    return rank


def scores(spark, edges, seeds, **how):
    return urlfilter.host_scores(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"), **how).collect()


def test_propagation_against_plain_walks(spark):
    """The walks that never end, to within what the tolerance leaves: at most tolerance * damping / (1 - damping) of the mass."""
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "c", 1), ("d", "e", 4), ("f", "d", 1), ("g", "g2", 1)]
    seeds = [("a", 3, 0), ("e", 0, 2), ("c", 1, 1), ("z", 0, 1)]
    got = {r.host: r for r in scores(spark, edges, seeds, tolerance=1e-6)}
    trust = plain_rank(edges, {h: a for h, a, _ in seeds})
    distrust = plain_rank([(d, s, n) for s, d, n in edges], {h: b for h, _, b in seeds})
    for h in {*trust, *distrust}:
        assert abs(got[h].trust - trust.get(h, 0)) < 6e-6 and abs(got[h].distrust - distrust.get(h, 0)) < 6e-6
    assert all(0 <= r.residual <= 1e-6 for r in got.values())


def test_far_hosts_get_their_mass(spark):
    """A chain of 16 hosts from a seed: the last has damping**16 of the mass."""
    chain = [(f"h{i:02d}", f"h{i + 1:02d}", 1) for i in range(16)]
    got = {r.host: r for r in scores(spark, chain, [("h00", 1, 0)], tolerance=1e-3)}
    assert abs(got["h16"].trust - 0.15 * 0.85**16) < 1e-3 < got["h16"].trust and got["h16"].residual <= 1e-3


def test_verdicts_of_the_method(spark):
    rows = [
        (1, "http://good.com/x", '<a href="http://mid.org/">'), (2, "http://mid.org/", "<A HREF=//bad.net/>"), (3, "http://bad.net/es/1", ""), (4, "http://evil.org/", '<a class=k href = "https://BAD.net/es/">'),
        (5, None, None), (6, "x", ""), (7, "http://lone.org", '<a href="/rel">'), (4, "http://evil.org/", '<a class=k href = "https://BAD.net/es/">'),
    ]
    got = {r.key: r.verdict for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert urlfilter.judge(pages(spark, rows)).count() == len(rows)
    assert urlfilter.judge(pages(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = urlfilter.op8_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert urlfilter.op8_url_filter(spark, "/root/testdata/sf0.001").where(F.col("verdict").isNull()).count() == 0
