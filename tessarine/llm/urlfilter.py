"""URL filter: explicit rules, and trust and distrust propagated over the host link graph.

Rules name a host (with all subdomains) and a path prefix; the longest that fits decides. Hosts of pages that rules
allow are trusted seeds, hosts of pages that rules block are distrusted seeds, each weighted by such pages. Trust is a
personalised PageRank along links from the trusted seeds; distrust is one against the links from the blocked seeds, as
those who link to blocked hosts share in their distrust. A host is blocked if its distrust exceeds its trust by more than
`threshold` times the mean mass of a host; pages without a rule take their host's verdict, hosts without any mass are allowed.

All of it is DataFrame operations: links are extracted by a regular expression, both walks run as one table of
(direction, host), every round is one join with the written table of links and one partial sum, so a hub's rows can be split. Every few rounds
the walks are written out, and end once a round moves no more than `tolerance` of their mass; as a round moves at most the damping's part of what the round
before moved, the number of rounds is bounded whatever the graph, and hosts at any distance from a seed that the tolerance can tell from nothing are reached. The mass that the
last round moved is returned as residual.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; null html has no
links; very long html is searched whole; links of a host to itself carry nothing; repeated rows count as often as they stand; hosts of equal trust and distrust are allowed, of two
rules of equal length the one later in the order of host, path and verdict counts; empty tables give empty tables; columns other than key, url and html are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, forget, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src != dst and src != '' and dst != ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, every: int = 4) -> DataFrame:
    """(host, trust, distrust, residual) of all hosts with any mass. edges: (src, dst, n); seeds: (host, allowed, blocked). Rounds go on, `every` of them at a time, until one moves at most `tolerance`."""
    both = edges.select(F.lit(1).alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(edges.select(F.lit(-1), "dst", "src", "n"))
    out = both.groupBy("way", "host").agg(F.sum("n").alias("all"))
    edge = cut(both.join(out, ["way", "host"]).select("way", "host", "to", (F.col("n") / F.col("all")).alias("share")), "edges")
    total = seeds.agg(F.greatest(F.coalesce(F.sum("allowed"), F.lit(0)), F.lit(1)).alias("a"), F.greatest(F.coalesce(F.sum("blocked"), F.lit(0)), F.lit(1)).alias("b")).first()
    start = cut(
        seeds.where("allowed > 0").select(F.lit(1).alias("way"), "host", (F.col("allowed") / total.a).alias("mass"))
        .union(seeds.where("blocked > 0").select(F.lit(-1), "host", F.col("blocked") / total.b)),
        "seeds",
    )
    again = start.select("way", "host", ((1 - damping) * F.col("mass")).alias("mass"), F.lit(0.0).alias("last"))
    rank, residual = start.withColumn("last", F.lit(0.0)), 0.0
    walking = not edge.isEmpty() and not start.isEmpty()
    while walking:
        new = rank
        for _ in range(every):
            moved = edge.join(new, ["way", "host"]).select("way", F.col("to").alias("host"), (damping * F.col("share") * F.col("mass")).alias("mass"), F.lit(0.0).alias("last"))
            before = new.select("way", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("last"))
            new = moved.union(again).union(before).groupBy("way", "host").agg(F.sum("mass").alias("mass"), F.sum("last").alias("last"))
        new = cut(new, "rank")
        forget(rank)
        rank = new
        residual = float(rank.groupBy("way").agg(F.sum(F.abs(F.col("mass") - F.col("last"))).alias("d")).agg(F.max("d").alias("d")).first().d or 0.0)
        walking = residual > tolerance
    part = lambda way: F.sum(F.when(F.col("way") == way, F.col("mass")).otherwise(0.0))
    return rank.groupBy("host").agg(part(1).alias("trust"), part(-1).alias("distrust")).withColumn("residual", F.lit(residual))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", key: str = "page_id", threshold: float = 0.0, **how) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust)."""
    parsed = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    parsed = parsed.select("key", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    side = lambda v: F.sum((F.col("ruled") == v).cast("long"))
    seeds = parsed.where("ruled is not null and host != ''").groupBy("host").agg(side("allow").alias("allowed"), side("block").alias("blocked"))
    scores = cut(host_scores(links(pages, url, html), cut(seeds, "seeds"), **how), "scores")
    mean = 1.0 / max(1, scores.count())
    joined = parsed.join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") > threshold * mean, F.lit(False))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return joined.select("key", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def oracle(damping: float = 0.85, rounds: int = 60) -> str:
    """The same in DuckDB SQL, one common table expression per round, of which no more than the bound for the tolerance are needed."""
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    link = _LINK.replace("'", "''")
    sql = f"""
WITH a AS MATERIALIZED (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{_PARTS}', 1), '')")} AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
p AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM a),
l AS (SELECT host AS src, {lower("dst")} AS dst FROM a, unnest(regexp_extract_all(html, '{link}', 1)) t(dst)),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
b AS (SELECT 1 AS way, src AS host, dst AS towards, n FROM e UNION ALL SELECT -1, dst, src, n FROM e),
edge AS MATERIALIZED (SELECT way, host, towards, n / sum(n) OVER (PARTITION BY way, host) AS share FROM b),
s AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS allowed, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM p WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
start AS MATERIALIZED (SELECT 1 AS way, host, allowed / sum(allowed) OVER () AS mass FROM s WHERE allowed > 0 UNION ALL SELECT -1, host, blocked / sum(blocked) OVER () FROM s WHERE blocked > 0),
r0 AS (FROM start)"""
    for i in range(1, rounds + 1):
        sql += f""",
r{i} AS MATERIALIZED (SELECT way, host, sum(mass) AS mass FROM (SELECT way, edge.towards AS host, {damping} * share * mass AS mass FROM edge JOIN r{i - 1} USING (way, host)
  UNION ALL SELECT way, host, CASE WHEN EXISTS (FROM edge) THEN 1 - {damping} ELSE 1 END * mass FROM start) GROUP BY way, host)"""
    return sql + f""",
z AS (SELECT host, coalesce(sum(mass) FILTER (WHERE way = 1), 0) AS trust, coalesce(sum(mass) FILTER (WHERE way = -1), 0) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust - trust > 0 THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM p LEFT JOIN z USING (host)
"""
