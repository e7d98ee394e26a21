"""Operator 10: URL rules first, then link-graph propagation per host; DataFrame functions only.

Rules judge pages; what they say about a host's pages seeds two personalised PageRanks over host edges: trust flows along links from allowed
hosts, distrust flows against links from blocked ones (a host that links to blocked hosts earns some). A page without a rule is blocked if
distrust exceeds trust by ``margin`` of a full seed on its host, else allowed. Ranks are whole numbers out of ``SCALE``, so sums don't depend
on their order. Ranks start from the own share of the seeds and can only grow, so rounds go on until ``CUT`` of them change nothing: the tolerance is
less than one of ``SCALE`` for each host. Edges are summed by host pair before anything else; ranks hold a row a host and are written to the
checkpoint folder each ``CUT`` rounds. Links with a scheme and links of the form //host/ are read.

A null url, or one without "://", has an empty host and path and no rule; empty hosts have no seeds, so such pages are allowed. Repeated
rows are judged alike; null html has no links; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import cut_lineage

#: ROUNDS are those of OP10_SQL: DAMPING to that power is less than one of SCALE, so ranks change no more.
SCALE, DAMPING, ROUNDS, MARGIN, CUT = 1_000_000, 85, 100, 50, 4
HOST_PATTERN, PATH_PATTERN = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
LINKS = r"""(?is)<a\s(?:[^>]*?[\s"'/])?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH_PATTERN, 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, counted: source, target, links."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("link"))
    whole = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("source", host_of(whole).alias("target")).where("target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Trust and distrust of each host, out of ``SCALE``, where further rounds change nothing; seeds: host, good, bad."""
    edges = cut_lineage(edges)
    out_links = edges.groupBy("source").agg(F.sum("links").alias("of"))
    in_links = edges.groupBy("target").agg(F.sum("links").alias("of"))
    forth = edges.join(out_links, "source").select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("links") * SCALE / F.col("of")).cast("long").alias("good_share"), F.lit(0).cast("long").alias("bad_share"))
    back = edges.join(in_links, "target").select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0).cast("long").alias("good_share"), (F.col("links") * SCALE / F.col("of")).cast("long").alias("bad_share"))
    moves = cut_lineage(forth.unionByName(back))
    seeds = cut_lineage(seeds)
    keep, pass_on = 100 - DAMPING, DAMPING
    start = seeds.select("host", *[F.expr(f"{c} * {keep}").alias(c) for c in ("good", "bad")])
    rank, before = start.select("host", F.expr("good div 100").alias("good"), F.expr("bad div 100").alias("bad")), None
    while True:
        now = rank.agg(F.sum("good"), F.sum("bad")).first()
        if now == before:  # no rank ever falls, so equal sums are equal ranks
            return rank
        before = now
        for _ in range(CUT):
            sent = rank.join(moves, "host").select(F.col("to").alias("host"), *[F.expr(f"good * good_share div {SCALE} * {pass_on}").alias("good"), F.expr(f"bad * bad_share div {SCALE} * {pass_on}").alias("bad")])
            rank = start.unionByName(sent).groupBy("host").agg(*[F.expr(f"sum({c}) div 100").alias(c) for c in ("good", "bad")])
        rank = cut_lineage(rank)


def judge_urls(pages: DataFrame, rules=RULES, margin: int = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r.name for r in rules if r.allow])
    hosts = ruled.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), F.count_if(allowed).alias("yes"), F.count_if(F.col("rule").isNotNull() & ~allowed).alias("no"))
    seeds = hosts.select("host", F.expr(f"yes * {SCALE} div n").alias("good"), F.expr(f"no * {SCALE} div n").alias("bad"))
    rank = propagate(seeds, host_edges(ruled)).select("host", "good", "bad")
    least = SCALE * (100 - DAMPING) * margin // 10_000
    poor = F.coalesce(F.col("bad") - F.col("good"), F.lit(0)) > least
    verdict = F.when(F.col("rule").isNull(), F.when(poor, "block").otherwise("allow")).when(allowed, "allow").otherwise("block")
    return ruled.drop("html").join(rank, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "good", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def rank(k: int) -> str:
        sent = f"""UNION ALL SELECT m."to", good * good_share // {SCALE} * {DAMPING}, bad * bad_share // {SCALE} * {DAMPING} FROM rank{k - 1} JOIN moves m USING (host)""" if k else ""
        return f"rank{k} AS MATERIALIZED (SELECT host, CAST(sum(good) // 100 AS BIGINT) AS good, CAST(sum(bad) // 100 AS BIGINT) AS bad FROM (SELECT host, good * {100 - DAMPING} AS good, bad * {100 - DAMPING} AS bad FROM seeds {sent}) GROUP BY host)"

    host = r"translate(regexp_extract(coalesce({}, ''), '(?s)^.*?://([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "')"
    cases = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))
    good = ", ".join(f"'{r.name}'" for r in RULES if r.allow)
    links = LINKS.replace("'", "''")
    whole = "CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END"
    return f"""
WITH read AS MATERIALIZED (SELECT page_id, html, {host.format('url')} AS host, regexp_extract(coalesce(url, ''), '{PATH_PATTERN}', 1) AS path FROM pages),
ruled AS MATERIALIZED (SELECT *, CASE {cases} END AS rule FROM read),
seeds AS MATERIALIZED (SELECT host, count(*) FILTER (rule IN ({good})) * {SCALE} // count(*) AS good,
                 count(*) FILTER (rule IS NOT NULL AND rule NOT IN ({good})) * {SCALE} // count(*) AS bad FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS source, unnest(regexp_extract_all(html, '{links}', 1)) AS link FROM ruled WHERE host <> ''),
edges AS MATERIALIZED (SELECT source, target, count(*) AS links FROM (SELECT source, {host.format(whole)} AS target FROM links) WHERE target <> '' AND source <> target GROUP BY ALL),
moves AS MATERIALIZED (SELECT source AS host, target AS "to", CAST(floor(links * {SCALE} / sum(links) OVER (PARTITION BY source)) AS BIGINT) AS good_share, 0 AS bad_share FROM edges
          UNION ALL SELECT target, source, 0, CAST(floor(links * {SCALE} / sum(links) OVER (PARTITION BY target)) AS BIGINT) FROM edges),
{', '.join(rank(k) for k in range(ROUNDS + 1))}
SELECT page_id, host, path, rule, CASE WHEN rule IN ({good}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN coalesce(bad - good, 0) > {SCALE * (100 - DAMPING) * MARGIN // 10_000} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN rank{ROUNDS} USING (host)"""


OP10_SQL = _sql()
