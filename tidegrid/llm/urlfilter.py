"""Operator 6: pages allowed or blocked by url rules, and elsewhere by trust and distrust carried over host links.

A rule is a host and the beginning of a path; it fits the host and all its subdomains, and the longest fitting rule
decides. Pages that no rule fits are decided for their host: trust starts at hosts with allowed pages and follows
links, distrust starts at hosts with blocked pages and goes back along links, both as personalised PageRank; a host is
blocked where its distrust outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# The rules of the query (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute links in a page.
_LINKS = r"""(?i)\bhref\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]*)"""


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z in lower case) and path of a url; both empty without a ://."""
    url = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)


def _suffixes(host: Column) -> Column:
    """The host itself and all domains that it lies under."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host -> rules: its fitting rules (rule, path, verdict), the longest first; hosts without any are absent.

    Of rules of equal text the first verdict in alphabetical order holds."""
    spread = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("at"))
    known = rules.groupBy(_lower(F.col("host")).alias("at"), F.col("path").alias("start")).agg(F.min("verdict").alias("verdict"))
    fit = spread.join(known, "at").select("host", F.struct((-F.length(F.concat("at", "start"))).alias("minus"), F.concat("at", "start").alias("rule"), F.col("start").alias("path"), "verdict").alias("r"))
    return fit.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def _rank(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, name: str) -> DataFrame:
    """Personalised PageRank: host, score. ``seeds``: host, seed (sums to 1); ``edges``: src, dst, w (w sums to 1 by src).

    Each round is a join of scores with links and a sum; it ends once the scores move by less than ``tolerance`` together, which takes as many
    rounds as its logarithm to the base ``damping`` at most: what is then still to come is at most tolerance * damping / (1 - damping). What reaches a host without links ends there."""
    if not 0 < damping < 1 or tolerance <= 0:
        raise ValueError("scores settle for a damping between 0 and 1 and a tolerance above 0 only")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    score = cut(start, name)
    while True:
        flow = edges.join(score.select(F.col("host").alias("src"), F.col("score").alias("s")), "src").select(F.col("dst").alias("host"), (damping * F.col("s") * F.col("w")).alias("score"))
        new = cut(start.union(flow).groupBy("host").agg(F.sum("score").alias("score")), name)
        moved = new.join(score.withColumnRenamed("score", "was"), "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        score = new
        if (moved or 0.0) < tolerance:
            return score


def judge(pages: DataFrame, rules: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, margin: float = 0.0) -> DataFrame:
    """Each page's page_id, host, path, rule (the longest fitting, as host and path; else null), verdict, trust, distrust.

    ``rules``: host, path, verdict (allow or block). Pages without a fitting rule are blocked if their host's distrust is
    more than its trust plus ``margin``, else allowed; so are hosts that no score reaches. A null url, or one without ://,
    has the empty host, which has no rule and no links. Every row of ``pages`` (page_id, url, html; other columns are
    ignored) gives one row, repeated rows and null ids too. Trust and distrust sum to at most 1 over all hosts.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = cut(split.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "url-hosts")
    fitting = cut(rules_by_host(hosts.select("host"), rules), "url-rules")
    first = F.get(F.filter("rules", lambda r: F.startswith("path", r["path"])), F.lit(0))
    ruled = split.join(fitting, "host", "left").select("page_id", "host", "path", first.alias("r"))
    ruled = cut(ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled")), "url-ruled")

    source, _ = parts(F.col("url"))
    links = pages.select(source.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINKS), 1)).alias("dst"))
    links = links.select("src", _lower(F.col("dst")).alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = cut(links, "url-links")

    def scores(verdict: str, name: str, src: str, dst: str) -> DataFrame:
        seeds = ruled.where(F.col("ruled") == verdict).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        total = seeds.agg(F.sum("n")).first()[0] or 1
        out = links.groupBy(src).agg(F.sum("n").alias("all"))
        edges = cut(links.join(out, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("all")).alias("w")), name + "-edges")
        seeds = seeds.select("host", (F.col("n") / total).alias("seed"))
        return _rank(seeds, edges, damping, tolerance, name).withColumnRenamed("score", name[4:])

    by_host = scores("allow", "url-trust", "src", "dst").join(scores("block", "url-distrust", "dst", "src"), "host", "full").fillna(0.0, ["trust", "distrust"])
    out = ruled.join(cut(by_host, "url-scores"), "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust") + margin, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op6_link_trust_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).drop("trust", "distrust")
