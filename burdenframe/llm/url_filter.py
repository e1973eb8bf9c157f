"""URL filters: listed rules first, then trust and distrust that spread over the links between hosts.

Hosts whose pages are mostly allowed by rules are trusted seeds, hosts whose pages are mostly blocked are blocked seeds.
Personalised PageRank spreads trust from the former along links, and distrust from the latter against them, since who
links to a blocked host is suspect. A host with more distrust than trust is blocked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.plans.workspace import stored

#: Fixed rules (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6
#: Share of distrust in what a host has from which on it is blocked.
MAX_DISTRUST = 0.5


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows of verdict, rule, host and path."""
    rows = spark.createDataFrame(list(rules), "verdict string, rule string")
    at = F.instr("rule", F.lit("/"))
    return rows.select("verdict", "rule", F.substr("rule", F.lit(1), at - 1).alias("host"), F.substr("rule", at).alias("path"))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host and path) and the longest rule that fits: ``rule`` and ``rule_verdict``, else null.

    The rules of a host and of the domains above it are brought to the host once; pages then meet them by host.
    """
    hosts = pages.select("host").filter("host != ''").distinct()
    labels = F.split("host", r"\.", -1)
    above = hosts.select("host", labels.alias("labels")).select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("domain"))
    own = above.join(rules.withColumnRenamed("host", "domain"), "domain").groupBy("host").agg(
        F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "path", "verdict")).alias("rules"))
    own = own.select(F.col("host").alias("known"), F.reverse(F.array_sort("rules")).alias("rules"))
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    joined = pages.join(own, pages["host"] == own["known"], "left")
    return joined.withColumn("fit", fit).withColumns({"rule": F.col("fit.rule"), "rule_verdict": F.col("fit.verdict")}).drop("fit", "rules", "known")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links to other hosts in the pages: ``src``, ``dst`` and their number ``n``. Relative links stay on their host."""
    found = F.regexp_extract_all(F.col(f"`{html}`"), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    whole = F.transform(F.filter(found, lambda x: x.rlike("^(?i:[a-z][a-z0-9+.-]*:)?//")), lambda x: F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))
    links = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(whole).alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    return links.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host that either reaches.

    ``seeds`` has host, trusted and blocked (weights). Each kind of seed sums to 1. Every round is one join of links with
    ranks and one sum, written out; rounds end when ranks move by less than ``tolerance`` in total. They do:
    each round moves them by at most ``damping`` times what the one before did, so 0.85 and 1e-6 take 90 rounds or fewer.
    """
    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = None
    for kind, total in (("trusted", totals.t), ("blocked", totals.b)):
        part = seeds.filter(F.col(kind) > 0).select("host", F.lit(kind).alias("kind"), (F.col(kind) / F.lit(float(total or 1))).alias("seed"))
        start = part if start is None else start.union(part)
    start = stored(start, "seeds")
    out, into = links.groupBy("src").agg(F.sum("n").alias("all")), links.groupBy("dst").agg(F.sum("n").alias("all"))
    ways = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("trusted").alias("kind"), (F.col("n") / F.col("all")).alias("share"))
    ways = stored(ways.union(links.join(into, "dst").select(F.col("dst"), F.col("src"), F.lit("blocked"), F.col("n") / F.col("all"))), "ways")
    ranks = start.select("host", "kind", (F.col("seed") * (1 - damping)).alias("rank"))
    if not ways.isEmpty():
        while True:
            sent = ranks.join(ways, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
            both = sent.union(start.select("host", "kind", F.col("seed") * (1 - damping))).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
            both = stored(both, "ranks")
            moved = both.join(ranks.withColumnRenamed("rank", "old"), ["host", "kind"], "full").agg(
                F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            ranks = both
            if (moved or 0.0) <= tolerance:
                break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("trusted").alias("trust"), of("blocked").alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``trust`` and ``distrust`` of every page.

    The longest rule that fits decides, else the host: block if distrust is more than ``max_distrust`` of its trust and distrust
    together, else allow, as for hosts that nothing reaches. A null url, or one without ``://``, has an empty host and is allowed. Null pages
    have no links. Every row comes back once, repeated rows too; other columns are left out; an empty table gives an empty table.
    """
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    ruled = stored(with_rules(parts, rules), "ruled")
    of = lambda verdict: F.sum(F.when(F.col("rule_verdict") == verdict, 1).otherwise(0))
    hosts = ruled.filter("host != ''").groupBy("host").agg(F.count("*").alias("n"), of("allow").alias("allowed"), of("block").alias("refused"))
    weight = lambda c: F.when(F.col(c) * 2 > F.col("n"), 1.0).otherwise(0.0)
    seeds = hosts.select("host", weight("allowed").alias("trusted"), weight("refused").alias("blocked")).filter("trusted + blocked > 0")
    ranks = propagate(stored(host_links(pages, url, html), "links"), seeds).withColumnRenamed("host", "ranked")
    joined = ruled.join(ranks, ruled["host"] == ranks["ranked"], "left").fillna(0.0, ["trust", "distrust"])
    suspect = F.col("distrust") > (F.col("trust") + F.col("distrust")) * max_distrust
    verdict = F.coalesce("rule_verdict", F.when(suspect, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
