"""URL verdicts by rules and by link-graph propagation. [DataFrame functions only]

A rule is a host and a path, fits the host and all its subdomains where the url's path begins
with the rule's, and the longest fitting rule wins (a tie goes to the block). Where no rule fits,
the host decides: trust flows along the links between hosts from the shares of pages that the
rules allow, distrust flows against them from the shares that they block (personalised
PageRank from both kinds of seeds; a host without a link to follow keeps its own). A host is
blocked if its distrust exceeds its trust and reaches ``threshold``.

Mass that is split among the linkers of a host falls with their number, so steps are weighted at the
receiver: the distrust of a host is the chance that a walk along its links, which stops at each host
with chance 0.15, stops where the rules block, and its trust the same for a walk against links and what the rules
allow (PageRank personalised to the host, read at the seeds). Both are between 0 and 1 on a graph of any
size. ``averaged=False`` splits mass among linkers instead.

Links are absolute or scheme-relative targets of href and src in the pages' html; counts are
summed by pair of hosts before they are shuffled by one. Null urls, and urls without ``://``,
have empty host and path, which no rule fits, and take part in no link; a null html has no
links; an empty table gives an empty result; repeated rows are pages of their own; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.sources.storage import materialize, release


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def _fit(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def ruled(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the rules are a list of the program and become one expression."""
    host, path = parts(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block"))
    choose = lambda k: F.coalesce(*(F.when(_fit(F.col("host"), F.col("path"), r[1]), F.lit(r[k])) for r in order), F.lit(None).cast("string"))
    return out.withColumn("rule", choose(1)).withColumn("rule_verdict", choose(0))


def links(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float, by: str = "a") -> DataFrame:
    """(host, mass) by personalised PageRank over (a, b, n) from the seeds (host, seed); by ``b``, means of what comes in."""
    total = edges.groupBy(by).agg(F.sum("n").alias("all"))
    steps = materialize(edges.join(total, by).select("a", "b", (F.col("n") / F.col("all")).alias("w")))
    hosts = materialize(seeds.join(total.select(F.col(by).alias("host"), F.lit(1).alias("out")), "host", "left"))
    mass = hosts.select("host", F.col("seed").alias("mass"))
    for _ in range(rounds):
        flow = steps.join(mass, F.col("a") == F.col("host")).groupBy(F.col("b").alias("to")).agg(F.sum(F.col("w") * F.col("mass")).alias("flow"))
        old = hosts.join(mass, "host").join(flow, F.col("host") == F.col("to"), "left")
        kept = F.when(F.col("out").isNull(), F.col("mass")).otherwise(0.0)
        last, mass = mass, materialize(old.select("host", ((1 - damping) * F.col("seed") + damping * (kept + F.coalesce("flow", F.lit(0.0)))).alias("mass")))
        release(last)
    return mass


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS, damping: float = DAMPING, averaged: bool = True) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust to every page."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict", "verdict", "trust", "distrust")]
    known = ruled(pages.select(*names), url_col, rules)
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = known.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    edges = materialize(links(known, "host", html_col))
    if edges.isEmpty():  # every host keeps its own seeds
        mass = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    else:
        ends = reduce(DataFrame.union, [edges.select(F.col(c).alias("host")) for c in ("src", "dst")]).distinct()
        seeds = materialize(seeds.join(ends, "host", "full").fillna(0.0, ["good", "bad"]))
        by = "b" if averaged else "a"
        good = _spread(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n"), seeds.select("host", F.col("good").alias("seed")), rounds, damping, by)
        bad = _spread(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n"), seeds.select("host", F.col("bad").alias("seed")), rounds, damping, by)
        mass = good.withColumnRenamed("mass", "trust").join(bad.withColumnRenamed("mass", "distrust"), "host")
    out = known.join(mass.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left").drop("__host").fillna(0.0, ["trust", "distrust"])
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow"))).select(*names, "host", "path", "rule", "verdict", "trust", "distrust")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS, damping: float = DAMPING, averaged: bool = True) -> str:
    """The same in DuckDB, a table for each round of propagation."""
    by = "b" if averaged else "a"
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block"))
    fits = []
    for _, rule in order:
        name, slash, rest = rule.partition("/")
        fits.append(f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')")
    case = lambda k: "CASE " + " ".join(f"WHEN {f} THEN '{r[k]}'" for f, r in zip(fits, order, strict=True)) + " END"
    link = LINK.replace("'", "''")
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    tables = [
        "raw AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's') AS hh, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages)",
        f"h AS (SELECT page_id, html, {lower('hh')} AS host, path FROM raw)",
        f"k AS (SELECT *, {case(1)} AS rule, {case(0)} AS verdict FROM h)",
        f"l AS (SELECT src, {lower('dst')} AS dst FROM (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS dst FROM k WHERE host <> ''))",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE dst <> '' AND src <> dst GROUP BY 1, 2)",
        "s0 AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad FROM k WHERE host <> '' GROUP BY 1)",
        "s AS (SELECT coalesce(s0.host, v.host) AS host, coalesce(good, 0.0) AS good, coalesce(bad, 0.0) AS bad FROM s0 FULL JOIN (SELECT src AS host FROM e UNION SELECT dst FROM e) v ON s0.host = v.host)",
    ]
    for side, a, b in (("good", "src", "dst"), ("bad", "dst", "src")):
        tables.append(f"{side}w AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {b if averaged else a}) AS w FROM e)")
        tables.append(f"{side}0 AS (SELECT host, {side} AS mass FROM s)")
        for r in range(rounds):
            tables.append(f"{side}f{r} AS (SELECT b AS host, sum(w * mass) AS flow FROM {side}w JOIN {side}{r} ON a = host GROUP BY 1)")
            keep = f"CASE WHEN s.host IN (SELECT {by} FROM {side}w) THEN 0.0 ELSE m.mass END"
            tables.append(f"{side}{r + 1} AS (SELECT s.host, {1 - damping!r} * s.{side} + {damping!r} * ({keep} + coalesce(flow, 0.0)) AS mass FROM s JOIN {side}{r} m ON s.host = m.host LEFT JOIN {side}f{r} f ON s.host = f.host)")
    return "WITH " + ",\n".join(tables) + f"""
SELECT page_id, k.host, path, rule, coalesce(verdict, CASE WHEN b.mass >= {threshold!r} AND b.mass > g.mass THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN good{rounds} g ON k.host = g.host LEFT JOIN bad{rounds} b ON k.host = b.host"""
