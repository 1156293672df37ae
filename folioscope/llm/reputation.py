"""URL filters: a table of rules, and for the pages no rule fits an empirical-Bayes reputation of the host.

Labelled outcomes (good or bad pages) are counted per host, registered domain and public suffix. Each level is the
beta-binomial prior of the one below: a suffix is shrunk to the mean of all pages, a domain to its suffix, a host to its
domain. How strongly is estimated per level by the method of moments from the spread of the groups' rates. A page is
blocked where even the lower bound of its host's share of bad pages is above a threshold, so a host with few labelled
pages follows its domain, and one with none has its domain's bound.

Counts are combined in the map tasks and hosts join back as one row each, so a host with a third of all pages costs no more
than others. Of the corpus the driver sees one mean and three strengths.

Null urls and urls without ``://`` have empty host and path; no rule fits them, and they share one reputation. Outcomes
without a page and pages without an outcome are fine; repeated outcomes of a page count as often as they occur. With no
outcome at all everything is allowed that no rule blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm.store import ascii_lower, materialize, table

# The rules of the production query, (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Labels that form a public suffix together with a two-letter country.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Reputation:
    """A host is blocked if mean - z * deviation of its posterior exceeds ``max_bad``."""

    max_bad: float = 0.5
    z: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def suffix_of(host: Column) -> Column:
    two = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:^|\.)(?:{two})\.[a-z][a-z]|(?:^|\.)[^.]*)$", 1)


def domain_of(host: Column) -> Column:
    two = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"([^.]*\.(?:(?:{two})\.[a-z][a-z]|[^.]*)|[^.]*)$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of its text and verdict; null where none fits."""
    fits = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        same = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(same & path.startswith(rule_path), F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _strength(groups: DataFrame, parent: str, how: Reputation) -> float:
    """Prior strength of a level, from counts ``n``, ``bad`` of groups and the mean ``parent`` each is shrunk to.

    Rates of groups of size n around mean m vary by m(1-m)/n * (1 + (n-1)/(s+1)); both sides are summed with weight n.
    """
    rate, mean = F.col("bad") / F.col("n"), F.col(parent)
    spread = mean * (1 - mean)
    total = groups.where("n > 0").agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("seen"), F.sum(spread).alias("noise"), F.sum(spread * (F.col("n") - 1)).alias("more"))
    over = F.col("seen") - F.col("noise")
    s = F.when((over > 0) & (F.col("more") > 0), F.col("more") / over - 1).otherwise(how.most_strength)
    return max(how.least_strength, min(how.most_strength, total.select(F.coalesce(s, F.lit(how.most_strength))).first()[0]))


def _shrunk(groups: DataFrame, parent: str, name: str, how: Reputation) -> DataFrame:
    """Groups with their strength and posterior mean ``name``."""
    s = F.lit(_strength(groups, parent, how))
    return groups.withColumn("s", s).withColumn(name, (F.col("bad") + s * F.col(parent)) / (F.col("n") + s))


def host_reputation(pages: DataFrame, outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """host, n, bad, posterior ``mean`` and lower ``bound`` of the share of bad pages, for every host of ``pages``.

    ``pages`` has page_id and host, ``outcomes`` page_id and a boolean ``bad``.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counts = materialize(
        pages.join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "host-counts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = counts.agg(*sums).first()
    mean = F.lit(overall.bad / overall.n if overall.n else 0.0)
    suffixes = _shrunk(counts.groupBy("suffix").agg(*sums).withColumn("m0", mean), "m0", "m1", how).select("suffix", "m1")
    domains = _shrunk(counts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix"), "m1", "m2", how).select("domain", "m2")
    hosts = _shrunk(counts.join(domains, "domain"), "m2", "mean", how)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s") + 1))
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - how.z * deviation).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, how: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the counts and bound the verdict rests on where no rule fits."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # A table of its own, so that Spark can broadcast it if it is small and split a host of very many pages if it is not.
    hosts = materialize(host_reputation(split.select("page_id", "host"), outcomes, how).withColumnRenamed("host", "_host"), "host-reputation")
    both = split.join(hosts, F.col("host") == F.col("_host"))
    ruled = both.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > how.max_bad, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"),
                        F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "bound")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes from ``labels``, whose ids are taken as page ids: bad is low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))
    return rows.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


_LEVEL = """
{name}s AS (SELECT greatest(2.0, least(1000.0, coalesce(CASE WHEN seen > noise AND more > 0 THEN more / (seen - noise) - 1 ELSE 1000.0 END, 1000.0))) AS s
  FROM (SELECT sum(n * (bad / n - m) * (bad / n - m)) AS seen, sum(m * (1 - m)) AS noise, sum(m * (1 - m) * (n - 1)) AS more FROM {name}0 WHERE n > 0)),
{name} AS (SELECT {name}0.*, s, (bad + s * m) / (n + s) AS post FROM {name}0, {name}s)"""
SQL = r"""
WITH u AS (SELECT page_id, url, instr(url, '://') AS mark FROM pages),
p AS (SELECT page_id, CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
c AS (SELECT host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
        regexp_extract(host, '([^.]*\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]*)|[^.]*)$', 1) AS domain,
        regexp_extract(host, '((?:^|\.)(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|(?:^|\.)[^.]*)$', 1) AS suffix
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END FROM c) AS m FROM c GROUP BY suffix),
""" + _LEVEL.format(name="suffixes") + r""",
domains0 AS (SELECT domain, d.n, d.bad, post AS m FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL) d JOIN suffixes USING (suffix)),
""" + _LEVEL.format(name="domains") + r""",
hosts0 AS (SELECT host, c.n, c.bad, post AS m FROM c JOIN domains USING (domain)),
""" + _LEVEL.format(name="hosts") + r""",
r AS (SELECT page_id, host, path, CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, post - 1.645 * sqrt(post * (1 - post) / (n + s + 1)) AS bound,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN hosts USING (host))
SELECT page_id, host, path, rule, n_labelled, n_bad,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
