"""URL filter: fixed host/path rules first, else the empirical-Bayes reputation of the page's host.

Labelled page outcomes are counted per host, registered domain and suffix. Each level shrinks towards its
parent by a beta-binomial prior whose strength is fitted from the data (moment estimate of the intra-class
correlation), suffixes towards the overall rate. A host is blocked when the upper bound of its posterior rate of
good pages lies below ``least_good``.

Defined cases: a null url or one without ``://`` has an empty host and path, which form a host of their own;
labels without a quality are ignored, a null toxicity counts as 0; a page may have several labels, each one
outcome; hosts without labels stand at their prior; repeated pages are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import table

# Fixed values: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Second-level labels that belong to the suffix under a two-letter country code.
SECOND_LEVEL = "co|com|org|net|ac|gov|edu"
LEAST_GOOD = 0.5
Z = 1.6449
WEAKEST, STRONGEST = 1.0, 1000.0
"""Bounds of a prior's strength, in labelled pages."""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null: none). Rules are a short list, compiled into one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, tail = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, f"(?:^|[.])((?:(?:{SECOND_LEVEL})[.])?[a-z]{{2}}|[^.]*)$", 1)


def domain_of(host: Column, suffix: Column) -> Column:
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix))
    return F.concat(F.regexp_extract(before, "([^.]*[.])$", 1), suffix)


def shrunk(level: DataFrame, parent_rate: str, rate: str) -> DataFrame:
    """Add the posterior rate of each unit of ``level`` (n, good, parent_rate); the prior's strength is one fitted number."""
    p = F.col(parent_rate)
    seen = level.filter(F.col("n") > 0)
    spread = F.sum(F.pow(F.col("good") - F.col("n") * p, 2) / (F.col("n") * p * (1 - p)))
    units, pages = F.count("*"), F.sum("n")
    correlation = F.when(pages > units, (spread - units) / (pages - units))
    strength = F.when(correlation > 0, 1 / correlation - 1).otherwise(STRONGEST)
    fitted = seen.agg(F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)), F.lit(STRONGEST)).alias("_strength"))
    with_prior = level.join(F.broadcast(fitted))  # a one-row aggregate
    posterior = (F.col("good") + F.col("_strength") * p) / (F.col("n") + F.col("_strength"))
    return with_prior.withColumn(rate, posterior).withColumnRenamed("_strength", f"{rate}_strength")


def host_reputations(outcomes: DataFrame) -> DataFrame:
    """host, n, upper bound of the good rate, from (host, n, good) rows of labelled counts (0 where there are none)."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall"))
    suffixes = shrunk(suffixes.join(F.broadcast(overall)), "overall", "suffix_rate")
    domains = shrunk(domains.join(suffixes.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "domain_rate")
    rated = shrunk(hosts.join(domains.select("suffix", "domain", "domain_rate"), ["suffix", "domain"]), "domain_rate", "rate")
    weight = F.col("n") + F.col("rate_strength")
    upper = F.col("rate") + Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return rated.select("host", "n", upper.alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labels for pages (page_id, url) and labels (doc_id, quality, toxic) of the same ids."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    outcomes = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good"))
    labelled = split.select("page_id", "host").join(outcomes, "page_id", "left")
    counts = labelled.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = split.join(host_reputations(counts), "host")
    by_method = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.col("n").alias("host_labels"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _shrunk_sql(name: str, source: str, parent: str, rate: str) -> str:
    return f"""
{name}_fit AS (SELECT coalesce(greatest({WEAKEST}, least({STRONGEST}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {STRONGEST} END)), {STRONGEST}) AS strength FROM (
  SELECT CASE WHEN sum(n) > count(*) THEN (sum(power(good - n * {parent}, 2) / (n * {parent} * (1 - {parent}))) - count(*)) / (sum(n) - count(*)) END AS rho FROM {source} WHERE n > 0)),
{name} AS (SELECT s.*, strength, (good + strength * {parent}) / (n + strength) AS {rate} FROM {source} s, {name}_fit)"""


OP7_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcomes AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
counted AS (SELECT host, sum(coalesce(n, 0)) AS n, sum(coalesce(good, 0)) AS good FROM split LEFT JOIN outcomes USING (page_id) GROUP BY 1),
suffixed AS (SELECT *, regexp_extract(host, '(?:^|[.])((?:(?:{SECOND_LEVEL})[.])?[a-z]{{2}}|[^.]*)$', 1) AS suffix FROM counted),
hosts AS (SELECT *, regexp_extract(substr(host, 1, length(host) - length(suffix)), '([^.]*[.])$', 1) || suffix AS domain FROM suffixed),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
s0 AS (SELECT s.*, o.overall FROM suffixes s, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS overall FROM suffixes) o),
{_shrunk_sql("s1", "s0", "overall", "suffix_rate")},
d0 AS (SELECT d.*, suffix_rate FROM domains d JOIN s1 USING (suffix)),
{_shrunk_sql("d1", "d0", "suffix_rate", "domain_rate")},
h0 AS (SELECT h.*, domain_rate FROM hosts h JOIN d1 USING (suffix, domain)),
{_shrunk_sql("h1", "h0", "domain_rate", "rate")},
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN rate + {Z} * sqrt(rate * (1 - rate) / (n + strength + 1)) < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict, CAST(n AS BIGINT) AS host_labels
FROM ruled JOIN h1 USING (host)
"""
