"""URL filters: listed rules, and empirical-Bayes host reputation for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if the url is null or has no `://`."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def site_name(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, "^.*@|:[0-9]*$", "")


def registered_domain(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The last two labels, or three if the last two are one of the suffixes (no list of public
    suffixes is at hand, so none is the default); an address as a whole."""
    name = site_name(host)
    three = F.substring_index(name, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(is_address(name), name).when(three, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$") | name.startswith("[")


def strength(groups: DataFrame) -> tuple[float, float]:
    """(overall rate, prior strength) of a beta-binomial over groups (n, bad), by moments."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    k, total, hits, squares, spread = groups.where("n > 0").agg(F.count("*"), F.sum(n), F.sum(bad), F.sum(n * n), F.sum(bad * bad / n)).first()
    if not total:
        return 0.0, 1.0
    p = hits / total
    free = total - squares / total - (k - 1)
    if p in (0.0, 1.0) or free <= 0:
        return p, 1000.0
    rho = min(0.999, max(0.001, ((spread - total * p * p) / (p * (1 - p)) - (k - 1)) / free))
    return p, (1 - rho) / rho


def reputation(outcomes: DataFrame, lift: float = 1.25, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, risk_bound, blocked) from (host, bad): labelled pages by host, bad 0 or 1.

    A host's rate of bad pages is shrunk to its registered domain's, that to its suffix's and
    that to the overall rate, each by a beta-binomial prior whose strength is fitted by
    moments at its level. A host is blocked if the lower posterior bound, by the normal
    approximation mean less z standard deviations, exceeds `lift` times the overall rate. Only counts by host are shuffled.
    """
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad")).where("host is not null and n > 0"))
    hosts = hosts.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), F.when(is_address(site_name(F.col("host"))), site_name(F.col("host"))).otherwise(F.substring_index(site_name(F.col("host")), ".", -1)).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall, by_suffix = strength(suffixes)
    (_, by_domain), (_, by_host) = strength(domains), strength(hosts)

    def shrunk(prior: Column | float, weight: float) -> Column:
        return (F.col("bad") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    at_suffix = suffixes.select("suffix", shrunk(F.lit(overall), by_suffix).alias("suffix_rate"))
    at_domain = domains.join(at_suffix, "suffix").select("domain", shrunk(F.col("suffix_rate"), by_domain).alias("domain_rate"))
    mean = shrunk(F.col("domain_rate"), by_host)
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + by_host + 1))
    return hosts.join(at_domain, "domain").select("host", bound.alias("risk_bound"), (bound > lift * overall).alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, lift: float = 1.25, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of pages (page_id, url): (page_id, host, path, rule, verdict).

    labels (doc_id, quality, toxic) has outcomes of pages, doc_id being the page's id: a page
    is bad if any of its labels says quality 0 or toxic 1; labels null in both, or of no page,
    don't count. A page whose host has no labelled page, and a null or odd url, is allowed.
    Repeated pages count, and are returned, as often as they occur. Empty tables give an empty
    result, or one decided by the rules alone; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcome = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    outcome = outcome.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = reputation(judged.select("page_id", "host").join(outcome, "page_id").select("host", "bad"), lift, z, suffixes)
    fitted = rule_of(F.col("host"), F.col("path"), rules)
    return (
        judged.withColumn("fitted", fitted)
        .join(known.where("blocked").select("host", "blocked"), "host", "left")
        .select("page_id", "host", "path", F.col("fitted.rule").alias("rule"), F.coalesce("fitted.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
    )


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id
), h AS (
  SELECT host, CASE WHEN regexp_matches(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '^[0-9.]+$|^\[') THEN [regexp_replace(host, '^.*@|:[0-9]*$', '', 'g')] ELSE string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') END AS parts, count(bad)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM u JOIN o USING (page_id) GROUP BY host HAVING count(bad) > 0
), h2 AS (
  SELECT host, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix, n, bad FROM h
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
lv AS (
  SELECT 'h' AS lv, n, bad FROM h2 UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s
), m0 AS (
  SELECT lv, count(*) AS k, sum(n) AS t, sum(bad) / sum(n) AS p, sum(n * n) AS sq, sum(bad * bad / n) AS sp FROM lv GROUP BY lv
), m AS (
  SELECT lv, p, CASE WHEN p IN (0, 1) OR t - sq / t - (k - 1) <= 0 THEN 1000.0 ELSE (1 - rho) / rho END AS w
  FROM (SELECT *, CASE WHEN p IN (0, 1) OR t - sq / t - (k - 1) <= 0 THEN 0.5 ELSE least(0.999, greatest(0.001, ((sp - t * p * p) / (p * (1 - p)) - (k - 1)) / (t - sq / t - (k - 1)))) END AS rho FROM m0)
), ps AS (SELECT suffix, (bad + w * p) / (n + w) AS r FROM s, m WHERE lv = 's'),
pd AS (SELECT domain, (bad + w * r) / (n + w) AS r FROM d JOIN ps USING (suffix), m WHERE lv = 'd'),
ph AS (
  SELECT host, mu - 1.645 * sqrt(mu * (1 - mu) / (n + w + 1)) > 1.25 * p AS blocked
  FROM (SELECT host, n, w, (bad + w * r) / (n + w) AS mu, (SELECT p FROM m WHERE lv = 's') AS p FROM h2 JOIN pd USING (domain), m WHERE lv = 'h')
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, CASE WHEN ph.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (host, path) LEFT JOIN ph USING (host)
"""
