"""URL filters: host rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled outcomes are counted per host. Beta-binomial priors shrink them from suffix to
registered domain to host: each level's concentration is estimated by moments from the spread
of its groups around their parents. A url is blocked where the lower posterior bound of its
host's share of bad outcomes exceeds a threshold. Hosts without outcomes take the bound that
follows from their domain, and domains without any that of their suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailtally.llm.common import LOWER, UPPER, table
from trailtally.session import pin

# The rules of the query (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

# Suffixes of two labels; everything else has one.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")

THRESHOLD = 0.5
Z = 1.645
SMALLEST_RHO, LARGEST_RHO = 0.001, 0.9

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def registered_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix. A host of one label is its own domain and suffix."""
    last_two = F.substring_index(host, ".", -2)
    double = last_two.isin(list(suffixes))
    domain = F.when(double, F.substring_index(host, ".", -3)).otherwise(last_two)
    return domain, F.when(double, last_two).otherwise(F.substring_index(host, ".", -1))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null. Equal lengths: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _concentration(groups: DataFrame, prior: str) -> Column:
    """Pseudo-count of the beta prior of ``groups`` (n, bad, prior mean), by moments, one row."""
    p, n = F.col(prior), F.col("n")
    noise = F.sum(n * p * (1 - p))
    spread = F.sum((F.col("bad") - n * p) * (F.col("bad") - n * p)) - noise
    room = F.sum(n * (n - 1) * p * (1 - p))
    rho = F.when(room > 0, F.greatest(F.lit(SMALLEST_RHO), F.least(F.lit(LARGEST_RHO), spread / room)))
    return groups.agg((1 / F.coalesce(rho, F.lit(SMALLEST_RHO)) - 1).alias("s")).scalar()


class Reputation(NamedTuple):
    """Lower posterior bounds of the share of bad outcomes, for hosts as far as they are known.

    ``hosts`` has (host, n, bad_mean, bad_low) of labelled hosts, ``domains`` (domain, bad_low) for
    other hosts of their domains, ``suffixes`` (suffix, bad_low) for other domains, and ``bad_low`` is
    for all else.
    """

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    bad_low: Column


def _low(mean: Column, strength: Column) -> Column:
    return mean - Z * F.sqrt(mean * (1 - mean) / (strength + 1))


def reputation(outcomes: DataFrame) -> Reputation:
    """Posteriors from rows (host, bad boolean).

    One row per host; outcomes without a host or verdict are left out. Copies are counted where
    they lie, so a host with a third of all rows sends one row per task. A host without
    outcomes is judged by what is known of its domain, else of its suffix, as a draw from there.
    """
    known = outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull())
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    domain, suffix = registered_domain(F.col("host"))
    # Each level is small and used several times, so it is stored once.
    hosts = pin(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Half a bad and half a good outcome keep the overall share inside (0, 1).
    overall = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("m")).scalar()

    def posterior(level: DataFrame, prior: str) -> tuple[DataFrame, Column]:
        """``level`` with ``mean`` and ``s``, the concentration around ``prior``, also by itself."""
        level = pin(level)
        s = _concentration(level, prior)
        mean = (F.col("bad") + F.col("s") * F.col(prior)) / (F.col("n") + F.col("s"))
        return pin(level.withColumn("s", s).withColumn("mean", mean)), s

    suffixes, s1 = posterior(suffixes.withColumn("m0", overall), "m0")
    domains, s2 = posterior(domains.join(suffixes.select("suffix", F.col("mean").alias("m1")), "suffix"), "m1")
    hosts, s3 = posterior(hosts.join(domains.select("domain", F.col("mean").alias("m2")), "domain"), "m2")
    return Reputation(
        hosts.select(
            "host", "n", F.col("mean").alias("bad_mean"), _low(F.col("mean"), F.col("n") + F.col("s")).alias("bad_low")
        ),
        domains.select("domain", _low(F.col("mean"), s3).alias("bad_low")),
        suffixes.select("suffix", _low(F.col("mean"), s2).alias("bad_low")),
        _low(overall, s1),
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad_mean, bad_low) of the labelled hosts; see :func:`reputation`."""
    return reputation(outcomes).hosts


def bad_hosts(hosts: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the distinct ``hosts`` (host) whose bound is above the threshold, labelled or not."""
    found = reputation(outcomes)
    domain, suffix = registered_domain(F.col("host"))
    bound = F.coalesce("_host_low", "_domain_low", "_suffix_low", found.bad_low)
    return (
        hosts.withColumns({"domain": domain, "suffix": suffix})
        .join(found.hosts.select("host", F.col("bad_low").alias("_host_low")), "host", "left")
        .join(found.domains.select("domain", F.col("bad_low").alias("_domain_low")), "domain", "left")
        .join(found.suffixes.select("suffix", F.col("bad_low").alias("_suffix_low")), "suffix", "left")
        .filter(bound > threshold)
        .select("host")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every page with host, path, rule, verdict and the posterior bound of its host.

    Rules are a short list and become one expression. A url without a host is allowed unless a rule
    blocks it; one of a host nobody labelled is judged by its domain, or by its suffix. Rows with equal urls or ids are judged
    each for itself; an empty table gives no rows. ``outcomes`` are rows (host, bad).
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decision = fitting_rule(F.col("host"), F.col("path"), rules)
    # Hosts are judged once each, however many pages they have.
    hosts = parts.filter(F.col("host") != "").select("host").distinct()
    bad = bad_hosts(hosts, outcomes, threshold).select("host", F.lit(True).alias("_bad"))
    judged = parts.withColumns({"rule": rule, "_decision": decision}).join(bad, "host", "left")
    method = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_decision", method).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page shows the document its path ends in, whose quality label is the outcome."""
    host, path = url_parts(F.col("url"))
    shown = pages.select(
        host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:/|\.html)?$", 1).alias("_number")
    )
    numbered = shown.filter(F.col("_number") != "").withColumn("_number", F.col("_number").cast("bigint"))
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    return numbered.join(marks, numbered["_number"] == marks["doc_id"]).select(
        "host", (F.col("_quality") == 0).alias("bad")
    )


def url_verdicts(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, table(spark, folder, "labels")))


URL_FILTER_SQL = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), numbered AS (
    SELECT host, try_cast(regexp_extract(path, '/([0-9]{1,18})(?:/|\.html)?$', 1) AS BIGINT) AS doc_id FROM parts
), marks AS (
    SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), hosts AS (
    SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (quality = 0))::DOUBLE AS bad,
           array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') AS domain,
           list_extract(string_split(host, '.'), -1) AS suffix
    FROM numbered JOIN marks USING (doc_id) GROUP BY host
), overall AS (
    SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m0 FROM hosts
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m0 FROM hosts, overall GROUP BY suffix
), s1 AS (
    SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * m0 * (1 - m0)) > 0 THEN greatest(0.001, least(0.9,
           (sum((bad - n * m0) * (bad - n * m0)) - sum(n * m0 * (1 - m0))) / sum(n * (n - 1) * m0 * (1 - m0)))) END,
           0.001) - 1 AS s FROM suffixes
), domains AS (
    SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad,
           any_value((x.bad + s1.s * x.m0) / (x.n + s1.s)) AS m1
    FROM hosts h JOIN suffixes x USING (suffix), s1 GROUP BY h.domain, h.suffix
), s2 AS (
    SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * m1 * (1 - m1)) > 0 THEN greatest(0.001, least(0.9,
           (sum((bad - n * m1) * (bad - n * m1)) - sum(n * m1 * (1 - m1))) / sum(n * (n - 1) * m1 * (1 - m1)))) END,
           0.001) - 1 AS s FROM domains
), domain_means AS (
    SELECT d.domain, (d.bad + s2.s * d.m1) / (d.n + s2.s) AS m2 FROM domains d, s2
), shrunk AS (
    SELECT h.host, h.n, h.bad, d.m2 FROM hosts h JOIN domain_means d USING (domain)
), s3 AS (
    SELECT 1 / coalesce(CASE WHEN sum(n * (n - 1) * m2 * (1 - m2)) > 0 THEN greatest(0.001, least(0.9,
           (sum((bad - n * m2) * (bad - n * m2)) - sum(n * m2 * (1 - m2))) / sum(n * (n - 1) * m2 * (1 - m2)))) END,
           0.001) - 1 AS s FROM shrunk
), means AS (
    SELECT host, n, s, (bad + s * m2) / (n + s) AS mean FROM shrunk, s3
), host_lows AS (
    SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) AS low FROM means
), domain_lows AS (
    SELECT domain, m2 - 1.645 * sqrt(m2 * (1 - m2) / (s3.s + 1)) AS low FROM domain_means, s3
), suffix_means AS (
    SELECT x.suffix, (x.bad + s1.s * x.m0) / (x.n + s1.s) AS m1 FROM suffixes x, s1
), suffix_lows AS (
    SELECT suffix, m1 - 1.645 * sqrt(m1 * (1 - m1) / (s2.s + 1)) AS low FROM suffix_means, s2
), all_low AS (
    SELECT m0 - 1.645 * sqrt(m0 * (1 - m0) / (s1.s + 1)) AS low FROM overall, s1
), every_host AS (
    SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') AS domain,
           list_extract(string_split(host, '.'), -1) AS suffix
    FROM parts WHERE host <> ''
), bad_hosts AS (
    SELECT e.host
    FROM every_host e LEFT JOIN host_lows h ON h.host = e.host LEFT JOIN domain_lows d ON d.domain = e.domain
    LEFT JOIN suffix_lows x ON x.suffix = e.suffix LEFT JOIN all_low a ON TRUE
    WHERE coalesce(h.low, d.low, x.low, a.low) > 0.5
), ruled AS (
    SELECT page_id, host, path,
           CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
                THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
                THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE r.rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
            WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled r LEFT JOIN bad_hosts b ON r.host = b.host
"""
