"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk from the whole web to the suffix, to
the registered domain, to the host: each level's prior is the level above with the weight of
``kappa`` pages, where kappa comes from the spread of host rates (beta-binomial moments). A
host is blocked where the lower bound of its posterior bad rate passes a limit.

Only counts per host are joined back to pages, so the pages are shuffled once, by host; a
hot host is pre-aggregated before its shuffle and its join partition can be split.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and is
allowed; urls of any length are read whole; hosts without labelled pages take the posterior
of their domain, suffix or the whole; with no labels at all every host is allowed; of rules
of equal length the first listed wins; repeated pages are judged alike and count as often as
they are there; a page's several outcomes all count; an empty table gives no rows; other
columns are carried through, but host, path, rule, verdict, mean and sd are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import ascii_lower, spare_names

#: Rules (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Public suffixes of two labels; every other suffix is the last label.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.mx", "co.za")


@dataclass(frozen=True)
class Prior:
    """The whole's bad rate and the weight in pages of each level's prior."""

    rate: float
    kappa: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.lit(""))
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null where none fits."""
    text = verdict = None
    for say, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        text = F.when(fits, at + start) if text is None else text.when(fits, at + start)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return text, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, user and port left out."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    wide = two.isin(*WIDE_SUFFIXES)
    return F.when(wide, three).otherwise(two), F.when(wide, two).otherwise(F.substring_index(bare, ".", -1))


def fit_prior(hosts: DataFrame) -> Prior:
    """Beta-binomial moments over hosts (columns n, bad): one row reaches the driver."""
    h = hosts.filter("n > 0")
    x = h.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    if not x["k"]:
        return Prior(0.0, 10.0)
    k, n, rate = x["k"], x["n"], x["bad"] / x["n"]
    if k < 2 or n <= k:
        return Prior(rate, 10.0)
    between = (x["q"] - n * rate * rate) / (k - 1)
    within = (x["bad"] - x["q"]) / (n - k)
    size = (n - x["nn"] / n) / (k - 1)
    spread = between + (size - 1) * within
    rho = min(max((between - within) / spread if spread > 0 else 0.0, 0.001), 0.5)
    return Prior(rate, (1 - rho) / rho)


def reputation(hosts: DataFrame, prior: Prior) -> DataFrame:
    """Per host (host, n, bad): posterior ``mean``, ``sd`` and ``pages`` of evidence."""
    domain, suffix = domain_of(F.col("host"))
    h = hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix"))
    by_domain = h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    kappa = F.lit(prior.kappa)

    def shrunk(bad: str, n: str, above: Column) -> Column:
        return (F.col(bad) + kappa * above) / (F.col(n) + kappa)

    by_suffix = by_suffix.select("suffix", shrunk("sbad", "sn", F.lit(prior.rate)).alias("s_mean"))
    by_domain = by_domain.join(by_suffix, "suffix").select("domain", shrunk("dbad", "dn", F.col("s_mean")).alias("d_mean"))
    mean = shrunk("bad", "n", F.col("d_mean"))
    return (
        h.join(by_domain, "domain")
        .select("host", "n", "bad", mean.alias("mean"))
        .withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + kappa + 1)))
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.5, z: float = 1.645, key: str = "page_id"
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the host's posterior.

    ``outcomes`` has (key, bad 0/1). Blocks where mean - z * sd > limit; a rule goes first.
    """
    host, path = url_parts(F.col("url"))
    own = ("host", "path", "rule", "verdict", "mean", "sd")
    (by_rule,) = spare_names([*pages.columns, *own], "ruled")
    parts = pages.select(*[c for c in pages.columns if c.lower() not in own], host.alias("host"), path.alias("path"))
    seen = outcomes.filter(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = (
        parts.select(key, "host")
        .join(seen, key, "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    known = reputation(hosts.filter("host <> ''"), fit_prior(hosts.filter("host <> ''")))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    bad = F.coalesce(F.col("mean") - F.lit(z) * F.col("sd") > F.lit(limit), F.lit(False))
    return (
        parts.withColumn("rule", rule)
        .withColumn(by_rule, ruled)
        .join(known.select("host", "mean", "sd"), "host", "left")
        .withColumn("verdict", F.coalesce(by_rule, F.when(bad, "block").otherwise("allow")))
        .drop(by_rule)
    )
