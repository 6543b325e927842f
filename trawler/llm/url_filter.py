"""URL filter by host reputation, with empirical-Bayes shrinkage. DataFrame functions only.

Labelled page outcomes are counted per host. The bad rate of a host is shrunk
towards its registered domain, that towards its suffix, and that towards the
rate of all pages: each level is a beta-binomial whose prior has the posterior
mean of the level above and a weight of so many pages. The weights are fitted
by moments from the spread of the children's rates around their parents'. A host is
blocked when the lower bound of its posterior exceeds ``max_bad_rate``. Listed
rules come first: the longest one that fits a host and path decides.

Null urls and urls without ``://`` have empty host and path; they fit no rule and
take the verdict of the empty host. Null labels and labels of no page count for
nothing; a host without labels has its domain's posterior. Repeated rows give
repeated results, and labels count once per page row and label row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm.frames import settled, small

#: (host, path prefix, verdict); a rule fits the host and all its subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Suffixes of two labels under which domains are registered. Fixed values.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za")

MAX_BAD_RATE = 0.5
Z = 1.96
WEIGHT_RANGE = (1.0, 1000.0)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(pages: DataFrame) -> DataFrame:
    rest = _rest(F.coalesce(F.col("url"), F.lit("")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return pages.withColumn("host", _lower_ascii(host)).withColumn("path", path)


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); else null."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = None
    for host, path, verdict in longest:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _weight(children: DataFrame) -> float:
    """Prior weight by moments. ``children``: n, k and the parent's mean."""
    mean, n, k = F.col("mean"), F.col("n"), F.col("k")
    chance = mean * (1 - mean)
    row = (
        children.filter("n > 0")
        .agg(
            F.sum((k - n * mean) * (k - n * mean) / n).alias("spread"),
            F.sum(chance).alias("chance"),
            F.sum(chance * (n - 1)).alias("room"),
        )
        .first()
    )
    low, high = WEIGHT_RANGE
    if row["spread"] is None or row["spread"] <= row["chance"] or not row["room"]:
        return high
    # E[(k - n m)^2 / n] = m (1 - m) (1 + (n - 1) rho), and rho = 1 / (weight + 1).
    rho = (row["spread"] - row["chance"]) / row["room"]
    return min(max(1 / rho - 1, low), high)


def reputation(hosts: DataFrame) -> DataFrame:
    """host, n, k -> host, bad_rate, bad_bound."""
    hosts = hosts.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    domains = settled(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = settled(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] is not None else 0.5

    level = suffixes.withColumn("mean", F.lit(mean))
    weight = _weight(level)
    posterior = (F.col("k") + weight * F.col("mean")) / (F.col("n") + weight)
    means = level.select("suffix", posterior.alias("mean"))

    level = settled(domains.join(means, "suffix"))
    weight = _weight(level)
    posterior = (F.col("k") + weight * F.col("mean")) / (F.col("n") + weight)
    means = level.select("suffix", "domain", posterior.alias("mean"))

    level = settled(hosts.join(means, ["suffix", "domain"]))
    weight = _weight(level)
    rate = (F.col("k") + weight * F.col("mean")) / (F.col("n") + weight)
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))
    return level.select("host", rate.alias("bad_rate"), F.greatest(F.lit(0.0), rate - Z * deviation).alias("bad_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad for every labelled page.

    A page is made from the document whose number its path ends in; that
    document's label is the outcome, bad if of low quality or toxic.
    """
    number = F.regexp_extract(F.col("path"), r"([0-9]+)(?:\.html|/)?$", 1)
    numbered = pages.select("host", number.alias("n")).select("host", F.expr("try_cast(n AS BIGINT)").alias("doc_id"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    told = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").select("doc_id", bad.alias("bad"))
    return numbered.filter("doc_id IS NOT NULL").join(told, "doc_id").select("host", "bad")


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound of every row."""
    judged = with_host_path(pages.select(F.col("page_id"), F.col("url")))
    outcomes = page_outcomes(judged.select("host", "path"), labels)
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    seen = judged.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    hosts = settled(counted.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    rated = judged.join(small(settled(reputation(hosts))), "host").withColumn("listed", rule_of(rules))
    own = F.when(F.col("bad_bound") > max_bad_rate, "block").otherwise("allow")
    return rated.select(
        "page_id",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), own).alias("verdict"),
        F.round("bad_rate", 9).alias("bad_rate"),
        F.round("bad_bound", 9).alias("bad_bound"),
    )
