"""Empirical-Bayes host reputation and URL verdicts, in DataFrame functions only.

Labelled page outcomes are counted per host, registered domain and suffix. A
beta-binomial prior is handed down suffix -> domain -> host: each level's rate
is shrunk towards its parent's with a strength fitted to the spread of that
level's rates (method of moments). Where rates differ no more than chance makes
them, the strength is as good as infinite and all take their parent's rate. A
posterior is no surer than its parent: the parent's variance counts by the
prior's share in the mean, and the weight is that of a beta distribution with
the total variance. A host is blocked when the lower
end of its posterior's interval lies above the overall rate times a ratio: the
verdict compares hosts and does not depend on how bad the corpus is. A host
without labels takes its domain's posterior, a new domain its suffix's, a new
suffix the overall one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the fitted prior strength, in pages: a prior weighs one page at
#: least; the upper end stands for no spread at all and only prevents overflow.
LEAST, MOST = 1.0, 1e9
#: A host with more than this share of all pages is hot; there are at most as many as the inverse.
HOT_SHARE = 0.001


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The name under which a host is counted: without user, port and final dot."""
    named = F.regexp_replace(host, r"(?s)^.*@", "")
    return F.regexp_replace(named, r"[.]?(:[0-9]*)?\z", "")


def _address(key: Column) -> Column:
    return key.rlike(r"^[0-9]+([.][0-9]+){3}$") | key.startswith("[")


def registered_domain(key: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The suffix and one label more; a bare suffix, an address or an empty key is itself."""
    parts = F.split(key, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(-F.size(parts), F.lit(-2)), 2), ".")
    keep = F.when(two.isin(*long_suffixes), 3).otherwise(2) if long_suffixes else F.lit(2)
    return F.when((F.size(parts) <= keep) | _address(key), key).otherwise(F.array_join(F.slice(parts, -keep, keep), "."))


def public_suffix(key: Column, long_suffixes: Sequence[str] = ()) -> Column:
    """The last label, or the last two where ``long_suffixes`` has them; addresses share one."""
    parts = F.split(key, r"\.")
    one = F.element_at(parts, -1)
    two = F.array_join(F.slice(parts, F.greatest(-F.size(parts), F.lit(-2)), 2), ".")
    named = F.when(two.isin(*long_suffixes), two).otherwise(one) if long_suffixes else one
    return F.when(_address(key), F.lit("(address)")).otherwise(named)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest rule that fits, else nulls.

    A rule ``host/path`` fits its host and all subdomains where the path
    starts with the rule's.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _strength(level: DataFrame, rate: str, prior: str) -> Column:
    """Method-of-moments prior strength of a level, as an aggregate.

    With e = sum (rate - prior)^2 * n, its expectation under strength m is
    about sum prior (1 - prior) * (1 + (n - 1) / (m + 1)); solved for m + 1.
    """
    v = F.col(prior) * (1 - F.col(prior))
    spread = F.sum(F.col("n") * (F.col(rate) - F.col(prior)) ** 2) - F.sum(v)
    room = F.sum(v * (F.col("n") - 1))
    m = F.when(spread <= 0, F.lit(MOST)).otherwise(room / spread - 1)
    return F.coalesce(F.least(F.greatest(m, F.lit(LEAST)), F.lit(MOST)), F.lit(MOST))


def _lower(mean: Column, weight: Column, z: float) -> Column:
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (weight + 1)))


def reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[dict[str, DataFrame], float, float]:
    """Posteriors per ``key``, ``domain`` and ``suffix``; overall mean and weight.

    ``outcomes``: ``key, domain, suffix, bad`` with ``bad`` 0, 1 or null
    (null: not labelled, ignored). Each table has its keys, ``mean`` and
    ``weight``. Counting pre-aggregates per host, so a hot host is one row per
    task before any shuffle; every level is written once and only two numbers
    per level reach the driver. The overall rate starts at one bad page in two.
    """
    hosts = (
        outcomes.where(F.col("bad").isNotNull())
        .groupBy("suffix", "domain", "key")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    )
    hosts = materialise(hosts, "hosts")  # one row per labelled host
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b")).first()
    overall, weight = (total["b"] + 1) / (total["n"] + 2), total["n"]

    def shrunk(level: DataFrame, label: str) -> DataFrame:
        level = materialise(level.withColumn("rate", F.col("b") / F.col("n")), label)
        m = level.agg(_strength(level, "rate", "prior").alias("m")).first()["m"]
        mean = (F.col("b") + m * F.col("prior")) / (F.col("n") + m)
        variance = 1 / (F.col("n") + m + 1) + (m / (F.col("n") + m)) ** 2 / (F.col("prior_weight") + 1)
        return level.withColumn("mean", mean).withColumn("weight", 1 / variance - 1)

    def rolled(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

    suffix = shrunk(rolled("suffix").withColumns({"prior": F.lit(overall), "prior_weight": F.lit(weight)}), "suffixes")
    up = suffix.select("suffix", F.col("mean").alias("prior"), F.col("weight").alias("prior_weight"))
    domain = shrunk(rolled("suffix", "domain").join(up, "suffix"), "domains")
    up = domain.select("suffix", "domain", F.col("mean").alias("prior"), F.col("weight").alias("prior_weight"))
    key = shrunk(hosts.join(up, ["suffix", "domain"]), "posteriors")
    return {"key": key, "domain": domain, "suffix": suffix}, overall, weight


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    ratio: float = 1.0,
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = 1.645,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """``(id, host, path, rule, verdict, mean, lower, level)`` per page row.

    ``outcomes``: ``url, bad``. A rule decides where one fits; else the page is
    blocked if the lower bound of its host's posterior exceeds ``ratio`` times
    the overall mean; with ``z`` 1.645 and ratio 1 that means: worse than the
    average page with a probability of about 19 in 20. Ports, user names
    and a final dot do not make another host, an address is its own domain. A
    null url, or one without ``://``, has an empty host and path and is judged
    by the posterior of the empty host like any other. Urls may be of any
    length. Of two rules of one length that fit, the one later in the alphabet
    holds. Repeated rows stay, an empty table gives none, other columns are not
    read. Pages join the posteriors after these are one row per host; hosts
    with more than ``HOT_SHARE`` of the pages, at most a thousand, are broadcast
    to theirs and only the other pages are shuffled.
    """

    def placed(df: DataFrame, col: str) -> DataFrame:
        df = df.withColumn("host", url_host(F.col(col)))
        df = df.withColumn("key", host_key(F.col("host")))
        return df.withColumn("domain", registered_domain(F.col("key"), long_suffixes)).withColumn(
            "suffix", public_suffix(F.col("key"), long_suffixes)
        )

    tables, overall, weight = reputation(placed(outcomes.select("url", "bad"), "url"), z)
    seen = placed(pages.select(F.col(id_col), F.col(url_col).alias("__url")), "__url").withColumn("path", url_path(F.col("__url")))
    # One row per host that occurs: its posterior, from the nearest labelled level.
    known = seen.groupBy("key", "domain", "suffix").agg(F.count(F.lit(1)).alias("pages"))
    levels = ["key", "domain", "suffix"]
    for level in levels:
        part = tables[level].select(
            F.col(level).alias(f"{level}_k"), F.col("mean").alias(f"{level}_mean"), F.col("weight").alias(f"{level}_weight")
        )
        known = known.join(part, F.col(level) == F.col(f"{level}_k"), "left").drop(f"{level}_k")
    mean = F.coalesce(*[F.col(f"{x}_mean") for x in levels], F.lit(overall))
    sure = F.coalesce(*[F.col(f"{x}_weight") for x in levels], F.lit(weight))
    at = reduce(lambda rest, x: F.when(F.col(f"{x}_mean").isNotNull(), F.lit(x)).otherwise(rest), reversed(levels), F.lit("all"))
    known = known.select(F.col("key").alias("__key"), "pages", mean.alias("mean"), _lower(mean, sure, z).alias("lower"), at.alias("level"))
    known = materialise(known, "known")
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > ratio * overall, F.lit("block")).otherwise(F.lit("allow"))
    total = known.agg(F.sum("pages").alias("n")).first()["n"] or 0
    hot = known.where(F.col("pages") > HOT_SHARE * total)
    usual = seen.join(F.broadcast(hot.select("__key")), F.col("key") == F.col("__key"), "left_anti")
    usual = usual.join(known.where(F.col("pages") <= HOT_SHARE * total), F.col("key") == F.col("__key"))
    return seen.join(F.broadcast(hot), F.col("key") == F.col("__key")).unionByName(usual).select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "mean", "lower", "level"
    )
