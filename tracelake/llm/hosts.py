"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts for all other pages.

The labelled outcomes of a host's pages (poor or toxic, or neither) are shrunk through beta-binomial priors: all pages
give the prior of a suffix, a suffix's posterior is the prior of its registered domains, a domain's that of its hosts,
each time without the member's own outcomes.  The strength of a level's priors is fitted by moments from the spread of
its members' rates around their priors, and is never more than the outcomes that a prior rests on.  A host is blocked if
a lower bound of its posterior bad rate is over ``MOST_BAD``.

All of it is DataFrame work; outcomes are pre-aggregated by host, and later levels see one row per host at most.

Edge cases: a url that is null or has no ``://`` has an empty host and path, which share one reputation like a host; a
host without a dot is its own domain and suffix; a page without a label has a verdict by its host; labels that are null
in both fields are none; a document that is labelled twice is bad if any label says so; repeated pages are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import materialise

#: Suffixes of two parts; all others are the last part.
TWO_PART = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "co.in", "co.jp", "co.kr", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
#: Posterior standard deviations under the mean, and the bad rate above which a host is blocked.
DEVIATIONS, MOST_BAD = 1.645, 0.5
#: Bounds of the spread of a level, as the correlation of two outcomes of a member.
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5

Rule = tuple[str, str, str]


def with_host_and_path(rows: DataFrame) -> DataFrame:
    """Adds ``host``, with A-Z lower-cased, and ``path`` of ``url``; both are empty if there is no ``://``."""
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumns({"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest of (verdict, host, path) that fits, as a struct of rule and verdict, null if none does."""
    fits = None
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        at = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        one = F.when(at, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        fits = one if fits is None else F.coalesce(fits, one)
    return fits


def with_levels(rows: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of ``host``, without a port or user."""
    labels = F.split(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    two = last(2).isin(*TWO_PART)
    return rows.withColumns({"suffix": F.when(two, last(2)).otherwise(last(1)), "domain": F.when(two, last(3)).otherwise(last(2))})


def _fitted(members: DataFrame) -> DataFrame:
    """Adds ``strength``, what the prior of a member counts for, to members with ``n`` outcomes, ``y`` bad ones, and a
    ``prior`` mean that rests on ``worth`` outcomes.

    The level's spread is (sum of n (rate - prior)^2 / (prior (1 - prior)) - members) / sum of (n - 1); the strength that
    follows from it is no more than ``worth``.
    """
    p = F.col("prior")
    seen = members.filter(F.col("n") > 0)
    excess = F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - p, 2) / (p * (1 - p))) - F.count(F.lit(1))
    spread = F.coalesce(excess / F.nullif(F.sum(F.col("n") - 1), F.lit(0)), F.lit(LEAST_SPREAD))
    spread = F.least(F.greatest(spread, F.lit(LEAST_SPREAD)), F.lit(MOST_SPREAD))
    fitted = seen.agg(((1 - spread) / spread).alias("fitted"))
    return members.crossJoin(F.broadcast(fitted)).withColumn("strength", F.least("fitted", "worth")).drop("fitted")  # one row


def _below(members: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``prior`` and ``worth`` of members from their parents: the parent's own prior and what its other members show."""
    above = parents.select(*keys, F.col("n").alias("_n"), F.col("y").alias("_y"), F.col("prior").alias("_prior"), F.col("strength").alias("_strength"))
    worth = F.col("_strength") + F.col("_n") - F.col("n")
    prior = (F.col("_strength") * F.col("_prior") + F.col("_y") - F.col("y")) / worth
    return members.join(above, keys).withColumns({"worth": worth, "prior": prior}).drop("_n", "_y", "_prior", "_strength")


def reputations(outcomes: DataFrame) -> DataFrame:
    """``host``, ``n``, ``bad_rate`` and ``bad_bound`` of every host of ``outcomes`` (host, bad: boolean or null)."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("y"))
    hosts = materialise(with_levels(counts))
    both = F.sum("n").alias("n"), F.sum("y").alias("y")
    everything = hosts.agg(*both).select(F.coalesce("n", F.lit(0)).alias("_n"), F.coalesce("y", F.lit(0)).alias("_y"))
    others = F.col("_n") - F.col("n") + 2
    suffixes = hosts.groupBy("suffix").agg(*both).crossJoin(F.broadcast(everything))  # one row
    suffixes = _fitted(suffixes.withColumns({"worth": others.cast("double"), "prior": (F.col("_y") - F.col("y") + 1) / others}))
    domains = _fitted(_below(hosts.groupBy("domain", "suffix").agg(*both), suffixes, ["suffix"]))
    judged = _fitted(_below(hosts, domains, ["domain", "suffix"]))
    total = F.col("strength") + F.col("n")
    rate = (F.col("strength") * F.col("prior") + F.col("y")) / total
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (total + 1))
    return judged.withColumn("bad_rate", rate).select("host", "n", "bad_rate", (F.col("bad_rate") - DEVIATIONS * deviation).alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``bad_rate`` and ``bad_bound``.

    A page's outcome is the label of the document whose number is in its path.
    """
    rows = with_host_and_path(pages.select("page_id", "url"))
    rows = rows.select("page_id", "host", "path", F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)").alias("doc_id"))
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    outcomes = known.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    known_hosts = reputations(rows.join(outcomes, "doc_id", "left").select("host", "bad"))
    fitting = rule_of(rules)
    judged = rows.join(known_hosts, "host").withColumn("_rule", fitting)
    by_method = F.when(F.col("bad_bound") > MOST_BAD, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", by_method).alias("verdict"), "bad_rate", "bad_bound")
