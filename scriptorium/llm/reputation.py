"""URL filters: rules first, and an empirical-Bayes reputation of hosts for all other pages.

Labelled outcomes are counted per host, then summed to registered domains and suffixes. Each level is shrunk towards
the one above it: a suffix towards the corpus, a domain towards its suffix, a host towards its domain, by beta priors
of a strength that the spread of the rates between the siblings themselves gives (moments of the beta-binomial). A
page is blocked when even the lower bound of its host's posterior bad rate is over a limit; nothing else decides.

The registered domain of a host is the suffix and one label more. Suffixes come from a bounded set of rules, a parameter: the
longest rule that fits counts, ``*.`` stands for any one label, ``!`` marks an exception, whose suffix is one label shorter; where
no rule fits, the last label is the suffix. User names, ports and closing dots belong to no level, and numeric addresses are domains of their own,
under one suffix of all of them.

Only counts per host are joined back, never pages with each other, so a host of any size is one narrow row.

Defined results: a null url, or one without ``://``, has the empty host and path; pages without a label count for no
rate; repeated rows are judged alike (and count again in the rates); empty tables give empty results; hosts without labels get
the mean of the nearest level that has some; very long urls are judged whole; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import ascii_lower, broadcast_if_small, materialize

#: A page is blocked when the bad rate of its host is over LIMIT with about 95 percent certainty.
LIMIT = 0.3
Z = 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 200.0
#: Second-level names under which countries register domains, and countries that do so; a larger set of
#: rules may be given instead.
SECOND_LEVEL = {
    "ac": "at cn cr id il in jp kr nz rs th ug uk za zm",
    "co": "at bw ck cr id il in jp ke kr ls ma mz nz th tz ug uk uz ve vi za zm zw",
    "com": "ar au bd bh bn bo br bz cn co cy do ec eg et fj gh gt hk jm kh kw lb ly mt mx my na ng ni np om pa pe ph pk pl pr py qa ro sa sg sv tn tr tw ua uy vc ve vn",
    "edu": "ar au br cn co hk mx my ng pe ph pk pl sg tr tw ua vn",
    "gov": "ar au br cn co hk il in my ng ph pk pl sg tr tw ua uk vn za",
    "net": "ar au br cn co hk id il in mx my nz pe ph pk pl sg tr tw ua uk vn za",
    "org": "ar au br cn co hk il in mx my ng nz pe ph pk pl sg tr tw ua uk vn za",
}
SUFFIX_RULES = frozenset(f"{name}.{country}" for name, countries in SECOND_LEVEL.items() for country in countries.split()) | {
    "ne.jp", "or.jp", "go.jp", "or.kr", "go.kr", "ltd.uk", "plc.uk", "me.uk", "nhs.uk", "id.au", "geek.nz", "gen.nz", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp",
    "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "wordpress.com",
}


#: What of a host belongs to no level, numeric addresses, and the suffix that stands for all of these.
OUTSIDE = r"^.*@|\.*(?::\d*)?$"
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"
ADDRESSES = "[address]"


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits the host or one of its parents, else nulls."""
    fits = []
    for verdict, rule in rules:
        at, _, below = rule.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        fits.append((rule, verdict, fit))
    ordered = sorted(fits, key=lambda f: -len(f[0]))
    choose = lambda k: reduce(lambda c, f: c.when(f[2], F.lit(f[k])), ordered[1:], F.when(ordered[0][2], F.lit(ordered[0][k])))
    return (choose(0), choose(1)) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def levels(host: Column, rules: Iterable[str] = SUFFIX_RULES) -> tuple[Column, Column]:
    """The registered domain and its suffix."""
    name = F.regexp_replace(host, OUTSIDE, "")
    labels = F.split(name, r"\.", -1)
    rules = sorted(rules)
    plain = [r for r in rules if r[0] not in "*!"]
    any_label = [r.removeprefix("*.") for r in rules if r.startswith("*.")]
    exceptions = [r.removeprefix("!") for r in rules if r.startswith("!")]
    deepest = max((r.count(".") + 1 for r in rules), default=1)

    def last(n: int | Column) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), ".")

    n = F.lit(1)
    for k in range(2, deepest + 1):  # the longest fitting rule is met last
        n = F.when((F.size(labels) >= k) & (last(k).isin(plain) | last(k - 1).isin(any_label)), k).otherwise(n)
    for k in range(2, deepest + 1):
        n = F.when((F.size(labels) >= k) & last(k).isin(exceptions), k - 1).otherwise(n)
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(last(n + 1)), F.when(address, ADDRESSES).otherwise(last(n))


def strength(children: DataFrame) -> float:
    """The prior strength of a level by the method of moments over all its children (n, bad, prior mean m).

    One child with labels says nothing of the spread between children, so the prior is as weak as allowed then.
    """
    # E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) rho), and strength = 1 / rho - 1
    sums = children.where("n > 1 and m > 0 and m < 1").agg(
        F.count(F.lit(1)),
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2)),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)),
    )
    known, spread, expected, weight = sums.first()  # one row
    if known < 2:
        return WEAKEST
    if not weight or spread <= expected:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, weight / (spread - expected) - 1))


def reputation(outcomes: DataFrame, suffixes: Iterable[str] = SUFFIX_RULES) -> DataFrame:
    """From (host, bad 0/1 or null) per page: per host its counts, posterior mean and lower bound."""
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = materialize(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1)

    def shrunk(children: DataFrame) -> DataFrame:
        """The beta posterior (a, b) of each child under the prior with mean m; no prior counts for more pages than back its mean."""
        k = F.greatest(F.lit(WEAKEST), F.least(F.lit(strength(children)), F.col("backed")))
        return children.withColumn("a", F.col("m") * k + F.col("bad")).withColumn("b", (1 - F.col("m")) * k + F.col("n") - F.col("bad"))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    size = F.col("a") + F.col("b")
    top = shrunk(suffixes.withColumns({"m": F.lit(overall), "backed": F.lit(float(n or 0))})).select("suffix", mean.alias("m"), size.alias("backed"))
    middle = materialize(shrunk(domains.join(top, "suffix")).select("domain", mean.alias("m"), size.alias("backed")), "domain-rates")
    low = shrunk(hosts.join(middle, "domain"))
    # the normal bound of the beta posterior, continuous at both ends
    return low.select("host", "domain", "suffix", "pages", "n", "bad", mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("lower_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower_bound); outcomes are distinct (page_id, bad) rows."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    scores = materialize(reputation(rows.join(labels, "page_id", "left").select("host", "bad")), "host-reputation")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower_bound") > limit, "block").otherwise("allow")
    judged = rows.join(broadcast_if_small(scores.select("host", "bad_rate", "lower_bound")), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "lower_bound")
