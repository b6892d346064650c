"""URL filter: rules by host and path, and an empirical-Bayes reputation of hosts for what no rule fits.

The pages that a rule fits are the labelled outcomes (blocked or not). Bad rates are shrunk level by level
with beta-binomial priors: every suffix towards the rate of all pages, every registered domain towards its
suffix, every host towards its registered domain. How strongly a level holds its members together is
estimated from all outcomes, by the method of moments; what few groups say about that counts little, so a level of
two or three groups with outcomes holds nobody tightly. A level's uncertainty is its own posterior variance and the
share it takes over from the level above. A host is blocked if the lower bound of its posterior bad rate is above
the threshold; where not even its suffix has an outcome nothing is known of it, and it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from knowloom.llm.shared import free_name, staged

#: Standard deviations below the posterior mean at which the bad rate is judged, and the rate from which a host is bad.
BOUND, THRESHOLD = 1.64, 0.5
#: Rules are configuration and become part of the plan; a longer list is refused.
MOST_RULES = 500
# Endings of two labels under which strangers register their names.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.cn", "com.tw", "com.hk", "com.sg", "co.in", "co.id", "co.il",
    "com.br", "com.mx", "com.ar", "com.co", "com.tr", "co.za", "com.pl", "com.ua", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "appspot.com", "web.app", "pages.dev", "netlify.app", "vercel.app",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or without ``://``: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule, as ``struct(rule, verdict)``, that fits host and path; null if none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's (which begins with ``/``).
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def bare(host: Column) -> Column:
    """The host without user and port, for the hierarchy of domains."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _long(name: Column, suffixes: tuple[str, ...]) -> Column:
    """True where a name stands under a suffix of two labels."""
    if not suffixes:
        return F.lit(False)
    return F.substring_index(name, ".", -2).isin(*suffixes) & name.contains(".") & (F.substring_index(name, ".", -2) != name)


def domain_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more; an address or a single label is its own."""
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).when(_long(name, suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label, or the last two if they are one of ``suffixes``; an address is its own suffix."""
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).when(_long(name, suffixes), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def _strength(level: DataFrame, mean: str) -> DataFrame:
    """One row ``s``: pseudo-counts with which a level holds to the means of the level above.

    Under a beta-binomial with means m and intra-class correlation r, the squared misses ``(k - n m)^2`` add up to
    ``n m (1 - m) (1 + (n - 1) r)``. Solve for r, keep it within [1 / (groups + 1), 0.999], and return ``(1 - r) / r``: that
    a few groups with outcomes are alike is no evidence that the next one is like them.
    """
    m = F.col(mean)
    spread = F.sum(F.col("n") * m * (1 - m))
    misses = F.sum(F.pow(F.col("k") - F.col("n") * m, F.lit(2.0)))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    r = F.when(pairs > 0, (misses - spread) / pairs).otherwise(F.lit(0.5))
    least = F.greatest(F.lit(0.001), 1 / (F.count_if(F.col("n") > 0) + 1))
    return level.agg(F.least(F.lit(0.999), F.greatest(least, r)).alias("r")).select(((1 - F.col("r")) / F.col("r")).alias("s"))


def reputations(judged: DataFrame, bound: float = BOUND, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host``, ``mean`` and ``low``: posterior bad rate and its lower bound of each host in ``judged``.

    ``judged`` has one row per page: ``host`` and ``bad`` (true, false, or null without an outcome). Hosts without an
    outcome take what their domain or suffix says. Without any outcome the rate of all pages is one half, and ``low`` is 0
    under a suffix without one. Pages are counted once, into one row per host; the levels are small tables: one row per host, domain and suffix, made by counts that combine before they move.
    """
    # Sums of whole numbers: the same however the pages are dealt.
    hosts = judged.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("k"))
    hosts = hosts.withColumn("name", bare(F.col("host"))).select("host", "n", "k", domain_of(F.col("name"), suffixes).alias("domain"), suffix_of(F.col("name"), suffixes).alias("suffix"))
    hosts = staged(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # Three levels, three numbers: each strength is one row and is read as such.
    n, k = F.coalesce(F.sum("n"), F.lit(0)) + 2, F.coalesce(F.sum("k"), F.lit(0)) + 1
    whole = ends.agg((k / n).alias("m"), (k / n * (1 - k / n) / (n + 1)).alias("v")).first()
    ends = ends.withColumns({"above": F.lit(float(whole.m)), "unsure": F.lit(float(whole.v)), "known": F.col("n") > 0})
    ends = _shrunk(ends, "suffix", "known")
    domains = _shrunk(domains.join(ends, "suffix"), "suffix", "domain", "known")
    hosts = _shrunk(hosts.join(domains, ["suffix", "domain"]), "host", "known")
    return hosts.select("host", F.col("above").alias("mean"), F.when(F.col("known"), F.col("above") - bound * F.sqrt("unsure")).otherwise(F.lit(0.0)).alias("low"))


def _shrunk(level: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with the posterior mean (``above``) and variance (``unsure``) of a level, from its counts and those of the level over it."""
    s = _strength(level, "above").first().s
    n, mean = F.col("n") + F.lit(s), (F.col("k") + F.lit(s) * F.col("above")) / (F.col("n") + F.lit(s))
    return level.select(*keys, mean.alias("above"), (mean * (1 - mean) / (n + 1) + F.pow(F.lit(s) / n, F.lit(2.0)) * F.col("unsure")).alias("unsure"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], bound: float = BOUND, threshold: float = THRESHOLD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``low`` (the bound; null where a rule decides).

    Null urls and urls without ``://`` have an empty host and path, fit no rule and share the reputation of the empty
    host. Repeated rows are judged alike and each counts as an outcome. Other columns stay; a clash of names moves the
    new column to ``host_1`` and so on. An empty table gives no rows.
    """
    names = {n: free_name(pages, n) for n in ("host", "path", "rule", "verdict", "low")}
    taken = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = taken.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    known = reputations(ruled.select("host", (F.col("by.verdict") == "block").alias("bad")), bound, suffixes)
    verdict = F.coalesce("by.verdict", F.when(F.col("low") > threshold, "block").otherwise("allow"))
    return ruled.join(known, "host").select("row.*", F.col("host").alias(names["host"]), F.col("path").alias(names["path"]), F.col("by.rule").alias(names["rule"]), verdict.alias(names["verdict"]), F.when(F.col("by").isNull(), F.col("low")).alias(names["low"]))
