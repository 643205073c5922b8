"""URL filters: fixed rules first, then the reputation of the host.

Labelled page outcomes (good or not) are counted per host and shrunk by beta-binomial
priors: the suffix towards all pages, the registered domain towards its suffix, the host
towards its domain. How strongly a level pulls is estimated from the spread of good rates
among its members (method of moments). A page whose host's lower posterior bound is under
the limit is blocked. Hosts without labels stand at the posterior of the nearest level
that has them. Suffixes of several labels (co.uk) come from a bounded list, a parameter; a
suffix is the last label where none of them fits. An IP address is its own domain and suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut

# Standard deviations below the posterior mean at which the bound lies (about 95 % one-sided).
Z = 1.645
LIMIT = 0.5
# Bounds of a prior's strength in labelled pages.
STRENGTH = (2.0, 1000.0)

# Suffixes of several labels under which anyone can register, by their last label.
_SHARED = {
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "au": "asn com edu gov id net org",
    "nz": "ac co geek gen govt iwi kiwi maori mil net org school",
    "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co go ne or pe re",
    "cn": "ac com edu gov net org",
    "tw": "com edu gov idv net org",
    "hk": "com edu gov idv net org",
    "sg": "com edu gov net org per",
    "my": "com edu gov mil name net org",
    "th": "ac co go in mi net or",
    "id": "ac co go my net or sch web",
    "ph": "com edu gov net ngo org",
    "vn": "com edu gov net org",
    "in": "ac co edu firm gen gov ind net nic org res",
    "pk": "com edu gov net org",
    "bd": "ac com edu gov net org",
    "lk": "ac com edu gov net org",
    "za": "ac co gov law mil net nom org web",
    "ke": "ac co go me ne or sc",
    "ng": "com edu gov net org",
    "eg": "com edu gov net org",
    "il": "ac co gov k12 muni net org",
    "sa": "com edu gov med net org sch",
    "tr": "av bel com edu gen gov k12 net org web",
    "ua": "com edu gov in kiev kyiv lviv net odessa org",
    "pl": "com edu gov info net org waw",
    "pt": "com edu gov org",
    "es": "com edu gob nom org",
    "gr": "com edu gov net org",
    "at": "ac co gv or",
    "hu": "co info org",
    "br": "art blog com edu eco gov ind jus leg mil net org",
    "ar": "com edu gob int net org tur",
    "mx": "com edu gob net org",
    "co": "com edu gov net nom org",
    "pe": "com edu gob net org",
    "ve": "co com edu gob net org",
    "uy": "com edu gub net org",
    "ec": "com edu gob net org",
    "io": "github gitlab readthedocs",
    "com": "appspot blogspot firebaseapp herokuapp s3.amazonaws wordpress",
    "net": "azurewebsites cloudfront",
    "app": "netlify vercel web",
    "dev": "fly pages workers",
    "org": "neocities",
}
SUFFIXES = tuple(f"{part}.{last}" for last, parts in _SHARED.items() for part in parts.split())
# Suffixes are a parameter that goes to every task; more than this are refused.
MAX_SUFFIXES = 20_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def rest_of(url: Column) -> Column:
    """What follows the first ``://`` up to a query or fragment; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"(?s)^[^/]*(/.*)$", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (name, verdict); null if none does.

    Rules of one length that both fit are taken in the order of their names.
    """
    chain = F
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chain = chain.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict")))
    return F.lit(None).cast("struct<name:string,verdict:string>") if chain is F else chain


def named(host: Column) -> Column:
    """The host for its levels: without a user's name, a port and dots at the end."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.+$", "")


def is_address(name: Column) -> Column:
    """Whether it is an IP address, of version 6 in brackets."""
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")


def suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that ends the host, or else its last label; addresses stay whole."""
    return _levels(host, suffixes)[1]


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix of a host and the label before it (all of a shorter one); addresses stay whole."""
    return _levels(host, suffixes)[0]


def _levels(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    if len(suffixes) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} suffixes")
    name = named(host)
    by_labels: dict[int, set[str]] = {}
    for each in suffixes:
        by_labels.setdefault(each.count(".") + 1, set()).add(each)
    domain_of = F.when(is_address(name), name)
    suffix_of = F.when(is_address(name), name)
    for labels in sorted(by_labels, reverse=True):
        end = F.substring_index(name, ".", -labels)
        fits = end.isin(sorted(by_labels[labels]))
        domain_of = domain_of.when(fits, F.substring_index(name, ".", -labels - 1))
        suffix_of = suffix_of.when(fits, end)
    return domain_of.otherwise(F.substring_index(name, ".", -2)), suffix_of.otherwise(F.substring_index(name, ".", -1))


def _strength(n: Column, good: Column) -> Column:
    """Strength of the prior that the good rates of a group's members suggest.

    With binomial noise alone the rates vary by mean * (1 - mean) / n; what they vary beyond
    that is the members' own, and the larger it is, the weaker the prior.
    """
    total, members = F.sum(n), F.count("*")
    mean = F.sum(good) / total
    noise = mean * (1 - mean)
    # Sum over members of n * (rate - mean)^2, written with sums that aggregate in one pass.
    spread = F.sum(good * good / n) - total * mean * mean
    scale = total - F.sum(n * n) / total
    between = F.try_divide(spread - (members - 1) * noise, scale)
    found = F.when(between > 0, noise / between - 1).otherwise(F.lit(STRENGTH[1]))
    return F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.coalesce(found, F.lit(STRENGTH[1]))))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior bound of every host of ``pages``.

    ``pages`` has page_id and host, ``outcomes`` page_id and good (boolean). Returns host,
    n and good (its labelled pages), mean and bound. Null outcomes count as unlabelled;
    repeated outcomes of one page each count. Without any label the overall mean is one half.
    """
    known = outcomes.where(F.col("good").isNotNull()).select(F.col("page_id").alias("_id"), "good")
    labelled = pages.join(known, F.col("page_id") == F.col("_id")).groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good")
    )
    hosts = pages.select("host").distinct().withColumnRenamed("host", "_host")
    counts = hosts.join(labelled, F.col("_host") == F.col("host"), "left").select(
        F.col("_host").alias("host"),
        registered_domain(F.col("_host"), suffixes).alias("domain"),
        suffix(F.col("_host"), suffixes).alias("suffix"),
        F.coalesce("n", F.lit(0.0)).alias("n"),
        F.coalesce("good", F.lit(0.0)).alias("good"),
    )
    counts = cut(counts, "host-counts")
    with_labels = counts.where("n > 0")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = with_labels.groupBy("domain", "suffix").agg(
        *sums, _strength(F.col("n"), F.col("good")).alias("pull")
    )
    ends = domains.groupBy("suffix").agg(*sums, _strength(F.col("n"), F.col("good")).alias("pull"))
    top = ends.agg(*sums, _strength(F.col("n"), F.col("good")).alias("pull"))

    top = top.select(
        F.coalesce(F.try_divide("good", "n"), F.lit(0.5)).alias("top_mean"),
        F.coalesce("pull", F.lit(STRENGTH[1])).alias("top_pull"),
    )

    def shrunk(good: Column, n: Column, mean: Column, pull: Column) -> Column:
        return (good + pull * mean) / (n + pull)

    # One row stands for all pages, so it reaches every suffix by an equal constant.
    ends = (
        ends.withColumn("_one", F.lit(1))
        .join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
        .select(
            F.col("suffix").alias("_suffix"),
            shrunk(F.col("good"), F.col("n"), F.col("top_mean"), F.col("top_pull")).alias("suffix_mean"),
            F.col("pull").alias("suffix_pull"),
        )
    )
    domains = domains.join(ends, F.col("suffix") == F.col("_suffix")).select(
        F.col("domain").alias("_domain"),
        shrunk(F.col("good"), F.col("n"), F.col("suffix_mean"), F.col("suffix_pull")).alias("domain_mean"),
        F.col("pull").alias("domain_pull"),
    )
    placed = (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
        .join(ends, F.col("suffix") == F.col("_suffix"), "left")
        .join(domains, F.col("domain") == F.col("_domain"), "left")
    )
    mean = F.coalesce("domain_mean", "suffix_mean", "top_mean")
    pull = F.coalesce("domain_pull", "suffix_pull", "top_pull")
    good = F.col("good") + pull * mean
    weight = F.col("n") + pull
    rate = good / weight
    return placed.select(
        "host",
        "n",
        "good",
        rate.alias("mean"),
        (rate - Z * F.sqrt(rate * (1 - rate) / (weight + 1))).alias("bound"),
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """``pages`` with host, path, rule, bound and verdict (allow or block).

    A null url, or one without ``://``, has an empty host and path; it is judged like any
    other host. Columns of these names are replaced, repeated rows are judged alike.
    """
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    bounds = host_reputation(parsed.select("page_id", "host"), outcomes, suffixes).select(
        F.col("host").alias("_of"), F.col("bound").alias("_bound")
    )
    bounds = cut(bounds, "host-bounds")
    found = parsed.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") < limit, "block").otherwise("allow")
    return (
        found.join(bounds, F.col("host") == F.col("_of"), "left")
        .withColumns({"rule": F.col("_rule.name"), "bound": F.col("_bound")})
        .withColumn("verdict", F.coalesce(F.col("_rule.verdict"), own))
        .drop("_rule", "_of", "_bound")
    )


def url_verdicts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
