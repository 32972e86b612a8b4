"""URL filters: path rules first, then the empirical-Bayes reputation of the host.

A rule is (verdict, host, path).  It fits its host and all subdomains of it when the URL's path starts with the
rule's path; of the rules that fit, the one with the longest host and path wins.  Pages without a rule get the
verdict of a beta-binomial model: labelled outcomes are counted by host, and each host's rate is shrunk to that of its
registered domain, which is shrunk to that of its suffix, which is shrunk to the rate of all pages.  How hard each
level shrinks follows from how much the rates of that level differ beyond binomial noise.  A page is allowed when the
lower posterior bound of its host's rate reaches ``min_good``; the bound is the beta posterior's mean less z of its
standard deviations.

The suffix is the last label, or the last two when they are in ``SUFFIXES``; the registered domain has one label more.
User names, ports and a closing dot do not count for either.  An IP address is its own domain and suffix.

Cases: a null URL, or one without ``://``, has an empty host and path and is judged as the host ''.  Hosts without
labelled pages get the mean of their domain (then suffix, then all pages).  Without any labelled page every rate is the
prior ``no_data``.  URLs of any length are read whole.  Repeated rows are judged alike and all returned.  A null page_id matches no label.  Columns beyond
those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut_lineage, spread_join

Rule = tuple[str, str, str]

#: Public suffixes of two labels, by top-level domain, and those of large hosters.  Others count as one label.
SUFFIXES = [
    f"{second}.{top}"
    for top, seconds in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi kiwi maori net org school",
        "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org",
        "in": "ac co edu firm gen gov ind net nic org res", "id": "ac co go or sch web", "th": "ac co go in net or", "my": "com edu gov net org", "sg": "com edu gov net org per",
        "ph": "com edu gov net org", "vn": "com edu gov net org", "pk": "com edu gov net org", "bd": "com edu gov net org", "lk": "com edu gov net org", "il": "ac co gov k12 muni net org",
        "tr": "av bel com edu gen gov k12 net org web", "sa": "com edu gov net org", "eg": "com edu gov net org", "za": "ac co gov net org web", "ke": "ac co go ne or", "ng": "com edu gov net org",
        "gh": "com edu gov org", "br": "art blog com edu eco gov ind inf jus leg mil net org", "ar": "com edu gob gov int net org", "mx": "com edu gob net org", "co": "com edu gov net org",
        "pe": "com edu gob net org", "ve": "co com edu gob net org", "uy": "com edu gub net org", "ec": "com edu gob net org", "pl": "com edu gov net org", "ua": "co com edu gov in net org",
        "pt": "com edu gov org", "es": "com edu gob nom org", "gr": "com edu gov net org", "cy": "ac com gov net org", "ro": "com org", "hu": "co org", "at": "ac co gv or", "rs": "ac co edu gov in org",
        "io": "github gitlab", "com": "blogspot herokuapp wordpress appspot", "app": "netlify vercel web", "dev": "pages workers",
    }.items()
    for second in seconds.split()
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; nulls without one."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")).cast(kind)).otherwise(out)
    return out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")
    name = F.when(name.endswith("."), F.regexp_replace(name, r"\.$", "")).otherwise(name)
    own = name.rlike(r"(?s)^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$")
    last = [F.regexp_extract(name, r"(?s)(?:[^.]*\.){0,%d}[^.]*$" % more, 0) for more in range(3)]  # the last one, two and three labels
    two = last[1].isin(SUFFIXES)
    return F.when(own, name).when(two, last[2]).otherwise(last[1]), F.when(own, name).when(two, last[1]).otherwise(last[0])


def _strength(good: Column, seen: Column) -> tuple[Column, ...]:
    """Aggregates of one level of groups, for its prior strength: sums of good and seen, groups, and squares."""
    p = F.when(seen > 0, good / seen)
    return F.sum(F.when(seen > 0, good)), F.sum(F.when(seen > 0, seen)), F.count(F.when(seen > 0, 1)), F.sum(seen * p * p)


def _shrinkage(k, n, g, q) -> float:
    """Prior strength of one level, by moments: what the rates differ by beyond binomial noise."""
    if not n or n <= g:
        return 10.0
    m = k / n
    if m in (0.0, 1.0):
        return 1000.0
    spread = (q / n - m * m) / (m * (1 - m))
    noise = g / n
    rho = min(max((spread - noise) / (1 - noise), 0.001), 0.5)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, z: float = 1.645, no_data: float = 0.5) -> DataFrame:
    """pages: host, good (1, 0 or null when not labelled).  Returns host, pages, mean, lower: one row per host.

    The pages are read once; what follows works on their counts by host.
    """
    hosts = cut_lineage(pages.groupBy("host").agg(F.sum("good").alias("k"), F.count("good").alias("n"), F.count("*").alias("pages")))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.select("host", "pages", F.coalesce("k", F.lit(0)).alias("k"), "n", domain.alias("domain"), suffix.alias("suffix"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("dk"), F.sum("n").alias("dn")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("dk").alias("sk"), F.sum("dn").alias("sn")))
    levels = [(hosts, "k", "n"), (domains, "dk", "dn"), (suffixes, "sk", "sn")]
    sums = [tuple(level.agg(*_strength(F.col(k), F.col(n))).first()) for level, k, n in levels]
    by_host, by_domain, by_suffix = (_shrinkage(*s) for s in sums)
    k, n = sums[2][:2]
    mean = k / n if n else no_data
    suffixes = suffixes.select("suffix", ((F.col("sk") + by_suffix * mean) / (F.col("sn") + by_suffix)).alias("s_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("dk") + by_domain * F.col("s_mean")) / (F.col("dn") + by_domain)).alias("d_mean"))
    a, size = F.col("k") + by_host * F.col("d_mean"), F.col("n") + by_host
    return (
        hosts.join(domains, "domain")
        .withColumn("mean", a / size)
        .withColumn("lower", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)))
        .select("host", "pages", "mean", "lower")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), min_good: float = 0.5, z: float = 1.645
) -> DataFrame:
    """pages: page_id, url.  outcomes: page_id, good (0 or 1); of repeated page_ids the worse outcome counts.

    Returns page_id, host, path, rule, verdict, good_rate (posterior mean) and good_bound (lower bound).
    """
    known = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = parsed.select("page_id", "host").join(known, "page_id", "left")
    hosts = cut_lineage(host_reputation(labelled, z).withColumnRenamed("pages", "n"))
    return (
        spread_join(parsed, hosts, ["host"])  # the pages of a large host stay where they are
        .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", F.when(F.col("lower") >= min_good, "allow").otherwise("block")).alias("verdict"),
            F.col("mean").alias("good_rate"), F.col("lower").alias("good_bound"),
        )
    )
