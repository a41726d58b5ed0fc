"""URL rules with redirect equivalence.

Rules name a host, which stands for its subdomains too, and the beginning of a path; the
longest that fits an address decides. Addresses that lead to the same place form a group:
one run of distributed connected components takes redirects, canonical links and the ties
of addresses to their normal form as edges. An address without a rule of its own is
blocked if its group holds a blocked address and no allowed one: an explicit allow
anywhere in the group takes precedence over what is passed on, and an address's own rule
over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelytics.llm.common import stored
from edgelytics.llm.components import components

#: (host, path, action) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only say where a visitor came from.
_TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """One spelling for addresses that differ in scheme, www. or m., fragment, tracking
    parameters or a closing slash. Null or no :// : null, as nothing is known of it."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?i)(^|&){_TRACKING}(?=&|$)", ""), r"^&+|&+$", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, whole)


def link_targets(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, target): canonical links and refresh redirects that the pages name, as full addresses."""
    text = F.col(html).cast("string")
    link, refresh = F.regexp_extract(text, _LINK, 0), F.regexp_extract(text, _REFRESH, 0)
    href = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.regexp_extract(refresh, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    named = F.filter(F.array(F.when(F.contains(F.lower(text), F.lit("canonical")), href), F.when(F.contains(F.lower(text), F.lit("refresh")), to)), lambda x: x != "")
    found = pages.filter(F.col(url).contains("://")).select(F.col(url).alias("url"), F.explode(named).alias("target"))
    scheme, host = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^.*?(://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1)
    target = F.col("target")
    whole = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, host, target))
        .otherwise(F.concat(scheme, host, F.when(folder == "", "/").otherwise(folder), target))
    )
    return found.select("url", whole.alias("target"))


def judge_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, action) for distinct `urls`; rule and action null if none fits.

    A host is looked up under itself and each of its parent domains, so rules are found by
    an equi-join however many there are. Hosts are joined first and once each: a host of a
    third of all pages meets the rules as one row.
    """
    split = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    split = stored(split, "urls")
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = split.select("host").filter("host != ''").distinct().select("host", F.explode(parents).alias("rule_host"))
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    # longest first; of equal ones the longer host, then allow
    weight = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"),
        (F.col("action") == "allow").alias("c"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "action",
    )
    by_host = hosts.join(named, "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(weight), asc=False).alias("fits"))
    # stored, so that the join's shuffle reads files on both sides and a hot host can be split
    joined = split.join(stored(by_host, "host-rules"), "host", "left")
    best = F.try_element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(1))
    return joined.select("url", "host", "path", best["rule"].alias("rule"), best["action"].alias("action"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """key, url, host, path, rule, verdict, passed_on: one row per row of `pages`.

    `rules` has host, path and action (block or allow), few per host; `redirects`, if
    given, has source and target addresses from a crawl. The verdict is the own rule's;
    else block if the group holds a blocked address and no allowed one; else allow, also
    for a null url or one without ://, which belong to no group. passed_on says that the
    group decided. Repeated pages are judged alike; other columns are not read.
    """
    # nodes are addresses ("u ") and normal forms ("n ")
    edges = [link_targets(pages, url, html)] if html else []
    if redirects is not None:
        edges.append(redirects.select(F.col("source").alias("url"), "target"))
    urls = pages.select(F.col(url).alias("url"))
    links = None
    for more in edges:
        links = more if links is None else links.union(more)
    if links is not None:
        links = stored(links.filter("contains(url, '://') and contains(target, '://')").distinct(), "page-links")
        urls = urls.union(links.select("target")).union(links.select("url"))
    judged = stored(judge_urls(urls.filter("url is not null").distinct(), rules), "judged-urls")
    ties = judged.select(F.concat(F.lit("u "), "url").alias("a"), F.concat(F.lit("n "), normal_form(F.col("url"))).alias("b"))
    if links is not None:
        ties = ties.union(links.select(F.concat(F.lit("u "), "url"), F.concat(F.lit("u "), "target")))
    found = components(ties, "a", "b").filter(F.startswith("node", F.lit("u ")))
    groups = stored(found.select(F.substring("node", 3, 1 << 30).alias("url"), F.col("component").alias("group")), "aliases")
    named = judged.join(groups, "url", "left")
    verdicts = named.filter("group is not null and action is not null").groupBy("group").agg(
        F.bool_or(F.col("action") == "block").alias("blocked"), F.bool_or(F.col("action") == "allow").alias("allowed")
    )
    aliases = named.join(verdicts, "group", "left")
    passed = F.col("action").isNull() & F.coalesce(F.col("blocked") & ~F.col("allowed"), F.lit(False))
    verdict = F.coalesce("action", F.when(passed, "block").otherwise("allow"))
    decided = aliases.select("url", "host", "path", "rule", verdict.alias("verdict"), passed.alias("passed_on"))
    joined = pages.select(F.col(key), F.col(url).alias("url")).join(decided, "url", "left")
    return joined.select(
        key, "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("passed_on", F.lit(False)).alias("passed_on"),
    )
