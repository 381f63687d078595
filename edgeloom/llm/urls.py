"""URL filters: longest-rule verdicts, and block decisions carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (verdict, rule); a rule is a host, a slash and the beginning of a path (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules are compiled into the plan; a longer list belongs in a table.
MAX_RULES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visitor came from (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.expr("substr({0}, locate('://', {0}) + 3)".format("_url"))).otherwise(F.lit(""))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df plus host and path: after the first '://' up to '/', '?', '#'; then up to '?', '#'. Null or no '://': both empty."""
    df = df.withColumn("_url", F.col(url)).withColumn("_rest", _rest(F.col("_url")))
    df = df.withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER))
    return df.withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_url", "_rest")


def match_rules(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """df plus rule and rule_verdict of the longest rule that fits host and path; else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def alias_key(url: str) -> Column:
    """What a URL is redirected to by convention: no scheme, www. or m., fragment, tracking parameters, index page or final slash; null where there is no '://'."""
    u = F.regexp_replace(F.col(url), r"^.*?://", "")
    u = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), rf"(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    u = F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"(?:/index)?\.html?(?=$|\?)", "")
    u = F.regexp_replace(u, r"/+(?=$|\?)", "")
    host = F.translate(F.regexp_extract(u, r"^[^/?]*", 0), _UPPER, _LOWER)
    key = F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(u, r"^[^/?]*", ""))
    return F.when(F.col(url).contains("://"), key)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value written into the plan once, however often f mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, with or without quotes; '' if there is none."""
    p = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>][^\s>]*))"
    return F.trim(F.concat(*(F.regexp_extract(tag, p, k) for k in (1, 2, 3))))


def _refreshed(content: Column) -> Column:
    """The URL in the content of a refresh, with or without 'url=' and quotes; '' if there is none."""
    p = r"(?is)^\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?+|[;,\s]*url\s*=\s*)(?:\"([^\"]*)|'([^']*)|([^\"'].*))"
    return F.trim(F.concat(*(F.regexp_extract(content, p, k) for k in (1, 2, 3))))


def _resolve(target: Column, base: Column) -> Column:
    """The target as a whole URL; null for none, other schemes, mere fragments and relative ones without a base."""
    site, whole = F.regexp_extract(base, r"^.*?://[^/?#]*", 0), F.regexp_extract(base, r"^.*?://[^?#]*", 0)
    folder = F.when(site == whole, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(whole, r"^.*/", 0))
    relative = F.when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^(.*?:)//", 1), target)).when(target.startswith("/"), F.concat(site, target)).when(target.startswith("?"), F.concat(whole, target)).otherwise(F.concat(folder, target))
    named = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
    return F.when(target.rlike(r"^(?:$|#)|^[A-Za-z][A-Za-z0-9+.\-]*:"), named).when(site != "", _let(relative, _without_dots))


def _without_dots(url: Column) -> Column:
    """The URL without '.' and '..' as parts of its path."""
    site, path, rest = (F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    parts = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    up = lambda got, x: F.when(x == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0)))).when(x == ".", got).otherwise(F.concat(got, F.array(x)))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(site, F.lit("/"), F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), up), "/"), rest)).otherwise(url)


def link_targets(html: str, url: str) -> Column:
    """URLs that a page names as its canonical form or refreshes to, in any letter case; relative ones as its base or its own URL has them."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta|base)(?=[\s/])[^>]*"), F.lit(0))
    canonical = lambda tag: tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = lambda tag: tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    found = F.transform(F.filter(tags, lambda tag: canonical(tag) | refresh(tag)), lambda tag: F.when(tag.rlike("(?i)^<link"), _attribute(tag, "href")).otherwise(_refreshed(_attribute(tag, "content"))))
    bases = F.filter(F.transform(F.filter(tags, lambda tag: tag.rlike("(?i)^<base")), lambda tag: _resolve(_attribute(tag, "href"), F.col(url))), lambda x: x.isNotNull())
    whole = F.transform(found, lambda target: _let(F.coalesce(F.get(bases, F.lit(0)), F.col(url)), lambda own: _resolve(target, own)))
    return F.array_distinct(F.array_compact(whole))


def judge_pages(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, alias_of) for every page.

    Edges are the conventional redirect of every URL (alias_key), the links found in html, and redirects
    (from_url, to_url) where given. A URL with a rule keeps that rule's verdict. One without takes its component's:
    allow if any member, page or mere target, is explicitly allowed; else block if any is blocked; else allow.
    A page whose URL is null or has no '://' is on its own and allowed. Repeated pages get equal rows.

    The conventional edges form stars whose hub is a function of the URL, so components run over the hubs only, and
    only over those that a link or redirect ties to another. Component verdicts are combined before the shuffle.
    """
    df = pages.select(F.col(key).alias(key), F.col(url).alias("_u"), (link_targets(html, url) if html else F.expr("cast(array() as array<string>)")).alias("_to"))
    df = match_rules(url_parts(df, "_u"), rules).withColumn("_key", alias_key("_u"))
    edges = df.where("size(_to) > 0").select("_key", F.explode("_to").alias("_u")).select(F.col("_key").alias("a"), alias_key("_u").alias("b"), "_u")
    if redirects is not None:
        r = redirects.select("from_url", "to_url")
        ends = r.select(alias_key("from_url").alias("a"), alias_key("to_url").alias("b"), F.col("to_url").alias("_u"))
        edges = edges.unionByName(ends).unionByName(r.select(alias_key("from_url").alias("a"), alias_key("to_url").alias("b"), F.col("from_url").alias("_u")))
    tied = connected_components(edges.select("a", "b"))
    targets = match_rules(url_parts(edges.select("_u").distinct(), "_u"), rules).withColumn("_key", alias_key("_u"))
    known = df.select("_key", "rule_verdict").unionByName(targets.select("_key", "rule_verdict")).where("_key is not null and rule_verdict is not null").distinct()
    known = known.join(tied, known["_key"] == tied["node"], "left").withColumn("_component", F.coalesce("component", "_key"))
    blocked = known.groupBy("_component").agg(F.max((F.col("rule_verdict") == "block").cast("int")).alias("b"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("a")).where("b = 1 and a = 0").select(F.col("_component").alias("_blocked"))
    named = df.join(tied, df["_key"] == tied["node"], "left").withColumn("_component", F.coalesce("component", "_key"))
    out = named.join(blocked, named["_component"] == blocked["_blocked"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.col("_component").alias("alias_of"))
