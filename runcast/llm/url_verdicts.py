"""URL filter with redirect equivalence: block decisions reach the aliases of a URL, allows come first.

Pages name their aliases in canonical links, refresh redirects and share links. These edges join URLs into
components. A URL that no rule fits is blocked if its component holds a blocked URL and no allowed one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.llm.common import lower_ascii
from runcast.llm.components import components
from runcast.session import materialize

MAX_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    """Fits a host, its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"


# the rules of the contract, fixed values
RULES = (UrlRule("allow", "com"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
         UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))

_PARTS = r"://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
_SHARED = r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*?\bcontent\s*=\s*["']?([^"'\s>]+)"""
_REFERENCES = ((r"&(?:#0*47|#[xX]0*2[fF]|sol);", "/"), (r"&(?:#0*61|#[xX]0*3[dD]|equals);", "="),
               (r"&(?:#0*58|#[xX]0*3[aA]|colon);", ":"), (r"&(?:#0*63|#[xX]0*3[fF]|quest);", "?"),
               (r"&(?:amp|AMP|#0*38|#[xX]0*26);", "&"))
_TRACKING = r"(?<=[?&])(?:utm_[a-z]+|gclid|fbclid)=[^&]*&?"


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def url_node(url: Column) -> Column:
    """The URL as a node: no scheme, fragment or tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("?"), query), _TRACKING, ""), r"[?&]$", "")
    return F.when(url_host(url) != "", F.concat(url_host(url), url_path(url), query))


def decoded(text: Column) -> Column:
    """Character references that stand in URLs; the ampersand's come last."""
    for regex, char in _REFERENCES:
        text = F.regexp_replace(text, regex, char)
    return text


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments; a ``..`` above the root is dropped."""
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
                       lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                       .when(part == ".", done).otherwise(F.concat(done, F.array(part))))
    ends = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as an absolute URL, seen from the page ``url``; null for other schemes and pure fragments."""
    own_path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    root = F.concat(F.lit("http://"), url_host(url))
    folder, rest = F.regexp_extract(own_path, r"^(.*/)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)") | (url_host(url) == ""), F.lit(None).cast("string"))
            .when(target.startswith("?"), F.concat(root, url_path(url), target))
            .when(target.startswith("/"), F.concat(root, without_dots(path), rest))
            .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest)))


def alias_urls(url: Column, html: Column) -> Column:
    """Absolute URLs that a page declares to be itself, all links of each kind; relative ones start from its URL."""
    html = F.coalesce(html, F.lit(""))
    found = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(regex), F.lit(1))
                                for regex in (_CANONICAL, _REFRESH, _SHARED)]))
    absolute = F.transform(found, lambda target: resolved(url, decoded(target)))
    hinted = html.rlike(r"(?i)canonical|refresh|og:url")
    return F.when(hinted, F.filter(absolute, lambda target: target.isNotNull())).otherwise(
        F.array().cast("array<string>"))


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Rules are compiled into the projection."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into one projection")
    fits = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict)):
        fit = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        told = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fits = F.when(fit, told) if fits is None else fits.when(fit, told)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged_pages(pages: DataFrame, rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The contract's row of every page. ``redirects`` may add edges (columns ``source_url``, ``target_url``).

    A null URL, or one without ``://``, has an empty host and path, no alias and the verdict ``allow``.
    Repeated pages stay; a hot URL is one node.
    """
    url, html = F.col("url"), F.col("html")
    told = materialize(
        pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"),
                     url_node(url).alias("node"), alias_urls(url, html).alias("aliases"))
        .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)), "urls")
    links = told.where(F.size("aliases") > 0).select(url.alias("a"), F.explode("aliases").alias("b"))
    if redirects is not None:
        links = links.union(redirects.select("source_url", "target_url"))
    links = materialize(links.where("a is not null and b is not null").distinct(), "links")
    groups = components(links.select(url_node(F.col("a")).alias("a"), url_node(F.col("b")).alias("b"))
                        .where("a is not null and b is not null"))
    ends = links.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    ruled = ends.select(url_node(F.col("end")).alias("node"),
                        fitting_rule(url_host(F.col("end")), url_path(F.col("end")), rules).alias("fit"))
    decided = (ruled.join(groups, "node").groupBy("component")
               .agg(F.max(F.col("fit.verdict") == "allow").alias("allowed"),
                    F.max(F.col("fit.verdict") == "block").alias("blocked"), F.count("*").alias("component_size")))
    by_node = groups.join(decided, "component").select(
        F.col("node").alias("_node"), "component", "component_size",
        F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
        .alias("passed_on"))
    return told.join(by_node, told["node"] == by_node["_node"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "passed_on", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(u, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
fitted AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted"""
