"""URL filters with redirect equivalence.

A rule decides about the urls that it fits. A url that no rule fits shares the fate of its aliases:
urls are nodes, redirects and canonical links are edges, and a block anywhere in a component reaches
all its members that have no rule of their own - unless a member is explicitly allowed, which wins.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: (host, path, verdict); a rule is written host + path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rule tables up to this many rows are broadcast.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url without scheme and fragment, its host lower-cased: the key of a page, whichever way it is written."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    node = F.concat(host_of(url), path_of(url), query)
    return F.when(node != "", node)


def _without_dots(path: Column) -> Column:
    """A path without the segments "." and "..", which stay within the site."""
    nothing = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        nothing,
        lambda held, part: F.when(part == ".", held)
        .when(part == "..", F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held))
        .otherwise(F.concat(held, F.array(part))),
    )
    joined = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.contains("/."), joined).otherwise(path)


def _resolved(base: Column, href: Column) -> Column:
    """href as an absolute url, or null for what names no page."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when((href == "") | href.startswith("#") | href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("?"), F.concat(site, path_of(base), href))
        .when(href.startswith("/"), F.concat(site, _without_dots(path), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
    )


#: What holds no links of the page: comments, scripts, styles, templates.
_NO_LINKS = r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea)\b.*?(?:</\1\s*>|$)"
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_LINK, _META = rf"(?is)<link\b{_ATTRIBUTES}>", rf"(?is)<meta\b{_ATTRIBUTES}>"
#: Character references that urls are written with.
_REFERENCES = [(r"(?i)&#(38|x26);", "&"), (r"(?i)&(#47|#x2f|sol);", "/"), (r"(?i)&(#58|#x3a|colon);", ":"), (r"(?i)&(#61|#x3d|equals);", "="), (r"(?i)&(#46|#x2e|period);", "."), ("&amp;", "&")]


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; empty if the tag has none."""
    quoted = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, quoted, k) for k in (1, 2, 3))))


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target) urls of all canonical links and redirects by meta refresh, outside comments and scripts."""
    html = F.col(html_col)
    # the cheap test spares most pages the expensive patterns
    some = pages.filter(F.lower(html).rlike("canonical|refresh")).select(F.col(url_col).alias("source"), F.regexp_replace(html, _NO_LINKS, " ").alias("html"))
    links = F.filter(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda tag: F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda tag: F.lower(_attribute(tag, "http-equiv")) == "refresh")
    found = F.concat(
        F.transform(links, lambda tag: _attribute(tag, "href")),
        F.transform(metas, lambda tag: F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*["']?([^"'\s]+)""", 1)),
    )
    href = F.col("href")
    for pattern, character in _REFERENCES:
        href = F.regexp_replace(href, pattern, character)
    hrefs = some.select("source", F.explode(found).alias("href")).filter("href <> ''").select("source", href.alias("href"))
    return hrefs.select("source", _resolved(F.col("source"), F.col("href")).alias("target")).filter("target IS NOT NULL")


def _rules_frame(spark, rules) -> DataFrame:
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    return rules


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and rule_verdict to distinct rows (host, path): the longest rule that fits, else null.

    Of rules written alike, allow wins. The rules are joined on the host's suffixes, so their number
    does not multiply the work: broadcast up to BROADCAST_RULES rows, else shuffled.
    """
    counted = rules.limit(BROADCAST_RULES + 1).count()
    rules = F.broadcast(rules) if counted <= BROADCAST_RULES else rules
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = wide.join(rules, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("rule_verdict") == "allow").alias("allows"), rule.alias("rule")))
    found = fits.groupBy("host", "path").agg(best.alias("best"))
    return found.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.allows"), "allow").otherwise("block").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules=None, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, component.

    rules: rows (host, path, verdict). edges: (source, target) urls of known redirects, besides those that
    the pages' html states (html_col None: no html). component is the least node of the alias component,
    null for urls in no edge. A null url, or one without "://", has empty host and path, no rule and no
    aliases: it is allowed; null html states no edge. Rules written alike: allow wins. Long urls and pages are
    read whole. Repeated rows are each judged; an empty table gives no rows; further columns, whatever their
    names, are not looked at.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    rules = _rules_frame(spark, RULES if rules is None else rules)
    parts = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url")]
    own = pages.select(*parts).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    found = []
    if html_col:
        found.append(page_edges(pages, url_col, html_col))
    if edges is not None:
        found.append(edges.select("source", "target"))
    links = None
    for frame in found:
        links = frame if links is None else links.unionByName(frame)
    if links is not None:
        links = scratch.store(links.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")).filter("u <> v").distinct(), "links")
    keys = own.select("host", "path")
    linked = links is not None and links.seen["n_rows"] > 0
    if linked:
        members = scratch.store(components(links, scratch), "members")
        with_scheme = F.concat(F.lit("x://"), F.col("node"))
        members = members.select("node", "component", host_of(with_scheme).alias("host"), path_of(with_scheme).alias("path"))
        keys = keys.unionByName(members.select("host", "path"))
    # urls are many, (host, path) pairs fewer: each is matched once, and a hot host is many pairs
    matched = scratch.store(match_rules(keys.filter("host <> ''").distinct(), rules), "matched")
    judged = own.join(matched, ["host", "path"], "left")
    if linked:
        fates = members.join(matched, ["host", "path"], "left").groupBy("component").agg(
            F.coalesce(F.bool_or(F.col("rule_verdict") == "allow"), F.lit(False)).alias("any_allow"),
            F.coalesce(F.bool_or(F.col("rule_verdict") == "block"), F.lit(False)).alias("any_block"),
        )
        inherited = members.join(fates, "component").select(
            "node", "component", F.when(F.col("any_block") & ~F.col("any_allow"), "block").otherwise("allow").alias("inherited")
        )
        judged = judged.join(inherited, "node", "left")
    else:
        judged = judged.select("*", F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("inherited"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "inherited", F.lit("allow")).alias("verdict"), "component")


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


#: Without an edge in the pages no verdict is inherited, so the rules alone give the result; the
#: edges themselves are tested against a brute-force version.
ORACLE = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""
