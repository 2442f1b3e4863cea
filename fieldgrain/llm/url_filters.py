"""URL block and allow rules, carried over to aliases (operator 2). DataFrame functions only.

Rules name a host and a path prefix; the longest that fits a URL decides. A URL without a fitting rule may still be an
alias: pages name others by a canonical link or a meta refresh, and the pages and their targets form a graph whose
connected components hold equivalent URLs. An unruled URL is blocked if its component holds a URL that a block rule
fits and none that an allow rule fits: an explicit allow takes precedence, and a URL's own rule over both.

Nodes are URLs by host, path and query; scheme and fragment make no difference. null URL or no "://": host and path are
empty, no rule fits, allowed, and its links are not followed. null html: no links. All canonical links and refreshes of a
page count; those without an address name nothing. Repeated pages are one node, and each row gets its verdict. Ties
between rules of equal length: the first. Texts of any length are read whole. Empty table: no rows. Columns named host,
path, rule or verdict are replaced, further ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .components import components

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; only A-Z are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits. Of equal lengths the first."""
    # host and path are compared as in the rule's text, host + path; that text's length decides.
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """host + path + query; null where the URL has no ://."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)))


def target_of(url: Column, href: Column) -> Column:
    """An absolute URL for a link found on the page: absolute, scheme-relative, rooted, or relative to the page's folder."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path_of(url), href))
        .otherwise(F.concat(root, folder, href))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that redirect or canonical-link one to the other."""
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.contains("url", F.lit("://")))
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    attribute = lambda t, name: F.trim(F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*["']?\s*([^"'>\s]+)""", 1))
    canonical = F.transform(tags(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), lambda t: attribute(t, "href"))
    refresh = F.transform(tags(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), lambda t: attribute(t, "url"))
    found = some.select("url", F.explode(F.concat(canonical, refresh)).alias("href"))
    clean = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(target_of(F.col("url"), clean)).alias("b")).where("a <> b")


def judge(pages: DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict. edges: (a, b) of nodes, from redirect logs for instance; else the pages' own links."""
    edges = links(pages, url, html) if edges is None else edges
    parted = pages.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))})
    parted = parted.withColumn("__fg_rule", rule_of(F.col("host"), F.col("path"), rules))
    members = components(edges)
    if members.isEmpty():
        return parted.withColumns({"rule": F.col("__fg_rule.rule"), "verdict": F.coalesce("__fg_rule.verdict", F.lit("allow"))}).drop("__fg_rule")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = members.withColumn("__fg_rule", rule_of(host_of(as_url), path_of(as_url), rules)).groupBy("component").agg(F.bool_or(F.coalesce(F.col("__fg_rule.verdict") == "block", F.lit(False))).alias("blocks"), F.bool_or(F.coalesce(F.col("__fg_rule.verdict") == "allow", F.lit(False))).alias("allows"))
    alias = members.join(ruled.where("blocks and not allows"), "component").select(F.col("node").alias("__fg_node"), F.lit("block").alias("__fg_alias"))
    out = parted.withColumn("__fg_node", node_of(F.col(url))).join(alias, "__fg_node", "left")
    return out.withColumns({"rule": F.col("__fg_rule.rule"), "verdict": F.coalesce("__fg_rule.verdict", "__fg_alias", F.lit("allow"))}).drop("__fg_rule", "__fg_node", "__fg_alias")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


_URL = r"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)"
_PATH = r"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def oracle(rules=RULES) -> str:
    """The same verdicts in DuckDB's SQL; the components by a recursive walk, for small inputs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = lambda u: f"translate({_URL.format(u=u)}, '{upper}', '{upper.lower()}')"
    node = lambda u: f"CASE WHEN contains({u}, '://') THEN {host(u)} || {_PATH.format(u=u)} || regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}{h}{p}'".replace("{}", v + ":") for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    folder = f"regexp_replace({_PATH.format(u='url')}, '[^/]*$', '')"
    attr = r"""(?is)\b{}\s*=\s*["'']?\s*([^"''>\s]+)"""
    link = r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>"""
    meta = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>"""
    return f"""
WITH RECURSIVE parted AS (SELECT page_id, url, html, coalesce({host('url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path, {node('url')} AS node FROM pages),
ruled AS (SELECT *, CASE {fits} END AS hit FROM parted),
hrefs AS (
  SELECT url, node, replace(unnest(list_concat([regexp_extract(t, '{attr.format('href')}', 1) FOR t IN regexp_extract_all(html, '{link}', 0)], [regexp_extract(t, '{attr.format('url')}', 1) FOR t IN regexp_extract_all(html, '{meta}', 0)])), '&amp;', '&') AS href FROM parted WHERE node IS NOT NULL AND html IS NOT NULL),
targets AS (SELECT node, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN {scheme} || ':' || href
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') THEN NULL WHEN starts_with(href, '/') THEN {scheme} || '://' || {host('url')} || href
  WHEN starts_with(href, '?') THEN {scheme} || '://' || {host('url')} || {_PATH.format(u='url')} || href
  ELSE {scheme} || '://' || {host('url')} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || href END AS target FROM hrefs),
edges AS (SELECT node AS a, {node('target')} AS b FROM targets WHERE target IS NOT NULL),
sides AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a, a AS b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
parts AS (SELECT a, b, {host("'x://' || b")} AS host, {_PATH.format(u="'x://' || b")} AS path FROM reach),
hits AS (SELECT a, CASE {fits} END AS hit FROM parts),
alias AS (SELECT a FROM hits GROUP BY a HAVING bool_or(coalesce(starts_with(hit, 'block:'), false)) AND NOT bool_or(coalesce(starts_with(hit, 'allow:'), false)))
SELECT page_id, host, path, substr(hit, 7) AS "rule", CASE WHEN hit IS NOT NULL THEN substr(hit, 1, 5) WHEN node IN (SELECT a FROM alias) THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
