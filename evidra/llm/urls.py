"""URL rules with redirect equivalence: pages that redirect or canonical-link edges connect share block decisions.

The host stands after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path from there up to "?", "#"
or the end. Null urls and urls without "://" have an empty host and path, fit no rule and have no aliases. A url's own
rule decides; else, among the rules of its aliases, an allow rule precedes a block rule; else the url is allowed. Every
row has its own result, so repeated rows have equal ones; an empty table gives an empty result; extra columns don't
matter. Null html has no edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written
from evidra.llm.components import components

#: Fixed values: (decision, host, path). A rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(decision, text) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<decision:string,text:string>")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones go before
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(decision).alias("decision"), F.lit(rule_host + rule_path).alias("text"))).otherwise(out)
    return out


def node(url: Column) -> Column:
    """What makes two urls the same place: host, path without "." and ".." segments, and query, without scheme and fragment;
    null without a host."""
    h, query = host(url), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(h != "", F.concat(h, without_dots(path(url)), query))


def without_dots(p: Column) -> Column:
    """A path, from its first slash, with "." segments gone and each ".." taking the segment before it along."""
    steps = F.slice(F.split(p, "/"), 2, 1 << 30)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    folder = p.rlike(r"/\.{1,2}$") & (F.size(kept) > 0)
    return F.when(p == "", "/").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise("")))


def absolute(href: Column, base: Column) -> Column:
    """href as a full url, seen from base; null where it is empty, a place in the page itself, or no http or https."""
    href = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme, h, p = F.substring_index(base, "://", 1), host(base), path(base)
    folder = F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "[^/]*$", ""))
    site = F.concat(scheme, F.lit("://"), h)
    return (
        F.when((href == "") | href.startswith("#"), F.lit(None).cast("string"))
        .when(href.rlike("^(?i:https?)://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, F.when(p == "", F.lit("/")).otherwise(p), href))
        .otherwise(F.concat(site, folder, href))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute of just this name, without quotes; empty where there is none."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) urls: from each page to its canonical link (one of the words of a link's rel) and to where it redirects; what stands
    in comments isn't read."""
    html = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", " ")
    tags = pages.where("url is not null and html is not null").select("url", F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^<>]*>"), 0).alias("links"), F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^<>]*>"), 0).alias("metas"))
    canonical = F.filter("links", lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter("metas", lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    to = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    hrefs = F.array(F.get(F.transform(canonical, lambda t: _attribute(t, "href")), F.lit(0)), F.get(F.transform(refresh, to), F.lit(0)))
    return tags.select("url", F.explode(hrefs).alias("href")).where("href <> ''").select(F.col("url").alias("a"), absolute(F.col("href"), F.col("url")).alias("b")).where("b is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page. redirects(a, b): further pairs of urls that are one place."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    alias = components(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    url = F.concat(F.lit("any://"), F.col("node"))
    decided = alias.select("component", rule(host(url), path(url), rules)["decision"].alias("decision")).groupBy("component").agg(F.min("decision").alias("decision")).where("decision is not null")  # allow sorts first
    shared = written(alias.join(decided, "component").select("node", F.col("decision").alias("shared")))
    out = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node")).withColumn("own", rule(F.col("host"), F.col("path"), rules))
    return out.join(shared, "node", "left").select("page_id", "host", "path", F.col("own.text").alias("rule"), F.coalesce("own.decision", "shared", F.lit("allow")).alias("verdict"))


def _sql() -> str:
    """The whole operator as one SQL text, links and components included."""
    rest = lambda u: f"CASE WHEN position('://' IN {u}) = 0 THEN '' ELSE substr({u}, position('://' IN {u}) + 3) END"
    host_of = lambda u: f"translate(regexp_extract({rest(u)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    path_of = lambda u: f"regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1)"
    value = lambda t, n: rf"""regexp_replace(regexp_extract({t}, '(?is)[\s"'']{n}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""
    rules = ", ".join(f"('{d}', '{h}', '{p}')" for d, h, p in RULES)
    return rf"""
WITH RECURSIVE parsed AS (SELECT page_id, url, {host_of("coalesce(url, '')")} AS host, {path_of("coalesce(url, '')")} AS path FROM pages),
rules(decision, rule_host, rule_path) AS (VALUES {rules}),
tags AS (
  SELECT url, regexp_extract_all(html, '(?is)<link\b[^<>]*>') AS links, regexp_extract_all(html, '(?is)<meta\b[^<>]*>') AS metas
  FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g') AS html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)),
hrefs AS (
  SELECT url, {value("list_filter(links, lambda t: list_contains(regexp_split_to_array(lower(" + value("t", "rel") + r"), '\s+'), 'canonical'))[1]", "href")} AS href FROM tags
  UNION ALL SELECT url, regexp_extract({value("list_filter(metas, lambda t: lower(trim(" + value("t", "http-equiv") + ")) = 'refresh')[1]", "content")}, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags),
seen AS (SELECT url, trim(replace(href, '&amp;', '&')) AS href, split_part(url, '://', 1) || '://' || {host_of("url")} AS site, {path_of("url")} AS path FROM hrefs WHERE href <> ''),
links AS (
  SELECT url AS a, CASE WHEN href = '' OR starts_with(href, '#') THEN NULL WHEN regexp_matches(href, '^(?i:https?)://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, '?') THEN site || CASE WHEN path = '' THEN '/' ELSE path END || href
    ELSE site || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS b FROM seen),
places AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM links UNION ALL SELECT b FROM links) WHERE url IS NOT NULL),
steps AS (
  SELECT url, {host_of("url")} AS h, {path_of("url")} AS p, regexp_extract({rest("url")}, '^[^?#]*(\?[^#]*)?', 1) AS q,
    list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({path_of("url")}, '/')[2:], lambda s: [s])), lambda done, s: CASE s[1] WHEN '..' THEN done[:len(done) - 1] WHEN '.' THEN done ELSE list_concat(done, s) END) AS kept FROM places),
nodes AS (SELECT url, CASE WHEN h <> '' THEN h || CASE WHEN p = '' THEN '/' ELSE '/' || array_to_string(kept, '/') || CASE WHEN regexp_matches(p, '/\.{{1,2}}$') AND len(kept) > 0 THEN '/' ELSE '' END END || q END AS node FROM steps),
edges AS (SELECT x.node AS a, y.node AS b FROM links l JOIN nodes x ON x.url = l.a JOIN nodes y ON y.url = l.b WHERE x.node <> y.node),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT b, b FROM edges UNION SELECT r.node, CASE WHEN e.a = r.other THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.a = r.other OR e.b = r.other),
judged AS (
  SELECT page_id, NULL::VARCHAR AS node, host, path FROM parsed
  UNION ALL SELECT NULL::BIGINT, node, {host_of("'any://' || node")}, {path_of("'any://' || node")} FROM (SELECT DISTINCT node FROM reach)),
ranked AS (
  SELECT j.page_id, j.node, r.decision, r.rule_host || r.rule_path AS rule FROM judged j JOIN rules r ON (j.host = r.rule_host OR j.host LIKE '%.' || r.rule_host) AND starts_with(j.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY j.page_id, j.node ORDER BY length(r.rule_host || r.rule_path) DESC) = 1),
shared AS (SELECT r.node, min(k.decision) AS decision FROM reach r JOIN ranked k ON k.node = r.other GROUP BY r.node)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.decision, s.decision, 'allow') AS verdict
FROM parsed p LEFT JOIN ranked own ON own.page_id = p.page_id LEFT JOIN nodes n ON n.url = p.url LEFT JOIN shared s ON s.node = n.node
"""


ORACLE_SQL = _sql()
