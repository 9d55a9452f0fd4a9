"""URL filters: rules by host and path, carried to aliases over redirect and canonical-link components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, written

#: Rules up to this number are written into the plan as literals; a longer list has to come as a DataFrame.
MAX_INLINE_RULES = 256
#: (host, path, action) that op1 applies.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['\"]?([^\"'\s>]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Node of the alias graph: host, path and query; the scheme and the fragment do not name another page."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), url_path(url), query))


def resolved(base: Column, href: Column) -> Column:
    """href as an absolute URL, seen from the page base."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/") & (folder != scheme), folder).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when((href == "") | href.startswith("#"), base)
        .otherwise(F.concat(folder, href))
    )


def inline_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, allow, rule, action) of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's path. Between rules of equal length
    an allow wins, then the rule greater by code point.
    """
    fits = []
    for rule_host, rule_path, action in rules:
        entry = F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(int(action == "allow")).alias("allow"), F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        fits.append(F.when(((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path), entry))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,allow:int,rule:string,action:string>")


def joined_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """As inline_rule for a rule table of any size: equi-join on host suffixes. keys: (node, host, path), node unique."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = keys.select("node", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    best = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), (F.col("action") == "allow").cast("int").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    return wide.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("node").agg(F.max(best).alias("own"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(src, dst) alias keys of canonical links and meta-refresh redirects; no Python, one pass over the HTML."""
    url, html = F.col(url_col), F.col(html_col)
    hrefs = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.array(F.regexp_extract(html, _LINK, 1), F.regexp_extract(html, _REFRESH, 1)))
    found = pages.where(url.contains("://")).select(url.alias("u"), F.explode(hrefs).alias("h")).where("h <> ''")
    target = resolved(F.col("u"), F.regexp_replace("h", "&amp;", "&"))
    return found.select(alias_key(F.col("u")).alias("src"), alias_key(target).alias("dst")).where("dst is not null and src <> dst").distinct()


def url_filters(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Judge every row of pages.

    Each url takes the longest rule that fits. Edges between aliases come from canonical links and meta refreshes in
    the HTML and from redirects (from_url, to_url). In a connected component an allow rule of any member lets all
    members without a rule of their own through; else a block rule of any member blocks them. Targets that are no rows
    of pages count as members. Urls in no component and without a rule are allowed.

    Null or malformed urls (no ://) have empty host and path, no rule, and are allowed. Null HTML has no links. Repeated
    rows are judged alike, each giving a row. An empty table gives an empty result. Only the id, url and HTML
    columns are read, so other columns may have any name.
    Returns id, host, path, rule, verdict, component (least alias key; null outside components).
    """
    url = F.col(url_col)
    edges = link_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select(alias_key(F.col("from_url")).alias("src"), alias_key(F.col("to_url")).alias("dst")).where("src is not null and dst is not null and src <> dst")
        edges = given if edges is None else edges.unionByName(given)
    base = pages.select(F.col(id_col), url.alias("_url"), url_host(url).alias("host"), url_path(url).alias("path"), alias_key(url).alias("_node"))
    inline = not isinstance(rules, DataFrame)
    if inline and len(rules) > MAX_INLINE_RULES:
        rules, inline = pages.sparkSession.createDataFrame(list(rules), "host string, path string, action string"), False

    def own(frame: DataFrame, node: str) -> DataFrame:
        if inline:
            return frame.withColumn("_own", inline_rule(F.col("host"), F.col("path"), rules))
        keys = frame.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), "host", "path").dropDuplicates(["node"])
        return frame.join(joined_rule(keys, rules).withColumnRenamed("own", "_own"), F.col(node) == F.col("node"), "left").drop("node")

    judged = own(base, "_node")
    edges = written(edges, "url-edges") if edges is not None else None
    if edges is None or edges.isEmpty():
        spread = judged.withColumn("component", F.lit(None).cast("string")).withColumn("_method", F.lit(None).cast("string"))
    else:
        components = written(connected_components(edges), "url-components")
        members = components.withColumn("host", F.regexp_extract("node", r"(?s)^([^/?]*)", 1)).withColumn("path", F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1))
        verdicts = own(members, "node") if inline else own(members.withColumnRenamed("node", "_k"), "_k").withColumnRenamed("_k", "node")
        decided = verdicts.groupBy("component").agg(F.max((F.col("_own.action") == "allow").cast("int")).alias("a"), F.max((F.col("_own.action") == "block").cast("int")).alias("b"))
        method = F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").otherwise("allow")
        decided = written(decided.select("component", method.alias("_method")), "url-decided")
        table = components.join(decided, "component").select(F.col("node").alias("_node"), "component", "_method")
        spread = judged.join(table, "_node", "left")
    return spread.select(id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.action", "_method", F.lit("allow")).alias("verdict"), "component")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP1_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) END AS q
  FROM pages),
k AS (SELECT page_id, host, path, CASE WHEN q IS NOT NULL THEN host || path || q END AS node, html, url FROM p),
links AS (
  SELECT node AS src, regexp_extract(t.tag, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) AS href
  FROM k, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t(tag)
  WHERE node IS NOT NULL AND regexp_matches(t.tag, '(?i)rel\s*=\s*["'']?canonical\b')),
e AS (
  SELECT DISTINCT src, translate(regexp_extract(href, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(href, '^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(href, '^.*?://[^?#]*(\?[^#]*)', 1) AS dst
  FROM links WHERE contains(href, '://')),
sym AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
reach AS (SELECT DISTINCT src AS node, src AS other FROM sym UNION SELECT r.node, s.dst FROM reach r JOIN sym s ON s.src = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
rules(rh, rp, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
nodes AS (
  SELECT node, host, path FROM k WHERE node IS NOT NULL
  UNION SELECT node, regexp_extract(node, '^([^/?]*)', 1), regexp_extract(node, '^[^/?]*([^?]*)', 1) FROM comp),
own AS (
  SELECT n.node, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(act, length(rh || rp)) AS act
  FROM nodes n JOIN rules ON (n.host = rh OR ends_with(n.host, '.' || rh)) AND starts_with(n.path, rp) GROUP BY n.node),
decided AS (
  SELECT component, CASE WHEN bool_or(act = 'allow') THEN 'allow' WHEN bool_or(act = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM comp LEFT JOIN own USING (node) GROUP BY component)
SELECT k.page_id, k.host, k.path, own.rule, coalesce(own.act, decided.verdict, 'allow') AS verdict, comp.component
FROM k LEFT JOIN own ON own.node = k.node LEFT JOIN comp ON comp.node = k.node LEFT JOIN decided ON decided.component = comp.component
"""
