"""URL rules with redirect equivalence.

Host/path rules decide the URLs they fit.  URLs that are one page under several
names (same address up to scheme, fragment, tracking parameters and file
endings; ``rel=canonical`` links; refresh redirects) form alias classes, found as
connected components, and a block decision reaches every alias that has no rule
of its own -- unless some alias is explicitly allowed, which takes precedence.
Rules are fitted to every end of a link, so an alias that is no page decides too.
DataFrame functions only.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule and no aliases and is allowed; repeated rows get equal rows; empty tables
give empty results; nulls among the edges are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.llm.graph import connected_components
from gridlake.llm.tables import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid)(=|$)"

#: Action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("action", "rule_host", "rule_path"), r)])
            for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Address without scheme, fragment, tracking parameters, file ending and
    closing slash; null where there is no host."""
    rest = _rest(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"),
                                              lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    key = F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host_of(url) != "", key)


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']?([^"'>\s]+)""", 1)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` URLs of canonical links and refresh redirects."""
    text = F.coalesce(F.col(html), F.lit(""))
    canonical = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)(<link\b[^>]*>)"), 1),
                         lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)(<meta\b[^>]*>)"), 1),
                       lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""))
    targets = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")),
                       F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*['"]?([^"'>\s]+)""", 1)))
    found = pages.select(F.col(url).alias("src"), F.explode(targets).alias("dst"))
    return (found.where((F.col("dst") != "") & F.col("src").isNotNull())
                 .select("src", resolved(F.col("src"), F.col("dst")).alias("dst")))


def resolved(page: Column, target: Column) -> Column:
    """The address of a link's target as seen from the page: relative targets start at
    the page's folder, and the segments ``.`` and ``..`` are taken out."""
    here = F.regexp_extract(page, "^([^?#]*?://[^/?#]*)", 1)
    own = F.regexp_extract(page, "^[^?#]*?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(own, "^(.*/)", 1)
    path = F.regexp_extract(target, "^([^?#]*)", 1)
    after = F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    whole = (F.when(path == "", own).when(path.startswith("/"), path)
              .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)))
    segments = F.split(whole, "/")
    # a closing . or .. names a folder
    walked = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
                         lambda done, x: F.when(x == ".", done)
                         .when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                         .otherwise(F.concat(done, F.array(x))))
    flat = F.concat(F.lit("/"), F.array_join(walked, "/"),
                    F.when(whole.rlike(r"/\.\.?$") & (F.size(walked) > 0), "/").otherwise(""))
    whole = F.when(whole.rlike(r"/\.\.?(/|$)"), flat).otherwise(whole)
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
             .when(target.startswith("//"), F.concat(F.lit("http:"), target))
             .otherwise(F.concat(here, whole, after)))


def fitting_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, action)``: the longest fitting rule of each distinct
    address that has one.  Addresses are matched by joining every domain suffix of
    the host with the rules' hosts, so the cost does not grow with
    addresses x rules."""
    distinct = addresses.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = distinct.where(F.col("host") != "").select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    return (fits.groupBy("host", "path")
                .agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("action"))).alias("m"))
                .select("host", "path", "m.rule", "m.action"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, alias_class, verdict, via_alias)`` per page row.

    ``edges(src, dst)``: URLs known to be the same page.
    """
    url = F.col(url_col)
    named = lambda u: (host_of(u).alias("host"), path_of(u).alias("path"), alias_key(u).alias("key"))
    rows = pages.select(F.col(id_col), *named(url), F.lit(True).alias("is_page"))
    if edges is not None:
        edges = cut(edges.select("src", "dst"), "url-edges")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("u")).select(*named(F.col("u")))
        rows = rows.unionByName(ends.where("key is not null").distinct().withColumn("is_page", F.lit(False)),
                                allowMissingColumns=True)
    rows = cut(rows, "url-rows")
    ruled = rows.join(fitting_rules(rows, rules), ["host", "path"], "left")
    if edges is not None:
        pairs = edges.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b"))
        classes = connected_components(pairs, "url").withColumnRenamed("node", "key")
        ruled = (ruled.join(classes, "key", "left")
                      .withColumn("alias_class", F.coalesce("component", "key")).drop("component"))
    else:
        ruled = ruled.withColumn("alias_class", F.col("key"))
    ruled = cut(ruled, "url-ruled")
    decided = (ruled.where("alias_class is not null and action is not null").groupBy("alias_class")
                    .agg(F.max((F.col("action") == "block").cast("int")).alias("blocked"),
                         F.max((F.col("action") == "allow").cast("int")).alias("allowed")))
    out = ruled.where("is_page").join(decided, "alias_class", "left")
    inherited = F.when((F.col("blocked") == 1) & (F.col("allowed") == 0), "block").otherwise("allow")
    return out.select(F.col(id_col), "host", "path", "rule", "alias_class",
                      F.coalesce(F.col("action"), inherited).alias("verdict"),
                      (F.col("action").isNull() & (F.coalesce(F.col("blocked"), F.lit(0)) == 1)).alias("via_alias"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = judge(pages, rule_table(spark), link_edges(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: DuckDB: the pages carry no canonical or refresh links, so aliases are equal keys.
OP9_SQL = r"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
a AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM p),
k AS (SELECT row_number() OVER () AS r, page_id, host, path,
  CASE WHEN host <> '' THEN host || regexp_replace(path, '(/index)?(\.html?)?/*$', '') END AS base, q FROM a),
parts AS (SELECT r, unnest(string_split(q, '&')) AS x FROM k),
kept AS (SELECT r, string_agg(x, '&' ORDER BY x) AS q FROM parts
  WHERE x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid)(=|$)') GROUP BY r),
rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT k.r, page_id, host, path, base || coalesce('?' || kept.q, '') AS key, action, rh || rp AS rule,
  row_number() OVER (PARTITION BY k.r ORDER BY length(rh || rp) DESC NULLS LAST) AS n
  FROM k LEFT JOIN kept ON kept.r = k.r
  LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
b AS (SELECT * FROM m WHERE n = 1),
c AS (SELECT key, bool_or(action = 'block') AS blocked, bool_or(action = 'allow') AS allowed FROM b
  WHERE action IS NOT NULL GROUP BY key)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN c.blocked AND NOT c.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN c USING (key)
"""
