"""URL filters with redirect equivalence (native: DataFrame functions only).

Rules name a host and a path prefix; the longest that fits decides. URLs joined by canonical-link or
redirect edges are aliases: components of that graph carry a block decision to members without a rule of
their own, unless a member is allowed by a rule. Own rules always come first.

Defined results: null url or one without `://` has empty host and path, fits no rule and has no alias;
repeated rows are judged alike; null html has no edges; an empty table gives an empty table; only
page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, let
from .components import connected_components

#: (verdict, host, path) of the standard rule set.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. For rule lists of a few hundred entries."""
    c = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        c = F.when(fits, value) if c is None else c.when(fits, value)
    return c


def node_of(url: Column) -> Column:
    """Identity of a URL for aliases: host, path and query; scheme and fragment don't count. Null for no URL."""
    rest = F.regexp_extract(_rest(url), r"^([^/?#]*)([^#]*)", 2)
    return F.when(F.instr(url, "://") > 0, F.xxhash64(host_of(url), rest))


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\s\"'>]+)"


def decoded(c: Column) -> Column:
    """c with the character references that URLs need: ASCII ones by number, and those for & < > " '."""

    def piece(x: Column) -> Column:
        number = F.regexp_extract(x, r"^#([0-9]{1,4});?", 1)
        sixteen = F.regexp_extract(x, r"^#[xX]([0-9a-fA-F]{1,4});?", 1)
        code = F.when(number != "", number.cast("int")).when(sixteen != "", F.conv(sixteen, 16, 10).cast("int"))
        out = F.when(code.between(32, 126), F.concat(F.char(code), F.regexp_replace(x, r"^#[xX]?[0-9a-fA-F]{1,4};?", "")))
        for name, char in _NAMED.items():
            out = out.when(x.startswith(name + ";"), F.concat(F.lit(char), x.substr(len(name) + 2, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), x))

    return let(F.split(c, "&"), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), piece), "")))


def _without_dots(path: Column) -> Column:
    """A rooted path without . and .. segments."""
    def joined(parts: Column) -> Column:
        none = F.slice(parts, 1, 0)
        kept = F.aggregate(F.slice(parts, 2, 1 << 30), none, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
        return F.concat(F.lit("/"), F.array_join(kept, "/"))

    return let(F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/"), joined)


def resolved(ref: Column, base: Column) -> Column:
    """The absolute URL of a reference on a page with this base; null if empty or of a scheme without hosts."""
    return let(F.struct(ref.alias("ref"), base.alias("base")), lambda x: _resolved(x["ref"], x["base"]))


def _resolved(ref: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([^:]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    path = F.regexp_extract(ref, r"^[^?#]*", 0)
    rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    return (
        F.when((ref == "") | (F.instr(base, "://") == 0), F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), ref))
        .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), ref))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(ref.startswith("#"), F.regexp_extract(base, r"^[^#]*", 0))
        .when(ref.startswith("?"), F.concat(root, path_of(base), ref))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(path_of(base) == "", "/").otherwise(F.regexp_extract(path_of(base), r"^(.*/)", 1)), path)), rest))
    )


def link_targets(url: Column, html: Column) -> Column:
    """Absolute URLs of canonical links and meta refreshes of a page, by its first base element if it has one."""
    tags = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\s[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0)),
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0)),
    )
    own = F.regexp_extract(F.regexp_extract(html, r"(?i)<base\s[^>]*>", 0), _HREF, 1)
    base = F.coalesce(resolved(decoded(own), url), url)

    def target(tag: Column, base: Column) -> Column:
        raw = F.regexp_extract(tag, r"(?i)(?:\bhref\s*=\s*[\"']?|;\s*url\s*=\s*[\"']?)([^\s\"'>]+)", 1)
        return resolved(decoded(raw), base)

    return F.filter(let(base, lambda b: F.transform(tags, lambda tag: target(tag, b))), lambda x: x.isNotNull())


def page_edges(pages: DataFrame) -> DataFrame:
    """url, target of every canonical link and meta refresh in pages(url, html)."""
    seen = pages.where(F.col("html").rlike("(?i)canonical|refresh"))
    return seen.select("url", F.explode(link_targets(F.col("url"), F.col("html"))).alias("target"))


def url_filter(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, by ('rule', 'alias' or 'default').

    edges: (url, target) pairs besides those in the pages' html, such as a redirect log.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    links = page_edges(pages.select("url", "html"))
    if edges is not None:
        links = links.unionByName(edges.select("url", "target"))
    links = ws.write(links.where(F.col("url").isNotNull() & F.col("target").isNotNull()).distinct(), "links")
    judged = pages.select("page_id", "url").select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.col("r.rule").alias("rule")
    members = connected_components(ws, links.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")))
    nodes = links.select("url").union(links.select("target")).distinct().select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v"))
    classes = members.join(nodes, "node").groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("a"), F.bool_or(F.col("v") == "block").alias("b"))
    alias = ws.write(members.join(classes, "component").where("b and not coalesce(a, false)").select("node", F.lit("block").alias("alias")).distinct(), "alias")
    out = judged.withColumn("node", node_of(F.col("url"))).join(alias, "node", "left")
    by = F.when(F.col("r").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", own, F.coalesce("r.verdict", "alias", F.lit("allow")).alias("verdict"), by.alias("by"))


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


#: The same in DuckDB: components as the transitive closure of the links, whose targets may be absolute, or begin
#: with a slash or two (others take resolving, which tests hold against urllib).
ORACLE_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
  UNION ALL
  SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\s[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
refs AS (SELECT url, replace(regexp_extract(tag, '(?i)(?:\bhref\s*=\s*["'']?|;\s*url\s*=\s*["'']?)([^\s"''>]+)', 1), '&amp;', '&') AS ref FROM tags),
links AS (SELECT url, CASE WHEN regexp_matches(ref, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN ref
    WHEN starts_with(ref, '//') THEN regexp_extract(url, '^([^:]*)://', 1) || ':' || ref
    WHEN starts_with(ref, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*', 0) || ref END AS target FROM refs),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM links WHERE target IS NOT NULL),
u AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls),
p AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(rest, '^([^/?#]*)([^#]*)', 2) END AS tail FROM u),
r AS (SELECT *, CASE WHEN tail IS NOT NULL THEN host || ' ' || tail END AS node, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
e AS (SELECT a.node AS a, b.node AS b FROM links JOIN r a ON a.url = links.url JOIN r b ON b.url = links.target WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a),
alias AS (SELECT reach.node FROM reach JOIN r ON r.node = reach.other GROUP BY reach.node
  HAVING bool_or(coalesce(rule IN ('example.com/en/', 'net/es/', 'net/fr/'), false)) AND NOT bool_or(coalesce(rule IN ('com/', 'www.example.com/en/'), false)))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN node IN (SELECT node FROM alias) THEN 'block' ELSE 'allow' END AS verdict
FROM pages LEFT JOIN r ON r.url = pages.url
"""
