"""URL verdicts: prefix rules on hosts and paths, carried over redirect and canonical links.

Every URL has a node: host and path without a closing slash, plus its query without tracking
parameters, so spellings of one address meet by equality.  Redirects (meta refresh) and canonical
links of the pages are edges between nodes; the connected components of these edges are aliases
of one another.  A URL under a rule gets the verdict of that rule.  Any other URL is blocked if an
alias is blocked by a rule and no alias is explicitly allowed by one; otherwise it is allowed.

A node's rows are combined before they are joined, and only groups that end blocked are joined
back, so a host or a URL that holds a third of the pages is one row there.

Defined cases: null or malformed URL (no ``://``): empty host and path, no rule, no node, allowed.
Null or empty html: no edges.  Repeated rows: judged one by one, alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, lower_ascii, staged, table


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed by the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
CANONICAL = "(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>"
REFRESH = "(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"
HREF = "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
# Entities of HTML for signs of addresses.
ENTITIES = (("#x2f|#47|sol", "/"), ("#x3a|#58|colon", ":"), ("#x3f|#63|quest", "?"), ("#x3d|#61|equals", "="), ("quot|#34|#x22", '"'), ("amp|#38|#x26", "&"))
GOES_TO = "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address a URL spells; null where it has no host."""
    host, path = host_of(url), F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                                       .otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule, allow before block at equal length; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(link: Column, base: Column) -> Column:
    """An absolute URL for a link found on the page ``base``."""
    scheme = F.regexp_extract(base, "^([^:/?#]*:)//", 1)
    site = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (F.when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(site, link))
            .otherwise(F.concat(folder, F.when(folder == site, F.lit("/")).otherwise(F.lit("")), link)))


def decoded(link: Column) -> Column:
    """The few entities that occur in addresses; the ampersand last, so that nothing is decoded twice."""
    for entity, sign in ENTITIES:
        link = F.regexp_replace(link, f"(?i)&(?:{entity});", sign)
    return link


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``source`` and ``target`` URL of every redirect and canonical link that a page declares, however many there are.

    Tags without an address (a page that refreshes itself) and links to the page itself say nothing.
    """
    def addresses(tag: str, part: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))

    links = F.concat(addresses(CANONICAL, HREF), addresses(REFRESH, GOES_TO))
    return (pages.where(F.col(html).rlike("(?i)canonical|http-equiv"))
            .select(F.col(url).alias("source"), F.explode(F.array_distinct(F.filter(links, lambda x: x != ""))).alias("link"))
            .select("source", resolved(decoded(F.col("link")), F.col("source")).alias("target"))
            .where("source is not null and target is not null and source != target"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, links: DataFrame | None = None, key: str = "page_id",
          url: str = "url") -> DataFrame:
    """``key``, host, path, rule and verdict of every page.

    ``links`` has source and target URLs: what the pages declare, and a crawler's redirect log if there is one.
    """
    link_nodes = None
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    said = own.where("own is not null").select("node", F.col("own.verdict").alias("verdict"))
    if links is not None:
        link_nodes = staged(links.select(F.explode(F.array("source", "target")).alias("url"),
                                         node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
        said = said.unionByName(
            link_nodes.select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("own"))
            .where("own is not null").select("node", F.col("own.verdict").alias("verdict")))
    per_node = said.where("node is not null").groupBy("node").agg(
        F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    if link_nodes is None:
        blocked = per_node.where("block and not allow").select("node")
    else:
        alias = components(link_nodes, "a", "b")
        grouped = per_node.join(alias, "node", "left").withColumn("group", F.coalesce("component", "node"))
        groups = grouped.groupBy("group").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
        groups = groups.where("block and not allow").select("group")
        # a group is its own only node, or the nodes of a component
        members = alias.select("node", F.col("component").alias("group")).join(groups, "group", "left_semi").select("node")
        blocked = members.unionByName(groups.select(F.col("group").alias("node"))).distinct()
    return own.join(blocked.withColumn("aliased", F.lit(True)), "node", "left").select(
        F.col("id").alias(key), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("aliased"), F.lit("block")), F.lit("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, link_edges(pages))


# The given pages declare no links, so aliases are the spellings of one address here; tests cover links by brute force.
ORACLE = r"""
WITH cut AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS kept
  FROM cut),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (
  SELECT p.page_id, p.host, p.path,
         CASE WHEN p.host <> '' THEN p.host || regexp_replace(p.path, '/+$', '')
              || CASE WHEN len(p.kept) > 0 THEN '?' || array_to_string(p.kept, '&') ELSE '' END END AS node,
         arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL),
blocked AS (SELECT node FROM judged WHERE verdict IS NOT NULL AND node IS NOT NULL GROUP BY node
            HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN blocked b ON b.node = j.node
"""
