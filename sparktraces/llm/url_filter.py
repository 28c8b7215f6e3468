"""URL rules whose block decisions spread to aliases over redirect and canonical-link edges.

Only DataFrame functions are used.

Link targets are resolved as browsers do: absolute, ``//host``, ``/path``, ``?query``, or relative to the folder of the
page (or of its base element) with ``.`` and ``..`` carried out; schemes without a host (``mailto:``) give no edge.

Defined results. A null url, or one without ``://``, has an empty host and path; no rule fits it and it has no
alias. Between rules the longest wins; a tie goes to allow. A page without a rule of its own is blocked if an
alias is blocked by rule and no alias is allowed by rule; an explicit allow always goes first. Null html has no
links. Repeated rows are judged alike. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.llm.components import components
from sparktraces.operators.stage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def url_host(url: Column) -> Column:
    """Host after the first ``://`` with A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path up to the query or fragment; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """What names a page in the alias graph: host, path and query. Null for a url without host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, url_path(url), F.regexp_extract(url, PARTS, 3)))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)

    branches = [(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return reduce(lambda found, b: F.when(b[0], b[1]).otherwise(found), reversed(branches), F.lit(None).cast("struct<rule:string,verdict:string>"))


def without_dots(path: Column) -> Column:
    """A path from / on whose . and .. parts are carried out; .. of the root is the root."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    up = F.lit("..")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    done = F.when(F.element_at(parts, -1).isin("..", "."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(done, "/"))).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The url that a link target means on a page with url ``base``; null where it is no url with a host."""
    origin, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), url_path(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, "(?s)^/(.*/)", 1))
    own, tail = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)", 1)
    return (
        F.when(target.rlike(f"{SCHEME}//"), target)
        .when(target.rlike(SCHEME), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(origin == "", None)
        .when(target.startswith("/"), F.concat(origin, without_dots(own), tail))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(origin, without_dots(F.concat(folder, own)), tail))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) of every canonical link and refresh in the pages; targets are resolved against the page's base or url."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    found = F.array_distinct(F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), 1), F.regexp_extract_all(html, F.lit(REFRESH), 1)))
    links = pages.select(url.alias("url"), html.alias("html"), found.alias("found"))
    base = F.when(F.size("found") > 0, F.regexp_extract("html", BASE, 1))
    links = links.select("url", base.alias("base"), F.explode("found").alias("to"))
    links = links.select("url", F.regexp_replace("base", "&amp;", "&").alias("base"), F.regexp_replace("to", "&amp;", "&").alias("to"))
    links = links.select("url", "to", F.when(F.col("base") != "", resolved(F.col("base"), F.col("url"))).alias("base"))
    links = links.select("url", "to", F.coalesce("base", "url").alias("base"))
    # written once: a filter on the nodes would repeat the whole expression for each part of them
    links = staged(links.select("url", resolved(F.col("to"), F.col("base")).alias("to")))
    edges = links.select(url_node(F.col("url")).alias("src"), url_node(F.col("to")).alias("dst"))
    return edges.filter("src is not null and dst is not null")


def judged(
    pages: DataFrame,
    rules: tuple[Rule, ...],
    *,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every page.

    ``redirects`` adds edges (src, dst) of urls that are known from elsewhere. Urls at the far end of an edge
    count with their own rule even if no page has them. Only nodes that have an edge take part in the graph;
    all other pages are judged without a shuffle of the page texts.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        known = redirects.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst"))
        edges = edges.unionByName(known.filter("src is not null and dst is not null"))
    aliases = components(edges.filter("src <> dst"), "src", "dst")
    named = F.concat(F.lit("x://"), F.col("node"))
    by_rule = fitting_rule(url_host(named), url_path(named), rules)["verdict"]
    said = aliases.groupBy("component").agg(
        F.max((by_rule == "block").cast("int")).alias("any_block"), F.max((by_rule == "allow").cast("int")).alias("any_allow")
    )
    spread = F.when((F.col("any_block") == 1) & (F.coalesce("any_allow", F.lit(0)) == 0), "block").otherwise("allow")
    spread = aliases.join(said.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select("node", "component", spread.alias("spread"))
    url = F.col(url_col)
    fitted = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), url_node(url).alias("own"))
    fitted = fitted.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return fitted.join(spread, F.col("own") == F.col("node"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "spread", F.lit("allow")).alias("verdict"),
        "component",
    )
