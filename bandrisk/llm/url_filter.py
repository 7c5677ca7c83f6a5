"""Block and allow rules for URLs, carried over redirects and canonical links.

A page names other addresses of its own: the canonical link and the target of a refresh, as seen from
the page or the base it sets. Links in comments, scripts and the like are not its own. Such edges make
URLs equivalent, so the components of their graph are the aliases of one page. A rule that fits
a URL decides it. The others follow their aliases: allow if any alias is explicitly allowed, block
if any is blocked and none allowed, else allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandrisk.llm.components import connected_components
from bandrisk.llm.dom import _ATTRIBUTE as ATTRIBUTE
from bandrisk.llm.dom import _Ends as TagEnds
from bandrisk.llm.text import lower_ascii
from bandrisk.sources.store import Scratch

# The rules of the query, as (host and path, verdict).
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """What equal URLs share: host, path and query; NULL without a host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), rest))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or NULL; the rules are a short list."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


# What can hold a tag that is none, and the tags that name another address.
_MARKED = re.compile(r"<!--|<(script|style|template|textarea|title|noscript|iframe|svg)\b|<(link|meta|base)(?=[\s/>])", re.I)
_REFRESH = re.compile(r"url\s*=\s*(?:'([^']*)|\"([^\"]*)|(.*))", re.I | re.S)
_BASE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def _named_tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """The ``link``, ``meta`` and ``base`` tags of a page with their attributes, character references decoded.

    Tags in comments, scripts, styles and other content that is no markup are not the page's. The first
    of equal attributes counts.
    """
    at, ends = 0, TagEnds(html)
    while found := _MARKED.search(html, at):
        at = found.end()
        if found[0] == "<!--":
            over = html.find("-->", at)
        elif found[1]:
            closing = re.compile(rf"</{found[1]}\b", re.I).search(html, at)
            over = closing.end() if closing else -1
        else:
            over = ends(at)
        if over < 0:
            return
        if found[2]:
            attributes: dict[str, str] = {}
            for part in ATTRIBUTE.finditer(html, at, over):
                attributes.setdefault(part[1].lower(), unescape(part[2] or part[3] or part[4] or "").strip())
            yield found[2].lower(), attributes
        at = over


def named_addresses(url: str, html: str) -> list[str]:
    """Absolute addresses of the canonical links and refreshes of a page; what is no address is left out."""
    base, hrefs = "", []
    for tag, attributes in _named_tags(html):
        href = attributes.get("href", "")
        if tag == "base":
            base = base or href
        elif tag == "link" and "canonical" in attributes.get("rel", "").lower().split():
            hrefs.append(href)
        elif tag == "meta" and attributes.get("http-equiv", "").lower() == "refresh":
            target = _REFRESH.search(attributes.get("content", ""))
            hrefs.append((target[1] or target[2] or target[3] or "").strip() if target else "")
    addresses = []
    for href in hrefs:
        try:
            address = urljoin(urljoin(url, base), href) if href else ""
        except ValueError:
            continue
        if _BASE.match(address):
            addresses.append(address)
    return addresses


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
        found = [(url, address) for url, html in pairs for address in named_addresses(url, html)]
        columns = [pa.array(values, pa.string()) for values in (zip(*found) if found else ([], []))]
        yield pa.record_batch(columns, ["source", "target"])


def page_links(pages: DataFrame) -> DataFrame:
    """``(source, target)`` URL nodes of the canonical links and refreshes of ``pages(url, html)``; NULL if without a host.

    Only pages that have the words for one are looked into.
    """
    worded = pages.where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike("(?i)canonical|refresh"))
    links = worded.select("url", "html").mapInArrow(_linked, "source string, target string")
    return links.select(url_node(F.col("source")).alias("source"), url_node(F.col("target")).alias("target"))


def judge_urls(
    pages: DataFrame,
    scratch: Scratch,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)`` may name further pairs of equivalent URLs. A URL that is NULL or
    has no ``://`` has an empty host and path, fits no rule, has no aliases and is allowed. Aliases
    that no page has take part: a rule that fits a link's target decides for the page. Rows come out
    as often as they go in, whatever else they share; other columns are left out.
    """
    links = page_links(pages)
    if redirects is not None:
        more = redirects.select(url_node(F.col("source")).alias("source"), url_node(F.col("target")).alias("target"))
        links = links.unionByName(more)
    # Stored first: a filter on the nodes would otherwise be pushed into the patterns that make them.
    edges = scratch.keep(links.select(F.col("source").alias("u"), F.col("target").alias("v")))
    components = connected_components(edges, scratch)
    own_host = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    own_path = F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    aliases = scratch.keep(components.select("node", "component", rule_of(own_host, own_path, rules)["verdict"].alias("own")))
    decided = aliases.groupBy("component").agg(
        F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"),
        F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"),
    )
    inherited = aliases.join(decided, "component").where("blocked AND NOT allowed").select("node")
    judged = pages.select(
        "page_id",
        "url",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        url_node(F.col("url")).alias("_node"),
    ).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    with_alias = judged.join(inherited.withColumn("_inherits", F.lit("block")), judged["_node"] == inherited["node"], "left")
    return with_alias.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_inherits", F.lit("allow")).alias("verdict"),
    )
