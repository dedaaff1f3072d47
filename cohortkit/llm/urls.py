"""URL filters: host and path rules, carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""
HOST = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, HOST, 2), F.lit(""))


def resource(url: Column) -> Column:
    """What a link names: scheme and host in lower case, no fragment; null without ://."""
    parts = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^#]*)", 2)
    return F.when(parts != "", F.concat(lower_ascii(parts), rest))


def resolve(link: Column, base: Column) -> Column:
    """An absolute url for a link found on page ``base``; up to 64 leading dot segments are walked."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    dots = F.regexp_extract(link, r"^((?:\.{1,2}/){0,64})", 1)
    up = ((F.length(dots) - F.length(F.replace(dots, F.lit("../"), F.lit("")))) / 3).cast("int")
    below = F.split(F.regexp_extract(url_path(base), r"(?s)^/?(.*/)?", 1), "/")
    kept = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1 - up, F.lit(0)))
    folder = F.concat(origin, F.lit("/"), F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("/"))), ""))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link == "", F.lit(None))
            .when(link.startswith("?"), F.concat(origin, url_path(base), link))
            .otherwise(F.concat(folder, F.substr(link, F.length(dots) + 1))))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): each page's resource and what its canonical links and refresh redirects name."""
    html = F.coalesce("html", F.lit(""))
    every = lambda tag, url: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)),
                                         lambda t: F.replace(F.regexp_extract(t, url, 1), F.lit("&amp;"), F.lit("&")))
    targets = F.concat(every(CANONICAL, HREF), every(REFRESH, REFRESH_URL))
    return (pages.select("url", F.explode(F.filter(targets, lambda t: t != "")).alias("link"))
            .select(resource(F.col("url")).alias("a"), resource(resolve(F.col("link"), F.col("url"))).alias("b"))
            .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) rule that fits, allow before block
    among equals; nulls if none does.  A rule fits its host and subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]],
                redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, propagated) for every page.

    A rule's verdict stands.  Pages without a rule are aliases of everything they reach over
    canonical links, refresh redirects and ``redirects`` (two url columns), in any direction:
    they are blocked if a resource of that component is, unless one is explicitly allowed.
    Resources that are only linked to count too.  Everything else is allowed.

    Components are found on resources, not pages, so copies of a page cost one row; only those
    with a blocked and no allowed resource are joined back.  Null or odd urls have an empty
    host and path and no links; null html has no links; page_id may be null or repeat; other
    columns are ignored.  The rules are a list that a person keeps; they become one expression.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.toDF("a", "b").select(
            resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b")))
    found = components(edges)
    _, decided = rule_of(url_host(F.col("node")), url_path(F.col("node")), rules)
    by_root = found.select("node", "root", decided.alias("decided"))
    blocked = (by_root.groupBy("root").agg(F.max(F.col("decided") == "block").alias("b"),
                                           F.max(F.col("decided") == "allow").alias("a"))
               .filter("b AND NOT coalesce(a, false)").select("root"))
    aliases = found.join(blocked, "root").select(F.col("node").alias("_node"))
    parts = pages.select("page_id", resource(F.col("url")).alias("_r"), url_host(F.col("url")).alias("host"),
                         url_path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "_own": verdict})
    joined = parts.join(aliases, parts["_r"] == aliases["_node"], "left")
    spread = F.col("_own").isNull() & F.col("_node").isNotNull()
    return joined.select("page_id", "host", "path", "rule", F.coalesce(
        "_own", F.when(spread, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        spread.alias("propagated"))
