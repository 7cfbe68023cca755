"""Operator 10, URL filters: redirect equivalence (DataFrame functions only).

Rules (host, path) decide a URL when one fits: the rule's host is the
URL's host or a parent domain of it, and the URL's path starts with the
rule's path; the longest rule wins. URLs that no rule fits take the
decision of their aliases: redirects (``<meta http-equiv=refresh>``) and
canonical links (``<link rel=canonical>``) are edges, their connected
components are found by a distributed job, and a component that holds a
blocked URL blocks its members. A URL with an allow rule of its own stays
allowed.

Every canonical link and every refresh of a page counts. Attribute values are
read whole, quoted or not; the named references of markup characters and
numeric ones up to 255 are decoded; a tag ends at its first ``>``. Targets
are resolved against the page's URL: ``//``, ``/``, ``?``, ``.`` and ``..``;
targets of schemes without ``://`` (``mailto:``) are no links. As nodes, URLs
lose their fragment, dot segments and upper case in the host, and an empty
path is ``/``.

Edge cases: a null URL or one without ``://`` has empty host and path,
no rule and verdict ``allow``; null html has no edges; repeated pages are
judged row by row alike; an empty table gives an empty result. Columns
other than the key, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize
from fleetlens.llm.components import connected_components

RULE_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"
_CANONICAL = (r"(?is)\srel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'"
              r"|canonical(?![^\s/>]))")
_REFRESH = r"(?is)\shttp-equiv\s*=\s*(?:\"\s*refresh\s*\"|'\s*refresh\s*'|refresh(?![^\s/>]))"
_VALUE = r"(?is)\s{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
# seconds, a separator, and the target with or without ``url=``
_TARGET = r"(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.*)$"
_NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def url_host(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path: after the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; ``/`` if empty."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    walked = F.aggregate(segments, F.lit(""), lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*$", ""))
                         .when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s)))
    closed = F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path == "", "/").when(path.contains("/."), closed).otherwise(path)


def url_node(url: Column) -> Column:
    """The URL as a graph node: fragment and dot segments dropped, host lower-cased; null without ``://``."""
    return F.when(url.contains("://"), F.concat(
        F.regexp_extract(url, r"(?s)^(.*?://)", 1), url_host(url), _without_dots(url_path(url)),
        F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)))


def _value(tag: Column, name: str) -> Column:
    """An attribute's value, decoded and trimmed; empty if there is none."""
    raw = F.concat(*[F.regexp_extract(tag, _VALUE.format(name), i) for i in (1, 2, 3)])
    parts = F.split(raw, "&#")
    digits = r"^([0-9]{1,3}|[xX][0-9a-fA-F]{1,2});"

    def decoded(p: Column) -> Column:
        number = F.regexp_extract(p, digits, 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).try_cast("int")
        return F.when(p.rlike(digits) & (code < 256), F.concat(F.char(code), F.regexp_replace(p, digits, ""))
                      ).otherwise(F.concat(F.lit("&#"), p))

    text = F.when(raw.contains("&#"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
                  ).otherwise(raw)
    for reference, char in _NAMED:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.trim(text)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes of every canonical link and refresh redirect in the pages."""
    u = F.col(url)
    links = F.transform(F.filter(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_CANONICAL)),
                        lambda t: _value(t, "href"))
    moves = F.transform(F.filter(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: t.rlike(_REFRESH)),
                        lambda t: F.regexp_replace(F.regexp_extract(_value(t, "content"), _TARGET, 1), r"(?s)^([\"'])(.*?)\1.*$", "$2"))
    found = (pages.where(u.contains("://") & F.col(html).rlike("(?i)canonical|refresh"))
             .select(u.alias("u"), F.explode(F.concat(links, moves)).alias("to")).select("u", F.trim("to").alias("to")))
    root = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract("u", r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    to = F.col("to")
    absolute = (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
                .when(to.startswith("//"), F.concat(F.regexp_extract("u", r"(?s)^(.*?:)//", 1), to))
                .when(to.startswith("/"), F.concat(root, to))
                .when(to.startswith("?"), F.concat(page, to))
                .when(to.startswith("#") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
                .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), to)))
    return (found.where(to != "").select(url_node(F.col("u")).alias("src"), url_node(absolute).alias("dst"))
            .where("src != dst").distinct())


def fit_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of distinct (host, path) with the longest fitting rule.

    Each host is expanded to its parent domains, at most one row a label,
    and equi-joined with the rules on the host; no row meets a rule of
    another domain. Returns host, path, rule, rule_verdict for the pairs
    that some rule fits.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    r = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"))
    name = F.concat("_rh", "_rp")
    best = F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("_rv").alias("v")))
    return (addresses.select("host", "path").distinct()
            .withColumn("_rh", F.explode(parents)).join(r, "_rh")
            .where(F.col("path").startswith(F.col("_rp")))
            .groupBy("host", "path").agg(best.alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], key: str = "page_id",
               url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, alias_group.

    ``rules``: (host, path, allow|block) rows. ``edges`` (src, dst URLs)
    replaces the edges read from the pages' html. ``alias_group`` is the
    smallest URL of the page's component, null if it has no alias.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), RULE_SCHEMA)
    if edges is None:
        edges = page_edges(pages, url, html)
    else:
        edges = edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst"))
    groups = connected_components(edges, "src", "dst")

    u = F.col(url)
    base = pages.select(F.col(key), url_host(u).alias("host"), url_path(u).alias("path"), url_node(u).alias("_node"))
    addresses = base.select("host", "path").unionAll(
        groups.select(url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path")))
    # written tables on the small side of each join: AQE can then split a hot URL or group on the other side
    fits = materialize(fit_rules(addresses.where("host != ''"), rules), "url-rules")

    members = groups.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))})
    blocked = (members.join(fits, ["host", "path"], "left").groupBy("component")
               .agg(F.max(F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("_blocked")))
    alias = materialize(groups.join(materialize(blocked, "url-blocked"), "component").select(
        F.col("node").alias("_node"), F.col("component").alias("alias_group"), "_blocked"), "url-aliases")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return (base.join(fits, ["host", "path"], "left").join(alias, "_node", "left")
            .select(key, "host", "path", "rule", verdict.alias("verdict"), "alias_group"))
