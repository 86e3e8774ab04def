"""URL verdicts from prefix rules, carried over redirect and canonical-link aliases.

A rule names a host (with all its subdomains) and a path prefix; the longest
that fits decides. A URL that no rule fits is blocked when the URLs it is
equivalent to, by redirects or canonical links, include a blocked one. A rule
that allows a URL itself always stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

# The policy of the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<link\b(?=[^<>]*\brel\s{0,9}=\s{0,9}["']?canonical)[^<>]*?\bhref\s{0,9}=\s{0,9}["']?([^"'\s<>]+)"""
_REFRESH = (r"""(?i)<meta\b(?=[^<>]*http-equiv\s{0,9}=\s{0,9}["']?refresh)"""
            r"""[^<>]*?content\s{0,9}=\s{0,9}["'][^"'<>]*?url\s{0,9}=\s{0,9}["']?([^"'\s<>]+)""")
_BASE = r"""(?i)<base\b[^<>]*?\bhref\s{0,9}=\s{0,9}["']?([^"'\s<>]+)"""
# The entities that addresses are written with.
_ENTITIES = (("&#38;", "&"), ("&#x26;", "&"), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def alias_key(url: Column) -> Column:
    """What equal addresses share: host, path without a closing slash, query; no scheme or fragment.

    Equal to nothing but itself where there is no ``://``.
    """
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/\z", ""), rest)
    return F.when(url.contains("://"), key).otherwise(url)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct<rule, action>`` of the longest fitting rule, else NULL."""
    found = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        answer = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, answer) if found is None else found.when(fits, answer)
    return found


def plain(target: Column) -> Column:
    """An address as written in HTML without its entities, ``&amp;`` last."""
    for entity, sign in _ENTITIES:
        target = F.replace(target, F.lit(entity), F.lit(sign))
    return target


def without_dots(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` parts, as addresses are resolved."""
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(
            part == ".", done).otherwise(F.concat(done, F.array(part)))

    folder = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.concat(F.lit("/"), kept, F.when(kept != "", folder).otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """The absolute address of a target met on a page whose address is ``base``; NULL without a host."""
    origin = F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)\A.*?:(?=//)", 0)
    query = F.regexp_extract(base, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)\A.*/", 0))
    there = F.regexp_extract(target, r"(?s)\A[^?#]*", 0)
    behind = F.substring(target, F.length(there) + 1, F.length(target))
    from_root = F.when(there.startswith("/"), there).otherwise(F.concat(folder, there))
    clean = F.when(from_root.contains("/."), without_dots(from_root)).otherwise(from_root)
    return F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), target).when(
        (origin == "") | target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None)).when(
        target.startswith("//"), F.concat(scheme, target)).when(
        target.startswith("?"), F.concat(origin, path, target)).when(
        target.startswith("#"), F.concat(origin, path, query)).otherwise(F.concat(origin, clean, behind))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst``: each page and what its canonical link or meta refresh points at.

    Targets are resolved as browsers do, against the page's ``base`` element if
    it has one; those of another kind than host and path, such as ``mailto:``,
    are not followed. Patterns never run past a tag, so they are linear.
    """
    low = F.lower(html)
    canonical = F.when(F.contains(low, F.lit("canonical")), F.regexp_extract(html, _HREF, 1))
    refresh = F.when(F.contains(low, F.lit("refresh")), F.regexp_extract(html, _REFRESH, 1))
    base = F.when(F.contains(low, F.lit("<base")), plain(F.regexp_extract(html, _BASE, 1)))
    found = pages.select(url, base.alias("base"), F.explode(F.array_compact(F.array(canonical, refresh))).alias("target"))
    here = F.when(F.coalesce("base", F.lit("")) != "", resolved(F.col("base"), F.col(url))).otherwise(F.col(url))
    return (
        found.filter("target != ''").withColumns({"base": F.coalesce(here, F.col(url)), "target": plain(F.col("target"))})
        .select(F.col(url).alias("src"), resolved(F.col("target"), F.col("base")).alias("dst")).dropna()
    )


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None,
    key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``key, host, path, rule, verdict`` and ``alias_of`` for every page.

    ``redirects`` (``src, dst`` URLs), if given, joins the links found in the
    pages. Equivalent URLs are the connected components over both. The verdict
    is that of the longest fitting rule; without one it is ``block`` when any
    URL of the component, crawled or not, is blocked by a rule, else ``allow``.
    NULL URLs and URLs without ``://`` have empty host and path and are
    allowed; pages that repeat are judged alike; other columns are ignored.
    """
    links = link_edges(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = stored(links, "links")
    aliases = components(links.select(
        alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")))

    def judged(u: Column) -> Column:
        return matched_rule(host_of(u), path_of(u), rules)

    blocked = (
        pages.select(F.col(url).alias("u"))
        .unionByName(links.select(F.col("src").alias("u"))).unionByName(links.select(F.col("dst").alias("u")))
        .filter(judged(F.col("u"))["action"] == "block").select(alias_key(F.col("u")).alias("node")).distinct()
        .join(aliases, "node", "left").select(F.coalesce("component", "node").alias("alias_of")).distinct()
        .withColumn("_blocked", F.lit(True)))
    u = F.col("_u")
    return (
        pages.select(F.col(key).alias("_id"), F.col(url).alias("_u"))
        .select("_id", host_of(u).alias("host"), path_of(u).alias("path"), judged(u).alias("_rule"),
                alias_key(u).alias("node"))
        .join(aliases, "node", "left")
        .withColumn("alias_of", F.coalesce("component", "node"))
        .join(blocked, "alias_of", "left")
        .select(
            F.col("_id").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.action"), F.when(F.col("_blocked"), "block"), F.lit("allow"))
            .alias("verdict"), "alias_of"))
