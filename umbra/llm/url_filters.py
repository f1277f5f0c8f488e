"""URL rules, with block decisions carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import lower_az, materialise
from umbra.llm.components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
CANONICAL = r"""(?is)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
REFRESH = r"""(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""
#: Where markup is none.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|noscript|template)\b.*?(?:</\1\b|\z)"
#: A link that names its scheme; only with // behind it a host follows.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_az(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """The URL as a node of aliases: host (A-Z lower-cased), path and query; scheme and fragment dropped."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.concat(url_parts(url)[0], F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: Column | None = None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are literals of the plan."""
    name, says = None, None
    for verdict, of, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        name = F.when(fits, of + under) if name is None else name.when(fits, of + under)
        says = F.when(fits, verdict) if says is None else says.when(fits, verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, says)


def _resolved(host: Column, path: Column, link: Column) -> Column:
    """An absolute URL for ``link`` as found on the page of host and path; null for what names no other page (mailto:, #part)."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(path, "^(.*/)", 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(SCHEME + "//"), link)
        .when(link.rlike(SCHEME), None)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("?"), F.concat(F.lit("x://"), host, path, link))
        .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): pages' keys and the keys their redirects and canonical links name. A key is host, path and query (see :func:`url_key`)."""
    host, path = url_parts(F.col(url_col))
    html = F.regexp_replace(F.col(html_col), UNREAD, " ")
    canonical = F.when(F.col(html_col).rlike("(?i)canonical"), F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1))
    refresh = F.when(F.col(html_col).rlike("(?i)refresh"), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), REFRESH_URL, 1))
    found = pages.select(url_key(F.col(url_col)).alias("u"), host.alias("h"), path.alias("p"), F.explode(F.array(canonical, refresh)).alias("link")).where("link <> '' AND h <> ''")
    to = found.select("u", _resolved(F.col("h"), F.col("p"), F.col("link")).alias("to"))
    return to.where(url_parts(F.col("to"))[0] != "").select("u", url_key(F.col("to")).alias("v")).distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides. Where none fits, the page is blocked if
    a block rule holds for any URL of its alias component (pages joined by
    redirects and canonical links, and the targets they name, page or not);
    otherwise it is allowed. An explicit allow rule always wins for its own URL,
    whatever its aliases; it does not free aliases that no rule names. Rules see
    host and path; aliases are whole URLs, so pages of one path with different
    queries are different ones.

    ``redirects``: more edges as URLs (u, v), as from a crawl log. Pages with
    null or malformed URLs have no host, no aliases and verdict allow; null html
    has no links; links in comments and scripts are none. Rules of one length that
    fit the same URL go in the order of verdict, host and path, allow first.
    Repeated pages each get a row; other columns aren't read; an empty table
    gives none; pages of any length are read whole.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("u")).alias("u"), url_key(F.col("v")).alias("v")).where("u <> '' AND v <> ''"))
    edges = materialise(edges, "aliases")
    blocked = _blocked(edges, rules)
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_key(F.col(url_col)).alias("key"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "says": verdict})
    if blocked is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"))
    return judged.join(blocked, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))


def _blocked(edges: DataFrame, rules) -> DataFrame | None:
    """(key, hit) of every key in a component with a blocked URL; None without edges."""
    if edges.isEmpty():
        return None
    member = connected_components(edges)
    member = member.unionAll(member.select("component", "component")).distinct()
    _, says = best_rule(F.regexp_extract("node", "^([^/?]*)", 1), F.regexp_extract("node", "^[^/?]*([^?]*)", 1), rules)
    bad = member.where(says == "block").select("component").distinct()
    return member.join(bad, "component", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("hit"))
