"""Tags of HTML pages in one pass from left to right."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A tag, quotes counting only behind an equals sign. Nothing is tried twice (possessive), so a match costs no more than its length.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
#: The same without quotes, once a tag was never closed.
PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


def raw_ends(tags) -> dict[str, re.Pattern]:
    """For :func:`walk`: elements whose content holds no tags, by how they end."""
    return {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in tags}


def attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names (lower case) and values, without quotes, of a tag's attributes."""
    return ((name.lower(), value.strip("\"'")) for name, value in ATTRIBUTE.findall(text))


def walk(page: str, raw: dict[str, re.Pattern]) -> Iterator[tuple[str, str, bool, str, str]]:
    """(text before, tag in lower case, whether it is an end tag, attributes, content) for every tag in order.

    Comments and declarations come as a tag without name, as does what stands
    behind the last tag. A raw element comes once, as its start tag with its
    content (to the end of the page if it isn't closed). A tag that never ends
    makes quotes count no more from there on; behind the last ``>`` all is text,
    up to an unclosed comment. Linear in the length of the page.
    """
    at, n, last, tags = 0, len(page), page.rfind(">"), TAG
    while at < n:
        lt = page.find("<", at)
        while 0 <= lt < last and not (page[lt + 1].isalpha() or page[lt + 1] in "!?/"):
            lt = page.find("<", lt + 1)
        if lt < 0 or lt > last:
            comment = page.find("<!--", at)
            yield page[at : n if comment < 0 else comment], "", False, "", ""
            return
        if page[lt + 1] in "!?":
            end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            yield page[at:lt], "", False, "", ""
            if end < lt:
                return
            at = end
            continue
        m = tags.match(page, lt)
        if m is None and page[lt + 1].isalpha() and tags is TAG:
            tags = PLAIN_TAG
            m = tags.match(page, lt)
        if m is None:  # </ without a name
            yield page[at : lt + 1], "", False, "", ""
            at = lt + 1
            continue
        text, at, name = page[at:lt], m.end(), m[1].lower()
        if page[lt + 1] != "/" and name in raw and not m[2].endswith("/"):
            close = raw[name].search(page, at)
            inner = page[at : n if close is None else close.start()]
            at = n if close is None else (page.find(">", close.end()) + 1 or n)
            yield text, name, False, m[2], inner
        else:
            yield text, name, page[lt + 1] == "/", m[2], ""
