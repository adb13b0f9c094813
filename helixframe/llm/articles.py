"""The main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block-level element. Lines in menus, footers, adverts and the like, and lines
that are mostly links, count as empty. Over windows of a few lines the text lengths are summed; the main text runs
from where the sums first surge to where they last dive.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import shaped, text_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Fixed values of the markup language.
RAW = frozenset("script style noscript template textarea title iframe svg math select option button object".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption article section main header footer nav aside form "
    "fieldset blockquote pre figure figcaption details summary hr body html head address".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN = frozenset("nav footer aside form dialog menu".split())
#: Words of class, id or role that mark a block as something else than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navigation navbar breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login "
    "related recommended share sharing social comment comments disqus reply replies respond toolbar widget pagination pager search "
    "contentinfo complementary alert copyright hidden paywall gdpr donate".split()
)
#: Beginnings of longer words that mark one too.
MARK_STEMS = ("comment", "sidebar", "advert", "sponsor", "breadcrumb", "newsletter", "cookie", "footer", "paginat", "navigat", "subscri", "recommend", "related")
#: Words that take their mark from the next one, those of an article's own parts, and marks of readers' words, which wrap no article.
NO_MARKS = frozenset("has no non not with without overflow".split())
OWN = frozenset("article content entry main page post story".split())
READERS = ("comment", "disqus", "repl", "respond")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!][^>]*\Z")


def _mark(attributes: str) -> str:
    """The word that marks a block as something else than the article, or an empty one. In a name of several words it is the
    first or the last, and begins with a stem or is a mark by itself."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            if token in ("hidden", "is-hidden", "visually-hidden"):
                return "hidden"
            for k in {0, len(words) - 1} if words else ():
                word = words[k]
                if word == "hidden" or k and words[k - 1] in NO_MARKS or word == "header" and OWN.intersection(words):
                    continue
                if word in MARKS or word.startswith(MARK_STEMS):
                    return word
    return ""


def lines(page: str) -> list[tuple[str, bool, bool, int, int]]:
    """(text, whether it may be main text, whether it is in an article, characters in links, number of the block around it)
    of each block with text. A form or a block marked by its attributes may be main text all the same if it holds most of the
    page's text that is not in links, unless it is of readers' comments or without the article that the page has."""
    found, wrappers, articles = _lines(page, frozenset())
    most = sum(len(text) - linked for text, _, _, linked, _ in found) / 2
    known = any(main and article for _, main, article, _, _ in found)
    wrong = frozenset(k for k, size in wrappers.items() if size > most and (k in articles or not known))
    return _lines(page, wrong)[0] if wrong else found


def _lines(page: str, unmarked: frozenset[int]) -> tuple[list[tuple[str, bool, bool, int, int]], dict[int, int], set[int]]:
    """The lines, the characters outside links in each marked block by its number, and which of these hold text of an article;
    blocks in `unmarked` are not marked."""
    out: list[tuple[str, bool, bool, int, int]] = []
    wrappers: dict[int, int] = {}
    articles: set[int] = set()
    open_: list[tuple[str, bool, bool, int, int]] = []  # name, may be main text, in an article, block around a line, marked blocks
    marked: list[int] = []  # the open marked blocks, outermost first
    around = number = 0
    parts: list[str] = []
    links, linked, at, main, article = 0, 0, 0, True, False

    def close_line() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, main, article, linked, around))
            for k in marked:
                wrappers[k] = wrappers.get(k, 0) + len(text) - linked
            if article:
                articles.update(marked)
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text.strip())

    def leave() -> None:
        nonlocal main, article, around
        main, article, around, depth = open_[-1][1:] if open_ else (True, False, 0, 0)
        del marked[depth:]

    size = len(page)
    while at < size:
        tag = _TOKEN.search(page, at)
        if tag is None:
            take(_OPEN_TAG.sub("", page[at:]))  # a tag that the page's end cuts off
            break
        if tag.start() > at:
            take(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        ends = bool(tag[1])
        if name in RAW and not ends and not tag[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            parts.append(" ")
        elif name == "a":
            links = max(0, links - 1) if ends else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close_line()
            if name in VOID:
                continue
            if not ends:
                links = 0
                if name == "p" and open_ and open_[-1][0] == "p":
                    open_.pop()
                    leave()
                number += 1
                inside = article or name in ("article", "main")
                mark = "" if name in ("article", "main", "body", "html") else name if name in NOT_MAIN or name == "header" and not article else _mark(tag[3])
                if mark and number not in unmarked:
                    main = False
                    if mark == "form" or name not in NOT_MAIN and name != "header" and not mark.startswith(READERS):
                        marked.append(number)
                article, around = inside, around if name in LEAVES else 0 if name in ("body", "html") else number
                open_.append((name, main, article, around, len(marked)))
            elif any(n[0] == name for n in open_):
                while open_.pop()[0] != name:
                    pass
                leave()
    close_line()
    return out, wrappers, articles


def main_text(page: str, window: int = 3, rich: int = 80) -> str:
    """The main text of one page. If most of the text that may be main is in article elements, it is their lines. Otherwise
    a stretch begins and ends where a window holds `rich` characters and takes in the lines next to it that are not empty; the
    text runs from the first to the last stretch, and over what else is in the same block as a line of `rich` characters."""
    found = lines(page)
    plain = [len(text) if main and 2 * linked <= len(text) else 0 for text, main, _, linked, _ in found]
    own = [len(text) if main and article else 0 for text, main, article, _, _ in found]
    if sum(own) * 2 >= sum(max(a, b) for a, b in zip(own, plain)) and any(own):
        return "\n".join(text for (text, *_), size in zip(found, own) if size)
    sizes = [max(a, b) for a, b in zip(own, plain)]
    sums = [sum(sizes[k:k + window]) for k in range(len(sizes))]
    surges, k = [], 0
    while k < len(sizes):
        if sums[k] < rich or not sizes[k]:
            k += 1
            continue
        surge = k
        while surge and sizes[surge - 1]:
            surge -= 1
        dive = k
        while dive < len(sizes) and (sums[dive] >= rich or sizes[dive]):
            dive += 1
        surges.append((surge, dive))
        k = dive
    # A page with little text has no surge: its lines that may be main text.
    first, last = (surges[0][0], surges[-1][1]) if surges else (0, len(sizes))
    blocks = {around for (*_, around), size in zip(found, sizes) if size >= rich} - {0}
    return "\n".join(text for k, (text, _, _, _, around) in enumerate(found) if sizes[k] and (first <= k < last or around in blocks or own[k]))


def extracted(pages: DataFrame, window: int = 3, rich: int = 80) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`.

    Null and empty pages, and pages without main text, have an empty text. Character references are decoded, white
    space within a block is one space. Repeated rows, null ids and urls stay; other columns are not read; an empty
    table gives an empty result.
    """

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, window, rich) for p in batch], dtype=object)

    rows = shaped(pages, page_id="long", url="string", html="string")
    return rows.select("page_id", "url", text(text_of("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
