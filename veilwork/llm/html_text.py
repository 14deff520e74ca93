"""Main text of web pages by site template removal.

1. Each page is cut into block elements; every block element's subtree gets a hash of its tags and text. 2. Spark counts, per host and per section (first folder of the path), the distinct
contents that hold a subtree: pages that read the same without this step are one content. 3. Subtrees outside the article on at least `least_pages` contents and `least_share` of those of the host or section are
deleted from its pages, subtrees inside article or main on at least `least_in_main` and `share_in_main`. 4. What does not recur word for word, such as a page's own menu, advert or
reader comments, is known by its tag, role or class; layout classes count outside article and main only, and not on a wrapper of the article, inside those it takes a mark of adverts or comments. What is left of article or main, or of the body where there is neither, is
the text: blocks in page order, white space runs turned into one space, joined by an empty line. Removed elements inside a line do not cut its block.

Null and empty html give an empty text; broken markup is read as far as it goes (unclosed elements end with their parent). A null url is a host of its own. Repeated rows
give equal rows and count once. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches, give_back, materialise, table

OPENING = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# HTML's elements by what they do to the text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
NO_TEXT = frozenset("script style template noscript iframe object svg canvas audio video select datalist textarea title head button".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside form menu dialog search".split())
ENDS_P = BLOCK - {"body", "html"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MARK = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|sidebar|side-bar|nav\w*|menu\w*|breadcrumbs?|comments?|disqus\w*|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|widget\w*|masthead|site-header|site-footer|page-header|page-footer|header|footer|skip-link|pagination|pager)(?=$|[\s_-])", re.I)
# Marks of what is no part of an article even where it is built of article elements
IN_MAIN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus\w*|replies|respond|cookies?|consent|newsletter|subscribe|signup|sharing|share-(?:bar|buttons?|links?)|social-(?:bar|buttons?|links?))(?=$|[\s_-])", re.I)
OTHER_TEXT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus\w*|replies|respond|related|recommend\w*)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _boiler(tag: str, attributes: str, in_main: bool) -> int:
    """2 for what its tag, role or class says is no article text, 1 for a class of the page's layout alone, which may stand on a wrapper of the article, else 0."""
    if tag in BOILER and not (tag == "header" and in_main):
        return 2
    found = 0
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag == "article" and re.search(r"(?i)\bcomment|\brepl(?:y|ies)", value):
                    return 2
                if in_main and IN_MAIN.search(value) and tag not in ("article", "main"):
                    return 2
                if not in_main and tag not in ("body", "html", "article", "main") and MARK.search(value):
                    found = 1
                    if OTHER_TEXT.search(value):
                        return 2
            elif name == "role":
                if value.lower() in ROLES:
                    return 2
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
    return found


class Page:
    """parent, tag, boiler, main (inside an article or main) per node; blocks: (node, text); hash per node."""

    def __init__(self, html: str):
        self._wrappers: set[int] = set()
        self._read(html)
        if wrappers := self._around_article():
            self._wrappers = wrappers
            self._read(html)

    def _around_article(self) -> set[int]:
        """Nodes with a layout class that hold the main element, or the articles where no other is left."""
        passed: set[int] = set()
        hard = [False]  # below or at an element that cannot be a wrapper
        tags = ("main",) if any(self.main) else ("article", "main")
        for n in range(1, len(self.tag)):
            hard.append(hard[self.parent[n]] or self.own[n] == 2)
            if self.tag[n] in tags and self.boiler[n] and not self.own[n] and not hard[n]:
                up = self.parent[n]
                while up > 0 and up not in passed:
                    passed.add(up)
                    up = self.parent[up]
        return {n for n in passed if self.own[n]}

    def _read(self, html: str) -> None:
        self.own = [0]
        self.parent, self.tag, self.boiler, self.main = [-1], ["#"], [False], [False]
        self.content: list[list] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._stack, self._buffer = [0], []
        self._mute = 0  # place in the stack of a removed element inside a line: its text is left out, the line goes on behind it
        self._open_tags: dict[str, int] = {}
        self._broken = at = 0
        while (m := OPENING.search(html, at)) is not None:
            start, opened = m.start(), m[2] is not None
            if m[0] == "<!--":
                end = html.find("-->", start + 4)
                end = len(html) if end < 0 else end + 2
            else:
                end = self._tag_end(html, m.end()) if opened else html.find(">", m.end())
                if end < 0:
                    break  # no ">" from here on, so no element either
            if start > at and not self._mute:
                self._buffer.append(html[at:start])
            at = end + 1
            if not opened:
                continue
            tag, attributes = m[2].lower(), html[m.end() : end]
            if m[1]:
                self._close(tag)
                continue
            if tag in RAW and not attributes.rstrip().endswith("/"):
                found = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                at = found.end() if found else len(html)
                continue
            self._open(tag, attributes)
        if at < len(html) and not self._mute:
            self._buffer.append(html[at:])
        self._flush()

    def _tag_end(self, html: str, at: int) -> int:
        """Place of the ">" that ends a tag, outside of quotes; -1 without one. Where a quote is never closed, quotes count for nothing up to it, so that no part is read again and again."""
        i = at
        while at >= self._broken:
            m = STOP.search(html, i)
            if m is None:
                self._broken = len(html)
                break
            if m[0] == ">":
                return m.start()
            i = html.find(m[0], m.end()) + 1
            if not i:
                self._broken = m.end()
        return html.find(">", at)

    def _pop(self, depth: int) -> None:
        """Ends the open elements from a place in the stack on."""
        for n in self._stack[depth:]:
            self._open_tags[self.tag[n]] -= 1
        del self._stack[depth:]

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                node = self._stack[self._mute - 1]  # the innermost element, or the one that holds what is left out
                self.content[node].append(text)
                self.blocks.append((node, text))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr") and not self._mute:
            self._buffer.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        top = self._stack[-1]
        own = 2 if tag in NO_TEXT else _boiler(tag, attributes, self.main[top])
        if len(self.parent) in self._wrappers:
            own = 0
        boiler = own > 0
        if tag not in BLOCK and not boiler:
            return
        if tag in BLOCK:
            self._flush()
        if tag in ENDS_P and self.tag[self._stack[-1]] == "p":
            self._pop(-1)
        if tag in SAME_ENDS:
            while self.tag[self._stack[-1]] in SAME_ENDS[tag]:
                self._pop(-1)
        top = self._stack[-1]
        node = len(self.parent)
        self.parent.append(top)
        self.tag.append(tag)
        self.own.append(own)
        self.boiler.append(boiler or self.boiler[top])
        self.main.append(not self.boiler[node] and (self.main[top] or tag in ("article", "main")))
        self.content.append([])
        self.content[top].append(node)
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            self._stack.append(node)
            self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
            if tag not in BLOCK and not self._mute:
                self._mute = len(self._stack) - 1

    def _close(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCK:
            self._flush()
        if self._open_tags.get(tag):  # else a stray end, for which nothing is looked through
            depth = len(self._stack) - 1
            while self.tag[self._stack[depth]] != tag:
                depth -= 1
            if depth <= self._mute:
                self._mute = 0
            self._pop(depth)

    def hashes(self) -> list[int | None]:
        """A signed 64-bit hash of each subtree's tags and text, odd inside an article or main; None without text."""
        out: list[int | None] = [None] * len(self.parent)
        for node in range(len(self.parent) - 1, -1, -1):  # children come after their parents
            parts = [x if isinstance(x, str) else out[x] for x in self.content[node]]
            parts = [p for p in parts if p is not None]
            if parts:
                h = xxhash.xxh3_64_intdigest(repr((self.tag[node], parts)).encode("utf-8", "surrogatepass"))
                out[node] = h - (1 << 64) if h >> 63 else h
        return [h if h is None else h & ~1 | main for h, main in zip(out, self.main)]

    def templates(self) -> set[int]:
        """Hashes of the subtrees that may be deleted: block elements below the body, and those below an article or main, but none that holds one whole."""
        has_main = {n for n in range(len(self.parent)) if self.main[n] and not self.main[self.parent[n]]}
        holds = set()
        for n in has_main:
            while n >= 0 and n not in holds:
                holds.add(n)
                n = self.parent[n]
        return {h for n, h in enumerate(self.hashes()) if h is not None and n and n not in holds and self.tag[n] not in ("html", "body", "head")}

    def text(self, gone: set[int]) -> str:
        drop = list(self.boiler)
        if gone:
            for n, h in enumerate(self.hashes()):
                if h in gone and not (self.main[n] and not self.main[self.parent[n]]):
                    drop[n] = True
        for n in range(1, len(drop)):
            drop[n] = drop[n] or drop[self.parent[n]]
        inside = [False]  # of the main element, beside which an article (a teaser) is none of the text
        for n in range(1, len(drop)):
            inside.append(inside[self.parent[n]] or self.tag[n] == "main")
        for part in (inside, self.main):
            if any(x and not d for x, d in zip(part, drop)):
                return "\n\n".join(t for n, t in self.blocks if part[n] and not drop[n])
        return "\n\n".join(t for n, t in self.blocks if not drop[n])


def common_subtrees(found: DataFrame, least_pages: int, least_share: float, least_in_main: int, share_in_main: float) -> tuple[DataFrame, DataFrame]:
    """(page, area, content, subtree) of all subtrees, and (area, subtree) of those to be deleted: from rows (page, host, section, content, subtrees). An area is a host or a section of one."""
    whole, part = F.concat("host", F.lit("/")), F.concat("host", F.lit("/"), "section", F.lit("/"))
    areas = found.withColumn("area", F.explode(F.when(F.col("section") == "", F.array(whole)).otherwise(F.array(whole, part))))
    nodes = areas.select("page", "area", "content", F.explode("subtrees").alias("subtree"))
    totals = materialise(areas.select("area", "content").distinct().groupBy("area").agg(F.count("*").alias("pages")))
    common = nodes.select("area", "subtree", "content").distinct().groupBy("area", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    inside = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    enough = F.when(inside, (F.col("n") >= least_in_main) & (F.col("n") >= share_in_main * F.col("pages"))).otherwise(F.col("n") >= least_share * F.col("pages"))
    return nodes, materialise(materialise(common).join(totals, "area").where(enough).select("area", "subtree"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, least_share: float = 0.1,
                 least_in_main: int = 10, share_in_main: float = 0.5) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    bound_arrow_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1)), F.lit(""))
    section = F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), host.alias("host"), section.alias("section"))
    rows = rows.withColumn("page", F.xxhash64("page_id", "url", "html"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [Page(h) for h in b["html"]]
            content = [xxhash.xxh3_64_intdigest(p.text(set()).encode("utf-8", "surrogatepass")) >> 1 for p in read]
            yield pd.DataFrame({"page": b["page"], "host": b["host"], "section": b["section"], "content": content, "subtrees": [sorted(p.templates()) for p in read]})

    found = materialise(rows.select("page", "host", "section", "html").mapInPandas(cut, "page long, host string, section string, content long, subtrees array<long>"))
    nodes, common = common_subtrees(found, least_pages, least_share, least_in_main, share_in_main)
    gone = nodes.join(common, ["area", "subtree"], "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("gone"))  # at most a page's own subtrees
    joined = rows.select("page_id", "url", "html", "page").join(materialise(gone), "page", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [Page(h).text(set(g) if g is not None else set()) for h, g in zip(b["html"], b["gone"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "gone").mapInPandas(read, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
