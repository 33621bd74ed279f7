"""Small per-document helpers that run inside tasks: HTML, chunks, robots files."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import quote, unquote, urljoin, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is never page content.
SILENT_TAGS = frozenset({"script", "style", "noscript", "template", "svg", "canvas", "head", "title"})
# Link endings that are never pages.
ASSET_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico",
    ".css", ".js", ".mjs", ".mp3", ".mp4", ".mov", ".avi", ".webm",
    ".zip", ".gz", ".tar", ".dmg", ".exe", ".ics", ".xml", ".rss",
    ".json", ".woff", ".woff2", ".ttf", ".eot",
)


def chunk_spans(ends: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut 0..ends[-1] into spans of at most ``limit``, at the last paragraph end in reach or else at the limit."""
    start = 0
    while start < ends[-1]:
        last = bisect_right(ends, start + limit) - 1
        stop = ends[last] if last >= 0 and ends[last] > start else start + limit
        yield start, stop
        start = stop


def chunks_of(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters that end where paragraphs end if they can.

    A text over the limit is cut with two line ends behind every paragraph, the last one
    included; a blank last piece is left out unless it is the only one.
    """
    if len(text) <= limit:
        return [text if text.strip() else ""]
    ends = list(accumulate(len(paragraph) + 2 for paragraph in text.split("\n\n")))
    padded = f"{text}\n\n"
    pieces = [padded[start:stop] for start, stop in chunk_spans(ends, limit)]
    return pieces[:-1] or [""] if not pieces[-1].strip() else pieces


class _Reader(HTMLParser):
    """One pass over a document: hrefs, the base address and text nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []
        self.base: str | None = None
        self.nodes: list[str] = []
        self._open: list[str] = []
        self._node: list[str] = []

    def _end_node(self) -> None:
        node = "".join(self._node).strip()
        if node:
            self.nodes.append(node)
        self._node.clear()

    def handle_starttag(self, tag, attrs):
        self._end_node()
        if tag == "body":
            self._open.clear()
        if tag in SILENT_TAGS:
            self._open.append(tag)
        href = dict(attrs).get("href")
        if href is not None:
            if tag == "a":
                self.hrefs.append(href)
            elif tag == "base" and self.base is None:
                self.base = href

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_node()
        if tag in self._open:
            del self._open[len(self._open) - 1 - self._open[::-1].index(tag) :]

    def handle_comment(self, data):
        self._end_node()

    def handle_data(self, data):
        if not self._open:
            self._node.append(data)


def _read(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._end_node()
    return reader


def text_of(html: str) -> str:
    return "\n".join(_read(html).nodes)


def links_of(page_url: str, html: str) -> Iterator[tuple[str, str]]:
    """(absolute address, 'page' or 'pdf') of every anchor; asset links are dropped."""
    document = _read(html)
    try:
        base = urljoin(page_url, document.base) if document.base else page_url
    except ValueError:
        base = page_url
    for href in document.hrefs:
        try:
            address = urljoin(base, href).split("#")[0]
            path = urlparse(address).path.lower()
        except ValueError:
            continue
        if path.endswith(".pdf"):
            yield address, "pdf"
        elif not path.endswith(ASSET_ENDINGS):
            yield address, "page"


def parse_robots(status: int, body: str, agent: str) -> tuple[bool, list[dict], float | None]:
    """(closed, ordered rules of the agent's entry, crawl delay)."""
    if status >= 500:
        return True, [], None
    if status >= 400:
        return False, [], None
    document = RobotFileParser()
    document.parse(body.splitlines())
    entry = next((e for e in document.entries if e.applies_to(agent)), document.default_entry)
    rules = [{"path": r.path, "allow": bool(r.allowance)} for r in entry.rulelines] if entry else []
    delay = document.crawl_delay(agent)
    return False, rules, None if delay is None else float(delay)


@F.pandas_udf(T.StringType())
def robots_path(urls: pd.Series) -> pd.Series:
    """The part of an address robots rules are matched against."""

    def part(url: str) -> str:
        try:
            p = urlparse(unquote(url or ""))
        except ValueError:
            return "/"
        return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"

    return urls.map(part)
