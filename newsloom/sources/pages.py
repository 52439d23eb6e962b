"""Feeds, listing pages and article pages given as text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Whole paths that are no articles.
BLOCKED = ("rss", "epaper", "privacy-policy", "terms")


def feed_entries(xml: str | None) -> list[tuple[str, str | None, str | None]]:
    """(url, title, published) of the entries of an RSS or Atom feed; the url is the link, else the id; entries without an http url are left out, a broken feed has none."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        said = {}
        for child in node:
            name = child.tag.rpartition("}")[2]
            said.setdefault(name, (child.text or "").strip() or child.get("href", ""))
        url = said.get("link") or said.get("id") or said.get("guid") or ""
        if re.match(r"https?://", url):
            out.append((url, said.get("title") or None, said.get("pubDate") or said.get("published") or said.get("updated") or None))
    return out


def parse_feeds(feeds: DataFrame, source: str = "source_name", xml: str = "xml") -> DataFrame:
    """(source, url, title, published_at): dates that can't be read are null."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(s, *e) for s, x in zip(f[source], f[xml]) for e in feed_entries(x)], columns=[source, "url", "title", "published"])

    parsed = feeds.select(source, xml).mapInPandas(work, f"{source} string, url string, title string, published string")
    return parsed.select(source, "url", "title", lenient_time(F.col("published")).alias("published_at"))


def lenient_time(said: Column) -> Column:
    """A time as feeds and pages give it: with or without a day's name, a zone as a number, Z or GMT, ISO with or without zone (then UTC); null for anything else."""
    formats = ["d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    bare = F.regexp_replace(F.regexp_replace(F.trim(said), r"^[A-Za-z]{3,9},\s*", ""), r"\s*(?:GMT|UTC|UT)$", " +0000")  # Spark reads no names of days
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


_LINK = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", re.S | re.I)


def listing_links(page: str | None, base: str | None) -> list[tuple[str, str]]:
    """(url, title) of the links of a page that stay on its host, have a path and a title of ten characters."""
    out, host = [], urlsplit(base or "").netloc.lower()
    for href, text in _LINK.findall(page or ""):
        url = urljoin(base or "", html.unescape(href))
        p = urlsplit(url)
        title = " ".join(html.unescape(re.sub("<[^>]*>", " ", text)).split())
        if p.netloc.lower() == host and p.path not in ("", "/") and len(title) >= 10 and p.path.strip("/").lower() not in BLOCKED:
            out.append((url, title))
    return out


def parse_listings(pages: DataFrame, key: str, page: str, base: str, limit: int = 20) -> DataFrame:
    """(key, url, title, rank): the first `limit` different links of each page, in order."""
    kind = pages.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *e) for k, x, b in zip(f[key], f[page], f[base]) for i, e in enumerate(listing_links(x, b))]
            yield pd.DataFrame(rows, columns=[key, "at", "url", "title"])

    found = pages.select(key, page, base).mapInPandas(work, f"{key} {kind}, at int, url string, title string")
    first = found.groupBy(key, "url").agg(F.min(F.struct("at", "title")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("f.at"))
    return first.select(key, "url", F.col("f.title").alias("title"), rank.alias("rank")).where(F.col("rank") <= limit)


#: Characters that a paragraph, and all paragraphs together, have at least for the main extraction to hold.
LEAST_PARAGRAPH, LEAST_BODY = 40, 120


class _Text(HTMLParser):
    """Collects the text of a page without scripts and styles, and apart from it the paragraphs outside of what surrounds an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.paragraphs: list[str] = []
        self.hidden = self.around = 0
        self.inside: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "noscript")
        self.around += tag in ("nav", "aside", "footer", "header", "form")
        if tag == "p":
            self._close()
            self.inside = []

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        self.around -= tag in ("nav", "aside", "footer", "header", "form") and self.around > 0
        if tag in ("p", "div", "article", "section", "body"):
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)
            if self.inside is not None and not self.around:
                self.inside.append(data)

    def _close(self) -> None:
        if self.inside is not None:
            text = " ".join("".join(self.inside).split())
            if len(text) >= LEAST_PARAGRAPH:
                self.paragraphs.append(text)
        self.inside = None


_DESCRIPTION = re.compile(r"<meta\b[^>]*name\s*=\s*[\"']description[\"'][^>]*content\s*=\s*[\"']([^\"']*)", re.I)


def article_text(page: str | None) -> tuple[str, bool]:
    """The text of a page and whether extraction gave any: its longer paragraphs, else its description, else all that isn't script or style."""
    p = _Text()
    p.feed(page or "")
    p.close()
    p._close()
    body = "\n".join(p.paragraphs)
    if len(body) >= LEAST_BODY:
        return body, True
    if (m := _DESCRIPTION.search(page or "")) and m[1].strip():
        return html.unescape(m[1]).strip(), True
    text = " ".join(" ".join(p.out).split())
    return text, bool(text)


def extract_articles(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, text, extraction_succeeded)."""
    kind = pages.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [article_text(x) for x in f[page]]
            yield pd.DataFrame({key: f[key], "text": [m[0] for m in made], "extraction_succeeded": [m[1] for m in made]})

    return pages.select(key, page).mapInPandas(work, f"{key} {kind}, text string, extraction_succeeded boolean")
