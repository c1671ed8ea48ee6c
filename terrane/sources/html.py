"""Listing pages and articles as text, with the standard library's parser in Arrow functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIDDEN = ("script", "style", "nav", "footer", "header", "noscript", "template")
CONTENT = ("article", "main")
LISTED = "array<struct<url:string,title:string,date_raw:string>>"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Links(HTMLParser):
    """Anchors of one class, their text, their title attribute, and text of a date element inside."""

    def __init__(self, css: str):
        super().__init__(convert_charrefs=True)
        self.css, self.found, self.open, self.depth = css, [], None, 0
        self.date_depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and self.css in classes:
            self.open = {"url": a.get("href") or "", "title": a.get("title") or "", "text": [], "date": []}
        elif self.open is not None and tag not in _VOID and ("date" in classes or self.date_depth):
            self.date_depth += 1

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.found.append(self.open)
            self.open, self.date_depth = None, 0
        elif self.date_depth:
            self.date_depth -= 1

    def handle_data(self, data):
        if self.open is not None:
            (self.open["date"] if self.date_depth else self.open["text"]).append(data)


def listed(html: str | None, css: str) -> list[dict[str, str]]:
    """Entries (url, title, date_raw) whose address ends in a number; blank titles are skipped."""
    parser = _Links(css)
    parser.feed(html or "")
    out = []
    for link in parser.found:
        title = " ".join(" ".join(link["text"]).split()) or link["title"].strip()
        if re.search(r"/\d+\.html$", link["url"]) and title:
            out.append({"url": link["url"], "title": title, "date_raw": " ".join(" ".join(link["date"]).split())})
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.inside, self.all, self.content = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.inside += tag in CONTENT

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        self.inside = max(0, self.inside - (tag in CONTENT))

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.all.append(data.strip())
            if self.inside:
                self.content.append(data.strip())


def visible(html: str | None) -> str:
    """What a reader sees of a page's content element, else of the page; empty when it can't be read."""
    parser = _Text()
    try:
        parser.feed(html or "")
        parser.close()
    except (ValueError, AssertionError):
        return ""
    return " ".join(" ".join(parser.content or parser.all).split())


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    return html.map(visible)


def article_text(html, limit: int = 6000):
    """The first characters of the visible text."""
    return F.substring(visible_text(html), 1, limit)


def listing(pages: DataFrame, html: str = "html", css: str = "list-item") -> DataFrame:
    """One row for each entry of each page, in page order."""

    @F.pandas_udf(LISTED)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda h: listed(h, css))

    rows = pages.withColumn("_entries", run(F.col(html)))
    keep = [c for c in pages.columns if c != html]
    return rows.select(*keep, F.posexplode("_entries").alias("place", "e")).select(*keep, "place", "e.url", "e.title", "e.date_raw")


def crawl(pages: DataFrame, section: str = "section", page: str = "page", html: str = "html", css: str = "list-item", most_pages: int = 40) -> DataFrame:
    """Entries of landed listing pages, each address of a section once, at its first page.

    Pages count up to the first that is missing or brings nothing new, and ``most_pages`` at most.
    """
    entries = listing(pages.where(F.col(page).between(1, most_pages)), html, css)
    first = entries.groupBy(section, "url").agg(F.min(F.struct(page, "place", "title", "date_raw")).alias("f"))
    fresh = first.select(section, "url", F.col(f"f.{page}").alias(page), "f.place", "f.title", "f.date_raw")
    held = fresh.groupBy(section).agg(F.array_sort(F.collect_set(page)).alias("_p"))  # at most most_pages numbers
    run = F.size(F.filter(F.transform("_p", lambda p, i: p == i + 1), lambda ok: ok))
    return fresh.join(held.select(section, run.alias("_last")), section).where(F.col(page) <= F.col("_last")).drop("_last")
