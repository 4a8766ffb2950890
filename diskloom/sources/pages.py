"""Game pages in HTML: title by expressions, the rest by a parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest description that counts, in bytes.
SHORTEST = 40
SCHEMA = "title string, description string, genre string, cover string, shots array<string>"
_VOID = {"img", "meta", "br", "hr", "link", "input"}


def page_title(html: Column) -> Column:
    """Text of h1, else of title, without what follows a bar and without a last word Amiga."""
    text = lambda tag: F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), r"(?s)<[^>]*>", "")
    pick = F.when(F.trim(text("h1")) != "", text("h1")).otherwise(text("title"))
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        pick = F.replace(pick, F.lit(entity), F.lit(letter))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return strip(F.regexp_replace(strip(F.regexp_replace(pick, r"(?s)\|.*", "")), r" Amiga\z", ""))


class _Page(HTMLParser):
    """Collects texts by element, links, images and meta tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.images: list[dict] = []
        self.links: list[dict] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in (a.get("property"), a.get("name")):
                if key:
                    self.meta.setdefault(key, a.get("content", ""))
        if tag == "img":
            self.images.append(a)
        if tag in _VOID:
            return
        block = {"tag": tag, "class": a.get("class", "").split(), "href": a.get("href", ""), "text": [], "links": []}
        if tag == "a":
            self.links.append(block)
            for outer in self.open:
                outer["links"].append(block)
        self.open.append(block)
        self.blocks.append(block)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        for block in self.open:
            block["text"].append(data)


def _picture(url: str) -> str:
    return url.split("/image/", 1)[1].split("?")[0].split("/")[0] if "/image/" in url else ""


def scan(html: str | None) -> tuple[str | None, str | None, str | None, list[str]]:
    """(description, genre, front cover, screenshots) of a page; images by their hash."""
    page = _Page()
    page.feed(html or "")
    description = genre = cover = None
    for name in ("game-about", "game-description"):
        block = next((b for b in page.blocks if name in b["class"]), None)
        text = " ".join("".join(block["text"]).split()) if block else ""
        if len(text.encode()) >= SHORTEST:
            description = text
            break
    if description is None:
        description = next((t for key in ("og:description", "description") if len((t := page.meta.get(key, "").strip()).encode()) >= SHORTEST), None)
    for row in (b for b in page.blocks if "game-info-row" in b["class"]):
        if "".join(row["text"]).lstrip().lower().startswith("tags"):
            found: dict[str, str] = {}
            for link in row["links"]:
                if link["href"].startswith("/browse/"):
                    label = "".join(link["text"]).strip() or link["href"].removeprefix("/browse/").replace("-", " ")
                    if label:
                        found.setdefault(label.lower(), label)
            if found:
                genre = ", ".join(found.values())
                break
    for image in page.images:
        if "lbcover" in image.get("src", "") and "front" in image.get("alt", "").lower() and _picture(image["src"]):
            cover = _picture(image["src"])
            break
    shots = dict.fromkeys(h for b in page.links if "s=2x" in b["href"] and (h := _picture(b["href"])))
    return description, genre, cover, list(shots)


def scan_pages(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """``key``, title, description, genre, cover and screenshots of each page; null and broken pages give nulls and an empty list."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [scan(h) for h in frame["html"]]
            yield pd.DataFrame({key: frame["k"], "title": frame["title"], "description": [f[0] for f in found], "genre": [f[1] for f in found], "cover": [f[2] for f in found], "shots": [f[3] for f in found]})

    return pages.select(F.col(key).alias("k"), F.col(html).alias("html"), page_title(F.col(html)).alias("title")).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def fetched(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``wanted`` (``url``, ...) with ``html`` and ``error`` from a table of fetched pages (``url``, ``status``, ``html``).

    A page that isn't there (404, or no row) has neither; any other status than
    2xx is an error. Of several rows of a URL a good one counts.
    """
    good = F.col("status").between(200, 299)
    one = pages.groupBy("url").agg(F.max_by("html", F.when(good, F.col("status"))).alias("html"), F.min("status").alias("_status"), F.max(good).alias("_good"))
    error = F.when(~F.col("_good") & (F.col("_status") != 404), F.concat(F.lit("status "), F.col("_status").cast("string")))
    return wanted.join(one.select("url", F.when(F.col("_good"), F.col("html")).alias("html"), error.alias("error")), "url", "left")
