"""Tags of pages as a browser reads them: attributes in any quoting, comments and script bodies apart; what a self-contained page may not have; and figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "place int, tag string, attribute string, value string"
#: The pseudo attribute of a row that stands for the tag itself, and of one that holds the body of a script or style.
ITSELF, BODY = "", "#body"
#: What a script may not call, and what a style may not load.
FORBIDDEN = r"\b(?:fetch|XMLHttpRequest|WebSocket|EventSource|eval|Function|Worker|SharedWorker|importScripts)\s*\(|\bimport\s*(?:\(|[\w*{])|\b(?:sendBeacon|serviceWorker)\b"
LOADING = r"""(?i)@import|url\s*\(\s*["']?(?!data:|#)"""


class _Tags(HTMLParser):
    """Rows of TAGS. The parser is a tag automaton: quoted, bare and valueless attributes, comments, declarations, bodies of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.place, self.body = -1, None

    def handle_starttag(self, tag, attrs):
        self.place += 1
        self.rows.append((self.place, tag, ITSELF, None))
        self.rows += [(self.place, tag, name, value) for name, value in attrs]
        if tag in ("script", "style"):
            self._ended()
            self.body = (self.place, tag, [])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.body and tag == self.body[1]:
            self._ended()

    def handle_data(self, data):
        if self.body:
            self.body[2].append(data)

    def _ended(self):
        if self.body:
            place, tag, parts = self.body
            self.rows.append((place, tag, BODY, "".join(parts)))
        self.body = None

    def close(self):
        if self.body:  # a body that nothing ends is the rest of the page
            self.body[2].append(self.rawdata)
            self.rawdata = ""
        super().close()
        self._ended()


def tags_of(html: str) -> list[tuple]:
    scan = _Tags()
    scan.feed(html)
    scan.close()
    return scan.rows


class _Figures(HTMLParser):
    """(caption, labels, alts) of each figure; what lies in a figure within a figure belongs to both."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[tuple] = []
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag == "figure":
            self.open.append({"n": self.n, "caption": [], "has_caption": False, "text": [], "labels": [], "alts": [], "in": None})
            self.n += 1
        for f in self.open:
            if tag == "img":
                f["alts"].append(dict(reversed(attrs)).get("alt") or "")
            elif tag == "figcaption" and not f["has_caption"]:
                f["in"], f["has_caption"] = "caption", True
            elif tag == "text":
                f["labels"].append([])
                f["in"] = "label"

    def handle_endtag(self, tag):
        for f in self.open:
            if (tag, f["in"]) in (("figcaption", "caption"), ("text", "label")):
                f["in"] = None
        if tag == "figure" and self.open:
            self._ended()

    def handle_data(self, data):
        for f in self.open:
            f["text"].append(data)
            if f["in"] == "caption":
                f["caption"].append(data)
            elif f["in"] == "label":
                f["labels"][-1].append(data)

    def _ended(self):
        f = self.open.pop()
        words = lambda parts: " ".join("".join(parts).split())
        self.done.append((f["n"], words(f["caption"] if f["has_caption"] else f["text"]), [words(x) for x in f["labels"]], f["alts"]))

    def close(self):
        super().close()
        while self.open:
            self._ended()


def figures_of(html: str) -> list[tuple]:
    scan = _Figures()
    scan.feed(html)
    scan.close()
    return sorted(scan.done)


def _scanned(pages: DataFrame, page: str, html: str, rows_of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    kind = pages.schema[page].dataType.simpleString()
    names = [page, *[x.split()[0] for x in schema.split(", ")]]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [rows_of(text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*[r for rows in found for r in rows], strict=True)) or [()] * (len(names) - 1)
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            types = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
            arrays = [pa.array(c, types[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *arrays], names=names)

    return pages.select(page, html).mapInArrow(scan, f"{page} {kind}, {schema}")


def tag_rows(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, place, tag, attribute, value): a row for every tag (attribute ``ITSELF``), for each of its attributes, and for the body of a script or style (``BODY``).

    Names are in lower case, character references resolved; an attribute without a value has null. Null pages have no rows.
    """
    return _scanned(pages, page, html, tags_of, TAGS)


def figure_rows(pages: DataFrame, page: str, html: str, most: int = 128) -> DataFrame:
    """(page, place, caption, labels, alts): every figure of a page with its caption (its text where it has none), the texts of its drawings and the alternative texts of its
    images, the first ``most`` of each; an image without one has an empty text."""
    rows = _scanned(pages, page, html, figures_of, "place int, caption string, labels array<string>, alts array<string>")
    return rows.withColumns({c: F.slice(c, 1, most) for c in ("labels", "alts")})


def unsafe_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``tag_rows`` that a self-contained page may not have, with a code: handlers; resources, frames and redirects from elsewhere; links that are neither web nor inner; scripts
    that reach out."""
    tag, name, value = F.col("tag"), F.col("attribute"), F.coalesce("value", F.lit(""))
    here = lambda *names: tag.isin(*names)
    outside = name.isin("src", "srcset", "poster", "action") & (value != "") & (~value.startswith("data:") | (name == "srcset") | (here("script") & (name == "src")))
    frame = (name == ITSELF) & here("iframe", "object", "embed", "base", "link")
    redirect = here("meta") & (name == "http-equiv") & (F.lower(value) == "refresh")
    used = here("image", "use") & name.isin("href", "xlink:href") & (value != "") & ~value.startswith("#")
    loads = ((name == "style") | (here("style") & (name == BODY))) & value.rlike(LOADING)
    link = here("a") & (name == "href") & (value != "") & ~value.startswith("#") & ~value.rlike(r"(?i)^[\x00-\x20]*https?:")
    code = (
        F.when(name.startswith("on"), "unsafe_html")
        .when(outside | frame | redirect | used | loads, "external_dependency")
        .when(link, "unsafe_link")
        .when(here("script") & (name == BODY) & value.rlike(FORBIDDEN), "forbidden_runtime")
    )
    return rows.withColumn("code", code).filter("code is not null")


def asset_findings(rows: DataFrame, page: str, manifest_id: str) -> DataFrame:
    """(page, code): pages without a script or a style of their own, and those that don't have just one manifest: a JSON script of that id."""
    attribute = lambda n: F.max(F.when(F.col("attribute") == n, F.col("value")))
    tags = rows.filter(F.col("tag").isin("script", "style")).groupBy(page, "place", "tag").agg(attribute("type").alias("type"), attribute("id").alias("id"))
    json = F.coalesce(F.col("type") == "application/json", F.lit(False))
    count = lambda rule: F.count_if(rule)
    own = tags.groupBy(page).agg(count((F.col("tag") == "script") & ~json).alias("scripts"), count(F.col("tag") == "style").alias("styles"), count((F.col("tag") == "script") & json & F.col("id").eqNullSafe(manifest_id)).alias("manifests"))
    every = rows.select(page).distinct().join(own, page, "left").fillna(0, ["scripts", "styles", "manifests"])
    missing: Column = F.when((F.col("scripts") == 0) | (F.col("styles") == 0), "assets_missing")
    return every.select(page, F.explode(F.array_compact(F.array(missing, F.when(F.col("manifests") != 1, "manifest_invalid")))).alias("code"))
