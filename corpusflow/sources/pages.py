"""Pages to element rows: format sniffing, a tag scan, sections carried forward, and layout rules over extracted blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import noise_heading

#: Tags that make elements, tags whose text is dropped, and where the content of a page may begin.
SELECTED = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "figure", "pre", "math", "li")
DROPPED = ("script", "style", "nav", "noscript", "iframe", "object", "form")
ROOTS = ("article", "main", "body")
HEADINGS = ("h1", "h2", "h3")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
MAX_BYTES = 32 * 1024 * 1024
ELEMENTS = "page_id long, source_order int, tag string, content string, rows array<array<string>>, reliable boolean"


class _Scan(HTMLParser):
    """Elements of one page in order: (root depth, tag, text, table rows, reliable). An element inside another selected one is part of it,
    headings apart; an open paragraph isn't closed by the next, as plain tag scanners read it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.dropped = 0
        self.roots: dict[str, list] = {r: [] for r in (*ROOTS, "")}
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        self.stack.append(tag)
        self.dropped += tag in DROPPED
        if self.dropped:
            return
        if tag in SELECTED and (tag in HEADINGS or not any(t in SELECTED for t in self.stack[:-1])):
            self.open.append({"tag": tag, "text": [], "rows": [], "spans": False, "depth": len(self.stack), "roots": [r for r in ROOTS if r in self.stack]})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self.open[-1]["text"].append(" ")
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.open[-1]["rows"][-1].append("")
            self.open[-1]["spans"] |= any(n in ("rowspan", "colspan") for n, _ in attrs)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            self._close(len(self.stack))
            top = self.stack.pop()
            self.dropped -= top in DROPPED
            if top == tag:
                break

    def _close(self, depth):
        while self.open and self.open[-1]["depth"] >= depth:
            e = self.open.pop()
            for r in (*e["roots"], ""):
                self.roots[r].append(e)

    def handle_data(self, data):
        if self.dropped:
            return
        for e in self.open:
            e["text"].append(data)
            if e["rows"] and e["rows"][-1] and ("td" in self.stack or "th" in self.stack):
                e["rows"][-1][-1] += data

    def elements(self) -> list[dict]:
        self.close()
        self._close(0)
        return next((self.roots[r] for r in ROOTS if self.roots[r]), self.roots[""])


def elements_of(html: str) -> list[tuple]:
    scan = _Scan()
    scan.feed(html)
    out = []
    for e in scan.elements():
        text = " ".join("".join(e["text"]).split())
        rows = [[" ".join(c.split()) for c in r] for r in e["rows"]] if e["tag"] == "table" else None
        reliable = bool(rows) and len({len(r) for r in rows}) == 1 and all(all(r) for r in rows) and not e["spans"] if rows is not None else None
        if text:
            out.append((len(out), e["tag"], text, rows, reliable))
    return out


def page_elements(pages: DataFrame) -> DataFrame:
    """One row per element of every page within the size cap: page_id, source_order, tag, content, rows and reliable (tables)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.bool_()]
        for batch in batches:
            rows = [(i, *e) for i, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for e in elements_of(html.as_py() or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "source_order", "tag", "content", "rows", "reliable"])

    return pages.filter(F.octet_length("html") <= MAX_BYTES).select(F.col("page_id").cast("long"), "html").mapInArrow(scan, ELEMENTS)


def oversized_pages(pages: DataFrame) -> DataFrame:
    """A finding (code, page_id, length) for every page above the size cap, which ``page_elements`` leaves out."""
    size = F.octet_length("html")
    return pages.filter(size > MAX_BYTES).select(F.lit("SOURCE_TOO_LARGE").alias("code"), "page_id", size.cast("long").alias("length"))


def sectioned(elements: DataFrame, key: str = "page_id", order: str = "source_order") -> DataFrame:
    """Elements that aren't headings, each with the latest heading before it and whether that is a noise section."""
    heading = F.col("tag").rlike("^h[1-6]$")
    window = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    carried = elements.withColumn("heading", heading).withColumn("section_title", F.last(F.when(heading, F.col("content")), ignorenulls=True).over(window)).withColumn("section_order", F.last(F.when(heading, F.col(order)), ignorenulls=True).over(window))
    return carried.filter(~F.col("heading")).withColumn("noise", F.coalesce(noise_heading(F.col("section_title")), F.lit(False))).drop("heading")


def section_parents(sections: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Each section with the nearest earlier one of a lower level, from running last orders by level (levels are 1 to 6)."""
    window = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col(level) == k, F.col(order))).over(window) for k in range(1, 7)}
    lower = F.array(*(F.when(F.col(level) > k, F.col(f"_last_{k}")) for k in range(1, 7)))
    return sections.withColumns({f"_last_{k}": c for k, c in last.items()}).withColumn("parent", F.array_max(F.filter(lower, lambda x: x.isNotNull()))).drop(*(f"_last_{k}" for k in range(1, 7)))


def repeated_edges(blocks: DataFrame, pages: DataFrame, source: str, page: str, text: str) -> DataFrame:
    """Edge texts that stand on at least 2 pages of their source and half of all that it has: headers and footers. Pages are counted by source from ``pages``."""
    found = blocks.groupBy(source, text).agg(F.count_distinct(page).alias("n_pages")).filter("n_pages >= 2")
    total = pages.groupBy(source).agg(F.count_distinct(page).alias("_all"))
    return found.join(total, source).filter(F.col("n_pages") >= F.floor(F.col("_all") / 2)).drop("_all")


def reading_order(blocks: DataFrame, page: str, width: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``reading``: bands between full-width blocks from top to bottom; in a band the left column, then the right. A page without
    blocks in both columns is read by y, then x. Blocks have x0, y0, x1; ``ties`` orders blocks of one place.

    A block is left if it ends before the middle and right if it begins after it, both give or take 4 % of the width; one that is neither
    spans the page, whatever its own width. A band ends where a spanning block begins.
    """
    left, right = F.col("x1") <= 0.54 * width, F.col("x0") >= 0.46 * width
    both = F.bool_or(right).over(W.partitionBy(page)) & F.bool_or(left).over(W.partitionBy(page))
    df = blocks.withColumns({"_span": ~left & ~right, "_right": right, "_two": both})
    # blocks at a spanning block's own height come after it
    above = W.partitionBy(page).orderBy("y0").rangeBetween(W.unboundedPreceding, W.currentRow)
    nth = W.partitionBy(page).orderBy("y0", "x0", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = F.count_if("_span")
    band = F.when(F.col("_span"), spans.over(nth)).otherwise(spans.over(above))
    df = df.withColumn("_band", F.when(F.col("_two"), band).otherwise(0))
    side = F.when(~F.col("_two") | F.col("_span"), 0).when(F.col("_right"), 2).otherwise(1)
    return df.withColumn("reading", F.row_number().over(W.partitionBy(page).orderBy("_band", side, "y0", "x0", *ties))).drop("_span", "_right", "_two", "_band")
