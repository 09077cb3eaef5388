"""Rules over page blocks (text, box, font) from any extractor: headings by type, equation numbers, captions that matter, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CAPTION, EQUATION, EQUATION_SIGN, NUMBER, heading_title, reference_keys
from ..shared import Rounds

#: The items of a kind that a figure keeps, and the share of a page's height above a caption that is its figure's.
MAX_VISUAL_ITEMS, FIGURE_SHARE = 128, 0.35
#: Words that a title may hold in lower case, and words of a focus that say nothing.
SMALL_WORDS = "a an the of and or in on for to with".split()
FOCUS_WORDS = "the in of a shown figure table".split()


def numbered_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Whether a line in the form of a numbered heading is one: its title is all upper case, bold, larger than the body, or a short title."""
    title = heading_title(text)
    words = F.regexp_extract_all(title, F.lit("([A-Za-z]+)"))
    capital = lambda w: F.substring(w, 1, 1).rlike("[A-Z]")
    small = F.array(*map(F.lit, SMALL_WORDS))
    short = F.size(words).between(1, 8) & capital(title) & ~title.rlike(r"[.;:=!?]|\d") & F.forall(words, lambda w: capital(w) | F.array_contains(small, F.lower(w)))
    upper = (F.upper(title) == title) & title.rlike("[A-Za-z]")
    return F.coalesce(title.isNotNull() & (upper | bold | (size > 1.05 * body) | short), F.lit(False))


def font_heading(text: Column, size: Column, body: Column) -> Column:
    """A short line without a form of its own, in type clearly larger than the body."""
    return (F.length(text) < 100) & ~F.contains(text, F.lit("\n")) & ~text.rlike(CAPTION) & heading_title(text).isNull() & (size > 1.2 * body)


def equation_candidates(blocks: DataFrame, page: str, key: str) -> DataFrame:
    """(page, number, expression): for each isolated equation number the expressions it may belong to: left of it, on its base line, not much taller.

    Blocks have text, x0, y0, x1, y1. Base lines are bucketed by the reach, so a number meets the blocks of a few buckets of its page only.
    """
    number = F.trim("text").rlike(rf"^\({NUMBER}\)$")
    expression = F.col("text").rlike(EQUATION_SIGN) & ~F.contains("text", F.lit("\n")) & ~F.col("text").rlike(EQUATION) & ~number
    height = F.col("y1") - F.col("y0")
    reach = F.greatest(F.lit(3.0), height * 0.4)
    numbers = blocks.filter(number).select(page, F.col(key).alias("number"), F.col("x0").alias("n_x0"), F.col("y1").alias("n_y1"), height.alias("n_height"), reach.alias("reach"))
    low, high = F.floor((F.col("n_y1") - F.col("reach")) / 8).cast("long"), F.floor((F.col("n_y1") + F.col("reach")) / 8).cast("long")
    numbers = numbers.withColumn("line", F.explode(F.sequence(low, high)))
    found = blocks.filter(expression).withColumn("line", F.floor(F.col("y1") / 8).cast("long")).join(numbers, [page, "line"])
    found = found.filter((F.col("x1") <= F.col("n_x0")) & (F.abs(F.col("y1") - F.col("n_y1")) <= F.col("reach")) & (height <= F.col("n_height") * 2))
    return found.select(page, "number", F.col(key).alias("expression")).distinct()


def taken_in_order(pairs: DataFrame, page: str) -> DataFrame:
    """(page, number, expression) of ``pairs`` as numbers taken in their order give: each takes the one expression left to it, and nothing if none or several are.

    What a number gets depends on the earlier ones that share a candidate with it. So a round decides, everywhere at once, the numbers that are first at each of their candidates; those
    that take one take it from the others. Every page decides one at least, and chains of numbers that compete are short.
    """
    with Rounds(pairs.sparkSession) as rounds:
        left, taken = rounds.keep(pairs.select(page, "number", "expression")), []
        while not left.isEmpty():
            first = F.min("number").over(W.partitionBy(page, "expression")) == F.col("number")
            by = W.partitionBy(page, "number")
            told = left.withColumn("first", first).withColumns({"ready": F.min("first").over(by), "n": F.count("expression").over(by)})
            told = rounds.keep(told.select(page, "number", "expression", "ready", "n"))
            now = told.filter("ready and n = 1").select(page, "number", "expression")
            taken.append(now)
            rest = told.filter("not ready").select(page, "number", "expression").join(now.select(page, "expression"), [page, "expression"], "left_anti")
            fresh = rounds.keep(rest.select(page, "number", "expression"))
            rounds.drop(left)
            left = fresh
        out = pairs.select(page, "number", "expression").limit(0)
        for part in taken:
            out = out.unionByName(part)
        return rounds.result(out)


def numbered_equations(blocks: DataFrame, page: str, key: str) -> DataFrame:
    """Isolated equation numbers and the expression each is joined to: numbers take theirs in the order of ``key``, each the only one that is left to it."""
    return taken_in_order(equation_candidates(blocks, page, key), page)


def figure_items(captions: DataFrame, items: DataFrame, page: str, key: str, item: str, height: float, most: int = MAX_VISUAL_ITEMS) -> DataFrame:
    """(page, key, kind, item): what lies in the region above each caption, as wide as it and up to ``FIGURE_SHARE`` of the page's height: labels, shapes, images.

    ``captions`` and ``items`` have x0, y0, x1, y1, items also their kind. A region is a fixed share of its page, so captions meet the items of their page: each box is shuffled once, by page, and what
    follows by page and caption stays where it is. Of each kind the first ``most`` in the order of ``item`` stay. A page is one task's work.
    """
    a = captions.select(page, key, F.col("x0").alias("r_x0"), F.greatest(F.lit(0.0), F.col("y0") - height * FIGURE_SHARE).alias("r_y0"), F.col("x1").alias("r_x1"), F.col("y0").alias("r_y1"))
    b = items.select(page, item, "kind", "x0", "y0", "x1", "y1")
    met = a.join(b, page).filter((F.greatest("r_x0", "x0") < F.least("r_x1", "x1")) & (F.greatest("r_y0", "y0") < F.least("r_y1", "y1"))).select(page, key, "kind", item)
    place = F.row_number().over(W.partitionBy(page, key, "kind").orderBy(item))
    return met.withColumn("_k", place).filter(F.col("_k") <= most).drop("_k")


def relevant_caption(text: Column, focus: Column, section_text: Column) -> Column:
    """Whether a caption matters to a focus: the focus names it, shares a word with it, or shares one with its section, which names it."""
    word = F.lit(r"([\p{L}\p{N}_]+)")
    terms = F.array_except(F.regexp_extract_all(F.lower(focus), word), F.array(*map(F.lit, FOCUS_WORDS)))
    shares = lambda t: F.arrays_overlap(terms, F.regexp_extract_all(F.lower(t), word))
    kind = F.when(F.lower(F.regexp_extract(text, CAPTION, 1)) == "table", "table").otherwise("figure")
    own = F.struct(kind.alias("kind"), F.lower(F.regexp_extract(text, CAPTION, 2)).alias("number"))
    names = lambda t: F.array_contains(reference_keys(t), own)
    return F.coalesce(text.rlike(CAPTION) & (names(focus) | shares(text) | (shares(section_text) & names(section_text))), F.lit(False))


def within_caps(elements: DataFrame, page: str, order: str, size: str, most: int, limit: int) -> DataFrame:
    """The elements of each page up to ``most``, and up to a running size of ``limit``."""
    so_far = W.partitionBy(page).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    told = elements.withColumns({"_n": F.row_number().over(W.partitionBy(page).orderBy(order)), "_size": F.sum(size).over(so_far)})
    return told.filter((F.col("_n") <= most) & (F.col("_size") <= limit)).drop("_n", "_size")


def nearest_overlapping(left: DataFrame, right: DataFrame, page: str, key: str, other: str, reach: float) -> DataFrame:
    """Each left box's nearest right box of its page that overlaps it horizontally and lies at most ``reach`` above or below it.

    Boxes have x0, y0, x1, y1. Places are bucketed by the reach: a left box looks into the buckets that its own height and reach cover.
    """
    bucket = lambda c: F.floor(c / reach).cast("long")
    a = left.select(page, key, *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    a = a.withColumn("_b", F.explode(F.sequence(bucket(F.col("a_y0") - reach), bucket(F.col("a_y1") + reach))))
    b = right.select(page, F.col(key).alias(other), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = b.withColumn("_b", F.explode(F.sequence(bucket(F.col("b_y0")), bucket(F.col("b_y1")))))
    gap = F.least(F.abs(F.col("b_y0") - F.col("a_y1")), F.abs(F.col("a_y0") - F.col("b_y1")))
    met = a.join(b, [page, "_b"]).filter(F.least("a_x1", "b_x1") > F.greatest("a_x0", "b_x0")).withColumn("gap", gap).filter(F.col("gap") < reach)
    best = met.groupBy(page, key).agg(F.min(F.struct("gap", other)).alias("best"))
    return best.select(page, key, f"best.{other}", "best.gap")
