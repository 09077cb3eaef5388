"""Text columns: tokens, phrases, references, captions, headings, noise, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no tokens, the number form, and the patterns of headings, captions and the like.
STOPWORDS = "the a an and or of to in for with by on is are how why described shown mechanism section equation figure table this that it".split()
TOKEN = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
NUMBER = r"\d+(?:\.\d+)*[a-zA-Z]?"
HEADING = r"^\s*(\d+(?:\.\d+)*)(?:[.)]|\s)+\s*([A-Za-z][^\n]{1,100})$"
CAPTION = rf"(?is)^\s*(Figure|Fig\.?|Table)\s+({NUMBER})\s*[.:\-]\s*(.*)"
EQUATION = rf"\(({NUMBER})\)\s*$"
EQUATION_SIGN = "[=∝→∑≤≥]"
ALGORITHM = r"(?i)^\s*(?:Algorithm|Pseudocode)\s*(\d+)?[.:\s]"
NOISE = r"(?i)^(references|bibliography|acknowledg(?:e)?ments|contents|table of contents|author affiliations)\b"
REFERENCE = rf"(?i)\b(section|sec\.?|equation|eq\.?|figure|fig\.?|table)\s*\(?\s*({NUMBER})\)?"
RISK = r"(?i)\b(benchmark|outperform|accuracy|experimental result|causes|causal)\b|\d+(?:\.\d+)?\s*%"


def folded(text: Column) -> Column:
    """Case folding for the texts at hand: lower case, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})")), lambda t: ~F.array_contains(stop, t))


def raw_tokens(text: Column) -> Column:
    """``tokens`` with the words that say nothing still among them."""
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(collapsed(text), collapsed(phrase))


def coverage(query: Column, terms: Column) -> Column:
    """Share of distinct query terms among ``terms``; 0 without any."""
    distinct = F.array_distinct(query)
    return F.when(F.size(distinct) == 0, 0.0).otherwise(F.size(F.array_intersect(distinct, terms)) / F.size(distinct))


def _group(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found)


def heading_number(text: Column) -> Column:
    return _group(text, HEADING, 1)


def heading_title(text: Column) -> Column:
    return _group(text, HEADING, 2)


def noise_heading(text: Column) -> Column:
    return F.coalesce(heading_title(text), text).rlike(NOISE)


def caption_kind(text: Column) -> Column:
    kind = F.lower(F.regexp_extract(text, CAPTION, 1))
    return F.when(kind == "table", "table").when(kind != "", "figure")


def caption_number(text: Column) -> Column:
    return F.lower(_group(text, CAPTION, 2))


def equation_number(text: Column) -> Column:
    return F.when(text.rlike(EQUATION_SIGN), _group(text, EQUATION, 1))


def element_type(text: Column) -> Column:
    """Caption, then equation, then algorithm, then paragraph."""
    return F.when(caption_kind(text).isNotNull(), "caption").when(equation_number(text).isNotNull(), "equation").when(text.rlike(ALGORITHM), "algorithm").otherwise("paragraph")


def reference_keys(text: Column) -> Column:
    """Array of (kind, number) that a text refers to."""
    kinds, numbers = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(2))

    def key(kind: Column, number: Column) -> Column:
        start = F.substring(F.lower(kind), 1, 2)
        name = F.when(start == "se", "section").when(start == "eq", "equation").when(start == "fi", "figure").otherwise("table")
        return F.struct(name.alias("kind"), F.lower(number).alias("number"))

    return F.zip_with(kinds, numbers, key)


def format_of(head: Column, mime: Column | None = None) -> Column:
    """pdf, html or unknown, from the first bytes as text; the MIME type decides only where they don't."""
    start = F.lower(F.ltrim(head))
    by_mime = F.when(F.contains(mime, F.lit("pdf")), "pdf").when(F.contains(mime, F.lit("html")), "html").otherwise("unknown") if mime is not None else F.lit("unknown")
    html = [F.contains(start, F.lit(x)) for x in ("<!doctype html", "<html", "<article", "<body")]
    return F.when(F.startswith(start, F.lit("%pdf-")), "pdf").when(html[0] | html[1] | html[2] | html[3], "html").otherwise(by_mime)


def safe_json(text: Column) -> Column:
    """JSON that may stand inside HTML."""
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def eight_digits(x: Column) -> Column:
    """A number with eight significant digits as C's ``%.8g`` writes it: no trailing zeros, with an exponent below 1e-4 and from 1e8 on. Null stays null.

    The digits are Java's, which round halves of the shortest decimal up; C rounds halves of the exact binary value to even, so the last digit of such a half may differ,
    as may digits of numbers below the normal range (under 1e-307), of which Java knows fewer.
    """
    x = x.cast("double")
    whole = F.format_string("%.7e", x)
    power = F.substring_index(whole, "e", -1).try_cast("int")
    bare = lambda t: F.regexp_replace(t, r"(\.\d*?)0+$", "$1")
    short = lambda t: F.regexp_replace(bare(t), r"\.$", "")
    wide = F.concat(short(F.substring_index(whole, "e", 1)), F.lit("e"), F.substring_index(whole, "e", -1))
    places = F.concat(F.lit("%."), F.greatest(F.lit(0), F.lit(7) - power).cast("string"), F.lit("f"))
    plain = short(F.call_function("format_string", places, x))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, F.when(whole.startswith("-"), "-0").otherwise("0"))
    return F.when(x.isNotNull(), F.coalesce(odd, F.when((power < -4) | (power >= 8), wide).otherwise(plain)))
