"""The gate between sources and evidence packs: every rule on documents, packs and blocks as findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import beside, explanations

#: The limits of a pack, and the codes of findings.
MAX_BLOCKS, MAX_BYTES = 12, 16_000
INVALID, SHORT = "EVIDENCE_PACK_INVALID", "RETRIEVAL_INSUFFICIENT_EVIDENCE"
#: Columns that a block shares with its source as they are.
SAME = "content page section section_title".split()
NUMBERS = "equation_number figure_number table_number".split()


@dataclass
class Evidence:
    """Tables over any number of cases; each has ``case``, and:

    documents: source_id, title. elements: element, position, content, page, section, section_title, kind, noise, equation_number, figure_number, table_number, bbox, rows (texts).
    warnings: warning. packs: source_id, confidence, size, size_limited, rerank_insufficient, unresolved, omitted_explicit, omitted_context (counts).
    blocks: place (from 0), evidence, rank, details_omitted, structured, from_pixels, and the columns of elements that they keep. sources: place, element. named: reference, element.
    """

    documents: DataFrame
    elements: DataFrame
    warnings: DataFrame
    packs: DataFrame
    blocks: DataFrame
    sources: DataFrame
    named: DataFrame


Rule = tuple[str, str, str, Column]


def ruled(df: DataFrame, target: Column, rules: list[Rule]) -> DataFrame:
    """(case, rule, code, status, target): a row for each of ``rules`` (rule, code, status, condition) that holds of a row; all are tried in one pass."""
    held = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(code).alias("code"), F.lit(status).alias("status"))) for rule, code, status, when in rules]
    return df.select("case", target.cast("string").alias("target"), F.inline(F.array_compact(F.array(*held)))).select("case", "rule", "code", "status", "target")


def evidence_findings(t: Evidence, max_blocks: int = MAX_BLOCKS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(case, rule, code, status, target): what the rules find. Rules on a block and its sources are columns of their join, those on a pack columns of one row with what its blocks and its
    document's elements come to; omitted references and context are anti joins. Cases are those of ``documents`` with a pack."""
    col = F.col
    text = F.trim(F.regexp_replace("content", r"\s+", " "))
    content = t.elements.groupBy("case").agg(F.bool_or(text != "").alias("has_text"))
    ids = t.blocks.groupBy("case").agg(F.count("place").alias("n"), F.count_distinct("evidence").alias("ids"))
    packs = t.packs.withColumnRenamed("source_id", "pack_source")
    whole = t.documents.join(packs, "case").join(content, "case", "left").join(ids, "case", "left").fillna(0, ["n", "ids"])
    by_case = ruled(whole, F.lit(None), [
        ("empty_source", "PARSE_FAILED", "FAIL", ~F.coalesce(col("has_text"), F.lit(False))),
        ("source_id", INVALID, "FAIL", ~col("pack_source").eqNullSafe(col("source_id"))),
        ("empty_pack", INVALID, "FAIL", col("n") == 0),
        ("duplicate_ids", INVALID, "FAIL", col("n") != col("ids")),
        ("size_limit", INVALID, "FAIL", (col("n") > max_blocks) | (col("size") > max_bytes)),
        ("size_limited", "EVIDENCE_SIZE_LIMITED", "WARN", col("size_limited")),
        ("rerank_insufficient", SHORT, "WARN", col("rerank_insufficient")),
        ("unresolved_references", SHORT, "WARN", col("unresolved") > 0),
        ("omitted_elements", SHORT, "WARN", col("omitted_explicit") > 0),
        ("confidence", SHORT, "WARN", ~col("confidence").eqNullSafe("HIGH")),
        ("no_title", "SOURCE_METADATA_UNAVAILABLE", "WARN", F.coalesce(col("title") == "", F.lit(True))),
    ])

    counted = t.sources.groupBy("case", "place").agg(F.count("element").alias("n_sources"))
    blocks = t.blocks.join(counted, ["case", "place"], "left")
    by_block = ruled(blocks, col("evidence"), [
        ("bare_block", INVALID, "FAIL", (F.coalesce(text, F.lit("")) == "") | col("n_sources").isNull()),
        ("rank", INVALID, "FAIL", ~col("rank").eqNullSafe(col("place"))),
        ("pixels", INVALID, "FAIL", col("from_pixels")),
    ])

    kept = [*SAME, *NUMBERS, "kind", "bbox", "rows"]
    source = t.elements.select("case", "element", F.lit(True).alias("there"), *[col(c).alias(f"s_{c}") for c in kept])
    pairs = t.sources.join(t.blocks, ["case", "place"]).join(source, ["case", "element"], "left")
    differs = lambda c: ~col(c).eqNullSafe(col(f"s_{c}"))
    either = lambda names: differs(names[0]) if len(names) == 1 else differs(names[0]) | either(names[1:])
    there, moved = col("there").isNotNull(), either(SAME)
    cells = there & ~moved & differs("rows")
    omitted = F.coalesce(col("details_omitted") & col("rows").isNull() & ~col("structured"), F.lit(False))
    expected = F.when(col("s_kind") == "figure", "figure_context").otherwise(col("s_kind"))
    by_source = ruled(pairs, col("evidence"), [
        ("absent_source", INVALID, "FAIL", ~there),
        ("differs_from_source", INVALID, "FAIL", there & moved),
        ("cells_omitted", "EVIDENCE_TABLE_DATA_OMITTED", "WARN", cells & omitted),
        ("cells_differ", INVALID, "FAIL", cells & ~omitted),
        ("numbers", INVALID, "FAIL", there & either(NUMBERS)),
        ("kind", INVALID, "FAIL", there & ~col("kind").eqNullSafe(expected)),
        ("bbox", INVALID, "FAIL", there & differs("bbox")),
    ])

    own = t.named.join(t.packs.select("case"), "case", "left_semi")
    inside = t.sources.select("case", "element").distinct()
    held = own.join(inside, ["case", "element"], "left_semi").select("case", "reference").distinct()
    lost = own.select("case", "reference").distinct().join(held, ["case", "reference"], "left_anti")
    by_reference = ruled(lost, col("reference"), [("reference_omitted", SHORT, "FAIL", F.lit(True))])

    prose = explanations(t.elements, beside(t.elements)).join(inside, ["case", "element"], "left_semi").select("case", F.col("near").alias("element"))
    bare = prose.join(inside, ["case", "element"], "left_anti").select("case").union(t.packs.filter("omitted_context > 0").select("case")).distinct()
    by_context = ruled(bare.join(t.packs.select("case"), "case", "left_semi"), F.lit(None), [("context_omitted", "EVIDENCE_CONTEXT_OMITTED", "WARN", F.lit(True))])

    told = t.warnings.join(t.packs.select("case"), "case", "left_semi")
    by_warning = told.select("case", F.lit("extraction").alias("rule"), F.substring_index("warning", ":", 1).alias("code"), F.lit("WARN").alias("status"), F.lit(None).cast("string").alias("target"))
    out = by_case
    for part in (by_block, by_source, by_reference, by_context, by_warning):
        out = out.unionByName(part)
    return out
