"""Whether what a lesson claims is grounded: claims against records, records against classes, evidence and computations, and the evidence behind derived claims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import reachable
from .within import by_case, reached, split_by_size

#: Classes and states of a record.
SOURCE_GROUNDED, DERIVED, UNSUPPORTED, PARTIAL = "SOURCE_GROUNDED", "DERIVED", "UNSUPPORTED", "PARTIAL"


@dataclass
class Grounding:
    """Tables over any number of cases; each has ``case``, and:

    claims: claim_id, claim. records: record (their order), claim_id, claim, class, status. record_refs: record, kind (evidence or computation), ref. objects: id, class.
    object_refs: id, ref (evidence). known: kind, ref (what evidence and which computations there are). classes: class (declared). provenance: ref.
    """

    cases: DataFrame
    claims: DataFrame
    records: DataFrame
    record_refs: DataFrame
    objects: DataFrame
    object_refs: DataFrame
    known: DataFrame
    classes: DataFrame
    provenance: DataFrame


def _told(df: DataFrame, target: Column, *rules: tuple[Column, str, str]) -> DataFrame:
    """A row per rule that holds: all rules are tried in one pass over ``df``."""
    held = [F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))) for rule, code, status in rules]
    return df.select("case", target.cast("string").alias("target"), F.inline(F.array_compact(F.array(*held)))).select("case", "code", "target", "status")


def grounding_findings(t: Grounding) -> DataFrame:
    """(case, code, target, status): the rules that claims, records, objects and provenance break.

    References meet what is known once and are summed up by record or object, whose rules are then columns of one row; the lineage rule alone compares the two sets of
    references. Of records that share a claim id the last counts for the claim, and each for its own rules. Claims that are empty or null claim nothing.
    """
    known = t.known.select("case", "kind", "ref").distinct().withColumn("there", F.lit(True))
    refs = t.record_refs.select("case", "record", "kind", "ref").distinct().join(known, ["case", "kind", "ref"], "left")
    absent = lambda kind: F.bool_or((F.col("kind") == kind) & F.col("there").isNull()).alias(f"bad_{kind}")
    some = lambda kind: F.bool_or(F.col("kind") == kind).alias(f"has_{kind}")
    of_record = refs.groupBy("case", "record").agg(absent("evidence"), absent("computation"), some("evidence"), some("computation"))

    object_refs = t.object_refs.select("case", "id", "ref").distinct()
    lineage = t.objects.filter(F.col("class") == SOURCE_GROUNDED).select("case", "id").join(object_refs, ["case", "id"])
    lineage = lineage.join(t.records.select("case", F.col("claim_id").alias("id"), "record"), ["case", "id"])
    lost = lineage.join(refs.filter("kind = 'evidence'").select("case", "record", "ref"), ["case", "record", "ref"], "left_anti").select("case", "record").distinct().withColumn("lost", F.lit(True))

    of = t.objects.select("case", F.col("id").alias("claim_id"), F.col("class").alias("object_class"))
    declared = t.classes.select("case", "class").distinct().withColumn("declared", F.lit(True))
    judged = t.records.join(of_record, ["case", "record"], "left").join(lost, ["case", "record"], "left").join(declared, ["case", "class"], "left").join(of, ["case", "claim_id"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_record = _told(
        judged,
        F.col("claim_id"),
        (~flag("declared"), "KNOWLEDGE_CLASS_UNDECLARED", "FAIL"),
        (flag("bad_evidence"), "EVIDENCE_REFERENCE_INVALID", "FAIL"),
        (flag("bad_computation"), "COMPUTATION_REFERENCE_INVALID", "FAIL"),
        ((F.col("class") == SOURCE_GROUNDED) & ~flag("has_evidence"), "SOURCE_CLAIM_UNGROUNDED", "FAIL"),
        ((F.col("class") == DERIVED) & ~flag("has_computation"), "DERIVED_CLAIM_UNBOUND", "FAIL"),
        (F.col("status") == UNSUPPORTED, "GROUNDING_UNSUPPORTED", "FAIL"),
        (F.col("status") == PARTIAL, "GROUNDING_PARTIAL", "WARN"),
        (F.col("class") != F.col("object_class"), "KNOWLEDGE_CLASS_MISMATCH", "FAIL"),
        (flag("lost"), "EVIDENCE_LINEAGE_MISMATCH", "FAIL"),
    )

    of_object = object_refs.join(known.filter("kind = 'evidence'").drop("kind"), ["case", "ref"], "left").groupBy("case", "id").agg(F.bool_or(F.col("there").isNull()).alias("bad"))
    by_object = _told(
        t.objects.join(of_object, ["case", "id"], "left"),
        F.col("id"),
        (flag("bad"), "EVIDENCE_REFERENCE_INVALID", "FAIL"),
        ((F.col("class") == SOURCE_GROUNDED) & F.col("bad").isNull(), "SOURCE_OBJECT_UNGROUNDED", "FAIL"),
    )

    last = t.records.groupBy("case", "claim_id").agg(F.max_by("claim", "record").alias("recorded"), F.count("record").alias("n"))
    claims = t.claims.filter("claim != ''").join(last.drop("n"), ["case", "claim_id"], "left")
    by_claim = _told(claims, F.col("claim_id"), (~F.coalesce(F.col("recorded") == F.col("claim"), F.lit(False)), "CLAIM_UNCLASSIFIED", "FAIL"))
    twice = last.filter("n > 1").select("case").distinct()
    by_id = _told(twice, F.lit(None), (F.lit(True), "DUPLICATE_CLAIM_ID", "FAIL"))

    origin = t.provenance.select("case", "ref").join(known.filter("kind = 'evidence'").drop("kind"), ["case", "ref"], "left").groupBy("case").agg(F.bool_or(F.col("there").isNull()).alias("bad"))
    by_case = _told(
        t.cases.select("case").join(origin, "case", "left"),
        F.lit("science.provenance"),
        (flag("bad"), "PROVENANCE_INVALID", "FAIL"),
        (F.col("bad").isNull(), "PROVENANCE_MISSING", "FAIL"),
    )
    return by_record.unionByName(by_object).unionByName(by_claim).unionByName(by_id).unionByName(by_case)


def claim_lineage(t: Grounding, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(case, claim_id, ref): the evidence that stands behind each derived claim, through whatever its computations rest on.

    ``edges`` (case, kind, id, to_kind, to) lead from a computation or object to what it rests on. Claims lead to their records and these to their references, so all is one relation, which is shuffled once,
    by case: a task takes whole cases. Cases with more than ``most`` edges, or that aren't numbers, are extended by new pairs to the fixpoint, all at once.
    """
    node = lambda kind, ref: F.concat_ws("\0", kind, F.col(ref).cast("string"))
    record = node(F.lit("\1record"), "record")
    link = lambda df, a, b, first=False: df.select("case", a.alias("a"), b.alias("b"), F.lit(first).alias("first"))
    derived = t.records.filter((F.col("class") == DERIVED) & F.col("record").isNotNull() & F.col("claim_id").isNotNull())
    parts = [
        link(derived, node(F.lit("\1claim"), "claim_id"), record, True),
        link(t.record_refs.filter("record is not null and kind is not null and ref is not null"), record, node(F.col("kind"), "ref")),
        link(edges.filter("kind is not null and id is not null and to_kind is not null and to is not null"), node(F.col("kind"), "id"), node(F.col("to_kind"), "to")),
    ]
    links = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("case is not null")
    case = dict(links.dtypes)["case"]

    def at_once(links: DataFrame) -> DataFrame:
        of = lambda c: F.struct("case", F.col(c).alias("node"))
        pairs = reachable(links.select(of("a").alias("a"), of("b").alias("b")), links.filter("first").select(of("a").alias("start")))
        return pairs.select("start.case", F.col("start.node").alias("start"), F.col("node.node").alias("node"))

    schema = f"case {case}, start string, node string"
    if case not in ("int", "bigint"):
        pairs = at_once(links)
    elif (large := split_by_size(edges, most)) is None:
        pairs = by_case(links, reached, schema)
    else:
        pairs = by_case(links.join(large, "case", "left_anti"), reached, schema).unionByName(at_once(links.join(large, "case", "left_semi")))
    text = lambda c: F.element_at(F.split(c, "\0", 2), 2)
    return pairs.filter(F.col("node").startswith("evidence\0")).select("case", text("start").alias("claim_id"), text("node").alias("ref"))
