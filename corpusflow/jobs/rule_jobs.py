"""Queries of block rules, explicit lookup, order, inputs, probes, patches and packs, on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..operators.blocks import figure_items, font_heading, nearest_overlapping, numbered_equations, numbered_heading, relevant_caption, within_caps
from ..operators.rules import (
    alternative_values,
    anchor_ranks,
    contiguous,
    final_order,
    missing_producers,
    named_elements,
    pack_pruned,
    patched,
    prepared_inputs,
    restored_enum,
    shared_anchors,
    trimmed,
)
from ..operators.closure import ancestors, hierarchy_findings, levels
from ..operators.checks import evidence_gate
from ..sources.tags import asset_findings, figure_rows, tag_rows, unsafe_rows
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


# -- blocks: line items are blocks of their order's page
def _text_of_block() -> F.Column:
    kind = F.col("l_partkey") % 4
    return F.when(kind == 0, F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")"))).when(kind == 1, F.concat(F.lit("y = "), F.col("l_partkey").cast("string"))).when(kind == 2, "plain words").otherwise("x ≤ 3 (7)")


_BLOCK = "CASE l_partkey % 4 WHEN 0 THEN '(' || l_linenumber || ')' WHEN 1 THEN 'y = ' || l_partkey WHEN 2 THEN 'plain words' ELSE 'x ≤ 3 (7)' END"


def equation_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated equation numbers and the expression that each takes in its turn; repeated line items are blocks of one key. A page is four orders, so numbers compete."""
    x0 = F.when(F.col("l_partkey") % 4 == 0, 90.0).otherwise(10.0)
    y1 = F.floor(F.col("l_quantity") / 4) * 4 + F.col("l_partkey") % 3
    page = F.floor(F.col("l_orderkey") / 4).alias("page")
    blocks = table(spark, sf_dir, "lineitem").select(page, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("block"), _text_of_block().alias("text"), x0.alias("x0"), (y1 - 10).alias("y0"), (x0 + 40).alias("x1"), y1.cast("double").alias("y1"))
    return numbered_equations(blocks.distinct(), "page", "block")


def heading_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines with a font size, against the exact middle of all sizes: numbered headings, headings by font, and neither."""
    part = table(spark, sf_dir, "part")
    body = part.agg(F.percentile("p_size", 0.5).alias("body"))
    title = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 1, F.initcap("p_name")).when(F.col("p_partkey") % 5 == 2, F.concat("p_name", F.lit(": see 3"))).otherwise(F.col("p_name"))
    text = F.when(F.col("p_partkey") % 7 == 0, title).otherwise(F.concat((F.col("p_partkey") % 9).cast("string"), F.lit(". "), title))
    lines = part.select("p_partkey", text.alias("text"), F.col("p_size").cast("double").alias("size"), (F.col("p_brand") == "Brand#1").alias("bold")).crossJoin(F.broadcast(body))
    return lines.select("p_partkey", numbered_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")).alias("numbered"), font_heading(F.col("text"), F.col("size"), F.col("body")).alias("by_font"))


def caption_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of parts against a focus made from their type, with the text of their section."""
    number = (F.col("p_partkey") % 6).cast("string")
    text = F.when(F.col("p_partkey") % 8 == 7, F.col("p_name")).otherwise(F.concat(F.when(F.col("p_size") % 2 == 0, "Figure ").otherwise("Table "), number, F.lit(": "), "p_name"))
    focus = F.concat(F.lit("the "), F.substring_index("p_brand", "#", -1), F.lit(" in Figure 3 of "), F.lower("p_type"))
    section = F.concat(F.lit("economy of Table "), (F.col("p_partkey") % 4).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", relevant_caption(text, focus, section).alias("relevant"))


def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part is found by: its name, its section (the brand), the cells of its row, and labels."""
    cells = F.array_compact(F.array(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))))
    text = F.concat_ws(" ", "p_name", F.coalesce(F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")), F.lit("")), F.array_join(cells, " "), F.lit("label"))
    return table(spark, sf_dir, "part").select("p_partkey", collapsed(text).alias("text"))


def element_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as elements of their user's page, five and 200 at most in number and running size."""
    sized = table(spark, sf_dir, "events").withColumn("size", F.floor("value").cast("long"))
    return within_caps(sized, "user_id", "event_id", "size", 5, 200).select("user_id", "event_id")


def caption_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items as captions, others as tables of their supplier's page: the nearest that overlaps across and lies within reach."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("box"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 3).alias("x1"), F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + 20).alias("y1"), "l_returnflag").distinct()
    found = nearest_overlapping(item.filter("l_returnflag = 'R'"), item.filter("l_returnflag = 'N'"), "l_suppkey", "box", "table", 200.0)
    return found.select("l_suppkey", "box", "table", F.round("gap", 4).alias("gap"))


def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items as captions of their supplier's page, the others as labels, shapes and images: how many of each kind lie in the region above a caption, at most 20."""
    x0, y0 = F.col("l_quantity") * 12.0, (F.col("l_partkey") * 7 % 790).cast("double")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "image").when(F.col("l_linenumber") % 3 == 1, "label").otherwise("shape")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").distinct()  # these say all of a box
    box = lines.select("l_suppkey", key.alias("box"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 50 + F.col("l_linenumber") * 10).alias("x1"), (y0 + 15).alias("y1"), "l_returnflag")
    found = figure_items(box.filter("l_returnflag = 'R'"), box.filter("l_returnflag = 'N'").withColumnRenamed("box", "item"), "l_suppkey", "box", "item", 800.0, most=20)
    return found.groupBy("l_suppkey", "box", "kind").agg(F.count("item").alias("n"), F.min("item").alias("first"), F.max("item").alias("last"))


QUERIES |= {f.__name__: f for f in (equation_association, heading_acceptance, caption_relevance, searchable_text, element_caps, caption_boxes, figure_regions)}
ORACLES |= {
    "figure_regions": """WITH b AS (SELECT DISTINCT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS box, CASE l_linenumber % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'label' ELSE 'shape' END AS kind, l_quantity * 12.0 AS x, (l_partkey * 7 % 790)::DOUBLE AS y, 50 + l_linenumber * 10 AS w, l_returnflag AS f FROM lineitem),
      m AS (SELECT c.l_suppkey, c.box, i.kind, i.box AS item FROM b c JOIN b i ON c.l_suppkey = i.l_suppkey AND c.f = 'R' AND i.f = 'N' AND i.x < c.x + c.w AND c.x < i.x + i.w AND i.y < c.y AND greatest(0, c.y - 280) < i.y + 15
        QUALIFY row_number() OVER (PARTITION BY c.l_suppkey, c.box, i.kind ORDER BY i.box) <= 20)
      SELECT l_suppkey, box, kind, count(*) AS n, min(item) AS first, max(item) AS last FROM m GROUP BY 1, 2, 3""",
    "equation_association": f"""WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey // 4 AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS block, {_BLOCK} AS text, CASE WHEN l_partkey % 4 = 0 THEN 90 ELSE 10 END AS x0, floor(l_quantity / 4) * 4 + l_partkey % 3 AS y1 FROM lineitem),
      m AS (SELECT n.page, n.block AS number, list(e.block) AS options FROM b n JOIN b e ON n.page = e.page
        WHERE regexp_matches(n.text, '^\\(\\d+\\)$') AND e.text LIKE 'y = %' AND e.x0 + 40 <= n.x0 AND abs(e.y1 - n.y1) <= 4 GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY number) AS k FROM m),
      r AS (SELECT page, 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS number, NULL::VARCHAR AS expression FROM k WHERE k = 1
        UNION ALL SELECT k.page, k.k, CASE WHEN len(o) = 1 THEN list_concat(taken, o) ELSE taken END, k.number, CASE WHEN len(o) = 1 THEN o[1] END
        FROM (SELECT k.*, r.taken, list_filter(k.options, lambda x: NOT list_contains(r.taken, x)) AS o FROM r JOIN k ON k.page = r.page AND k.k = r.k + 1) k)
      SELECT page, number, expression FROM r WHERE expression IS NOT NULL""",
    "heading_acceptance": """WITH t AS (SELECT p_partkey, p_size, p_brand = 'Brand#1' AS bold, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') WHEN 2 THEN p_name || ': see 3' ELSE p_name END AS title FROM part),
      b AS (SELECT median(p_size) AS body FROM part)
      SELECT p_partkey, p_partkey % 7 <> 0 AND (p_partkey % 5 = 0 OR bold OR p_size > 1.05 * body OR p_partkey % 5 = 1) AS numbered, p_partkey % 7 = 0 AND p_size > 1.2 * body AS by_font FROM t, b""",
    "caption_relevance": """WITH t AS (SELECT *, p_partkey % 6 AS number, CASE WHEN p_size % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, list_concat(string_split(lower(p_name), ' '), [CASE WHEN p_size % 2 = 0 THEN 'figure' ELSE 'table' END, (p_partkey % 6)::VARCHAR]) AS words,
        [split_part(p_brand, '#', 2), '3', lower(p_type)] AS focus, ['economy', 'of', 'table', (p_partkey % 4)::VARCHAR] AS section FROM part)
      SELECT p_partkey, p_partkey % 8 <> 7 AND ((kind = 'figure' AND number = 3) OR list_has_any(words, focus) OR (list_has_any(section, focus) AND kind = 'table' AND number = p_partkey % 4)) AS relevant FROM t""",
    "searchable_text": """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END || ' ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END || ' label'), '\\s+', ' ', 'g')) AS text FROM part""",
    "element_caps": """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5 AND sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 200""",
    "caption_boxes": """WITH i AS (SELECT DISTINCT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS box, l_quantity AS x, l_extendedprice AS y, l_returnflag AS f FROM lineitem),
      m AS (SELECT a.l_suppkey, a.box, b.box AS "table", least(abs(b.y - (a.y + 20)), abs(a.y - (b.y + 20))) AS gap FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.f = 'R' AND b.f = 'N' AND abs(a.x - b.x) < 3)
      SELECT l_suppkey, box, "table", round(gap, 4) AS gap FROM m WHERE gap < 200 QUALIFY row_number() OVER (PARTITION BY l_suppkey, box ORDER BY gap, "table") = 1""",
}


# -- lookup and order: regions, nations and customers are sections, orders their elements
def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("section"), F.upper("r_name").alias("number"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf_dir, "nation").select(text("n", "n_nationkey"), F.col("n_name"), text("r", "n_regionkey"))
    c = table(spark, sf_dir, "customer").select(text("c", "c_custkey"), F.col("c_name"), text("n", "c_nationkey"))
    return r.union(n).union(c)


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References (case, kind, number) and elements. Many cases share a reference, of which those to regions name a fifth of all elements each."""
    orders = table(spark, sf_dir, "orders")
    elements = orders.select("*", F.col("o_orderkey").alias("element"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("section"), F.when(F.col("o_orderkey") % 3 == 0, "table").otherwise("figure").alias("kind"), (F.col("o_orderkey") % 500).cast("string").alias("number"))
    cases = table(spark, sf_dir, "supplier")
    region = cases.join(F.broadcast(table(spark, sf_dir, "region")), F.col("s_suppkey") % 7 == F.col("r_regionkey")).select("s_suppkey", F.lit("section").alias("kind"), F.lower("r_name").alias("number"))
    nation = cases.select("s_suppkey", F.lit("section"), F.concat(F.lit("nation_"), (F.col("s_nationkey") * 2).cast("string")))
    customer = cases.select("s_suppkey", F.lit("section"), F.format_string("Customer#%09d", F.col("s_suppkey") * 2))
    figure = cases.select("s_suppkey", F.lit("figure"), (F.col("s_suppkey") * 5 % 800).cast("string"))
    references = region.union(nation).union(customer).union(figure).withColumnRenamed("s_suppkey", "case")
    return references.withColumn("number", F.lower("number")).distinct(), elements


def explicit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's references name: elements of a section and all below it, or of a number; and references that name nothing. Counted once a reference, for all cases that share it."""
    references, elements = _references(spark, sf_dir)
    found, _ = named_elements(references, elements, _sections(spark, sf_dir))
    counts = found.groupBy("kind", "number").agg(F.count("element").alias("n"), F.min("element").alias("first"))
    return references.join(counts, ["kind", "number"], "left").select("case", "kind", "number", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first")


def _placed(orders: DataFrame) -> DataFrame:
    """Each order's place among all, the dearest first, as a value to sort by; and whether it is a last resort as an anchor."""
    place = F.struct((-F.col("o_totalprice")).alias("price"), F.col("o_orderkey").alias("id"))
    return orders.withColumns({"place": place, "late": F.col("o_orderstatus") == "P"})


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("element"), "place", "late", "o_custkey")


def protected_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference's anchor: its best element, one that is open or finished if there is any; with its rank among all that its case's references name."""
    references, elements = _references(spark, sf_dir)
    return anchor_ranks(references, _placed(elements), _sections(spark, sf_dir))


def final_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, then the elements of the anchors' customers, then the 30 best; of each case one after another, each element once."""
    references, elements = _references(spark, sf_dir)
    found, places = named_elements(references, elements, _sections(spark, sf_dir))[0], _places(spark, sf_dir)
    first = shared_anchors(references, found, places).select("case", "element")
    owner = places.select("element", "o_custkey")
    near = first.join(owner, "element").select("case", "o_custkey").distinct().join(owner, "o_custkey").select("case", "element")
    near = near.join(found, "element").join(references, ["case", "kind", "number"], "left_semi").select("case", "element")
    # the best 30 of a case are among the best 30 of each of its references
    by = W.partitionBy("kind", "number").orderBy("place")
    best = found.join(places, "element").withColumn("k", F.row_number().over(by)).filter("k <= 30").select("kind", "number", "element", "place")
    best = references.join(best, ["kind", "number"]).select("case", "element", "place").distinct()
    best = best.withColumn("k", F.row_number().over(W.partitionBy("case").orderBy("place"))).filter("k <= 30").select("case", "element")
    parts = [df.distinct().withColumn("stage", F.lit(i)) for i, df in enumerate((first, near, best))]
    return final_order(parts[0].unionByName(parts[1]).unionByName(parts[2]).join(places.select("element", F.col("place").alias("rank")), "element"))


def section_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections below the customer's order before, to any depth; for one customer in 50 the first lies below the last, and for one in 70 below no order:
    how many sections each lies below (itself too), and the findings."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("section"), "o_custkey", "o_orderkey")
    own = W.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.last("section").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.when(F.col("o_custkey") % 50 == 0, last).when(F.col("o_custkey") % 70 == 0, F.lit("none"))
    sections = orders.select("section", F.coalesce(F.lag("section").over(own), first).alias("parent"))
    pairs = ancestors(sections)
    counts = pairs.groupBy(F.col("section").alias("target")).agg(F.count("ancestor").alias("n")).select(F.lit("DEPTH").alias("code"), "target", "n")
    return counts.unionByName(hierarchy_findings(sections, pairs).groupBy("code", "target").agg(F.count(F.lit(1)).alias("n")))


def contiguous_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether line numbers less one are 0 to n - 1 in each order."""
    return contiguous(table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_linenumber") - 1), "l_orderkey", "place")


def member_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with a negative balance, by segment of priority: membership alone, by a left semi join."""
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(poor, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def relation_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one relation that another lacks, counted with their repeats, both ways: shipped and returned parts of suppliers."""
    items = table(spark, sf_dir, "lineitem")
    one, two = items.filter("l_linestatus = 'F'").select("l_suppkey", "l_returnflag"), items.filter("l_linestatus = 'O'").select("l_suppkey", "l_returnflag")
    side = lambda a, b, name: a.exceptAll(b).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(one, two, "finished").unionByName(side(two, one, "open"))


_LOOKUP = """
WITH RECURSIVE s AS (SELECT 'r' || r_regionkey AS section, upper(r_name) AS number, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer),
below AS (SELECT section, lower(number) AS number FROM s UNION SELECT s.section, b.number FROM s JOIN below b ON s.parent = b.section),
e AS (SELECT o_orderkey AS element, 'c' || o_custkey AS section, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'figure' END AS kind, (o_orderkey % 500)::VARCHAR AS number, o_totalprice AS price, o_orderstatus AS status, o_custkey FROM orders),
refs AS (SELECT s_suppkey AS "case", 'section' AS kind, lower(r_name) AS number FROM supplier JOIN region ON s_suppkey % 7 = r_regionkey UNION SELECT s_suppkey, 'section', 'nation_' || s_nationkey * 2 FROM supplier UNION SELECT s_suppkey, 'section', 'customer#' || lpad((s_suppkey * 2)::VARCHAR, 9, '0') FROM supplier UNION SELECT s_suppkey, 'figure', (s_suppkey * 5 % 800)::VARCHAR FROM supplier),
found AS (SELECT DISTINCT "case", refs.kind, refs.number, element FROM refs JOIN below USING (number) JOIN e ON e.section = below.section WHERE refs.kind = 'section'
  UNION SELECT "case", refs.kind, refs.number, element FROM refs JOIN e ON e.kind = refs.kind AND e.number = refs.number WHERE refs.kind <> 'section'),
own AS (SELECT DISTINCT "case", element, price, status, o_custkey FROM found JOIN e USING (element)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY price DESC, element) AS rank FROM own),
best AS (SELECT f."case", f.kind, f.number, element, rank FROM found f JOIN ranked r USING ("case", element) QUALIFY row_number() OVER (PARTITION BY f."case", f.kind, f.number ORDER BY status = 'P', rank) = 1),
anchor AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY "case", element ORDER BY kind, number) = 1)
"""
QUERIES |= {f.__name__: f for f in (explicit_sections, section_chains, protected_anchors, final_places, contiguous_places, member_orders, relation_difference)}
ORACLES |= {
    "explicit_sections": _LOOKUP + """SELECT r."case", r.kind, r.number, count(element) AS n, min(element) AS first FROM refs r LEFT JOIN found f ON f."case" = r."case" AND f.kind = r.kind AND f.number = r.number GROUP BY 1, 2, 3""",
    "section_chains": """WITH RECURSIVE o AS (SELECT o_orderkey::VARCHAR AS section, lag(o_orderkey) OVER w::VARCHAR AS up, max(o_orderkey) OVER (PARTITION BY o_custkey)::VARCHAR AS last, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
      s AS (SELECT section, coalesce(up, CASE WHEN o_custkey % 50 = 0 THEN last WHEN o_custkey % 70 = 0 THEN 'none' END) AS parent FROM o),
      above AS (SELECT section, section AS ancestor, 0 AS step FROM s UNION SELECT a.section, s.parent, 1 FROM above a JOIN s ON s.section = a.ancestor WHERE s.parent IS NOT NULL AND s.parent <> 'none')
      SELECT 'DEPTH' AS code, section AS target, count(DISTINCT ancestor) AS n FROM above GROUP BY 2 UNION ALL SELECT 'SECTION_CYCLE', section, 1 FROM above WHERE section = ancestor AND step = 1
      UNION ALL SELECT DISTINCT 'SECTION_PARENT_ABSENT', 'none', 1 FROM s WHERE parent = 'none'""",
    "protected_anchors": _LOOKUP + 'SELECT "case", kind, number, element, rank FROM anchor',
    "final_places": _LOOKUP + """, parts AS (SELECT "case", element, 0 AS stage, rank FROM anchor
      UNION ALL SELECT r."case", r.element, 1, r.rank FROM (SELECT DISTINCT a."case", e.o_custkey FROM anchor a JOIN e USING (element)) c JOIN ranked r ON r."case" = c."case" AND r.o_custkey = c.o_custkey
      UNION ALL SELECT "case", element, 2, rank FROM ranked WHERE rank <= 30),
      f AS (SELECT "case", element, min((stage, rank)) AS spot FROM parts GROUP BY 1, 2) SELECT "case", element, spot[1]::INT AS stage, row_number() OVER (PARTITION BY "case" ORDER BY spot, element) - 1 AS place FROM f""",
    "contiguous_places": "SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1",
    "member_orders": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "relation_difference": """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') - count(*) FILTER (l_linestatus = 'O') AS d FROM lineitem GROUP BY 1, 2)
      SELECT l_suppkey, l_returnflag, abs(d) AS n, CASE WHEN d > 0 THEN 'finished' ELSE 'open' END AS side FROM c WHERE d <> 0""",
}


# -- graphs, inputs, probes, patches, packs
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every node of the graph of regions, nations, customers and orders, with short cuts from regions to customers: the longest way to it."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = nation.select(node("r", "n_regionkey").alias("a"), node("n", "n_nationkey").alias("b"))
    edges = edges.union(customer.select(node("n", "c_nationkey"), node("c", "c_custkey")))
    edges = edges.union(table(spark, sf_dir, "orders").select(node("c", "o_custkey"), node("o", "o_orderkey")))
    short = customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")), node("c", "c_custkey"))
    return levels(edges.union(short))


def producer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as variables that orders make (the one that sold it first) and bind; dependencies are known for orders of one customer alone."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bindings = items.select(F.col("l_orderkey").alias("computation"), F.col("l_partkey").alias("variable")).distinct()
    owners = bindings.groupBy("variable").agg(F.min("computation").alias("producer"))
    made = bindings.join(owners, "variable").select("computation", "producer").distinct()
    of = lambda c: orders.select(F.col("o_orderkey").alias(c), F.col("o_custkey").alias(f"{c}_cust"))
    known = made.join(of("computation"), "computation").join(of("producer"), "producer").filter("computation_cust % 10 = producer_cust % 10").select("computation", "producer")
    return missing_producers(bindings, owners, known).groupBy("computation").agg(F.count("variable").alias("n_missing"), F.min("variable").alias("first"))


def input_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of each order: what its setup gives, else its controls, else defaults."""
    default = F.create_map(F.lit("rate"), F.lit(0.5), F.lit("size"), F.lit(1.0))
    controls = F.create_map(F.lit("size"), F.col("o_totalprice"), F.lit("step"), F.lit(2.0))
    setup = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("step"), F.col("o_custkey").cast("double"))).otherwise(F.expr("cast(map() as map<string, double>)"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", prepared_inputs(default, controls, setup).alias("m"))
    return made.select("o_orderkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("rate", "size", "step")])


def scalar_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to try for each part's price: bounds from its size (some open), the middle, a step on."""
    low, high = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("double")), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 100.0)
    tried = alternative_values(low, high, F.col("p_retailprice").cast("double"), F.when(F.col("p_partkey") % 2 == 0, F.lit(10.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(tried).alias("place", "value")).select("p_partkey", F.col("place").cast("long").alias("place"), "value")


def enum_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types in odd case, some unknown, back to their names; null where there is none."""
    odd = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("s"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", restored_enum(odd, ["click", "view", "purchase", "error", "signup"]).alias("restored"))


def patched_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows as leaves with paths; patches for some, of which those beyond the allowed paths, or twice for one leaf, are refused."""
    s = table(spark, sf_dir, "supplier")
    leaves = s.select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_nationkey").cast("string").alias("nation")).unpivot(["id"], ["s_name", "nation"], "path", "value")
    one = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lit("s_name").alias("path"), F.concat(F.lit("new "), "s_name").alias("value"))
    two = s.filter("s_suppkey % 6 = 0").select("s_suppkey", F.lit("s_name"), F.lit("again"))
    three = s.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit("nation"), F.lit("99"))
    new, refused = patched(leaves, one.union(two).union(three), ["s_name"])
    return new.unionByName(refused.select("id", F.concat(F.lit("refused:"), "path").alias("path"), "value"))


def pack_pruned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidate lists of at most seven lines: whole, without details, or skipped, within 60 units."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("full_bytes"))
    return pack_pruned(lines.withColumn("compact_bytes", F.floor(F.col("full_bytes") / 3).cast("long")), "l_orderkey", "l_linenumber", 60)


def trimmed_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packs from whose end lines go until what is left and two units for each that went fit into 90."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"))
    return trimmed(lines, "l_orderkey", "l_linenumber", "size", 90, F.lit(2)).select("l_orderkey", "l_linenumber")


QUERIES |= {f.__name__: f for f in (dag_levels, producer_edges, input_maps, scalar_probes, enum_restored, patched_leaves, pack_pruned_blocks, trimmed_packs)}
ORACLES |= {
    "dag_levels": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
        UNION ALL SELECT 'r' || c_custkey % 5, 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0),
      f AS (SELECT DISTINCT a AS node, 0::BIGINT AS level FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, f.level + 1 FROM f JOIN e ON f.node = e.a) SELECT node, max(level) AS level FROM f GROUP BY 1""",
    "producer_edges": """WITH b AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS v FROM lineitem), o AS (SELECT v, min(c) AS p FROM b GROUP BY 1)
      SELECT c AS computation, count(*) AS n_missing, min(v) AS first FROM b JOIN o USING (v) WHERE p <> c AND NOT EXISTS (SELECT 1 FROM orders x JOIN orders y ON x.o_custkey % 10 = y.o_custkey % 10 WHERE x.o_orderkey = c AND y.o_orderkey = p) GROUP BY 1""",
    "input_maps": "SELECT o_orderkey, 0.5::DOUBLE AS rate, o_totalprice AS size, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE ELSE 2 END AS step FROM orders",
    "scalar_probes": """WITH p AS (SELECT p_partkey, p_retailprice AS d, CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS lo, CASE WHEN p_partkey % 5 > 0 THEN p_size * 100.0::DOUBLE END AS hi, CASE WHEN p_partkey % 2 = 0 THEN 10.0::DOUBLE ELSE 1 END AS st FROM part),
      u AS (SELECT p_partkey, d, lo, hi, k, CASE k WHEN 1 THEN lo WHEN 2 THEN hi WHEN 3 THEN (lo + hi) / 2 ELSE d + st END AS value FROM p, (VALUES (1), (2), (3), (4)) t(k)),
      g AS (SELECT p_partkey, value, min(k) AS k FROM u WHERE value IS NOT NULL AND value <> d AND coalesce(value >= lo, TRUE) AND coalesce(value <= hi, TRUE) GROUP BY 1, 2)
      SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS place, value FROM g""",
    "enum_restored": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN NULL WHEN event_type IN ('click', 'view', 'purchase', 'error', 'signup') THEN event_type END AS restored FROM events",
    "patched_leaves": """SELECT s_suppkey AS id, 's_name' AS path, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 THEN 'new ' || s_name ELSE s_name END AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR FROM supplier
      UNION ALL SELECT s_suppkey, 'refused:s_name', 'new ' || s_name FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'refused:s_name', 'again' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'refused:nation', '99' FROM supplier WHERE s_suppkey % 5 = 0""",
    "pack_pruned_blocks": """WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::BIGINT AS f, floor(max(l_quantity)::BIGINT / 3)::BIGINT AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
      r AS (SELECT l_orderkey, 0::BIGINT AS n, 0::BIGINT AS used, 0 AS l_linenumber, '' AS form FROM s WHERE n = 1
        UNION ALL SELECT s.l_orderkey, s.n, r.used + CASE WHEN r.used + f <= 60 THEN f WHEN r.used + c <= 60 THEN c ELSE 0 END, s.l_linenumber, CASE WHEN r.used + f <= 60 THEN 'full' WHEN r.used + c <= 60 THEN 'compact' ELSE 'skipped' END FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.n = r.n + 1)
      SELECT l_orderkey, l_linenumber, form FROM r WHERE n > 0""",
    "trimmed_packs": """WITH s AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM s),
      l AS (SELECT l_orderkey, max(k) AS last FROM w WHERE total + 2 * (n - k) <= 90 GROUP BY 1) SELECT l_orderkey, l_linenumber FROM w JOIN l USING (l_orderkey) WHERE k <= last""",
}


# -- gates
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence of their orders: findings by code and status, and their first target."""
    items = table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_linenumber") - 1).withColumn("o_orderkey", F.col("l_orderkey") * F.when(F.col("l_partkey") % 50 == 0, -1).otherwise(1))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    found = evidence_gate(items, orders, "l_orderkey", "l_linenumber", "place", "o_orderkey", F.col("l_shipdate") >= F.col("o_orderdate"), 6)
    return found.groupBy("code", "status").agg(F.count("*").alias("n"), F.min("target").alias("first"), F.max("details").alias("details"))


#: What every twelfth page gets beside its own text, and the findings that this is.
PLANTED = [
    ("""<img src='http://x' onload='f()'>""", {"external_dependency": 1, "unsafe_html": 1}),
    ("""<a href=javascript:f()>x</a>""", {"unsafe_link": 1}),
    ("""<input disabled onclick="f()">""", {"unsafe_html": 1}),
    ("""<!-- <img src="http://x" onload="f()"> -->""", {}),
    ("""<script type="application/json" id="manifest">{"t": "<img src='http://x'>"}</script>""", {"manifest_invalid": -1}),
    ("""<IMG SRC = "data:,x" ONERROR = f()>""", {"unsafe_html": 1}),
    ("""<a href="  HTTPS://x">x</a><a href=#top>x</a>""", {}),
    ("""<iframe></iframe><base href="/">""", {"external_dependency": 2}),
    ("""<meta content="1" http-equiv=Refresh>""", {"external_dependency": 1}),
    ("""<svg><use href="#a"/><image xlink:href="http://x"/></svg>""", {"external_dependency": 1}),
    ("""<p style="background: URL('http://x')">x</p><style>@import "x"</style>""", {"external_dependency": 2}),
    ("""<script>fetch("x")</script>""", {"forbidden_runtime": 1}),
]


def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page and code, what a page of its own may not have or lacks; every page has one of twelve pieces more."""
    more = F.get(F.array(*[F.lit(text) for text, _ in PLANTED]), (F.col("page_id") % len(PLANTED)).cast("int"))
    rows = tag_rows(table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html")), "page_id", "html")
    return unsafe_rows(rows).select("page_id", "code").unionByName(asset_findings(rows, "page_id", "manifest")).groupBy("page_id", "code").agg(F.count(F.lit(1)).alias("n"))


def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with two figures of its own: one with a drawing, images and a caption, one with text alone."""
    number = F.col("page_id").cast("string")
    one = F.concat(F.lit("<figure id=a><svg><text x=1>axis "), number, F.lit("</text><text>b  &amp; c</text></svg><img src=x alt='plot "), number, F.lit("'><img><figcaption>Figure "), number, F.lit(": <i>all</i> of it</figcaption></figure>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", one, F.lit("<p>between</p><figure>only\n text</figure>")).alias("html"))
    listed = lambda c: F.array_join(c, "|").alias(c)
    return figure_rows(pages, "page_id", "html").select("page_id", F.col("place").cast("long").alias("place"), "caption", listed("labels"), listed("alts"))


QUERIES |= {f.__name__: f for f in (source_gate, artifact_scan, page_figures)}
ORACLES |= {
    "source_gate": """WITH e AS (SELECT *, l_linenumber - 1 AS place, l_orderkey * CASE WHEN l_partkey % 50 = 0 THEN -1 ELSE 1 END AS src FROM lineitem),
      g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS ids, min(place) AS low, max(place) AS high FROM e GROUP BY 1),
      f AS (SELECT 'duplicate_evidence' AS code, 'FAIL' AS status, l_orderkey::VARCHAR AS target, (n - ids)::VARCHAR AS details FROM g WHERE n <> ids
        UNION ALL SELECT 'ranks_not_contiguous', 'FAIL', l_orderkey::VARCHAR, high::VARCHAR FROM g WHERE ids <> n OR low <> 0 OR high <> n - 1
        UNION ALL SELECT 'size_limited', 'WARN', l_orderkey::VARCHAR, n::VARCHAR FROM g WHERE n > 6
        UNION ALL SELECT 'absent_source', 'FAIL', src::VARCHAR, count(*)::VARCHAR FROM e WHERE src NOT IN (SELECT o_orderkey FROM orders) GROUP BY src
        UNION ALL SELECT 'differs_from_source', 'FAIL', l_orderkey::VARCHAR, count(*)::VARCHAR FROM e JOIN orders ON src = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY l_orderkey)
      SELECT code, status, count(*) AS n, min(target) AS first, max(details) AS details FROM f GROUP BY 1, 2""",
    # the pages' own tags are plain (attributes in double quotes), so a pattern finds theirs; what is planted is known
    "artifact_scan": """WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script\\b[^>]*>).*?</script>', '\\1', 'g') AS h FROM pages),
      t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)((?:\\s+[a-zA-Z:-]+="[^"]*")+)\\s*/?>', 1)) AS tag, unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)((?:\\s+[a-zA-Z:-]+="[^"]*")+)\\s*/?>', 2)) AS rest FROM h),
      a AS (SELECT page_id, lower(tag) AS tag, lower(unnest(regexp_extract_all(rest, '([a-zA-Z:-]+)="([^"]*)"', 1))) AS attribute, unnest(regexp_extract_all(rest, '([a-zA-Z:-]+)="([^"]*)"', 2)) AS value FROM t),
      c AS (SELECT page_id, CASE WHEN attribute LIKE 'on%' THEN 'unsafe_html' WHEN attribute IN ('src', 'srcset', 'poster', 'action') AND value <> '' AND value NOT LIKE 'data:%' THEN 'external_dependency'
        WHEN tag = 'a' AND attribute = 'href' AND value <> '' AND value NOT LIKE '#%' AND NOT regexp_matches(value, '(?i)^https?:') THEN 'unsafe_link' END AS code, 1 AS n FROM a
        UNION ALL SELECT page_id, 'manifest_invalid', 1 FROM pages UNION ALL SELECT page_id, code, k.n FROM pages JOIN (VALUES """
    + ", ".join(f"({k}, '{code}', {n})" for k, (_, found) in enumerate(PLANTED) for code, n in found.items())
    + """) k(r, code, n) ON page_id % 12 = r)
      SELECT page_id, code, sum(n)::BIGINT AS n FROM c WHERE code IS NOT NULL GROUP BY 1, 2 HAVING sum(n) > 0""",
    "page_figures": """SELECT page_id, 0::BIGINT AS place, 'Figure ' || page_id || ': all of it' AS caption, 'axis ' || page_id || '|b & c' AS labels, 'plot ' || page_id || '|' AS alts FROM pages
      UNION ALL SELECT page_id, 1, 'only text', '', '' FROM pages""",
}
