"""Queries of retrieval, on documents with every benchmark passage as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import RISK, STOPWORDS, TOKEN, caption_kind, caption_number, collapsed, element_type, equation_number, heading_number, heading_title, noise_heading, reference_keys, tokens
from ..operators.search import MAX_BYTES, bm25, confidence, document_frequencies, downgraded, exact_medians, neighbours, pack_greedily, rank_keys, ranked, term_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '{TOKEN}'), lambda t: NOT list_contains({_STOP}, t))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is a query."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query"), F.col("text").alias("phrase"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(docs(spark, sf_dir), queries(spark, sf_dir))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What queries name outright: here every query the document of its own number times seven."""
    return queries(spark, sf_dir).select("query", (F.col("query") * 7).alias("doc_id"))


#: Documents of this source stand in for noise sections.
NOISE_SOURCE = "src9"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = named(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return rank_keys(docs(spark, sf_dir), queries(spark, sf_dir), F.col("source") == NOISE_SOURCE, explicit)


PRELUDE = f"""
WITH q AS (SELECT item_id AS query, text AS phrase, list_distinct({tokens_sql('text')}) AS terms FROM benchmark),
qt AS (SELECT query, len(terms) AS n_terms, unnest(terms) AS term FROM q),
tok AS (SELECT doc_id, text, source, {tokens_sql('text')} AS tokens, {tokens_sql("split_part(text, chr(10), 1)")} AS head FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM tok) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term),
av AS (SELECT sum(len(tokens)) / count(*) AS average FROM tok),
w AS (SELECT tf.doc_id, term, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / average)) AS w FROM tf JOIN df USING (term) JOIN tok USING (doc_id), av),
bm AS (SELECT query, doc_id, sum(w) AS score, count(*) AS n_matched, max(n_terms) AS n_terms FROM w JOIN qt USING (term) GROUP BY 1, 2),
named AS (SELECT query, query * 7 AS doc_id FROM q WHERE query * 7 IN (SELECT doc_id FROM documents)),
cand AS (SELECT query, doc_id FROM bm UNION SELECT query, doc_id FROM named),
raw AS (SELECT b.query, b.doc_id, coalesce(score, 0) AS score, coalesce(n_matched, 0) / greatest(coalesce(n_terms, 1), 1) AS coverage, source = 'src9' AS noise,
  (n.query IS NOT NULL)::INT AS explicit, len(list_intersect(q.terms, tok.head)) AS overlap,
  contains(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(phrase), 'ß', 'ss'), '\\s+', ' ', 'g')))::INT AS exact
  FROM cand b JOIN tok USING (doc_id) JOIN q ON q.query = b.query LEFT JOIN bm ON bm.query = b.query AND bm.doc_id = b.doc_id LEFT JOIN named n ON n.query = b.query AND n.doc_id = b.doc_id),
keys AS (SELECT query, doc_id, explicit, CASE WHEN noise THEN 0 ELSE exact END AS exact, CASE WHEN noise THEN 0 ELSE overlap END AS overlap, score * CASE WHEN noise THEN 0.05::DOUBLE ELSE 1 END AS score, coverage
  FROM raw WHERE explicit = 1 OR score > 0 AND NOT noise),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY explicit DESC, exact DESC, overlap DESC, round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM keys)
"""


def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(tokens(F.col("text")))).alias("n_tokens"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def bm25_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_frequencies(counts(spark, sf_dir)).select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every query by BM25 alone; a report with a limit."""
    scores = bm25(counts(spark, sf_dir), queries(spark, sf_dir)).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).filter("rank <= 10").select("query", "doc_id", "score")


def rank_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best candidates of every query; a report with a limit."""
    top = ranked(keys(spark, sf_dir), 50)
    return top.select("query", "doc_id", "rank", "explicit", "exact", "overlap", F.round("coverage", 9).alias("coverage"), F.round("score", 9).alias("score"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: how many candidates are named, phrases and scored, the best one's coverage and size, whether the second ties with it,
    and how many of the documents named don't exist. The whole comes from one pass over the ranked candidates."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("explicit"), F.desc("exact"), F.desc("overlap"), F.desc(F.round("score", 9)), "doc_id"))
    found = keys(spark, sf_dir).withColumn("rank", rank)
    place = F.struct("explicit", "exact", "overlap", F.round("score", 9).alias("score"))
    by = found.groupBy("query").agg(
        F.sum("explicit").alias("explicit"), F.sum("exact").alias("exact"), F.count_if(F.col("score") > 0).alias("positive"),
        F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("top_coverage"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, place)) == F.max(F.when(F.col("rank") == 2, place)), F.lit(False)).alias("tied"),
    )
    missing = named(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").groupBy("query").agg(F.count("doc_id").alias("unresolved"))
    return queries(spark, sf_dir).select("query").join(by, "query", "left").join(missing, "query", "left").fillna({"explicit": 0, "exact": 0, "positive": 0, "top_coverage": 0.0, "tied": False, "unresolved": 0})


def tied_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("query", "positive", "exact", "tied")


def confidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query its class, and the class in the end: lower where something named is missing or the best document doesn't fit the budget."""
    found = _signals(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("top"), F.octet_length("text").alias("bytes")), "top", "left")
    c = confidence(F.col("explicit"), F.lit(0), F.col("exact"), F.col("positive"), F.col("top_coverage"), F.col("tied"))
    found = found.withColumn("confidence", c)
    final = downgraded(F.col("confidence"), F.col("unresolved") > 0, F.coalesce(F.col("bytes") > MAX_BYTES, F.lit(False)))
    return found.select("query", F.round("top_coverage", 9).alias("top_coverage"), "confidence", final.alias("final"))


def phrase_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a query as a phrase, and those that cover at least half of its terms."""
    found = keys(spark, sf_dir).filter("exact = 1 or coverage >= 0.5")
    return found.select("query", "doc_id", "exact", F.round("coverage", 9).alias("coverage"))


QUERIES |= {f.__name__: f for f in (tokens_by_lang, doc_lengths, bm25_df_idf, bm25_topk, tied_top, phrase_and_coverage)} | {"rank_keys": rank_key_rows, "confidence": confidence_class}
_SIGNALS = PRELUDE + """, s AS (SELECT q.query, coalesce(sum(explicit), 0) AS explicit, coalesce(sum(exact), 0)::BIGINT AS exact, count(*) FILTER (score > 0) AS positive, coalesce(max(coverage) FILTER (rank = 1), 0) AS c, max(doc_id) FILTER (rank = 1) AS top,
  count(*) FILTER (rank <= 2) = 2 AND count(DISTINCT (explicit, exact, overlap, round(score, 9))) FILTER (rank <= 2) = 1 AS tied FROM q LEFT JOIN ranks ON ranks.query = q.query GROUP BY 1)
"""
ORACLES |= {
    "tokens_by_lang": f"SELECT lang, count(*) AS n_docs, CAST(sum(len({tokens_sql('text')})) AS BIGINT) AS n_tokens FROM documents GROUP BY lang",
    "doc_lengths": f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens FROM documents",
    "bm25_df_idf": PRELUDE + "SELECT term, df, round(idf, 9) AS idf FROM df",
    "bm25_topk": PRELUDE + "SELECT query, doc_id, round(score, 9) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) <= 10",
    "rank_keys": PRELUDE + "SELECT query, doc_id, rank, explicit, exact, overlap::INT AS overlap, round(coverage, 9) AS coverage, round(score, 9) AS score FROM ranks WHERE rank <= 50",
    "tied_top": _SIGNALS + "SELECT query, positive, exact, tied FROM s",
    "confidence": _SIGNALS + """, t AS (SELECT query, round(c, 9) AS top_coverage, top, CASE WHEN explicit > 0 THEN 'HIGH' WHEN positive = 0 OR c = 0 THEN 'LOW' WHEN exact = 1 OR (c = 1 AND NOT tied) THEN 'HIGH' ELSE 'AMBIGUOUS' END AS confidence FROM s)
      SELECT query, top_coverage, confidence, CASE WHEN query * 7 NOT IN (SELECT doc_id FROM documents) THEN 'LOW' WHEN confidence = 'HIGH' AND coalesce(strlen(text) > 16000, FALSE) THEN 'AMBIGUOUS' ELSE confidence END AS final
      FROM t LEFT JOIN documents ON doc_id = top""",
    "phrase_and_coverage": PRELUDE + "SELECT query, doc_id, exact, round(coverage, 9) AS coverage FROM keys WHERE exact = 1 OR coverage >= 0.5",
}


def neighbors_same_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


def dedup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal language and text after folding and collapsing: the least doc_id stays. Digests are summed before the shuffle."""
    identity = F.sha2(F.concat_ws("|", "lang", collapsed(F.col("text"))), 256)
    return docs(spark, sf_dir).groupBy(identity.alias("identity")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("identity")


def pack_budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = docs(spark, sf_dir).select("source", "doc_id", F.octet_length("text").alias("size"))
    return pack_greedily(sized, "source", "doc_id", "size").select("source", F.col("place").cast("long").alias("place"), "doc_id")


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("E"), F.substring(F.sha2(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")), 256), 1, 20)).alias("evidence_id"), F.concat(F.lit("paper-"), F.sha2("text", 256)).alias("source_id"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.octet_length(F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))).cast("long").alias("bytes"))


def risk_filter_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four riskiest units by their order: a report with a limit, as units are verified one by one."""
    return docs(spark, sf_dir).filter(F.col("text").rlike(RISK)).select("doc_id", "lang").orderBy("doc_id").limit(4)


QUERIES |= {f.__name__: f for f in (neighbors_same_section, dedup_identity, pack_budget_skip, evidence_ids, token_estimate, risk_filter_limit)}
ORACLES |= {
    "neighbors_same_section": "SELECT a.conv_id, a.turn, b.turn AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1",
    "dedup_identity": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lang, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))",
    "pack_budget_skip": """
WITH RECURSIVE s AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id FROM s GROUP BY source
  UNION ALL SELECT f.source, s.n, CASE WHEN f.used + s.size <= 16000 AND f.k < 12 THEN f.used + s.size ELSE f.used END, CASE WHEN f.used + s.size <= 16000 AND f.k < 12 THEN f.k + 1 ELSE f.k END,
    CASE WHEN f.used + s.size <= 16000 AND f.k < 12 THEN s.doc_id END FROM f JOIN s ON s.source = f.source AND s.n = f.n + 1)
SELECT source, k - 1 AS place, doc_id FROM f WHERE doc_id IS NOT NULL""",
    "evidence_ids": "SELECT doc_id, 'E' || substr(sha256(source || ':' || doc_id::VARCHAR), 1, 20) AS evidence_id, 'paper-' || sha256(text) AS source_id FROM documents",
    "token_estimate": "SELECT doc_id, CAST(strlen(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR)) AS BIGINT) AS bytes FROM documents",
    "risk_filter_limit": r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)\b(benchmark|outperform|accuracy|experimental result|causes|causal)\b|\d+(?:\.\d+)?\s*%') ORDER BY doc_id LIMIT 4",
}


# -- references, captions, headings: texts made from part columns, as no document has any
_LINES = {
    "reference": ["{see} ", "{size}", " and eq. (", "{key}", ") in Section ", "{size}", ".2"],
    "caption": ["{kind} ", "{size}", "{mark} ", "{name}"],
    "heading": ["{number}", "{name}"],
    "equation": ["{sign}", "{name}", " (", "{size}", "a)", "{tail}"],
}


#: What stands in a line by a part's number: forms that are recognised, and forms that aren't.
_CHOICES = {
    "{see}": ("See Figure", "Figures of", "as Table", "see tables"),
    "{kind} ": ("Fig. ", "Table ", "Figure ", "Tabular "),
    "{mark}": (":", ".", ",", " -"),
    "{number}": ("3.1 ", "4) ", "References ", "2.", "7 Acknowledgements to ", "12 3 "),
    "{sign}": ("y = ", "y ≤ ", "y is "),
    "{tail}": ("", " ", " ends"),
}


def _line(parts: list[str]) -> F.Column:
    def of(name: str) -> F.Column:
        options = _CHOICES[name]
        return F.element_at(F.array(*map(F.lit, options)), (F.col("p_partkey") % len(options) + 1).cast("int"))

    cols = {"{size}": F.col("p_size").cast("string"), "{key}": (F.col("p_partkey") % 7).cast("string"), "{name}": F.col("p_name")} | {n: of(n) for n in _CHOICES}
    return F.concat(*(cols.get(x, F.lit(x)) for x in parts))


def _line_sql(parts: list[str]) -> str:
    def of(name: str) -> str:
        options = _CHOICES[name]
        return "list_extract([" + ", ".join(f"'{o}'" for o in options) + f"], CAST(p_partkey % {len(options)} + 1 AS INTEGER))"

    cols = {"{size}": "p_size::VARCHAR", "{key}": "(p_partkey % 7)::VARCHAR", "{name}": "p_name"} | {n: of(n) for n in _CHOICES}
    return "concat(" + ", ".join(cols.get(x) or "'" + x + "'" for x in parts) + ")"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def reference_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = part(spark, sf_dir).select("p_partkey", F.posexplode(reference_keys(_line(_LINES["reference"]))).alias("place", "key"))
    return keys.select("p_partkey", F.col("place").cast("long").alias("place"), "key.kind", "key.number")


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References joined to the captions they name; per caption, how many refer to it."""
    keys = reference_key_rows(spark, sf_dir).filter("kind in ('figure', 'table')")
    line = _line(_LINES["caption"])
    captions = part(spark, sf_dir).select(F.col("p_partkey").alias("target"), caption_kind(line).alias("kind"), caption_number(line).alias("number"))
    return captions.join(keys.groupBy("kind", "number").count(), ["kind", "number"], "left").select("target", F.coalesce("count", F.lit(0)).alias("n_references"))


def caption_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(_LINES["caption"])
    return part(spark, sf_dir).select("p_partkey", caption_kind(line).alias("kind"), caption_number(line).alias("number"), element_type(line).alias("element_type"))


def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(_LINES["heading"])
    return part(spark, sf_dir).select("p_partkey", heading_number(line).alias("number"), heading_title(line).alias("title"), noise_heading(line).alias("noise"))


def equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(_LINES["equation"])
    return part(spark, sf_dir).select("p_partkey", equation_number(line).alias("number"), element_type(line).alias("element_type"))


def visual_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for every visual: the one asked for if there is one, else that of its family, else the generic scene."""
    families = spark.createDataFrame(list(VISUALS.items()), "family string, component string")
    rows = part(spark, sf_dir).select("p_partkey", F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("family"), F.when(F.col("p_size") % 5 == 0, "matrix").alias("asked"))
    return rows.join(F.broadcast(families), "family", "left").select("p_partkey", F.coalesce("asked", "component", F.lit("scene")).alias("component"))


#: Families of parts stand in for those of mechanisms.
VISUALS = {"economy": "bars", "small": "distribution", "medium": "flow", "large": "trajectory"}
#: The rules in SQL: every reference of a line in its order, captions, and numbered headings.
_CAPTION_SQL = r"(?is)^\s*(Figure|Fig\.?|Table)\s+(\d+(?:\.\d+)*[a-zA-Z]?)\s*[.:\-]\s*(.*)"
_HEADING_SQL = r"^\s*(\d+(?:\.\d+)*)(?:[.)]|\s)+\s*([A-Za-z][^\n]{1,100})$"
_REFERENCE_SQL = r"(?i)\b(section|sec\.?|equation|eq\.?|figure|fig\.?|table)\s*\(?\s*(\d+(?:\.\d+)*[a-zA-Z]?)\)?"
_REFERENCES = f"""WITH l AS (SELECT p_partkey, {_line_sql(_LINES['reference'])} AS l FROM part),
m AS (SELECT p_partkey, unnest(regexp_extract_all(l, '{_REFERENCE_SQL}', 1)) AS k, unnest(regexp_extract_all(l, '{_REFERENCE_SQL}', 2)) AS v, generate_subscripts(regexp_extract_all(l, '{_REFERENCE_SQL}', 1), 1) - 1 AS place FROM l),
keys AS (SELECT p_partkey, place, CASE lower(k[:2]) WHEN 'se' THEN 'section' WHEN 'eq' THEN 'equation' WHEN 'fi' THEN 'figure' ELSE 'table' END AS kind, lower(v) AS number FROM m)
"""
QUERIES |= {"reference_keys": reference_key_rows, "reference_links": reference_links, "caption_kind": caption_kinds, "heading_parse": heading_parse, "equation_number": equation_numbers, "visual_dispatch": visual_dispatch}
ORACLES |= {
    "reference_keys": _REFERENCES + "SELECT p_partkey, place, kind, number FROM keys",
    "reference_links": _REFERENCES + f""", c AS (SELECT p_partkey AS target, CASE WHEN regexp_extract(l, '{_CAPTION_SQL}', 1) = '' THEN NULL WHEN lower(regexp_extract(l, '{_CAPTION_SQL}', 1)) = 'table' THEN 'table' ELSE 'figure' END AS kind, lower(regexp_extract(l, '{_CAPTION_SQL}', 2)) AS number
        FROM (SELECT p_partkey, {_line_sql(_LINES['caption'])} AS l FROM part)),
      n AS (SELECT kind, number, count(*) AS n FROM keys WHERE kind IN ('figure', 'table') GROUP BY 1, 2)
      SELECT target, coalesce(n, 0) AS n_references FROM c LEFT JOIN n ON n.kind = c.kind AND n.number = c.number""",
    "caption_kind": f"""SELECT p_partkey, CASE WHEN k = '' THEN NULL WHEN lower(k) = 'table' THEN 'table' ELSE 'figure' END AS kind, CASE WHEN k <> '' THEN lower(regexp_extract(l, '{_CAPTION_SQL}', 2)) END AS number, CASE WHEN k = '' THEN 'paragraph' ELSE 'caption' END AS element_type
      FROM (SELECT p_partkey, l, regexp_extract(l, '{_CAPTION_SQL}', 1) AS k FROM (SELECT p_partkey, {_line_sql(_LINES['caption'])} AS l FROM part))""",
    "heading_parse": f"""WITH l AS (SELECT p_partkey, {_line_sql(_LINES['heading'])} AS l FROM part), h AS (SELECT *, nullif(regexp_extract(l, '{_HEADING_SQL}', 1), '') AS number, nullif(regexp_extract(l, '{_HEADING_SQL}', 2), '') AS title FROM l)
      SELECT p_partkey, number, title, regexp_matches(coalesce(title, l), '(?i)^(references|bibliography|acknowledg(?:e)?ments|contents|table of contents|author affiliations)\\b') AS noise FROM h""",
    "equation_number": f"""SELECT p_partkey, CASE WHEN regexp_matches(l, '[=∝→∑≤≥]') THEN nullif(regexp_extract(l, '\\((\\d+[a-z]?)\\)\\s*$', 1), '') END AS number, CASE WHEN regexp_matches(l, '[=∝→∑≤≥]') AND regexp_matches(l, '\\(\\d+[a-z]?\\)\\s*$') THEN 'equation' ELSE 'paragraph' END AS element_type
      FROM (SELECT p_partkey, {_line_sql(_LINES['equation'])} AS l FROM part)""",
    "visual_dispatch": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'matrix' ELSE CASE lower(p_type) WHEN 'economy' THEN 'bars' WHEN 'small' THEN 'distribution' WHEN 'medium' THEN 'flow' WHEN 'large' THEN 'trajectory' ELSE 'scene' END END AS component FROM part",
}


# -- sections and thresholds on the other tables
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, each event with the latest error before or at it, as elements with their section."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    window = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(window).alias("section"))


def median_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority, the exact median of prices, and how many exceed 1.2 times it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    medians = exact_medians(orders, "o_orderpriority", "o_totalprice")
    above = orders.join(medians, "o_orderpriority").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 1.2 * F.col("median")).alias("n_above"), F.max("median").alias("median"))
    return above.select("o_orderpriority", F.round("median", 6).alias("median"), "n_above")


QUERIES |= {"section_carry_forward": section_carry_forward, "median_threshold": median_threshold}
ORACLES |= {
    "section_carry_forward": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events",
    "median_threshold": "WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY 1) SELECT o_orderpriority, round(max(median), 6) AS median, count(*) FILTER (o_totalprice > 1.2::DOUBLE * median) AS n_above FROM orders JOIN m USING (o_orderpriority) GROUP BY 1",
}
