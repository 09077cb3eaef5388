"""Retrieval: BM25, multi-key ranking, confidence, neighbourhoods, and greedy packing under a byte budget."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, collapsed, raw_tokens, tokens
from ..shared import Rounds

#: BM25's parameters, and the packing's limits.
K1, B = 1.5, 0.75
MAX_BLOCKS, MAX_BYTES = 12, 16_000
NOISE_WEIGHT = 0.05


def query_terms(queries: DataFrame) -> DataFrame:
    """Adds ``term`` rows to queries (query, phrase): their distinct tokens, and how many they are."""
    terms = queries.select("query", "phrase", F.array_distinct(tokens(F.col("phrase"))).alias("terms"))
    return terms.select("query", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


#: Rows of a few words that may be broadcast (some tens of MB); more meet by a shuffle.
MAX_SENT = 300_000


def sent(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= MAX_SENT else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores, where it is read in fewer (a file of one row group): a shuffle of what is small enough to be one split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def term_counts(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) for the terms of any query, and a row with a null term for all other tokens of each document.

    Every text is tokenised once, for all queries together: the queries' vocabulary meets the tokens, which are counted where they
    lie, so what is shuffled is a row per document and term matched. The counts are a written table, as weights, lengths and scores read them in turn.
    """
    vocabulary = sent(query_terms(queries).select("term").distinct())
    flat = spread(docs.select(key, text)).select(key, F.explode_outer(raw_tokens(F.col(text))).alias("token"))
    # words that say nothing are no tokens, but a text of these alone is a document
    said = flat.withColumn("token", F.when(~F.col("token").isin(*STOPWORDS), F.col("token")))
    known = said.join(vocabulary, F.col("token") == F.col("term"), "left")
    return Rounds(docs.sparkSession).result(known.groupBy(key, "term").agg(F.count("token").alias("tf")))


def document_frequencies(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, df, idf of the queries' terms, and the average length of a document."""
    df = counts.filter("term is not null").groupBy("term").agg(F.count(key).alias("df"))
    total = counts.agg(F.count_distinct(key).alias("n"), F.sum("tf").alias("tokens"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("tokens") / F.greatest("n", F.lit(1))).alias("average"))


def bm25(counts: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query, key, score, n_matched, n_terms) of documents with any term of a query. Term weights don't depend on the query, so each
    document's terms become one row with their weights first, and meet the queries there."""
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("n_tokens"))
    known = counts.filter("term is not null").join(sent(document_frequencies(counts, key)), "term").join(lengths, key)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("average")))
    met = known.select(key, "term", weight.alias("w")).join(sent(query_terms(queries)), "term")
    return met.groupBy("query", key).agg(F.sum("w").alias("score"), F.count("term").cast("int").alias("n_matched"), F.max("n_terms").alias("n_terms"))


def rank_keys(docs: DataFrame, queries: DataFrame, noise: Column | None = None, explicit: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of each query with what they are ranked by: explicit, exact, overlap, score and coverage.

    ``noise`` marks documents (references, acknowledgements) whose score is damped and whose exact phrase and overlap don't count;
    ``explicit`` has the (query, key) pairs that a query names. Eligible is what is named, or has a score and is no noise.
    """
    scores = Rounds(docs.sparkSession).result(bm25(term_counts(docs, queries, key, text), queries, key))
    noisy = noise if noise is not None else F.lit(False)
    lines = spread(docs.select(key, F.substring_index(text, "\n", 1).alias("line"))).select(key, F.explode(F.array_distinct(tokens(F.col("line")))).alias("term"))
    overlap = lines.join(sent(query_terms(queries)), "term").groupBy("query", key).agg(F.count("term").cast("int").alias("overlap"))
    exact = holding_phrase(scores, docs, queries, key, text)
    keys = scores.join(overlap, ["query", key], "left").join(exact, ["query", key], "left")
    flags = docs.select(key, noisy.alias("noise"))
    keys = keys.join(flags.filter("noise"), key, "left").withColumn("noise", F.coalesce("noise", F.lit(False)))
    if explicit is not None:
        named = explicit.select("query", key).distinct().withColumn("explicit", F.lit(1))
        keys = keys.join(named, ["query", key], "full").fillna({"score": 0.0, "n_matched": 0, "n_terms": 1, "noise": False})
    else:
        keys = keys.withColumn("explicit", F.lit(0))
    keys = keys.fillna({"overlap": 0, "exact": 0, "explicit": 0})
    quiet = ~F.col("noise")
    keys = keys.select(
        "query", key, "explicit", F.when(quiet, F.col("exact")).otherwise(0).alias("exact"), F.when(quiet, F.col("overlap")).otherwise(0).alias("overlap"),
        (F.col("score") * F.when(quiet, 1.0).otherwise(NOISE_WEIGHT)).alias("score"), F.when(F.col("n_terms") > 0, F.col("n_matched") / F.col("n_terms")).otherwise(0.0).alias("coverage"), "noise",
    )
    return keys.filter((F.col("explicit") == 1) | ((F.col("score") > 0) & ~F.col("noise")))


def holding_phrase(scores: DataFrame, docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, key, exact = 1) where a scored document holds the query's phrase.

    Within a phrase all terms but the first and the last stand alone, so a document that holds it matches all but two of them at least. Only such pairs are looked at:
    the texts that have any meet their phrases, and each pair is one search.
    """
    likely = Rounds(docs.sparkSession).result(scores.filter("n_matched >= n_terms - 2").select("query", key))
    wanted = likely.join(sent(queries.select("query", collapsed(F.col("phrase")).alias("wanted"))), "query")
    wanted = Rounds(docs.sparkSession).result(wanted.groupBy(key).agg(F.collect_list(F.struct("query", "wanted")).alias("phrases")) if likely.count() <= MAX_SENT else wanted.select(key, F.array(F.struct("query", "wanted")).alias("phrases")))
    whole = spread(docs.select(key, text)).join(sent(wanted), key).select(key, collapsed(F.col(text)).alias("whole"), "phrases")
    return whole.select(key, "whole", F.explode("phrases").alias("p")).filter(F.contains("whole", F.col("p.wanted"))).select("p.query", key, F.lit(1).alias("exact"))


def ranked(keys: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query by the keys in order, the smaller key first among equals. Tasks keep their own best before the shuffle."""
    order = [F.desc("explicit"), F.desc("exact"), F.desc("overlap"), F.desc(F.round("score", 9)), F.asc(key)]
    return keys.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def confidence(explicit: Column, unresolved: Column, exact: Column, positive: Column, top_coverage: Column, tied: Column) -> Column:
    return (
        F.when(unresolved > 0, "LOW")
        .when(explicit > 0, "HIGH")
        .when((positive == 0) | (top_coverage == 0), "LOW")
        .when((exact == 1) | ((top_coverage == 1) & ~tied), "HIGH")
        .otherwise("AMBIGUOUS")
    )


def downgraded(confidence: Column, missing: Column, limited: Column) -> Column:
    """The class in the end: LOW where something needed is missing, and no HIGH where the budget kept evidence out."""
    return F.when(missing, "LOW").when((confidence == "HIGH") & limited, "AMBIGUOUS").otherwise(confidence)


def neighbours(df: DataFrame, section: str, order: str) -> DataFrame:
    """Each row's neighbours one position before and after in its section, as an equi-join on positions."""
    near = df.select(section, F.col(order).alias("near"), F.explode(F.array(F.col(order) - 1, F.col(order) + 1)).alias(order))
    return near.join(df.select(section, order), [section, order]).select(section, order, "near")


#: Rows of a group, about, that one task looks through at a time.
PER_PART = 20_000


def possible_blocks(df: DataFrame, group: str, rank: str, size: str, most: int = MAX_BLOCKS, limit: int = MAX_BYTES) -> DataFrame:
    """Rows that greedy packing could take: those that fewer than ``most`` earlier rows of their group equal or undercut in size.
    Groups are counted, and cut into hashed parts of about PER_PART rows; a group's few survivors of these (about most * ln n a part) are cut and
    looked through again, so that no task sees a large group whole."""
    schema = df.select(group, rank, size).schema

    def survivors(frame):
        frame, least, keep = frame.sort_values(rank, kind="stable"), [], []
        for s in frame[size].tolist():
            keep.append(len(least) < most or s < least[-1])
            if keep[-1]:
                bisect.insort(least, s)
                del least[most:]
        return frame[keep][[group, rank, size]]

    some = df.select(group, rank, size).filter(F.col(size) <= limit)
    counts = some.groupBy(group).agg(F.count(rank).alias("_n"))
    parts = some.join(counts, group).withColumn("_part", F.pmod(F.xxhash64(rank), F.ceil(F.col("_n") / PER_PART)))
    some = parts.groupBy(group, "_part").applyInPandas(survivors, schema)
    # what is left of a part of PER_PART rows is hundreds of times less
    again = some.join(counts, group).withColumn("_part", F.pmod(F.xxhash64(rank), F.ceil(F.col("_n") / (PER_PART * 100))))
    return again.groupBy(group, "_part").applyInPandas(survivors, schema).groupBy(group).applyInPandas(survivors, schema)


def pack_greedily(df: DataFrame, group: str, rank: str, size: str, most: int = MAX_BLOCKS, limit: int = MAX_BYTES) -> DataFrame:
    """Rows taken in rank order while they fit; one that doesn't is skipped, and later, smaller ones may still enter."""
    rows = possible_blocks(df, group, rank, size, most, limit).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(size).cast("long").alias("s")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["s"] <= limit) & (F.size(a["kept"]) < most)
        return F.struct(F.when(fits, a["used"] + x["s"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(x["r"].cast("long")))).otherwise(a["kept"]).alias("kept"))

    return rows.select(group, F.posexplode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("place", rank))


def exact_medians(df: DataFrame, key: str, value: str, accuracy: int = 1000) -> DataFrame:
    """(key, median) of non-null values, exactly, without a buffer of a key's values: two approximate quantiles, whose error is bounded, hold the median between
    them; rows below are counted, and only the few between are ordered."""
    rows = df.select(key, value).filter(F.col(value).isNotNull())
    margin = 2.0 / accuracy
    bounds = rows.groupBy(key).agg(F.percentile_approx(value, [0.5 - margin, 0.5 + margin], accuracy).alias("_b"), F.count(value).alias("_n"))
    told = rows.join(bounds, key)
    # a value at the very edge is ordered too, and of few values all are
    low, high = F.when(F.col("_n") > 4 * accuracy, F.col("_b")[0]), F.when(F.col("_n") > 4 * accuracy, F.col("_b")[1])
    below = told.groupBy(key).agg(F.count_if(F.col(value) < low).alias("_below"))
    inside = told.filter((low.isNull() | (F.col(value) >= low)) & (high.isNull() | (F.col(value) <= high))).join(below, key)
    rank = F.row_number().over(W.partitionBy(key).orderBy(value)) + F.col("_below")
    middle = inside.withColumn("_rank", rank).filter((F.col("_rank") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_rank") == F.floor(F.col("_n") / 2) + 1))
    return middle.groupBy(key).agg(F.avg(value).alias("median"))
