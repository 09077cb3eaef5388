"""Substring dedup: sentences, lines and paragraphs, and runs of short ones, are hashed, the earliest of equal ones stays, the others go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_SENT, Scratch, documents, row_keys, stage

#: Where units end; a unit keeps its closing mark.
ENDS = {"sentence": re.compile(r"[.!?][\x20\t]+|\n+"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\t]*\n+")}
#: Units with fewer words, or shorter when normalised, are too common to call a repeat: texts that nothing was copied into share many.
MIN_WORDS, MIN_CHARS = 15, 24
#: What the query takes: a repeat of any of these goes. Many texts are one line, in which only sentences show what was copied.
ALL = ("paragraph", "line", "sentence")
#: Words from which sentences in a row are a unit together, and from which one word said again and again is. A passage of over 50 words holds either, or a unit of its own.
RUN_WORDS, SAME_WORDS = 25, 40
UNITS = "doc_id long, k1 long, start long, end long, h1 long, h2 long"


def units_of(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in ends.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def sentence_runs(text: str, words: int) -> Iterator[tuple[int, int]]:
    """From each sentence the fewest in a row, two or more, that have so many words."""
    spans = list(units_of(text, ENDS["sentence"]))
    sizes = [len(text[s:e].split()) for s, e in spans]
    to, held = 0, 0
    for k, (s, _) in enumerate(spans):
        while to < len(spans) and held < words:
            held, to = held + sizes[to], to + 1
        if held < words:
            return
        if to > k + 1 and sizes[k]:
            yield s, spans[to - 1][1]
        held -= sizes[k]


def hashed_units(docs: DataFrame, kinds: tuple[str, ...], min_words: int, min_chars: int, run_words: int = 0, same_words: int = 0) -> DataFrame:
    """Start, end (code points of the original text) and 128-bit digest of each unit long enough, normalised to lower case words
    with single spaces. Units of several kinds that have the same words at one place are one. Of equal units in one document only the first comes with its own row; later ones come with ``end`` negated.
    Runs of sentences of ``run_words`` words and of one word ``same_words`` times are told too, however often they stand in a document; the latter are equal whatever their length."""
    same = re.compile(rf"(?<!\S)(\S+)(?:\s+\1(?!\S)){{{max(1, same_words - 1)},}}")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, keys, starts, stops, digests = [], [], [], [], []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, found, first, runs = text.as_py() or "", {}, {}, {}
                for s, e in {x for kind in kinds for x in units_of(text, ENDS[kind])}:
                    if e - s < min_chars:
                        continue
                    words = (piece := text[s:e]).lower().split()
                    if len(words) < min_words or len(norm := " ".join(words)) < min_chars:
                        continue
                    # blanks before the first word are no difference of place
                    place, digest = e - len(piece.lstrip()), xxh3_128_digest(norm)
                    old = found.get((place, digest), (s, e))
                    found[place, digest] = min(s, old[0]), max(e, old[1])
                for s, e in sentence_runs(text, run_words) if run_words else ():
                    words = (piece := text[s:e]).lower().split()
                    if len(norm := " ".join(words)) >= min_chars:
                        runs[e - len(piece.lstrip()), xxh3_128_digest(norm)] = s, e
                for m in same.finditer(text) if same_words else ():
                    # no unit starts with a blank
                    runs[m.start(), xxh3_128_digest(" " + m[1].lower())] = m.span()
                told = [(*at, *span, first.setdefault(at[1], at[0]) == at[0]) for at, span in sorted(found.items())]
                for _, digest, s, e, leads in [*told, *((*at, *span, True) for at, span in runs.items() if at not in found)]:
                    ids.append(doc_id)
                    keys.append(key)
                    starts.append(s)
                    stops.append(e if leads else -e)
                    digests.append(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "start", "end", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), row_keys("doc_id", "text")[0], "text").mapInArrow(scan, UNITS)


def repeated_units(docs: DataFrame, unit: str | tuple[str, ...] = "sentence", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, run_words: int = 0, same_words: int = 0) -> DataFrame:
    """One row per unit to remove: doc_id, start, end, kept_doc_id, the id of the first document that holds the unit, and k1, the key of the text.
    With several kinds of ``unit`` rows may nest, and with runs overlap: what goes is their union. Runs go only where another document keeps them.

    Offsets are code points of the original text, end exclusive. The first document is that of the least id, null last, then of the least text key.
    Digests are summed before they are shuffled, so a unit that a third of all documents hold costs a row per task there; only digests of several documents meet the units again, by a join that Spark
    may split where a digest is frequent. Null and empty texts have no units; texts that share an id are documents of their own, and rows that repeat an id with
    its text are one, so no text loses a unit that another row does not keep. Other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = hashed_units(docs, (unit,) if isinstance(unit, str) else unit, min_words, min_chars, run_words, same_words)
        units = scratch.stage(found.withColumn("doc", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1")).drop("doc_id", "k1"), "units")
        keepers = units.groupBy("h1", "h2").agg(F.min("doc").alias("kept"), F.max("doc").alias("last"))
        shared = keepers.filter(~F.col("last").eqNullSafe(F.col("kept"))).drop("last")
        across = units.filter("end > 0").join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("kept")))
        # later copies within one document go too, whoever keeps the first
        within = units.filter("end < 0").join(shared, ["h1", "h2"], "left").withColumn("kept", F.coalesce("kept", "doc"))
        out = across.unionByName(within).select("doc.doc_id", "start", F.abs("end").alias("end"), F.col("kept.doc_id").alias("kept_doc_id"), "doc.k1")
        return stage(out, "repeated-units")


def without_units(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed units (a written table) cut from ``text``; every other column and row stays."""
    spans = removed.distinct().groupBy("doc_id", "k1").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = F.broadcast(spans) if removed.count() <= MAX_SENT else spans

    def rest(text, spans):
        pieces = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")),
            lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))).alias("kept")),
        )
        return F.concat(pieces["kept"], F.substring(text, (pieces["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_keys("doc_id", "text")[0].alias("k"))
    told = rows.join(spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("k1")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(rest(F.col("row.text"), F.col("spans")))
    return told.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(documents(spark, sf_dir), ALL, run_words=RUN_WORDS, same_words=SAME_WORDS).drop("k1")
