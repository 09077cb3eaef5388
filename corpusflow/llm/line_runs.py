"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated line runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_SENT, Scratch, documents, row_keys, stage

#: Lines in a run, and characters in a line (normalised), that a repeat must have.
MIN_LINES, MIN_CHARS = 2, 8
#: A run of fewer lines is a repeat too if it has as many words, or as many characters (for scripts without spaces).
RUN_WORDS, RUN_CHARS = 50, 300


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, k1 (tells texts of one id apart), pos, line, words, chars, and a 128-bit digest h1, h2 of every line with at least ``min_chars`` normalised
    characters. ``pos`` numbers the lines kept, so that blank and short ones are no gap; ``line`` is the place in the text."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(normalised(x).alias("text"), i.alias("line")))
    kept = docs.filter("text is not null").select("doc_id", row_keys("doc_id", "text")[0], F.posexplode(F.filter(lines, lambda x: F.length(x["text"]) >= min_chars)).alias("pos", "at"))
    text = F.col("at.text")
    chars = F.length(text)
    words = chars - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return kept.select("doc_id", "k1", "pos", "at.line", words.cast("int").alias("words"), chars.alias("chars"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))


def numbered(keys: DataFrame, columns: list, scratch: Scratch, name: str = "rank") -> DataFrame:
    """Adds ``name``, which orders distinct ``keys`` as ``columns`` do: a distributed sort, no counting."""
    return scratch.stage(keys.orderBy(*columns).withColumn(name, F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Prefix doubling over the repeated lines of all documents: the tables (doc, seg, pos, rank) for prefixes of 1, 2, 4 ... lines, from
    the second on with ``parent``, the rank of the prefix of half the length; and the documents' numbers (doc, doc_id, k1). The first
    table has the columns line, words and chars too.

    A document is a text of an id: ``doc`` numbers them in the order of id (null last), then text. A line that occurs once ends every
    repeat, so documents are cut there into segments (``seg``) and only repeated lines take part.
    A round's rank orders pairs (rank of a prefix, rank of the prefix that follows it); equal ranks are equal prefixes, and the end of a
    segment sorts first. Rounds stop when none splits any rank further: the last table, tied by document and position, is the suffix
    array. Each round is a window by segment, a sum by pair, and a join; pairs are summed before they are shuffled.
    """
    counts = lines.groupBy("h1", "h2").agg(F.count("pos").alias("n")).filter("n > 1").select("h1", "h2")
    ids = numbered(counts, ["h1", "h2"], scratch)
    repeated = scratch.stage(lines.join(ids, ["h1", "h2"]).drop("h1", "h2"), "repeated-lines")
    names = numbered(repeated.select("doc_id", "k1").distinct(), [F.col("doc_id").asc_nulls_last(), "k1"], scratch, "doc")
    own = names.withColumnsRenamed({"doc_id": "_id", "k1": "_k1"})
    placed = repeated.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1"))).drop("doc_id", "k1", "_id", "_k1")
    # rows that repeat an id with its text are one document
    by_doc = W.partitionBy("doc").orderBy("pos")
    level = scratch.stage(placed.dropDuplicates(["doc", "pos"]).withColumn("seg", F.col("pos") - F.row_number().over(by_doc)), "level")
    scratch.drop(repeated)
    levels, groups, step = [level], ids.count(), 1
    while True:
        follow = F.coalesce(F.lead("rank", step).over(W.partitionBy("doc", "seg").orderBy("pos")), F.lit(-1))
        pairs = scratch.stage(level.select("doc", "seg", "pos", "rank", follow.alias("next")), "pairs")
        ranks = numbered(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).select(F.col("rank").alias("r"), F.col("next").alias("x")), ["r", "x"], scratch)
        found = ranks.count()
        if found == groups:
            scratch.drop(pairs, ranks)
            return levels, names
        named = pairs.withColumnsRenamed({"rank": "r", "next": "x"}).join(ranks, ["r", "x"])
        level = scratch.stage(named.select("doc", "seg", "pos", "rank", F.col("r").alias("parent")), "level")
        scratch.drop(pairs, ranks)
        levels.append(level)
        groups, step = found, step * 2


def longest_copies(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(doc, seg, pos, n, source_doc, source_pos): for each place whose line occurs earlier, the most lines from there that do, and
    where these occur first. Earlier is by document, then line; a copy may overlap its source.

    A place that is first among equal prefixes of 2n lines, but not of n, has its length in between. Only such places, one for each
    prefix of 2n lines, are refined: a group of equal prefixes is split by the next h lines, for h from n/2 down to 1 by the stored
    levels. The firsts of its parts go on as they are, and each part goes on h lines longer. This is the descent to the longest common
    prefix for all suffixes at once; a group's first place and length name it. Places that are equal to the end of their segments are
    tied in the last level, and copies whole. Groups are summed and joined, so none is one task.
    """
    place = F.struct("doc", "pos", "seg")
    items = None
    for k in range(len(levels) - 1):
        reps = levels[k + 1].groupBy("rank").agg(F.min(place).alias("at"), F.min("parent").alias("parent"))
        heads = reps.groupBy("parent").agg(F.min("at").alias("head"), F.count("at").alias("n")).filter("n > 1").drop("n")
        found = reps.join(heads, "parent").select("at.*", F.col("head.doc").alias("source_doc"), F.col("head.pos").alias("source_pos"), F.lit(1 << k).alias("n"))
        # each level is a job of its own: their union as one plan would be more than the driver has room for
        found = scratch.stage(found, "level-items")
        items = found if items is None else items.unionByName(found)
    group = ["source_doc", "source_pos", "n"]
    is_first = F.col("doc").eqNullSafe(F.col("source_doc")) & (F.col("pos") == F.col("source_pos"))
    for j in reversed(range(len(levels) - 2)):
        items = scratch.stage(items, "items")
        if items.filter(F.col("n") >= 2 << j).isEmpty():
            continue
        names = levels[j].select(F.col("doc").alias("_doc"), F.col("seg").alias("_seg"), F.col("pos").alias("_pos"), F.col("rank").alias("name"))
        ahead = items.filter(F.col("n") >= 2 << j).join(names, (F.col("doc") == F.col("_doc")) & (F.col("seg") == F.col("_seg")) & (F.col("pos") + F.col("n") == F.col("_pos")), "left")
        ahead = scratch.stage(ahead.select(*items.columns, F.coalesce("name", F.lit(-1)).alias("name")), "ahead")
        parts = ahead.groupBy(*group, "name").agg(F.min(F.struct("doc", "pos")).alias("head"), F.count("pos").alias("members"))
        split = ahead.join(parts, [*group, "name"])
        heads = split.filter((F.col("doc") == F.col("head.doc")) & (F.col("pos") == F.col("head.pos"))).select(*items.columns)
        longer = split.filter("members > 1").withColumns({"source_doc": F.col("head.doc"), "source_pos": F.col("head.pos"), "n": F.col("n") + (1 << j)}).select(*items.columns)
        items = items.filter(F.col("n") < 2 << j).unionByName(heads).unionByName(longer)
    last = levels[-1].select("doc", "seg", "pos", "rank")
    tied = last.groupBy("rank").agg(F.min(F.struct("doc", "pos")).alias("head"), F.count("pos").alias("members")).filter("members > 1")
    rest = (F.max("pos").over(W.partitionBy("doc", "seg")) - F.col("pos") + 1).cast("int")
    tied = last.withColumn("n", rest).join(tied, "rank").select("doc", "seg", "pos", "n", F.col("head.doc").alias("source_doc"), F.col("head.pos").alias("source_pos")).filter(~is_first)
    if items is None:
        return tied
    found = scratch.stage(items.filter(~is_first), "items")
    # the first of the tied may itself be a whole copy of lines that go on elsewhere
    older = found.select(F.col("doc").alias("_doc"), F.col("pos").alias("_pos"), F.col("n").alias("_n"), F.col("source_doc").alias("_from_doc"), F.col("source_pos").alias("_source_pos"))
    tied = tied.join(older, (F.col("source_doc") == F.col("_doc")) & (F.col("source_pos") == F.col("_pos")) & (F.col("n") == F.col("_n")), "left")
    tied = tied.withColumns({"source_doc": F.coalesce("_from_doc", "source_doc"), "source_pos": F.coalesce("_source_pos", "source_pos")})
    return found.unionByName(tied.select(found.columns))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per maximal later copy of a run: doc_id, start_line, n_lines, source_doc_id, source_line, and k1, the key of the text.

    A copy is a run that occurs earlier (least doc_id, then line) and is in no longer such run of its document, of ``min_lines`` lines
    or more, or of RUN_WORDS words or RUN_CHARS characters or more; the source is where the whole run occurs first. Lines are numbered
    from 0. Lines below ``min_chars`` normalised characters neither belong to a run nor end one; ``n_lines`` counts those between.

    Null texts have no lines. Texts that share a doc_id are documents of their own, in the order of their keys; a null doc_id comes last; rows
    that repeat an id with its text are one document. An empty table gives no rows. No task holds more than a segment of one document or, for a run that
    very many documents share, one row per task.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.stage(kept_lines(docs, min_chars), "lines")
        levels, names = suffix_ranks(lines, scratch)
        scratch.drop(lines)
        copies = scratch.stage(longest_copies(levels, scratch), "copies")
        scratch.drop(*levels[1:])
        # where a copy ends never falls from line to line, so a copy lies in a longer one if it ends no later than that of the line before
        before = W.partitionBy("doc", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        maximal = copies.withColumn("reach", F.max(F.col("pos") + F.col("n")).over(before)).filter("reach is null or reach < pos + n")
        so_far = W.partitionBy("doc", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        sized = levels[0].select("doc", "pos", "line", "words", "chars", F.sum("words").over(so_far).alias("sum_words"), F.sum("chars").over(so_far).alias("sum_chars"))
        start = sized.select("doc", "pos", F.col("line").alias("start_line"), (F.col("sum_words") - F.col("words")).alias("words"), (F.col("sum_chars") - F.col("chars")).alias("chars"))
        end = sized.select("doc", F.col("pos").alias("end_pos"), F.col("line").alias("end_line"), "sum_words", "sum_chars")
        source = levels[0].select(F.col("doc").alias("source_doc"), F.col("pos").alias("source_pos"), F.col("line").alias("source_line"))
        runs = maximal.withColumn("end_pos", F.col("pos") + F.col("n") - 1).join(start, ["doc", "pos"]).join(end, ["doc", "end_pos"])
        enough = (F.col("n") >= min_lines) | (F.col("sum_words") - F.col("words") >= RUN_WORDS) | (F.col("sum_chars") - F.col("chars") >= RUN_CHARS)
        runs = runs.filter(enough).join(source, ["source_doc", "source_pos"]).join(names, "doc")
        runs = runs.join(names.select(F.col("doc").alias("source_doc"), F.col("doc_id").alias("source_doc_id")), "source_doc")
        return stage(runs.select("doc_id", "start_line", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("n_lines"), "source_doc_id", "source_line", "k1"), "runs")


def without_runs(docs: DataFrame, runs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines of ``runs`` (a written table) and the blank ones between them; short lines between, which may differ from the source's,
    stay, as does every other column and row. A text of which no line is left is empty. Texts are not shuffled if the runs are few enough to be sent to them."""
    gone = runs.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("start_line", "n_lines")).alias("spans"))
    gone = F.broadcast(gone) if runs.count() <= MAX_SENT else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_keys("doc_id", "text")[0].alias("k"))
    told = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("k1")), "left")
    lines = F.split("row.text", "\n")
    size = lambda i: F.length(normalised(F.get(lines, i)))
    cut = F.flatten(F.transform("spans", lambda x: F.sequence(x["start_line"], (x["start_line"] + x["n_lines"] - 1).cast("int"))))
    cut = F.filter(cut, lambda i: ~size(i).between(1, min_chars - 1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return told.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op1_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(documents(spark, sf_dir)).drop("k1")


#: op1_line_runs in SQL: of each line with an earlier copy, the longest run from there that occurs earlier, and of these the maximal ones.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos - 1 AS line_no, lower(trim(regexp_replace(u.line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
  WHERE text IS NOT NULL
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, length(line) AS chars, length(line) - length(replace(line, ' ', '')) + 1 AS words
  FROM lines WHERE length(line) >= 8
), sized AS (
  SELECT *, sum(words) OVER w AS sum_words, sum(chars) OVER w AS sum_chars FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), pairs AS (
  SELECT a.doc_id, a.pos, b.doc_id AS source_doc_id, b.pos AS source_pos
  FROM kept a JOIN kept b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, source_doc_id, pos - source_pos ORDER BY pos) AS island FROM pairs
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, source_doc_id, pos - source_pos, island ORDER BY pos DESC) AS n FROM islands
), longest AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, source_doc_id, source_pos) AS k FROM runs
), copies AS (
  SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM longest WHERE k = 1
)
SELECT c.doc_id, CAST(a.line_no AS INTEGER) AS start_line, CAST(z.line_no - a.line_no + 1 AS BIGINT) AS n_lines, c.source_doc_id, CAST(s.line_no AS INTEGER) AS source_line
FROM copies c JOIN sized a ON a.doc_id = c.doc_id AND a.pos = c.pos JOIN sized z ON z.doc_id = c.doc_id AND z.pos = c.pos + c.n - 1
JOIN sized s ON s.doc_id = c.source_doc_id AND s.pos = c.source_pos
WHERE (reach IS NULL OR reach < c.pos + c.n)
  AND (c.n >= 2 OR z.sum_words - a.sum_words + a.words >= 50 OR z.sum_chars - a.sum_chars + a.chars >= 300)
"""
