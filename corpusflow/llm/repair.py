"""Conversation structure repair: the cheapest edits by min-plus products over runs of equal rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What has been written: nothing, a system row, a user row, an assistant row. The first and the last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The user or assistant row that may come next, as the state it leads to.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INF = 1 << 60
#: Rows of a range that one task takes through the states.
PER_RANGE = 20_000
WHITE = " \t\n\x0b\x0c\r"
Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(INF, min(a[p][r] + b[r][q] for r in STATES)) for q in STATES) for p in STATES)


def before(a: Matrix, costs: Costs) -> Costs:
    """Costs to go before a transition, of those after it."""
    return tuple(min(INF, min(a[p][q] + costs[q] for q in STATES)) for p in STATES)


def _inserts() -> Matrix:
    """The cheapest insertions from state to state, any number of them."""
    out = []
    for p in STATES:
        row, at, cost = [INF] * 4, p, 0
        while row[at] == INF:
            row[at] = cost
            at, cost = NEXT[at], cost + INSERT
        out.append(tuple(row))
    return tuple(out)


UNIT: Matrix = tuple(tuple(0 if p == q else INF for q in STATES) for p in STATES)
INSERTS = _inserts()
#: Costs to go where no row is left.
LAST = before(INSERTS, tuple(0 if p in ENDS else INF for p in STATES))

#: A row's symbol is "-" if it must go, else its role's initial (s, u, a, or x for any other), in upper case if it is truncated.
GONE = "-"


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of a row in a state; inserts aside."""
    out = [("D", state, DELETE)]
    if symbol != GONE:
        more, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        kept = SYSTEM if initial == "s" and state == NOTHING else NEXT[state] if initial == {USER: "u", ASSISTANT: "a"}[NEXT[state]] else None
        if kept is not None:
            out.append(("K", kept, KEEP + more))
        out.append(("R", NEXT[state], REROLE + more))
    return out


@lru_cache(maxsize=4096)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2**k equal rows, inserts before each of them among it."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    step = [[INF] * 4 for _ in STATES]
    for p in STATES:
        for _, q, cost in choices(symbol, p):
            step[p][q] = min(step[p][q], cost)
    return times(INSERTS, tuple(map(tuple, step)))


def run_before(symbol: str, n: int, costs: Costs) -> Costs:
    """Costs to go before n equal rows, by the binary powers in n."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = before(power(symbol, k), costs)
    return costs


def run_matrix(runs: Iterable[tuple[str, int]]) -> Matrix:
    out = UNIT
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, power(symbol, k))
    return out


def collapse(symbols: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Neighbouring equal symbols as one run."""
    return [(s, sum(n for _, n in own)) for s, own in groupby(symbols, key=lambda x: x[0])]


def unroll(runs: list[tuple[str, int]], state: int, after: Costs) -> tuple[str, int, int]:
    """The least of the cheapest edit strings from ``state``, the state it ends in, and its cost to go; ``after``: costs to go after the runs."""
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(run_before(symbol, n, ends[-1]))
    ends.reverse()
    cost, out = ends[0][state], []
    for (symbol, n), end in zip(runs, ends[1:], strict=True):
        if symbol == GONE:  # deletions come before insertions in the order of letters, and nothing else is left to choose
            out.append("D" * n)
            continue
        inside = [end]
        for _ in range(n):
            inside.append(before(power(symbol, 0), inside[-1]))
        for i in range(n):
            now, then = inside[n - i], inside[n - i - 1]
            while True:
                options = [(letter, q, c) for letter, q, c in choices(symbol, state) if c + then[q] == now[state]]
                if INSERT + now[NEXT[state]] == now[state]:
                    options.append(("I", NEXT[state], INSERT))
                letter, state, _ = min(options)
                out.append(letter)
                if letter != "I":
                    break
    return "".join(out), state, cost


def final_inserts(state: int) -> str:
    n = 0
    while state not in ENDS:
        state, n = NEXT[state], n + 1
    return "I" * n


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` picks: a row dropped, emptied, without its sentence ends, doubled, or the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))), F.lit(20))
    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), way.alias("way")).filter("way != 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("way") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("way", "copy")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds what puts a conversation's rows in order without their texts: the conversation as a string, the first 32 characters of role and text, and
    128 bits of both."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    bits = {f"k{salt}": F.xxhash64(F.lit(salt), conv, "role", "text") for salt in (1, 2)}
    return rows.withColumns({"conv": conv, "p_role": F.left("role", F.lit(32)), "p_text": F.left("text", F.lit(32)), **bits})


#: The order of a conversation's rows, nulls first.
ORDER = ["turn", "p_role", "p_text", "k1", "k2"]


def symbols(rows: DataFrame) -> DataFrame:
    """One light row per different row of ``keyed`` rows: conv, the columns of ORDER, its first fault, its initial, and how often it is there.

    Rows equal in everything are neighbours, so they are counted before any shuffle; a row seen earlier is one whose turn isn't the first of its role and text.
    """
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.left("role", F.lit(1))
    own = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    light = rows.select("conv", *ORDER, own.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
    light = light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = light.groupBy("k1", "k2").agg(F.min(turn).alias("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(~F.col("first").eqNullSafe(turn), "duplicate").otherwise(F.col("fault"))
    return light.join(firsts, ["k1", "k2"]).withColumn("fault", fault).drop("first")


def segment_rows(frame: pd.DataFrame) -> list[tuple[str, list[tuple[str, int]], int, str, str]]:
    """Of a range's rows in order: conversation, runs, illegal neighbours within, first and last initial."""
    out, legal = [], {"su", "ua", "au"}
    columns = [frame[c].tolist() for c in ("conv", "fault", "initial", "n")]
    for conv, own in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
        line, illegal, first, last = [], 0, "", ""
        for _, fault, initial, n in own:
            illegal += (n - 1) + bool(last and last + initial not in legal)
            first, last = first or initial, initial
            if fault in ("blank", "duplicate"):
                line.append((GONE, n))
            else:  # what repeats a row at once is a duplicate of it
                line += [(initial.upper() if fault == "truncated" else initial, 1), *([(GONE, n - 1)] if n > 1 else [])]
        out.append((conv, collapse(line), illegal, first, last))
    return out


PIECE = "conv string, range int, entry int, leaves int, piece string, cost long, illegal long, first string, last string"


def _runs_text(runs: list[tuple[str, int]]) -> str:
    return " ".join(f"{s}{n}" for s, n in runs)


def _runs_of(text: str) -> list[tuple[str, int]]:
    return [(x[0], int(x[1:])) for x in text.split()]


def audits(light: DataFrame, scratch: Scratch, per_range: int = PER_RANGE) -> DataFrame:
    """Pieces of the audit (PIECE): a conversation's in the order of ``range``, of which that whose entry is the state reached counts.

    Rows are ranged by conversation and order, so a long conversation is many ranges, whose transitions multiply. A conversation that lies within one range is unrolled
    there. Of one at a range's edge a task gives the runs and their transition; costs to go are handed from range to range, a few
    numbers each; then each range is unrolled from every state that may enter it.
    """
    ranges = max(1, -(-light.count() // per_range))
    ranged = light.repartitionByRange(ranges, F.asc_nulls_first("conv"), *[F.asc_nulls_first(c) for c in ORDER]).withColumn("range", F.spark_partition_id())
    ranged = scratch.stage(ranged, "ranged")
    place = F.row_number().over(W.partitionBy("range").orderBy("conv", *[F.asc_nulls_first(c) for c in ORDER]))
    placed = ranged.select("range", place.alias("place"), "conv", "fault", "initial", "n")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        found = segment_rows(frame.sort_values("place"))
        rows = []
        for i, (conv, runs, illegal, first, last) in enumerate(found):
            edge = i in (0, len(found) - 1)
            piece, leaves, cost = (None, None, None) if edge else unroll(runs, NOTHING, LAST)
            rows.append((conv, int(frame["range"].iloc[0]), NOTHING, leaves, piece, cost, illegal, first, last, _runs_text(runs) if edge else None, [c for r in run_matrix(runs) for c in r] if edge else None))
        return _frame(rows, f"{PIECE}, runs string, matrix array<long>")

    walked = scratch.stage(placed.groupBy("range").applyInPandas(walk, f"{PIECE}, runs string, matrix array<long>"), "walked")

    def hand_on(frame: pd.DataFrame) -> pd.DataFrame:
        rows, costs = [], LAST
        for conv, at, matrix in frame.sort_values("range", ascending=False)[["conv", "range", "matrix"]].itertuples(index=False):
            rows.append((conv, int(at), list(costs)))
            costs = before(tuple(tuple(int(c) for c in matrix[4 * p : 4 * p + 4]) for p in STATES), costs)
        return _frame(rows, "conv string, range int, after array<long>")

    edges = walked.filter("runs is not null")
    after = edges.select("conv", "range", "matrix").groupBy("conv").applyInPandas(hand_on, "conv string, range int, after array<long>")

    def from_each_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                runs = _runs_of(r.runs)
                for state in STATES:
                    piece, leaves, cost = unroll(runs, state, tuple(int(c) for c in r.after))
                    rows.append((r.conv, r.range, state, leaves, piece, cost, r.illegal, r.first, r.last))
            yield _frame(rows, PIECE)

    opened = edges.drop("matrix").join(after, ["conv", "range"]).mapInPandas(from_each_state, PIECE)
    return walked.filter("runs is null").drop("runs", "matrix").unionByName(opened)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    dtype = {"int": "Int32", "long": "Int64"}
    return pd.DataFrame({n: pd.Series(list(c), dtype=dtype.get(t, object)) for (n, t), c in zip(fields, columns, strict=True)})


class Writer:
    """Follows one conversation: its pieces, then its rows in order, each of which takes its letters from the audit."""

    def __init__(self, conv: str):
        self.conv, self.pieces, self.audit, self.state, self.illegal, self.cost, self.last = conv, [], None, NOTHING, 0, None, ""
        self.at, self.written, self.count, self.hash = 0, NOTHING, 0, hashlib.sha256()

    def piece(self, entry: int, leaves: int, piece: str, cost: int, illegal: int, first: str, last: str, at: int) -> None:
        if self.pieces and at == self.place or entry != self.state:
            return  # of another entry
        self.cost = cost if self.cost is None else self.cost
        self.illegal += illegal + bool(self.last and self.last + first not in ("su", "ua", "au"))
        self.last, self.state, self.place = last, leaves, at
        self.pieces.append(piece)

    def _write(self, line: str) -> None:
        self.hash.update((("\n" if self.count else "") + line).encode())
        self.count += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.written = self.at + 1, NEXT[self.written]
            self._write(f"{ROLE[self.written]}:")

    def row(self, role: str, text: str) -> None:
        if self.audit is None:
            self.audit = "".join(self.pieces) + final_inserts(self.state)
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.written = SYSTEM if role[0] == "s" else NEXT[self.written]
            self._write(f"{role}:{text}")
        elif letter == "R":
            self.written = NEXT[self.written]
            self._write(f"{ROLE[self.written]}:{text}")

    def result(self) -> tuple[str, int, int, str, str]:
        self._inserted()
        return self.conv, self.illegal, self.cost, self.audit, self.hash.hexdigest()


WRITTEN = "conv string, illegal long, cost long, audit string, repaired_sha256 string"


def write_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations from sorted pieces and rows; one text and one audit are held at a time."""
    now = None
    for frame in batches:
        done = []
        for r in frame.itertuples(index=False):
            if now is None or now.conv != r.conv:
                if now:
                    done.append(now.result())
                now = Writer(r.conv)
            if r.role is None:
                now.piece(int(r.entry), int(r.leaves), r.piece, int(r.cost), int(r.illegal), r.first, r.last, int(r.range))
            else:
                now.row(r.role, r.text)
        yield _frame(done, WRITTEN)
    if now:
        yield _frame([now.result()], WRITTEN)


def repair_conversations(rows: DataFrame, every: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Per conv_id of ``every``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its ``rows`` (conv_id, turn, role, text, no null role or text).

    Rows stand in the order of turn (null first), then role and text (by their first 32 characters, then by a digest); repeated rows are rows. A role whose initial
    is not s, u or a (none at all included) can't be kept. Null conv_ids are one conversation. Those without rows have zeros, an empty audit
    and the hash of nothing; an empty table gives none. Other columns are not read.

    The faults and the edits are found without texts, ranges of a long conversation in parallel. Texts are shuffled once, to where a conversation's repaired
    text is hashed row by row: that hash is of one string, so one task makes it, however long the conversation is, but it holds one row's text and the audit only.
    """
    with Scratch(rows.sparkSession) as scratch:
        light = scratch.stage(symbols(keyed(rows)), "symbols")
        count = lambda fault, first: F.sum(F.when(F.col("fault") == fault, F.col("n") if first is None else first).otherwise(F.lit(0)))
        # of rows equal in everything the first may be anything, and those after it are duplicates unless blank
        again = F.sum(F.when(F.col("fault").eqNullSafe("duplicate"), F.col("n")).when(F.col("fault").eqNullSafe("blank"), 0).otherwise(F.col("n") - 1))
        faults = light.groupBy("conv").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), count("blank", None).alias("blank"), again.alias("duplicate"), count("truncated", F.lit(1)).alias("truncated")
        )
        pieces = audits(light, scratch, per_range)
        nothing = lambda names: {n: F.lit(None).cast(t) for n, t in names.items()}
        lines = keyed(rows).select("conv", *ORDER, "role", "text").withColumns(nothing({x.split()[0]: x.split()[1] for x in PIECE.split(", ")[1:]}))
        both = lines.unionByName(pieces, allowMissingColumns=True).repartition("conv")
        order = [F.col("conv"), F.col("role").isNotNull(), F.col("range"), *[F.asc_nulls_first(c) for c in ORDER]]
        both = both.sortWithinPartitions(*order).select("conv", "role", "text", *[x.split()[0] for x in PIECE.split(", ")[1:]])
        told = both.mapInPandas(write_out, WRITTEN).join(faults, "conv")
        conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
        out = every.select("conv_id").distinct().withColumn("conv", conv).join(told, "conv", "left")
        numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        empty = hashlib.sha256().hexdigest()
        return stage(out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), "repaired")


def op13_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(conversations), conversations)
