"""Graphs that lie within cases: many whole cases at a time in one task, as arrays of numbers; no round writes a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Rounds

#: The rows of a case that one task takes, and the rows that are computed together.
MOST_ROWS, CHUNK_ROWS = 1_000_000, 250_000


def split_by_size(edges: DataFrame, most: int | None = None) -> DataFrame | None:
    """The cases with more than ``most`` edges, which no task should take whole; null if there are none."""
    with Rounds(edges.sparkSession) as rounds:
        large = rounds.result(edges.groupBy("case").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (MOST_ROWS if most is None else most)).select("case"))
        return None if large.isEmpty() else large


def whole_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about CHUNK_ROWS rows that end where a case does; rows come in the order of ``case``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            rows = pa.Table.from_batches(held)
            case = rows.column("case").to_numpy()
            cut = int(np.searchsorted(case, case[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held)


def by_case(rows: DataFrame, told: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``told`` of tables of whole cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cases(batches):
            yield from told(table).to_batches(max_chunksize=50_000)

    return rows.repartition("case").sortWithinPartitions("case").mapInArrow(run, schema)


def _coded(table: pa.Table, *columns: str) -> tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]:
    """Nodes of the columns as numbers: (case, place in the names, names) of each number, and the numbers of each column; -1 for null."""
    names = pa.chunked_array([c for name in columns for c in table.column(name).chunks], pa.string()).combine_chunks().dictionary_encode()
    case = np.tile(table.column("case").to_numpy(), len(columns))
    there = np.asarray(names.indices.is_valid())
    code = names.indices.fill_null(0).to_numpy()
    cases, at = np.unique(case, return_inverse=True)
    keys, number = np.unique(at[there] * max(1, len(names.dictionary)) + code[there], return_inverse=True)
    out = np.full(len(case), -1)
    out[there] = number
    size = max(1, len(names.dictionary))
    return cases[keys // size], keys % size, names.dictionary, np.split(out, len(columns))


def led_to(table: pa.Table) -> pa.Table:
    """Edges (case, a, b) and marks (case, a, word, bits): the bits of all marks that each node leads to."""
    case, name, names, (a, b) = _coded(table, "a", "b")
    word = table.column("word").to_numpy(zero_copy_only=False)
    mark = ~np.isnan(word.astype(float))
    own, bits = a[mark], table.column("bits").filter(pa.array(mark)).to_numpy().astype(np.int64)
    order = np.argsort(a[~mark], kind="stable")
    start, end = a[~mark][order], b[~mark][order]
    parts = []
    for w in np.unique(word[mark]):
        at = word[mark] == w
        got = np.zeros(len(case), np.int64)
        np.bitwise_or.at(got, own[at], bits[at])
        live = np.isin(case[start], case[own[at]]) if len(start) else np.zeros(0, bool)
        s, e = start[live], end[live]
        firsts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
        while len(s):
            more = got[s[firsts]] | np.bitwise_or.reduceat(got[e], firsts)
            if (more == got[s[firsts]]).all():
                break
            got[s[firsts]] = more
        some = np.flatnonzero(got)
        parts.append(pa.table({"case": case[some], "node": names.take(pa.array(name[some])), "word": np.full(len(some), int(w), np.int32), "bits": got[some]}))
    return pa.concat_tables(parts) if parts else pa.table({"case": case[:0], "node": pa.array([], pa.string()), "word": np.zeros(0, np.int32), "bits": np.zeros(0, np.int64)})


def peeled(table: pa.Table) -> pa.Table:
    """Edges (case, a, b): the length of the longest way to each node; null on a circle and behind one."""
    case, name, names, (a, b) = _coded(table, "a", "b")
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), int)
    a, b = pairs[:, 0], pairs[:, 1]
    waits, level, depth = np.bincount(b, minlength=len(case)), np.full(len(case), -1), 0
    now = waits == 0
    while now.any():
        level[now] = depth
        waits = waits - np.bincount(b[now[a]], minlength=len(case))
        now, depth = (waits == 0) & (level < 0), depth + 1
    return pa.table({"case": case, "node": names.take(pa.array(name)), "level": pa.array(level, pa.int64(), mask=level < 0)})


def reached(table: pa.Table) -> pa.Table:
    """Edges (case, a, b, first): (case, start, node) for every node that the beginning of a ``first`` edge leads to, itself too."""
    case, name, names, (a, b) = _coded(table, "a", "b")
    n = max(1, len(case))
    first = np.asarray(table.column("first").to_numpy(zero_copy_only=False), bool)
    order = np.argsort(a, kind="stable")
    ends, begin = b[order], np.searchsorted(a[order], np.arange(n + 1))
    new = np.unique(a[first]) * (n + 1)  # a pair is start * n + node
    seen = new
    while len(new):
        start, node = new // n, new % n
        degree = begin[node + 1] - begin[node]
        at = np.repeat(begin[node] - np.r_[0, np.cumsum(degree)[:-1]], degree) + np.arange(degree.sum())
        new = np.setdiff1d(np.repeat(start, degree) * n + ends[at], seen)
        seen = np.union1d(seen, new)
    start, node = seen // n, seen % n
    text = lambda i: names.take(pa.array(name[i]))
    return pa.table({"case": case[start], "start": text(start), "node": text(node)})
