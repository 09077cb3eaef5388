"""Packing by best-fit decreasing: each document into the sequence with the least room that still takes it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, running_totals, small_batches, stage
from .packing import WINDOW, tokenized_pieces

END_ID = 1


class Rooms:
    """A segment tree over the remaining rooms 0 to ``window``: which rooms open sequences have, and the tightest that is large enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int = 1) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some sequence has: up until a right neighbour holds one, then down to its leftmost."""
        at = least + self.size
        if not self.tree[at]:
            while at & 1 or not self.tree[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing of ``counts[n]`` pieces of each length n, as rows (first place, pieces a sequence, first sequence, offset there, length).

    Places number the pieces from 0, longest first. Sequences with equal room stand for each other and are kept as ranges, as pieces of equal length are: after
    a piece of length n goes into the tightest room r, the next of that length goes there too while it fits, so a range takes ``r // n`` pieces a sequence
    at once. A range taken whole has less than half of its room left, and a length splits one range at most, so there are at most some tens of rows for each of
    the ``window`` lengths, however many pieces there are.
    """
    rooms, ranges = Rooms(window), [[] for _ in range(window + 1)]

    def put(room: int, start: int, count: int) -> None:
        if count:
            ranges[room].append((start, count))
            rooms.add(room)

    out, place, opened = [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                fresh = -(-left // (window // length))
                put(window, opened, fresh)
                opened += fresh
                continue
            start, count = ranges[room].pop()
            rooms.add(room, -1)
            each = room // length
            taken = min(left, each * count)
            full, rest = divmod(taken, each)
            out.append((place, each, start, window - room, length))
            put(room - each * length, start, full)
            if rest:
                put(room - rest * length, start + full, 1)
            put(room, start + full + (rest > 0), count - full - (rest > 0))
            place, left = place + taken, left - taken
    return np.array(out, np.int64).reshape(-1, 5)


def pack_best_fit(pieces: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Adds sequence_id and offset to pieces (..., length, nth); ``nth`` tells rows apart.

    One best-fit decreasing packing of all pieces: the driver sees how many pieces each length has (``window`` counts at most) and makes the plan of ranges; pieces
    are numbered longest first by a range-partitioned sort, and each finds the sequence of its number in the plan. A length that very many
    pieces share is cut into ranges like any other.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    first, each, start, used, length = best_fit_plan(counts, window).T
    ordered = pieces.withColumns({"_short": -F.col("length"), "_one": F.lit(1)})
    numbered = running_totals(ordered, ["_short", "nth"], "_one", "place", scratch.stage).drop("_short", "_one")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("place").schema) + ", sequence_id long, offset long"

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            row = np.searchsorted(first, place, "right") - 1
            nth = place - first[row]
            others = batch.select([n for n in batch.schema.names if n != "place"])
            new = pa.array(start[row] + nth // each[row]), pa.array(used[row] + nth % each[row] * length[row])
            yield pa.RecordBatch.from_arrays([*others.columns, *new], names=[*others.schema.names, "sequence_id", "offset"])

    return numbered.mapInArrow(assign, schema)


def pack_tightly(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenizes every document and packs it best-fit decreasing: doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Documents longer than ``window`` are cut into pieces of it, the last of which may be shorter; no other is cut. Null and empty texts are the end id alone, repeated
    rows and null ids are packed each; other columns of ``docs`` are not read; an empty table gives no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    with Scratch(docs.sparkSession) as scratch:
        with small_batches(docs.sparkSession):
            pieces = scratch.stage(tokenized_pieces(docs, tokenizer, window, end_id).withColumn("nth", F.monotonically_increasing_id()), "pieces")
        packed = pack_best_fit(pieces, window, scratch)
        piece = (F.col("start") / window).cast("int").alias("piece")
        return stage(packed.select("doc_id", piece, "start", "length", "ids_crc32", "sequence_id", "offset"), "best-fit")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tightly(documents(spark, sf_dir))
