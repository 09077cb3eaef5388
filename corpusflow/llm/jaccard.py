"""N-gram Jaccard join: universe partitions and the pigeonhole principle, one-deletion neighbourhoods, exact verification."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, ascii_lower, documents, mix, row_keys, segment_hashes, sent, small_batches, stage, text_buffers, word_bounds
from .graph import components

_U = np.uint64
#: Counters in a set's histogram of shingles, whose differences bound how far two sets differ; four times as many for each step in size.
CELLS, CELL_STEPS = 64, (512, 2048, 8192, 32768, 131072)
#: Pairs across classes that a list may cost for each of its members; one that costs more is left to one-deletion neighbourhoods.
DIRECT = 24
#: Lists of a set that its rows carry, so that a pair that meets in one of them isn't made again.
FIRSTS = 16
MAX_SEEDS = 64
#: Counters of fine segments by hash, and the pieces in which tasks hand them on.
COUNTERS, PIECES = 1 << 20, 256


class Plan:
    """Sizes fall into bands; a band's sets are hashed into segments, of which each posts the first few.

    With Jaccard similarity of at least num / den, sets of n and n' >= n shingles differ in at most ``most(n)`` of them. A set posts its
    segments in order until ``most(n)`` + 1 of them aren't empty; of any two similar sets, the one that stops first has a segment among
    these that both agree on. With one-deletion neighbourhoods a segment may differ in one shingle, so that half as many, larger
    ones do: they cost a signature for each shingle. A set that has too few segments to post is hashed again, under the next seed, besides.
    The allocation is by cost: of fine segments each set posts the cheapest; and deletions where their lists cost too many pairs still.
    """

    #: Sizes in a band differ by this factor. A set near the upper end posts in the next band too.
    RATIO = 4

    def __init__(self, num: int, den: int):
        if 10 * num < 7 * den:
            raise ValueError("similarities below 0.7 are not meant here")
        g = math.gcd(num, den)
        self.num, self.den = num // g, den // g

    def most(self, n):
        return ((self.den - self.num) * (n + n * self.den // self.num)) // (self.den + self.num)

    def need(self, n, deletions: bool):
        return (self.most(n) // 2 if deletions else self.most(n)) + 1

    def signatures(self, rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, deletions: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, signature) of all sets; ``rows`` is sorted and says whose shingle each hash is, ``sizes`` has the sets' sizes."""
        parts = [(r, s) for r, s, _ in self.groups(rows, hashes, sizes, deletions)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in ((0, np.int64), (1, np.uint64)))

    def groups(self, rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, deletions: bool = False, fine: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of (row, signature) by band and seed, with how many of a group each set needs, by row.

        With ``fine`` segments are smaller and more, and a set's group has all of them that aren't empty. It needs to post the ``most(n)`` + 1 that are
        rarest by any one order of all signatures: of the segments that two similar sets agree on, more than the others that either leaves
        out, the rarest is posted by both (empty segments are the least rare).
        """
        edges = self.RATIO ** np.arange(1, 31, dtype=np.int64)
        own, reach = np.searchsorted(edges, sizes, "right"), np.searchsorted(edges, sizes * self.den // self.num, "right")
        need = self.need(sizes, deletions)
        for shift in (0, 1):
            bands = own + shift
            todo = np.flatnonzero((sizes > 0) & (reach >= bands))
            most_needed = self.need(edges[bands] - 1, deletions)
            segments = most_needed + most_needed // 10 + 2
            if fine:
                segments = np.maximum(segments, edges[bands] * 2 // 5)
            for seed in range(MAX_SEEDS):
                if not len(todo):
                    break
                chosen = np.zeros(len(sizes), bool)
                chosen[todo] = True
                at = np.flatnonzero(chosen[rows])
                r, h = rows[at], hashes[at]
                count = np.where(chosen, segments, 0)
                base = np.cumsum(count) - count
                place = base[r] + (mix(h + _U(0x51ED27 + seed)) % segments[r].astype(np.uint64)).astype(np.int64)
                h = mix(h ^ _U(0xA5A5A5A5))
                total = int(count.sum())
                members, owner = np.bincount(place, minlength=total), np.repeat(np.arange(len(sizes)), count)
                filled = members > 0
                if deletions:
                    # one shingle against none differs in one, and has no signature for it; equal sets have no such segments
                    filled &= (members > 1) | (self.most(sizes)[owner] == 0)
                so_far = np.concatenate(([0], np.cumsum(filled)))
                so_far = so_far[:-1] - so_far[base[owner]]
                posted = np.ones(total, bool) if fine else so_far < need[owner]
                sums = exact_sums(place, h, total)
                name = mix((np.arange(total) - base[owner]).astype(np.uint64) + _U(1) + (bands[owner].astype(np.uint64) << _U(40)) + (_U(seed + MAX_SEEDS * fine) << _U(56)))
                whole = posted & (members > 0)
                yield owner[whole], mix(sums[whole] ^ name[whole]), need
                if deletions:
                    several = (posted & (members > 1))[place]
                    yield r[several], mix((sums[place] - h)[several] ^ name[place][several]), need
                reached = np.bincount(owner[filled & posted], minlength=len(sizes))
                todo = todo[reached[todo] < need[todo]]
            if len(todo):
                raise RuntimeError("no seed fills the segments of a set")


def exact_sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by place, modulo 2**64. Halves are summed as doubles, exact for up to 2**21 values at a time."""
    out = np.zeros(n, np.uint64)
    for at in range(0, len(values), 1 << 21):
        p, v = place[at : at + (1 << 21)], values[at : at + (1 << 21)]
        low, high = (np.bincount(p, x.astype(np.float64), n).astype(np.uint64) for x in (v & _U(0xFFFFFFFF), v >> _U(32)))
        out += low + (high << _U(32))
    return out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by both. Fewer words than ``words`` are one shingle."""
    low = ascii_lower(buf)
    starts, ends, rows = word_bounds(low, offsets)
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = segment_hashes(low, starts, ends)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    acc, factor = np.zeros(n, np.uint64), 1
    length = np.minimum(counts, words)[rows]
    for j in range(words):
        shifted = np.concatenate((h[j:], np.zeros(min(j, n), np.uint64)))
        acc = acc + np.where(j < length, mix(shifted) * _U(factor), _U(0))
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    acc = mix(acc + length.astype(np.uint64))
    whole = np.arange(n) - first[rows] <= counts[rows] - length
    rows, acc = rows[whole], acc[whole]
    order = np.lexsort((acc, rows))
    rows, acc = rows[order], acc[order]
    fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (acc[1:] != acc[:-1])))
    return rows[fresh], acc[fresh]


def lists(rows: np.ndarray, values: np.ndarray, n: int):
    """An Arrow array of lists, one for each of n rows."""
    import pyarrow as pa

    if len(rows) and (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def segment_counts(texts: DataFrame, words: int, plan: Plan) -> np.ndarray:
    """How often the fine segments of ``texts`` fall on each of COUNTERS counters. A task counts what it reads and hands on its counters in pieces, which are summed piece by piece, so what is
    shuffled is a fixed size a task, and what the driver gets doesn't grow."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, buf, offsets in text_buffers(batch.column(0)):
                rows, h = shingle_sets(buf, offsets, words)
                for _, s, _ in plan.groups(rows, h, np.bincount(rows, minlength=len(offsets) - 1), fine=True):
                    counts += np.bincount((s % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        pieces = [zlib.compress(x.astype("<i4").tobytes(), 1) for x in np.minimum(counts, 2**31 - 1).reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "counts"])

    def summed(key, frame):
        total = np.zeros(COUNTERS // PIECES, np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<i4")
        return pd.DataFrame({"piece": [key[0]], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    found = texts.select("text").mapInArrow(scan, "piece int, counts binary").groupBy("piece").applyInPandas(summed, "piece int, counts binary").collect()
    out = np.zeros((PIECES, COUNTERS // PIECES), np.int32)
    for r in found:
        out[r["piece"]] = np.frombuffer(r["counts"], "<i4")
    return out.reshape(-1)


def first_of_each(rows: np.ndarray, signatures: np.ndarray, need: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``need[row]`` signatures of each row that come first by their counter, then by themselves: one order for all sets."""
    order = np.lexsort((signatures, often[(signatures % _U(COUNTERS)).astype(np.int64)], rows))
    rows, signatures = rows[order], signatures[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < need[rows]], signatures[nth < need[rows]]


def sketched(texts: DataFrame, words: int, plan: Plan, kind: str, often: np.ndarray | None = None) -> DataFrame:
    """``texts`` with the columns that ``kind`` says in place of ``text``: n, d1, d2 (digest of the set), cells, and as signatures the rarest fine
    segments by ``often`` that each group of them needs to post ("whole"); or d1, d2 and as items the signatures of one-deletion neighbourhoods
    ("deletions") or the set itself ("sets")."""
    kept = [f for f in texts.schema if f.name != "text"]
    made = "d1 long, d2 long, " + ("n long, cells array<short>, signatures array<long>" if kind == "whole" else "items array<long>")
    schema = StructType([*kept, *StructType.fromDDL(made)])
    text_at = texts.columns.index("text")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first, buf, offsets in text_buffers(batch.column(text_at)):
                m = len(offsets) - 1
                rows, h = shingle_sets(buf, offsets, words)
                sizes = np.bincount(rows, minlength=m)
                columns = [batch.column(k).slice(first, m) for k in range(batch.num_columns) if k != text_at]
                columns += [pa.array(exact_sums(rows, mix(h ^ _U(k)), m).view(np.int64)) for k in (0x1234567, 0x89ABCDE)]
                if kind == "sets":
                    columns.append(lists(rows, h.view(np.int64), m))
                elif kind == "deletions":
                    r, s = plan.signatures(rows, h, sizes, True)
                    columns.append(lists(r, s.view(np.int64), m))
                else:
                    width = CELLS * 4 ** np.searchsorted(CELL_STEPS, sizes, "right")
                    base = np.concatenate(([0], np.cumsum(width)))
                    cells = np.bincount(base[rows] + (h % width[rows].astype(np.uint64)).astype(np.int64), minlength=base[-1])
                    columns += [pa.array(sizes), pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(np.minimum(cells, 32767).astype(np.int16)))]
                    posted = [first_of_each(*group, often) for group in plan.groups(rows, h, sizes, fine=True)]
                    r, s = (np.concatenate([np.zeros(0, t), *[p[k] for p in posted]]) for k, t in ((0, np.int64), (1, np.uint64)))
                    columns.append(lists(r, s.view(np.int64), m))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(scan, schema)


class _Join:
    """State of one join: nodes (one per distinct set) with their sizes and cells, pairs verified, links found, classes so far.

    Tables: ``nodes`` is node, k, n, d1, d2, cells; lists are (signature, node, n, members), ``open`` ones also have each member's
    ``class`` and the list's pivot.
    """

    def __init__(self, texts: DataFrame, nodes: DataFrame, words: int, plan: Plan, scratch: Scratch):
        self.texts, self.nodes, self.words, self.plan, self.scratch = texts, nodes, words, plan, scratch
        self.links: DataFrame | None = None
        self.seen: DataFrame | None = None
        self.known: DataFrame | None = None

    def fits(self, n: Column, m: Column) -> Column:
        """Whether sets of these sizes can be similar at all."""
        return F.least(n, m) * self.plan.den >= F.greatest(n, m) * self.plan.num

    def enough(self, n: Column, m: Column, shared: Column) -> Column:
        """Whether sets of these sizes are similar if they share so many."""
        return shared * (self.plan.num + self.plan.den) >= (n + m) * self.plan.num

    def fetched(self, wanted: DataFrame, kind: str) -> DataFrame:
        """(node, items) of the nodes ``wanted``: their texts are picked by row key, and the set is told by its digest."""
        wanted = self.scratch.stage(self.nodes.join(wanted, "node", "left_semi").select("k", F.col("node"), F.col("d1").alias("e1"), F.col("d2").alias("e2")), "wanted")
        texts = self.texts.join(sent(wanted), "k").drop("k")
        found = sketched(texts, self.words, self.plan, kind).filter("d1 = e1 and d2 = e2").drop("d1", "d2", "e1", "e2")
        out = self.scratch.stage(found, kind)
        if out.count() > wanted.count():  # a row that is repeated has its set fetched as often
            out = self.scratch.stage(out.dropDuplicates(["node"]), kind)
        self.scratch.drop(wanted)
        return out

    def verify(self, pairs: DataFrame) -> None:
        """Adds those of ``pairs`` (a < b) that are similar. Sizes and cells rule most others out before any set is fetched."""
        num, den = self.plan.num, self.plan.den
        node = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"c_{x}"))
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = self.scratch.stage(pairs, "candidates")
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        # of sets that fit, one histogram is four times as wide as the other at most: its quarters add up to one of the same width
        quarter = lambda c: F.size(c) / 4
        folded = lambda c: F.transform(F.slice(c, 1, quarter(c).cast("int")), lambda x, i: sum((F.get(c, i + (quarter(c) * k).cast("int")).cast("int") for k in (1, 2, 3)), x.cast("int")))
        like = lambda c, d: F.when(F.size(c) > F.size(d), folded(c)).otherwise(F.transform(c, lambda x: x.cast("int")))
        apart = F.aggregate(F.zip_with(like("c_a", "c_b"), like("c_b", "c_a"), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        total = F.col("n_a") + F.col("n_b")
        likely = pairs.join(node("a"), "a").join(node("b"), "b").filter(self.fits(F.col("n_a"), F.col("n_b"))).filter(apart * (num + den) <= total * (den - num))
        likely = self.scratch.stage(likely.select("a", "b", "n_a", "n_b"), "likely")
        sets = self.fetched(likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct(), "sets")
        of = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"s_{x}"))
        shared = F.size(F.array_intersect("s_a", "s_b"))
        found = likely.join(of("a"), "a").join(of("b"), "b").filter(self.enough(F.col("n_a"), F.col("n_b"), shared))
        found = self.scratch.stage(found.select("a", "b"), "found")
        self.scratch.drop(likely, sets)
        self.links = found if self.links is None else self.links.unionByName(found)

    def classes(self) -> DataFrame:
        """(node, class) of the nodes that have links so far."""
        old = self.known
        self.known = components(self.links, self.scratch.stage).withColumnsRenamed({"component": "class"})
        if old is not None:
            self.scratch.drop(old)
        return self.known

    def shared(self, rows: DataFrame, column: str) -> DataFrame:
        """Lists of the signatures that several nodes have. Signatures are counted first, combined before the shuffle, so that a
        frequent one is no single task's work; the join that follows may be split."""
        flat = rows.select("node", "n", F.explode(column).alias("signature"))
        counts = flat.groupBy("signature").agg(F.count("node").alias("members")).filter("members > 1")
        # few signatures are shared, so theirs is the side to hash, and the posts need no sort
        return self.scratch.stage(flat.join(counts.hint("shuffle_hash"), "signature").select("signature", "node", "n", "members"), "lists")

    def starred(self, lists: DataFrame) -> DataFrame:
        """Each list's members meet its hub, the one whose lists are longest in all: it stands closest to the middle of a group of near copies.
        A list costs as many pairs as it has members. Gives the lists that still span several classes."""
        weight = lists.groupBy("node").agg(F.sum("members").alias("weight"))
        told = self.scratch.stage(lists.join(weight, "node"), "weighted")
        hubs = told.groupBy("signature").agg(F.max(F.struct("weight", "node", "n")).alias("h"))
        hubs = self.scratch.stage(hubs.select("signature", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
        met = told.join(hubs, "signature").filter((F.col("hub") != F.col("node")) & self.fits(F.col("n"), F.col("hub_n")))
        self.verify(pair(met.select(F.col("hub").alias("x"), F.col("node").alias("y"))))
        classed = lists.join(self.classes(), "node", "left").withColumn("class", F.coalesce("class", "node"))
        classed = self.scratch.stage(classed, "classed")
        # the weightiest set of the hub's class stands for the hub from here on, so that the lists of one group have one pivot
        members = classed.select("node", "class").distinct().join(weight, "node")
        leaders = members.groupBy("class").agg(F.max(F.struct("weight", "node")).alias("l")).select("class", F.col("l.node").alias("pivot"))
        pivots = hubs.join(members.select(F.col("node").alias("hub"), "class"), "hub").join(leaders, "class").select("signature", "pivot")
        span = classed.groupBy("signature", "class").agg(F.count("node").alias("own")).groupBy("signature").agg(F.count("class").alias("classes"), F.sum("own").alias("size"), F.sum(F.col("own") * F.col("own")).alias("squares"))
        pairs = (F.col("size") * F.col("size") - F.col("squares")) / 2
        span = span.filter("classes > 1").select("signature", (pairs > DIRECT * F.col("size")).alias("dear"))
        left = classed.join(span, "signature").join(pivots, "signature")
        left = self.scratch.stage(left.select("signature", "node", "n", "class", "pivot", "dear"), "open-lists")
        self.scratch.drop(lists, told, hubs, classed)
        return left

    def across(self, lists: DataFrame) -> DataFrame:
        """The pairs of each list whose members lie in different classes."""
        # lists of the same members give the same pairs: two sets that share much share many lists, of which one is enough
        alike = lists.groupBy("signature").agg(F.count("node").alias("size"), *[F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"e{salt}") for salt in (1, 2)])
        unlike = self.scratch.stage(lists.join(alike.groupBy("size", "e1", "e2").agg(F.min("signature").alias("signature")).select("signature"), "signature"), "unlike-lists")
        # and of lists that aren't the same, the first is enough, as far as a set's first few are known to its rows
        firsts = unlike.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("signature")), 1, FIRSTS).alias("firsts"))
        unlike = self.scratch.stage(unlike.join(firsts, "node"), "unlike-lists")
        one, two = (unlike.select("signature", F.col("node").alias(x), F.col("class").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("firsts").alias(f"f_{x}")) for x in "xy")
        met_before = F.arrays_overlap(F.filter("f_x", lambda s: s < F.col("signature")), F.col("f_y"))
        met = one.join(two, "signature").filter(F.expr("x < y and c_x != c_y") & self.fits(F.col("n_x"), F.col("n_y")) & ~met_before)
        return self.scratch.stage(pair(met.select("x", "y")), "across")

    def centred(self, member: DataFrame, sets: DataFrame) -> DataFrame:
        """``member`` (pivot, node, n) with the group's middle as its pivot: of its members the one from which the others differ in the fewest items in all.

        Of a group of g sets, the one with the largest sum of 2 * (sets that have the item) - g over its items. Occurrences are counted before any shuffle, so the cost is a row per member and item.
        """
        items = self.scratch.stage(member.join(sets, "node").select("pivot", "node", F.explode("items").alias("item")), "items")
        often = items.groupBy("pivot", "item").agg(F.count("node").alias("often"))
        of_all = member.groupBy("pivot").agg(F.count("node").alias("of"))
        total = items.join(often, ["pivot", "item"]).groupBy("pivot", "node").agg(F.sum("often").alias("often"), F.count("item").alias("size"))
        score = F.struct((2 * F.col("often") - F.col("of") * F.col("size")).alias("score"), "node")
        middle = total.join(of_all, "pivot").groupBy("pivot").agg(F.max(score).alias("m")).select("pivot", F.col("m.node").alias("middle"))
        out = self.scratch.stage(member.join(middle, "pivot").select(F.col("middle").alias("pivot"), "node", "n").distinct(), "centred")
        self.scratch.drop(items)
        return out

    def about_pivots(self, lists: DataFrame) -> DataFrame:
        """Candidates among the members of long lists, from what each member has beyond the pivot h of its group, which is the members of all lists with one pivot.
        The group's own middle takes that pivot's place, as what the pivot lacks and most others have would make lists of the whole group.

        How much a member shares with h is counted exactly, and those that are similar to it are linked at once. Two sets x and y share no more than
        min(|x & h|, |y & h|) within h. If that is enough for their sizes, they meet by size: x, of
        another class than the pivot, looks for the few sizes for which |x & h| suffices. Else they share so many items outside h that they
        have one of their rarest ones in common, and meet in a list of that pivot and item.
        """
        num, den = self.plan.num, self.plan.den
        member = self.scratch.stage(lists.select("pivot", "node", "n").distinct(), "members")
        sets = self.fetched(member.select("node").distinct(), "sets")
        member = self.centred(member, sets)
        pivot = sets.select(F.col("node").alias("pivot"), F.col("items").alias("pivot_items"))
        own = member.filter("node != pivot").join(sets, "node").join(pivot, "pivot")
        own = own.select("pivot", F.size("pivot_items").alias("pivot_n"), "node", "n", F.array_except("items", "pivot_items").alias("own"))
        own = self.scratch.stage(own.withColumn("within", F.col("n") - F.size("own")), "own")
        near = own.filter(self.enough(F.col("n"), F.col("pivot_n"), F.col("within"))).select(F.col("pivot").alias("x"), F.col("node").alias("y"))
        self.links = self.links.unionByName(self.scratch.stage(pair(near), "near-pivots"))
        known = self.classes()
        class_of = lambda c, name: known.select(F.col("node").alias(c), F.col("class").alias(name))
        own = own.join(class_of("node", "class"), "node", "left").join(class_of("pivot", "pivot_class"), "pivot", "left")
        own = own.withColumn("class", F.coalesce("class", "node")).withColumn("pivot_class", F.coalesce("pivot_class", "pivot"))
        # by size: num * (n + m) <= within * (num + den)
        most = F.floor(F.col("within") * (num + den) / num).cast("long") - F.col("n")
        low, high = F.ceil(F.col("n") * num / den).cast("long"), F.least(most, F.floor(F.col("n") * den / num).cast("long"))
        x = own.filter((F.col("class") != F.col("pivot_class")) & (low <= high))
        x = x.select("pivot", F.col("node").alias("x"), F.col("class").alias("c_x"), F.col("n").alias("n_x"), F.explode(F.sequence(low, high)).alias("n"))
        y = own.select("pivot", "n", F.col("node").alias("y"), F.col("class").alias("c_y"), "within")
        by_size = x.join(y, ["pivot", "n"]).filter((F.col("c_x") != F.col("c_y")) & self.enough(F.col("n_x"), F.col("n"), F.col("within")))
        # by item: of the least overlap with any set that fits, what is not within the pivot has to be shared outside it
        need = F.greatest(F.lit(1), F.ceil((F.col("n") + low) * num / (num + den)).cast("long") - F.col("within"))
        posted = own.select("pivot", "node", "n", "class", (F.size("own") - need + 1).alias("keep"), F.size("own").alias("size"), F.explode("own").alias("item"))
        several = posted.groupBy("pivot", "item").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("node").alias("often")).filter("low < high").select("pivot", "item", "often")
        # rarest first: items that no other class has, then by how often they occur
        by_set = W.partitionBy("pivot", "node")
        posted = posted.join(several.hint("shuffle_hash"), ["pivot", "item"]).withColumn("known", F.count("item").over(by_set)).withColumn("nth", F.row_number().over(by_set.orderBy("often", "item")))
        posted = self.scratch.stage(posted.filter("nth <= keep - (size - known)").select("pivot", "item", "node", "n", "class"), "own-lists")
        one, two = (posted.select("pivot", "item", F.col("node").alias(x), F.col("class").alias(f"c_{x}"), F.col("n").alias(f"n_{x}")) for x in "xy")
        by_item = one.join(two, ["pivot", "item"]).filter(F.expr("x < y and c_x != c_y") & self.fits(F.col("n_x"), F.col("n_y")))
        out = self.scratch.stage(pair(by_size.select("x", "y").union(by_item.select("x", "y"))), "about-pivots")
        self.scratch.drop(member, sets, own, posted)
        return out


def pair(df: DataFrame) -> DataFrame:
    return df.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, carry: list[Column], words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: the columns ``carry``, n_shingles, and ``class``, a number that linked rows share (null without words).

    Rows link when their sets of ``words``-word shingles have a Jaccard similarity of at least num / den; every such link counts, though
    only as many are computed as classes need. Equal sets are one node. Lists of nodes with a common signature are first met by
    their hubs, which joins groups of near copies at the cost of a row per member. A set posts its rarest segments, by counters that a
    first pass over the texts fills, so a passage that many sets share makes no lists as long as they have enough else. Of lists that then span classes, those with few
    pairs across classes for their length have these compared; the members of the others post
    one-deletion neighbourhoods, met by hubs and compared in the same way, and what lies in long lists even so is compared by what it has beyond its
    list's pivot. Pairs pass exact bounds on size and on histogram distance before sets are fetched and intersected.

    Null and empty texts have no shingles and no class. Rows, not ids, are what is compared: repeated and null ids are rows like others. An empty
    table gives no rows. Columns that ``carry`` doesn't read may have any name.
    """
    plan = Plan(num, den)
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        key = F.xxhash64(*row_keys("doc_id", "text")).alias("k")
        names = [f"carry{i}" for i in range(len(carry))]
        texts = docs.select(key, "text")
        often = segment_counts(texts, words, plan)
        told = sketched(docs.select(key, "text", *[c.alias(x) for c, x in zip(carry, names, strict=True)]), words, plan, "whole", often)
        sketches = scratch.stage(told.withColumn("row", F.monotonically_increasing_id()), "sketches")
        rows = scratch.stage(sketches.drop("cells", "signatures"), "rows")
        # copies beyond the first of each set are fewer than sets, and are what is left out, so that signatures needn't be shuffled to choose nodes
        heads = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("head"), F.count("row").alias("times")).filter("times > 1").drop("times")
        copies = scratch.stage(rows.join(heads, ["d1", "d2"]).filter("row != head").select("row"), "copies")
        chosen = sketches.filter("n > 0").join(sent(copies), "row", "left_anti").withColumnRenamed("row", "node")
        nodes = scratch.stage(chosen.select("node", "k", "n", "d1", "d2", "cells"), "nodes")
        join = _Join(texts, nodes, words, plan, scratch)
        lists = join.shared(chosen.select("node", "n", "signatures"), "signatures")
        scratch.drop(sketches, copies)
        dear_of = lambda found: scratch.stage(found.filter("dear").select("node").distinct(), "dear")
        found = join.starred(lists)
        candidates, dear = join.across(found.filter("not dear")), dear_of(found)
        if not dear.isEmpty():
            deletions = join.fetched(dear, "deletions").join(nodes.select("node", "n"), "node")
            found = join.starred(join.shared(deletions, "items"))
            candidates = candidates.union(join.across(found.filter("not dear"))).union(join.about_pivots(found.filter("dear")))
        join.verify(candidates.distinct())
        heads = nodes.select("d1", "d2", "node").join(join.classes(), "node", "left")
        heads = heads.select("d1", "d2", F.coalesce("class", "node").alias("class"))
        out = rows.select(*names, "n", "d1", "d2").join(heads, ["d1", "d2"], "left")
        out = out.select(*[F.col(x).alias(f"{x}") for x in names], F.col("n").alias("n_shingles"), "class")
        return stage(out, "classes").withColumnsRenamed({x: docs.select(c).columns[0] for c, x in zip(carry, names, strict=True)})


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the least doc_id reachable by links (its own if it has none).

    A doc_id that several rows have is in the component of each; a null one is none, so a component of null ids alone has no id. See
    ``jaccard_classes`` for the rest.
    """
    told = jaccard_classes(docs, [F.col("doc_id").cast("long").alias("doc_id")], words, num, den)
    least = told.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return told.join(least, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), words=4, num=85, den=100)
