"""Hard negatives by a multiway hyperplane tree whose split points keep the distance ranges of their sibling subtrees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, stage

#: Split points of the tree's root, chosen from SAMPLED points for each; of a node below it; points of a leaf.
ROOT, SAMPLED, NODE, LEAF = 24, 4, 8, 128
#: Points and queries of one task.
PER_BLOCK, QUERIES_PER_BLOCK = 8192, 1024
#: New finds after which a search sorts out the best, beside twice what its windows may keep.
HELD = 20_000
#: Any window: from the least to the greatest long.
LOW, HIGH = -(2**63), 2**63 - 1
#: Doubles hold integers up to here exactly.
EXACT = 2.0**53


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered rows, exactly; those that no long holds become the nearest that one does."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each the farthest from those before it."""
    if not len(points):
        return points
    chosen, away = [0], distances(points[:1], points)[0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points[chosen[-1:]], points)[0])
    return points[chosen]


@dataclass
class Ranges:
    """For each split point (row) and subtree (column), the least and greatest distance to the subtree's points; per subtree, that of their squared norms."""

    near: np.ndarray
    far: np.ndarray
    light: np.ndarray
    heavy: np.ndarray

    def open(self, away: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which subtrees (columns) may hold what some query (row) looks for.

        A query at distance ``away[:, i]`` from split point i is at least ``away - far`` and ``near - away`` from every point of a subtree, and at most ``away + far``.
        Its windows, inner products from ``low`` to ``high``, are annuli around it: a point of squared norm t lies at the squared distance
        ``square + t - 2 * product``. A subtree whose range meets no annulus is left out. Rounding is allowed for on either side.
        """
        least = np.maximum(away[:, :, None] - self.far[None], self.near[None] - away[:, :, None]).max(axis=1).clip(0)
        most = (away[:, :, None] + self.far[None]).min(axis=1)
        inward = square[:, None] + self.light[None] - 2 * high.max(axis=1).astype(float)[:, None]
        outward = square[:, None] + self.heavy[None] - 2 * low.min(axis=1).astype(float)[:, None]
        slack = 1e-6 * (1 + square[:, None] + self.heavy[None])
        return (most**2 + slack >= inward) & (least**2 - slack <= outward)


@dataclass
class Node:
    rows: np.ndarray
    splits: np.ndarray | None = None
    ranges: Ranges | None = None
    children: list[Node] = field(default_factory=list)


def grow(vectors: np.ndarray, rows: np.ndarray) -> Node:
    """The tree over some rows: split points spread over a few dozen of them, every row below its nearest, down to leaves."""
    if len(rows) <= LEAF:
        return Node(rows)
    some = rows[:: max(1, len(rows) // (SAMPLED * NODE))]
    splits = spread_out(vectors[some], NODE)
    away = distances(vectors[rows], splits)
    owner = away.argmin(axis=1)
    cells = [np.flatnonzero(owner == j) for j in range(len(splits))]
    cells = [c for c in cells if len(c)]
    if len(cells) < 2:
        return Node(rows)
    square = (vectors[rows] ** 2).sum(axis=1)
    ranges = Ranges(
        np.stack([away[c].min(axis=0) for c in cells], axis=1), np.stack([away[c].max(axis=0) for c in cells], axis=1),
        np.array([square[c].min() for c in cells]), np.array([square[c].max() for c in cells]),
    )
    return Node(rows, splits, ranges, [grow(vectors, rows[c]) for c in cells])


class Search:
    """All queries of a block through one tree: for each window of a query the ``k`` points of greatest inner product within it, of the same label or of another."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, least: np.ndarray, same: bool, k: int):
        self.vectors, self.labels, self.least, self.same, self.k = vectors, labels, least, same, k
        self.tree = grow(vectors, np.arange(len(vectors)))

    def __call__(self, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, window, point, score; ``low`` and ``high`` have a row per query and a column per window (empty where low > high)."""
        self.queries, self.asked, self.low, self.high = queries, labels, low.copy(), high
        self.square = (queries**2).sum(axis=1)
        self.held, self.n = [], 0
        self._visit(self.tree, np.flatnonzero((low <= high).any(axis=1)))
        self._best()
        return self.held[0] if self.held else (np.zeros(0, np.int64),) * 4

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.children:
            self._leaf(node.rows, who)
            return
        away = distances(self.queries[who], node.splits)
        # subtrees that more queries are close to come first, and raise what the others must reach
        turn = np.argsort(-np.bincount(away.argmin(axis=1), minlength=len(node.splits))[: len(node.children)], kind="stable")
        for j in turn.tolist():
            one = Ranges(node.ranges.near[:, j : j + 1], node.ranges.far[:, j : j + 1], node.ranges.light[j : j + 1], node.ranges.heavy[j : j + 1])
            self._visit(node.children[j], who[one.open(away, self.square[who], self._floor(who), self.high[who])[:, 0]])

    def _floor(self, who: np.ndarray) -> np.ndarray:
        """The windows' lower ends; an empty window has none."""
        return np.where(self.low[who] <= self.high[who], self.low[who], HIGH)

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        scores = inner(self.queries[who], self.vectors[rows])
        fits = (self.asked[who][:, None] == self.labels[rows][None, :]) == self.same
        for w in range(self.low.shape[1]):
            i, j = np.nonzero(fits & (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None]))
            if len(i):
                self.held.append((who[i], np.full(len(i), w), rows[j], scores[i, j]))
                self.n += len(i)
        if self.n > HELD + 2 * self.k * self.low.size:
            self._best()

    def _best(self) -> None:
        """Keeps the first k of each window, and raises its lower end to the k-th score."""
        if not self.held:
            return
        q, w, p, s = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((self.least[p], -s, w, q))
        q, w, p, s = q[order], w[order], p[order], s[order]
        fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (w[1:] != w[:-1])))
        place = np.arange(len(q)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        stay = place < self.k
        kth = place == self.k - 1
        np.maximum.at(self.low, (q[kth], w[kth]), s[kth])
        self.held, self.n = [(q[stay], w[stay], p[stay], s[stay])], 0


class Forest:
    """The root of the tree over a written table of points (point, dim, v, label, least), one for each number of dimensions.

    Split points are spread over a sample of ``ROOT * SAMPLED`` points per number of dimensions, taken by hash: a bound that doesn't grow with the table. Every point goes to the cell of
    its nearest split point; cells' distance ranges are ``ROOT**2`` numbers. Cells are cut into hashed blocks of about ``PER_BLOCK`` points, each of
    which a task makes the lower tree of.
    """

    def __init__(self, points: DataFrame, scratch: Scratch, per_block: int = PER_BLOCK):
        self.scratch, self.spark = scratch, points.sparkSession
        draw = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64(F.lit(3), "point"), "point"))
        sample = points.select("dim", "v", draw.alias("draw")).filter(F.col("draw") <= ROOT * SAMPLED).toPandas()
        splits = {int(d): spread_out(np.stack(own.sort_values("draw")["v"].to_numpy()), ROOT) for d, own in sample.groupby("dim")}
        self.splits = splits

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for dim, own in frame.groupby("dim"):
                    yield own.assign(cell=distances(np.stack(own["v"].to_numpy()), splits[int(dim)]).argmin(axis=1).astype("int32"))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
        celled = scratch.stage(points.mapInPandas(settle, f"{kinds}, cell int"), "celled")

        def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for (dim, cell), own in frame.groupby(["dim", "cell"]):
                    x = np.stack(own["v"].to_numpy())
                    away, square = distances(x, splits[int(dim)]), (x * x).sum(axis=1)
                    yield pd.DataFrame({"dim": dim, "cell": cell, "split": np.arange(away.shape[1]), "near": away.min(axis=0), "far": away.max(axis=0), "light": square.min(), "heavy": square.max(), "n": len(own)})

        ranges = celled.select("dim", "cell", "v").mapInPandas(extent, "dim int, cell int, split int, near double, far double, light double, heavy double, n long")
        ranges = ranges.groupBy("dim", "cell", "split").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.min("light").alias("light"), F.max("heavy").alias("heavy"), F.sum("n").alias("n")).toPandas()
        self.ranges, self.cells, blocks = {}, {}, []
        for dim, own in ranges.groupby("dim"):
            at = {c: own[own["cell"] == c].sort_values("split") for c in sorted(own["cell"].unique())}
            stack = lambda c: np.stack([x[c].to_numpy() for x in at.values()], axis=1)  # noqa: B023, E731
            self.cells[int(dim)] = np.array(list(at), np.int64)
            self.ranges[int(dim)] = Ranges(stack("near"), stack("far"), stack("light")[0], stack("heavy")[0])
            blocks += [(int(dim), int(c), max(1, -(-int(x["n"].iloc[0]) // per_block))) for c, x in at.items()]
        # one row per cell
        self.blocks = self.spark.createDataFrame(blocks, "dim int, cell int, blocks int")
        self.points = celled.join(F.broadcast(self.blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).drop("blocks")

    def _route(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """The cells that each query visits: that of its nearest split point, or the others that its windows reach."""
        splits, ranges, cells = self.splits, self.ranges, self.cells

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for dim, own in frame.groupby("dim"):
                    if int(dim) not in splits:
                        continue
                    x = np.stack(own["v"].to_numpy())
                    low, high = np.stack(own["low"].to_numpy()), np.stack(own["high"].to_numpy())
                    away = distances(x, splits[int(dim)])
                    first = away.argmin(axis=1)[:, None] == cells[int(dim)][None, :]
                    if nearest:
                        i, j = np.nonzero(first)
                    else:
                        some = (low <= high).any(axis=1)
                        floor = np.where(low <= high, low, HIGH)
                        i, j = np.nonzero(some[:, None] & ~first & ranges[int(dim)].open(away, (x * x).sum(axis=1), floor, high))
                    yield own.iloc[i].assign(cell=cells[int(dim)][j].astype("int32"))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return self.scratch.stage(queries.mapInPandas(visit, f"{kinds}, cell int"), "routed")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(query, w, point, least, score): for each window w of ``queries`` (query, dim, v, label, low, high: arrays) the first k points of the same label or of another.

        The nearest cell comes first; the k-th score found there closes the windows from below for the other cells. Windows of one table have the same number of places.
        """
        near = self._met(self._route(queries, True), same, k)
        kth = near.filter(F.col("place") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
        rest = queries.join(kth, "query", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised)).drop("kth")
        far = self._met(self._route(rest, False), same, k)
        return self.scratch.stage(_first(near.drop("place").unionByName(far.drop("place")), k), "found")

    def _met(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        sizes = routed.groupBy("dim", "cell").agg(F.ceil(F.count("query") / QUERIES_PER_BLOCK).cast("int").alias("parts")).join(self.blocks, ["dim", "cell"])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # one row per cell
        asking = routed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "query"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
        given = self.points.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", every("parts"))
        keys = ["dim", "cell", "block", "part"]

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "w": [], "point": [], "least": [], "score": []}).astype("int64")
            least = right["least"].to_numpy()
            search = Search(np.stack(right["v"].to_numpy()), right["label"].to_numpy(), least, same, k)
            stack = lambda c: np.stack(left[c].to_numpy())
            q, w, p, s = search(stack("v"), left["label"].to_numpy(), stack("low"), stack("high"))
            return pd.DataFrame({"query": left["query"].to_numpy()[q], "w": w, "point": right["point"].to_numpy()[p], "least": least[p], "score": s})

        met = asking.select(*keys, "query", "v", "label", "low", "high").groupBy(*keys).cogroup(given.select(*keys, "point", "v", "label", "least").groupBy(*keys))
        return self.scratch.stage(_first(met.applyInPandas(meet, "query long, w int, point long, least long, score long"), k), "met")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query", "w").orderBy(F.desc("score"), "least"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _rows(df: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.cast("long").alias("label"), v.alias("v"), F.size("v").alias("dim")).distinct()


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), per_block: int = PER_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, embedding, label).

    An anchor's positives are its first ``positives`` other rows of its label by the integer inner product of floor(256 x); for each, the first ``negatives`` rows of other labels whose score
    is from window[0] to window[1] hundredths of the positive's. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; rows equal in all three are one, and other rows that share an id are rows of their own;
    vectors of another length than an anchor's are no candidates for it; scores beyond a long count as the nearest long. Tables without anchors give no rows.

    Rows equal in vector and label are one point with its first ids, so copies are searched for once and found once. The search is exact: the tree only leaves out subtrees that no window reaches.
    """
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.stage(_rows(df.select("vec_id", "embedding", "label")), "rows")
        most = max(positives, negatives) + 1
        nth = F.row_number().over(W.partitionBy("dim", "v", "label").orderBy("vec_id"))
        some = rows.withColumn("nth", nth).filter(F.col("nth") <= most)
        points = some.groupBy("dim", "v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0])
        points = scratch.stage(points.withColumn("point", F.monotonically_increasing_id()), "points")
        anchors = rows.filter(F.coalesce(is_anchor, F.lit(False))).join(points.select("dim", "v", "label", "point"), ["dim", "v", "label"])
        anchors = scratch.stage(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("point").alias("query")), "anchors")
        asked = points.join(anchors.select(F.col("query").alias("point")).distinct(), "point", "left_semi").select(F.col("point").alias("query"), "dim", "v", "label")
        asked = scratch.stage(asked, "asked")
        forest = Forest(points.select("point", "dim", "v", "label", "least"), scratch, per_block)
        ids = scratch.stage(points.select("point", F.posexplode("ids").alias("nth", "vec_id")), "ids")

        anyone = asked.withColumns({"low": F.array(F.lit(LOW)), "high": F.array(F.lit(HIGH))})
        # the anchor's own row is among them: one more is asked for
        near = forest.search(anyone, True, positives + 1).join(ids.filter(F.col("nth") <= positives), "point")
        pairs = anchors.join(near.select("query", "point", "vec_id", "score"), "query").filter("vec_id != anchor_id or point != query")
        place = F.row_number().over(W.partitionBy("query", "anchor_id").orderBy(F.desc("score"), "vec_id"))
        pairs = pairs.withColumn("place", place).filter(F.col("place") <= positives)
        pairs = scratch.stage(pairs.select("anchor_id", "query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        # a window for each score that a point's anchors have a positive of
        least, greatest = window
        exact = lambda c, n: F.col(c).cast("decimal(20,0)") * n
        scores = pairs.select("query", "positive_score").distinct()
        ends = scores.select("query", "positive_score", F.ceil(exact("positive_score", least) / 100).cast("long").alias("low"), F.floor(exact("positive_score", greatest) / 100).cast("long").alias("high"))
        windows = ends.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("positive_score", "low", "high"))).alias("ends"))
        windows = windows.select("query", *[F.col(f"ends.{c}").alias(c) for c in ("low", "high", "positive_score")])
        width = windows.agg(F.max(F.size("low"))).first()[0] or 1
        padded = lambda c, n: F.concat(F.col(c), F.array_repeat(F.lit(n), F.lit(width) - F.size(c))).alias(c)
        windows = scratch.stage(windows.select("query", padded("low", HIGH), padded("high", LOW), "positive_score"), "windows")
        found = forest.search(asked.join(windows.select("query", "low", "high"), "query"), False, negatives)
        at = windows.select("query", F.posexplode("positive_score").alias("w", "positive_score"))
        found = found.join(at, ["query", "w"]).join(ids.filter(F.col("nth") < negatives), "point")
        first = F.row_number().over(W.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", first).filter(F.col("rank") <= negatives).select("query", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = pairs.join(found, ["query", "positive_score"])
        return stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def op12_split_point_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH valid AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
pairs AS (
  SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pairs
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)
QUALIFY row_number() OVER w <= 10
"""
