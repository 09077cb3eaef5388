"""Vectors: collision-counting nearest neighbours, and near duplicates by rotated binary codes with correction factors."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, mix, sent, stage
from .graph import components


def valid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, empty or zero and has no null, NaN or infinite component; the vector as doubles."""
    return df.withColumn("v", doubles(vector)).filter(usable())


def doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def usable(v: str = "v") -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


# -- nearest neighbours ------------------------------------------------------------------------------------------------------------

#: Projections; window half-width over search radius; standard deviations below the expected collisions at which a vector still counts.
PROJECTIONS, REACH, SLACK = 256, 0.8, 0.8
#: Steps of a unit in which projections are kept.
STEPS = 2048
#: Search radii: a few for close neighbours, then in small steps up to where every unit vector lies.
RADII = np.array([0.12, 0.3, 0.55, *(0.8 * 1.08 ** np.arange(13))])


def within(x: float) -> float:
    """Probability that a standard normal value lies within x of 0."""
    return math.erf(x / math.sqrt(2))


def search_block(vectors: np.ndarray, queries: np.ndarray, skip: np.ndarray, k: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of the k nearest vectors found (unit rows; ``skip`` is the query's own position or -1).

    A query's windows, centred on its own projections, widen from radius to radius (virtual rehashing). How far each vector lies from the query
    is told once for each projection, in whole steps, and a radius counts who lies within its window: all vectors at once, without
    gathering what windows newly hold. Vectors in at least so many windows as one at that radius
    reaches with near certainty are verified exactly; the search ends when the k-th nearest verified lies within the radius.
    """
    n, dim = vectors.shape
    lines = np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))
    steps = lambda x: np.ascontiguousarray(np.rint(np.clip(x @ lines, -7.9, 7.9) * STEPS).astype(np.int16).T)
    projected, asked = steps(vectors), steps(queries)
    windows = np.rint(REACH * RADII * STEPS).astype(np.int16)
    apart, inside = np.empty_like(projected), np.empty(projected.shape, bool)
    share = within(REACH)
    threshold = PROJECTIONS * share - SLACK * math.sqrt(PROJECTIONS * share * (1 - share))
    out = []
    narrow = vectors.astype(np.float32)
    for i, (short, own) in enumerate(zip(queries.astype(np.float32), skip, strict=True)):
        new = np.ones(n, bool)
        if own >= 0:
            new[own] = False
        np.abs(np.subtract(projected, asked[:, i, None], out=apart), out=apart)
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for window, radius in zip(windows, RADII, strict=True):
            np.less_equal(apart, window, out=inside)
            # bytes hold the counts of 128 projections
            counts = sum(np.add.reduce(inside[j : j + 128].view(np.uint8), axis=0, dtype=np.uint8).astype(np.int32) for j in range(0, PROJECTIONS, 128))
            found = np.flatnonzero(new & (counts >= threshold)) if radius < 2 else np.flatnonzero(new)
            if len(found):
                new[found] = False
                value = narrow[found] @ short
                best, scores = np.concatenate((best, found)), np.concatenate((scores, value))
                if len(best) > k:  # what single precision can't tell from the k-th stays, for the exact measure to rank
                    stay = scores >= np.partition(scores, -k)[-k] - 1e-5
                    best, scores = best[stay], scores[stay]
            if len(best) >= k and math.sqrt(max(0.0, 2 - 2 * float(scores.min()))) <= radius:
                break
        out.append((best, scores))
    return out


def nearest(df: DataFrame, is_query: Column, k: int = 5, seed: int = 11, per_block: int = 8192, queries_per_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``df`` (vec_id, embedding) by cosine for each row that is a query.

    Equal vectors are one point with its least ids, so a group of copies is searched once and found once. Points go into hashed blocks of
    about ``per_block``, queries into blocks of about ``queries_per_block``; each pair of blocks is one task's index and search, so memory is
    bounded and the work is that of the stated query set against all rows. Invalid vectors (null, empty, zero, with null or non-finite
    components) and null ids take no part; vectors of another length than a query's are no candidates; a query's own row is none; ties go to the
    smaller vec_id; rows equal in id and vector are one row, other rows that share an id are rows of their own; a table without queries gives no rows.
    """
    with Scratch(df.sparkSession) as scratch:
        return _nearest(df, is_query, k, seed, per_block, queries_per_block, scratch)


def _nearest(df: DataFrame, is_query: Column, k: int, seed: int, per_block: int, queries_per_block: int, scratch: Scratch) -> DataFrame:
    rows = valid(df.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))).filter("vec_id is not null")
    rows = scratch.stage(rows.select("vec_id", "v", "is_query").distinct(), "vectors")
    points = rows.groupBy("v").agg(F.bool_or("is_query").alias("is_query"), F.min("vec_id").alias("least"))
    points = scratch.stage(points.select("v", F.size("v").alias("dim"), "is_query", "least", F.monotonically_increasing_id().alias("point")), "points")
    members = scratch.stage(rows.join(points.select("v", "point"), "v").select("vec_id", "is_query", "point"), "members")
    n, m = points.count(), points.filter("is_query").count()
    blocks, query_blocks = max(1, -(-n // per_block)), max(1, -(-m // queries_per_block))
    at = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "point"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    data = points.select(F.col("point").alias("vec_id"), "v", "dim", F.lit(False).alias("asks"), at("rows", blocks).alias("block"), every(query_blocks).alias("query_block"))
    asks = points.filter("is_query").select(F.col("point").alias("vec_id"), "v", "dim", F.lit(True).alias("asks"), at("queries", query_blocks).alias("query_block"), every(blocks).alias("block"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asking = frame["asks"].to_numpy(bool)
        x = np.stack(frame["v"].to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids = frame["vec_id"].to_numpy()
        queries, vectors = x[asking], x[~asking]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        own = {v: i for i, v in enumerate(ids[~asking].tolist())}
        found = search_block(vectors, queries, np.array([own.get(v, -1) for v in ids[asking].tolist()]), k, seed)
        return pd.DataFrame({"query_id": np.repeat(ids[asking], [len(p) for p, _ in found]), "vec_id": np.concatenate([ids[~asking][p] for p, _ in found]), "score": np.concatenate([s for _, s in found])})

    near = data.unionByName(asks).groupBy("block", "query_block", "dim").applyInPandas(search, "query_id long, vec_id long, score double")
    # the exact measure, on the vectors as given, for the few that blocks hand on; and a query's own point, whose other rows are candidates
    near = near.select(F.col("query_id").alias("asking"), F.col("vec_id").alias("point")).union(points.filter("is_query").select("point", "point"))
    given = points.select("point", "v", "least")
    near = near.join(given, "point").join(points.select(F.col("point").alias("asking"), F.col("v").alias("w")), "asking")
    near = near.select("asking", "point", "least", cosine(F.col("v"), F.col("w")).alias("score"))
    best = F.row_number().over(W.partitionBy("asking").orderBy(F.desc("score"), "least"))
    near = near.withColumn("place", best).filter(F.col("place") <= k + 1).select("asking", "point", "score")
    # of equal vectors the least ids can be among the nearest, and one more as the query may be one of them
    some = members.withColumn("place", F.row_number().over(W.partitionBy("point").orderBy("vec_id"))).filter(F.col("place") <= k + 1).select("point", "vec_id")
    queries = members.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("point").alias("asking"))
    pairs = queries.join(near, "asking").join(some, "point").filter("vec_id != query_id or point != asking")
    rank = F.row_number().over(W.partitionBy("query_id", "asking").orderBy(F.desc("score"), "vec_id"))
    return stage(pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def cosine(v: Column, w: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(v, w) / F.sqrt(dot(v, v)) / F.sqrt(dot(w, w))


def op6_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


# -- near duplicates ---------------------------------------------------------------------------------------------------------------

#: Standard deviations of an estimate within which the true value is taken to lie.
CONFIDENCE = 4.0
#: Wanted share of pairs exactly at the threshold whose codes meet in some band; pairs above it meet more often.
BAND_RECALL = 0.97
#: Largest level of a rotated vector's entries, which are kept as bytes.
LEVELS = 7
#: Bands whose keys are dealt out at once; members up to which a bucket's pairs are told column by column; entries of a group of buckets, about.
TURN, FEW, GROUP = 8, 32, 40_000
#: What a vector has in a band: the bucket's key, its point, up to 64 signs under the first rotation, the band.
ENTRY = np.dtype([("key", "<u8"), ("point", "<i8"), ("short", "<u8"), ("band", "<u2")])


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits per band and bands, for groups of up to n: about a quarter of a stranger for each member of a band's bucket."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(48, max(6, math.ceil(math.log2(max(2, n))) + 2))
    return bits, max(1, math.ceil(math.log(1 - BAND_RECALL) / math.log(1 - agree**bits)))


class Coder:
    """Binary codes of unit vectors under random rotations, with what it takes to estimate inner products from them.

    The first rotation's signs are a vector's code c. Against the code of x, a rotated vector y' gives <c, y'> / <c, x'>, an unbiased
    estimate of <x, y> whose error follows from the factor <c, x'>. Of y', its levels are kept: entries rounded at random to a
    few steps, so that the estimate stays unbiased. Signs under further rotations make the keys under which vectors meet.
    """

    def __init__(self, dim: int, bits: int, bands: int, seed: int):
        self.dim, self.bits, self.bands, self.seed = dim, bits, bands, seed
        self.turns = [rotation(dim, seed + i) for i in range(1 + -(-bits * bands // dim))]

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Packed signs under the further rotations, ``bits`` of them for each band."""
        turned = np.concatenate([x @ t.T > 0 for t in self.turns[1:]], axis=1)
        return np.packbits(turned[:, : self.bits * self.bands], axis=1)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, correction factors, levels (bytes) and the size of a level, of unit rows."""
        turned = x @ self.turns[0].T
        factor = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(self.dim), 1e-9)
        step = np.maximum(np.abs(turned).max(axis=1), 1e-12) / LEVELS
        # the draw is of the vector's own bits, so that a task that runs again stores the same
        draw = (mix(turned.view(np.uint64) + np.uint64(self.seed)) >> np.uint64(11)).astype(float) / 2.0**53
        levels = np.floor(turned / step[:, None] + draw).astype(np.int8)
        return np.packbits(turned > 0, axis=1), factor, levels, step


def band_keys(sides: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """A 64-bit key for each band from ``first`` to before ``last``: its signs and its number."""
    a, b = first * bits, last * bits
    up = np.unpackbits(sides[:, a // 8 : -(-b // 8)], axis=1)[:, a % 8 : a % 8 + b - a].reshape(len(sides), last - first, bits)
    packed = (up.astype(np.float64) @ 2.0 ** np.arange(bits)).astype(np.uint64)  # exact, as bits are 48 at most
    return mix(packed + np.uint64(1)) ^ mix(np.arange(first, last, dtype=np.uint64) + np.uint64(77))[None, :]


def may_reach(product: np.ndarray, factor: np.ndarray, step: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Whether inner products may be at least ``threshold``, by the products of codes with levels."""
    estimate = product * step / math.sqrt(dim) / factor
    # what the code leaves out, and what rounding to levels adds
    spread = np.maximum(0.0, 1 - factor**2) / factor**2 / max(1, dim - 1)
    return estimate + CONFIDENCE * np.sqrt(spread + step**2 / 4 / factor**2) >= threshold


def as_signs(signs: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(signs, axis=1, count=dim).astype(np.float32) * 2 - 1


def likely(signs: np.ndarray, factor: np.ndarray, levels: np.ndarray, step: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some vectors (rows) may have an inner product of at least ``threshold`` with which others (columns), by their codes alone."""
    dim = levels.shape[1]
    return may_reach(as_signs(signs, dim) @ levels.T.astype(np.float32), factor[:, None], step[None, :], dim, threshold)


def likely_pairs(signs: np.ndarray, factor: np.ndarray, levels: np.ndarray, step: np.ndarray, threshold: float) -> np.ndarray:
    """The same of the vectors of each row with one another."""
    dim = levels.shape[1]
    return may_reach(np.einsum("ij,ij->i", as_signs(signs, dim), levels.astype(np.float32)), factor, step, dim, threshold)


def most_unlike(n: int, threshold: float) -> int:
    """How many of n signs differ at most, within CONFIDENCE, for vectors at the threshold."""
    p = math.acos(threshold) / math.pi
    return math.ceil(n * p + CONFIDENCE * math.sqrt(n * p * (1 - p))) + 1


def dealt(point: np.ndarray, kind: np.ndarray, short: np.ndarray, sides: np.ndarray, bits: int, first: int, last: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of some vectors in the bands from ``first`` to before ``last``, sorted by group of buckets, and each one's group. ``kind`` tells what never meets."""
    entries = np.zeros((last - first, len(point)), ENTRY)
    entries["key"] = mix(band_keys(sides, bits, first, last) ^ mix(kind)[:, None]).T
    entries["point"], entries["short"], entries["band"] = point, short, np.arange(first, last)[:, None]
    entries = entries.reshape(-1)
    group = (entries["key"] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    return entries[order], group[order]


def bucket_pairs(entries: np.ndarray, unlike: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets of up to FEW: which entries (i, j) have signs that differ in ``unlike`` at most, all buckets at once. Of larger ones: which entries, and of how many."""
    order = np.argsort(entries["key"], kind="stable")
    key, short = entries["key"][order], entries["short"][order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    size = np.repeat(sizes, sizes)
    large = size > FEW
    some = (size > 1) & ~large
    own, key, short = order[some], key[some], short[some]
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, FEW):
        at = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(at):
            break
        at = at[np.bitwise_count(short[at] ^ short[at + apart]) <= unlike]
        i.append(own[at])
        j.append(own[at + apart])
    return np.concatenate(i), np.concatenate(j), order[large], size[large]


def binary_rows(raw: np.ndarray, ends: np.ndarray):
    """An Arrow column of bytes that end at ``ends``."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def stacked(column, kind=np.uint8) -> np.ndarray:
    """Byte strings of one length as the rows of an array."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


@lru_cache(maxsize=8)
def coder_for(dim: int, bits: int, bands: int, seed: int) -> Coder:
    return Coder(dim, bits, bands, seed)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0 to n - 1."""
    parent = list(range(n))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def inner_products(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i with rows j, some at a time."""
    some = max(1, 2**21 // x.shape[1])
    parts = [np.einsum("ij,ij->i", x[i[k : k + some]], x[j[k : k + some]]) for k in range(0, len(i), some)]
    return np.concatenate(parts) if parts else np.zeros(0)


def meetings(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """The row ranges of a sorted frame that belong together: two blocks of one bucket."""
    named = [frame[c].to_numpy() for c in MEETING]
    starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in named]))))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True))


MEETING = ("label", "key", "a", "b")
#: The table of codes; the label has its own type.
CODES = "point long, label ?, dim int, short long, signs binary, levels binary, sides binary, factor double, step double"


def near_duplicates(df: DataFrame, threshold: float = 0.93, seed: int = 5, per_block: int = 512) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label with cosine >= threshold found), component_id, kept.

    Binary codes, correction factors and levels of all vectors are stored once, with the signs under further rotations that make vectors of a label meet in buckets.
    Bands take turns: the entries of a few bands are dealt to groups of buckets in packed form. Small buckets of a group are told at once, by some signs, and the pairs
    left are estimated from their codes. A larger bucket is cut into blocks of at most ``per_block``, and a task compares two blocks by their codes alone, which
    gives the pairs in doubt, one bit each. Only the vectors of pairs in doubt are fetched, and only their inner products computed exactly. A pair that meets in several bands counts in
    the first. Large buckets give link counts and a spanning forest, never pairs. Equal vectors of a label are one point with a count; vectors are read from ``df`` when needed, not kept.

    Vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing. Rows equal in id, label and vector are one
    vector; other rows that share an id are vectors of their own, and a null id is none: it is ``kept`` if nothing it links to has one. An empty table gives no rows.
    """
    with Scratch(df.sparkSession) as scratch:
        return _near_duplicates(df, threshold, seed, per_block, scratch)


def _near_duplicates(df: DataFrame, threshold: float, seed: int, per_block: int, scratch: Scratch) -> DataFrame:
    given = df.select("vec_id", "label", "embedding").withColumn("v", doubles("embedding"))
    takes_part = F.col("label").isNotNull() & usable()
    for salt in range(64):  # vectors are told apart by 192 bits, and named by 64 of them, under a salt that gives no two the same
        point = F.xxhash64(F.lit(salt), "label", F.size("v"), "v")
        holes = F.when(F.exists("v", lambda x: x.isNull()), F.xxhash64(F.transform("v", lambda x: x.isNull()))).otherwise(F.lit(0))
        told = given.select("vec_id", "label", F.coalesce(F.size("v"), F.lit(-1)).alias("dim"), F.when(takes_part, point).alias("point"), F.xxhash64(F.lit(-1), "v").alias("k1"), F.xxhash64(F.lit(-2), "v").alias("k2"), holes.alias("holes"))
        everyone = scratch.stage(told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("times")), "vectors")
        points = everyone.filter("point is not null").groupBy("point", "label", "dim", "k1", "k2")
        points = scratch.stage(points.agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.sum("times").alias("times")).drop("k1", "k2"), "points")
        if points.groupBy("point").count().filter("count > 1").isEmpty():
            break
        scratch.drop(everyone, points)
    else:
        raise RuntimeError("no salt names all vectors")
    n = points.count()
    largest = points.groupBy("label", "dim").count().agg(F.max("count").alias("count"), F.max("dim").alias("dim")).first()
    bits, bands = bands_for(largest["count"] or 1, threshold)
    unlike = most_unlike(min(64, largest["dim"] or 1), threshold)
    label = df.schema["label"].dataType.simpleString()
    repeated = scratch.stage(points.filter("times > 1").select("point"), "repeated")
    repeats = not repeated.isEmpty()

    def vectors_of(wanted: DataFrame | None = None) -> DataFrame:
        """(point, label, dim, v) of all points, or of those in ``wanted``, from the table as given; of rows equal in label and vector one."""
        found = given.filter(takes_part).select(point.alias("point"), "label", F.size("v").alias("dim"), "v")
        if wanted is not None:
            found = found.join(sent(wanted), "point", "left_semi")
        if repeats:
            found = found.join(sent(repeated), "point", "left_anti").unionByName(found.join(sent(repeated), "point", "left_semi").dropDuplicates(["point"]))
        return found

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_numpy())
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def code(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                column = batch.column(3)
                offsets = column.offsets.to_numpy()
                flat, at, dims = column.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    x = flat[at[own][:, None] + np.arange(dim)]
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    coder, m = coder_for(dim, bits, bands, seed), len(own)
                    signs, factor, levels, step = coder.codes(x)
                    short = np.zeros((m, 8), np.uint8)
                    short[:, : signs.shape[1]] = signs[:, :8]
                    made = [binary_rows(r, np.arange(1, m + 1) * r.shape[1]) for r in (signs, levels, coder.sides(x))]
                    columns = [c.take(pa.array(own)) for c in batch.columns[:3]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(short.view(np.int64)[:, 0]), *made, pa.array(factor), pa.array(step)], names=[x.split()[0] for x in CODES.split(", ")])

    coded = vectors_of().mapInArrow(code, CODES.replace("?", label))
    coded = scratch.stage(coded, "codes")
    groups = max(1, n * min(TURN, bands) // GROUP)

    def deal(first: int, last: int):
        def scan(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    named = [batch.column(k).to_numpy() for k in range(3)]
                    entries, group = dealt(named[0], *[x.view(np.uint64) for x in named[1:]], stacked(batch.column(3).to_pylist()), bits, first, last, groups)
                    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(group[ends - 1]), binary_rows(entries, ends * ENTRY.itemsize)], names=["group", "entries"])

        return scan

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        entries = np.frombuffer(b"".join(frame["entries"]), ENTRY)
        i, j, large, size = bucket_pairs(entries, unlike)
        p, q, none = entries["point"][i], entries["point"][j], np.zeros(len(i), np.int64)
        return pd.DataFrame({
            "a": np.concatenate([np.minimum(p, q), entries["point"][large]]), "b": np.concatenate([np.maximum(p, q), np.zeros(len(large), np.int64)]),
            "band": np.concatenate([entries["band"][i], entries["band"][large]]).astype(np.int32), "key": np.concatenate([none, entries["key"][large].view(np.int64)]), "size": np.concatenate([none, size]),
        })

    turns = []
    for first in range(0, bands, TURN):
        sources = coded.select("point", F.xxhash64("label", "dim").alias("kind"), "short", "sides")
        entries = sources.mapInArrow(deal(first, min(bands, first + TURN)), "group long, entries binary")
        turns.append(scratch.stage(entries.groupBy("group").applyInPandas(meet, "a long, b long, band int, key long, size long"), "met"))
        del entries
        scratch.drop()  # a turn's shuffle files go before the next
    met = reduce(DataFrame.unionByName, turns)

    # pairs of small buckets: estimated one by one
    side = lambda x, *cs: coded.select(F.col("point").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "dim", "sides", *cs)])
    pairs = scratch.stage(met.filter("size = 0").groupBy("a", "b").agg(F.min("band").alias("band")), "pairs")

    def estimate(batches):
        for frame in batches:
            for dim, part in frame.groupby("dim_a"):
                signs, levels = stacked(part["signs_a"]), stacked(part["levels_b"], np.int8)
                part = part[likely_pairs(signs, part["factor_a"].to_numpy(), levels[:, : int(dim)], part["step_b"].to_numpy(), threshold)]
                if len(part):
                    keys = [band_keys(stacked(part[c]), bits, 0, bands) for c in ("sides_a", "sides_b")]
                    earlier = (keys[0] == keys[1]) & (np.arange(bands)[None, :] < part["band"].to_numpy()[:, None])
                    yield part[["a", "b"]].assign(first=~earlier.any(axis=1))

    both = pairs.join(side("a", "signs", "factor"), "a").join(side("b", "levels", "step"), "b").filter("label_a = label_b and dim_a = dim_b")
    few = scratch.stage(both.mapInPandas(estimate, "a long, b long, first boolean"), "pairs-in-doubt")

    # where a bucket is large, its members go to hashed blocks, and each pair of blocks is a group
    inside = met.filter("size > 0").select(F.col("a").alias("point"), "band", "key", F.ceil(F.col("size") / (per_block // 2)).cast("int").alias("wide"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("point"), F.col("wide")).cast("int"))
    blocks = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    blocks = blocks.select("key", "band", "point", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    by_code = blocks.withColumn("task", F.xxhash64("key", "a", "b")).join(coded.select("point", "label", "dim", "signs", "levels", "factor", "step"), "point")
    place = ["dim", "task", "label", "key", "a", "b", "band", "block", "point"]

    def doubt(frame: pd.DataFrame) -> pd.DataFrame:
        """Members that have a partner in doubt, with their place in their block, and for those of the first block one bit for each place of the second."""
        frame = frame.sort_values(list(MEETING), kind="stable").reset_index(drop=True)
        dim = int(frame["dim"].iloc[0])
        signs, levels = stacked(frame["signs"]), stacked(frame["levels"], np.int8)
        factor, step, block = (frame[c].to_numpy() for c in ("factor", "step", "block"))
        stays, at, bits = np.zeros(len(frame), bool), np.zeros(len(frame), np.int32), np.full(len(frame), b"", object)
        for s, e in meetings(frame):
            a, b = frame["a"].iloc[s], frame["b"].iloc[s]
            own = np.arange(s, e)
            left, right = own[block[s:e] == a], own[block[s:e] == b]
            maybe = likely(signs[left], factor[left], levels[right][:, :dim], step[right], threshold)
            if a == b:
                maybe = np.triu(maybe | maybe.T, 1)
            at[left], at[right] = np.arange(len(left)), np.arange(len(right))
            stays[left] |= maybe.any(axis=1)
            stays[right] |= maybe.any(axis=0)
            for i in np.flatnonzero(maybe.any(axis=1)):
                bits[left[i]] = np.packbits(maybe[i]).tobytes()
        return frame.assign(at=at, doubts=bits).loc[stays, [*place, "at", "doubts"]]

    unsure = scratch.stage(by_code.groupBy("dim", "task").applyInPandas(doubt, by_code.select(*place).schema.add("at", "integer").add("doubts", "binary")), "in-doubt")
    wanted = few.select(F.col("a").alias("point")).union(few.select("b")).union(unsure.select("point")).distinct()
    fetched = vectors_of(scratch.stage(wanted, "wanted")).select("point", "v").join(points.select("point", "dim", "copies"), "point")
    fetched = scratch.stage(fetched, "fetched")
    sides = coded.select("point", "sides")
    grouped = unsure.join(fetched.drop("dim"), "point").join(sides, "point")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Exact inner products of the pairs in doubt, and of no others."""
        frame = frame.sort_values([*MEETING, "block", "at"], kind="stable").reset_index(drop=True)
        x, keys = unit(frame["v"]), stacked(frame["sides"])
        ids, copies, block, at, doubts, band = (frame[c].to_numpy() for c in ("point", "copies", "block", "at", "doubts", "band"))
        counts, edges = np.zeros(len(ids), np.int64), []
        for s, e in meetings(frame):
            own = np.arange(s, e)
            right = own[block[s:e] == frame["b"].iloc[s]]
            row_at = np.zeros(at[right].max() + 1, np.int64)
            row_at[at[right]] = right
            asks = [k for k in range(s, e) if doubts[k]]
            partners = [row_at[np.flatnonzero(np.unpackbits(np.frombuffer(doubts[k], np.uint8)))] for k in asks]
            i, j = np.repeat(asks, [len(p) for p in partners]), np.concatenate(partners)
            near = inner_products(x, i, j) >= threshold
            i, j = i[near], j[near]
            if not len(i):
                continue
            # a pair counts in the first band in which it meets
            earlier = band_keys(keys[s:e], bits, 0, int(band[s]))
            first = ~np.logical_or.reduce([k[i - s] == k[j - s] for k in earlier.T]) if band[s] else np.ones(len(i), bool)
            np.add.at(counts, i[first], copies[j[first]])
            np.add.at(counts, j[first], copies[i[first]])
            edges += [(s + p, s + q) for p, q in forest(e - s, i - s, j - s)]
        some, found = np.flatnonzero(counts), np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"point": np.concatenate([ids[some], ids[found[:, 0]]]), "other": np.concatenate([np.full(len(some), -1), ids[found[:, 1]]]), "n": np.concatenate([counts[some], np.zeros(len(found), np.int64)])})

    def multiply(batches):
        for frame in batches:
            for _, part in frame.groupby("dim_a"):
                m = len(part)
                near = inner_products(np.concatenate([unit(part["v_a"]), unit(part["v_b"])]), np.arange(m), np.arange(m) + m) >= threshold
                part = part[near]
                counted = part[part["first"]]
                yield pd.DataFrame({
                    "point": np.concatenate([part["a"], counted["a"], counted["b"]]), "other": np.concatenate([part["b"], np.full(2 * len(counted), -1)]),
                    "n": np.concatenate([np.zeros(len(part), np.int64), counted["copies_b"], counted["copies_a"]]),
                })

    large = scratch.stage(grouped.groupBy("dim", "task").applyInPandas(compare, "point long, other long, n long"), "links")
    of = lambda x: fetched.select(F.col("point").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("v", "dim", "copies")])
    small = scratch.stage(few.join(of("a"), "a").join(of("b"), "b").mapInPandas(multiply, "point long, other long, n long"), "links")
    found = large.unionByName(small)
    scratch.drop(coded, *turns, pairs, few, unsure, fetched)
    counts = found.filter("n > 0").groupBy("point").agg(F.sum("n").alias("n"))
    classes = components(found.filter("n = 0").select(F.col("point").alias("a"), F.col("other").alias("b")).distinct(), scratch.stage).withColumnRenamed("node", "point")
    least = points.join(classes, "point").groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").drop("component")
    of_point = points.join(counts, "point", "left").join(classes, "point", "left")
    of_point = of_point.select("point", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    out = everyone.select("vec_id", "point").join(of_point, "point", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return stage(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near-vectors")


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
