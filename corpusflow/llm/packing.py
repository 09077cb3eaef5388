"""Packing: non-negative least squares over shallow length combinations, the rest packed greedily."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches, stage

WINDOW, END_ID = 4096, 2
#: Lengths count in steps of this many tokens, rounded up, where combinations are solved.
STEP = 16
#: Words a worker keeps the ids of, without the punctuation after them; later ones are encoded anew each time.
CACHE = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Python's split() also takes these for white space, the tokenizer doesn't.
ODD = "\x1c\x1d\x1e\x1fΣ"
#: Words that the tokenizer's normalizer leaves as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Punctuation between such a word and white space: a piece of its own.
TAIL = re.compile(r"([!-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)[!-/:-@\[-`{-~]*)(?=\s|$)")


class WordEncoder:
    """The tokenizer's ids as little-endian unsigned 32-bit bytes. Its pieces never span white space, so ids are kept by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.kept: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str], tokenizer) -> list[bytes]:
        """Of words of letters alone: each is one run of ids, and only its last id ends a word, so one call does for all."""
        if not words:
            return []
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(words):
            return self._encode(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _core(self, word: str) -> tuple[str, str]:
        core = word.rstrip(punctuation)
        return (core, word[len(core) :]) if core.isalpha() else (word, "")

    def _learnt(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't kept; keeps them while there is room."""
        kept = self.kept
        parts = {w: self._core(w) for w in missing}
        new = {p for pair in parts.values() for p in pair if p and p not in kept}
        kinds = [[], [], []]
        for p in new:
            kinds[0 if PLAIN.fullmatch(p) else 1 if p.isalpha() else 2].append(p)
        plain, letters, others = kinds
        found = dict(zip(plain + letters + others, self._encode_letters(plain, self.bare) + self._encode_letters(letters, self.tokenizer) + self._encode(others), strict=True))
        whole = {w: b"".join(found[p] if p in found else kept[p] for p in pair if p) for w, pair in parts.items()}
        if len(kept) < CACHE:
            kept |= found
            kept |= whole
        return whole

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in ODD):
            return self._encode([text])[0]
        words = TAIL.sub(r" \1", text.lower()).split() if "<|" not in text else text.split()
        ids = list(map(self.kept.get, words))
        if None in ids:
            whole = self._learnt({w for w, x in zip(words, ids, strict=True) if x is None})
            ids = [whole[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker, so that words are learnt once."""
    return WordEncoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``window`` ids; only documents longer than a window are cut."""

    def cut(batches: Iterator) -> Iterator:
        import os
        from zlib import crc32

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder_for(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                rows += [(doc_id, at, min(window, total - at), crc32(ids[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def combinations(bins: int, present: set[int]) -> list[tuple[int, ...]]:
    """Shallow combinations of present bins that fill ``bins`` exactly: up to three lengths, or copies of one and a filler."""
    out = {(bins,)} if bins in present else set()
    for a in sorted(present):
        for b in (b for b in present if b <= a and a + b <= bins):
            if a + b == bins:
                out.add((a, b))
            elif (c := bins - a - b) <= b and c in present:
                out.add((a, b, c))
        for k in range(2, bins // a + 1):
            rest = bins - k * a
            if not rest or rest in present:
                out.add(tuple(sorted((a,) * k + ((rest,) if rest else ()), reverse=True)))
    return sorted(out, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares of a x = b with x >= 0 by an active set: the column of the steepest gain enters, columns that turn negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if active.sum() >= a.shape[0] or gain.max(initial=-np.inf) <= tolerance:
            break
        active[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > tolerance * 1e-3).all():
                x[:] = 0
                x[at] = solved
                break
            low = solved <= tolerance * 1e-3
            step = np.min(x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300))
            x[at] += step * (solved - x[at])
            drop = at[low & (x[at] <= tolerance)]
            active[drop if len(drop) else at[low][:1]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def repeat_counts(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use each combination: the least-squares solution, rounded, never above what the histogram holds."""
    ways = combinations(bins, set(histogram))
    if not ways:
        return []
    rows = {b: k for k, b in enumerate(sorted(histogram))}
    a = np.zeros((len(rows), len(ways)))
    for j, way in enumerate(ways):
        for b in way:
            a[rows[b], j] += 1
    have = np.array([histogram[b] for b in sorted(histogram)], float)
    x = nnls(a, have)
    left, out = have.astype(np.int64), []
    for j in sorted(range(len(ways)), key=lambda j: -x[j]):
        if x[j] < 0.5:
            break
        need = a[:, j].astype(np.int64)
        times = int(min(math.floor(x[j] + 0.5), *(left[need > 0] // need[need > 0])))
        if times > 0:
            left -= times * need
            out.append((ways[j], times))
    return out


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: longest first, each into the fullest sequence that still has room."""
    order = np.argsort(-lengths, kind="stable")
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    nonempty = np.zeros(window + 1, bool)
    for i in order:
        n = int(lengths[i])
        room = n + int(nonempty[n:].argmax()) if nonempty[n:].any() else 0
        if room:
            s = open_by_room[room].pop()
            nonempty[room] = bool(open_by_room[room])
        else:
            s, room = len(used), window
            used.append(0)
        sequence[i], offset[i] = s, used[s]
        used[s] += n
        if room > n:
            open_by_room[room - n].append(s)
            nonempty[room - n] = True
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, step: int = STEP, per_group: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, nth, ...); ``nth`` tells equal ones apart, so that no part gets them all.

    The driver sees the histogram (``window / step`` counts at most) and the combinations chosen. Pieces of a length are numbered in
    hashed parts whose counts add up, so a length that very many pieces share is no single task's work; each number falls into one
    interval of a combination's repeats. What no combination takes is packed best-fit in hashed groups of about ``per_group``.
    Repeated rows are packed each; an empty table gives no rows.
    """
    spark, bins = pieces.sparkSession, window // step
    binned = pieces.withColumn("bin", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}
    total = sum(counts.values())
    chosen = repeat_counts(counts, bins)
    used, base, intervals = dict.fromkeys(counts, 0), 0, []
    for way, times in chosen:
        for slot, b in enumerate(way):
            intervals.append((b, used[b], used[b] + times, base - used[b], slot))
            used[b] += times
        base += times
    parts = max(1, total // 2_000)
    salted = binned.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(parts)).cast("int"))
    by_part = salted.groupBy("bin", "part").count()
    before = by_part.withColumn("before", F.sum("count").over(W.partitionBy("bin").orderBy("part")) - F.col("count")).drop("count")
    numbered = salted.withColumn("at", F.row_number().over(W.partitionBy("bin", "part").orderBy("doc_id", "start", "ids_crc32", "nth"))).join(before, ["bin", "part"])
    numbered = (scratch.stage if scratch else stage)(numbered.withColumn("at", F.col("before") + F.col("at") - 1).drop("before", "part"), "numbered-pieces")
    ways = spark.createDataFrame(intervals, "way_bin int, from_nth long, to_nth long, shift long, slot int")
    # at most a few intervals per combination and bin: their number doesn't grow with the data
    placed = numbered.join(F.broadcast(ways), (F.col("bin") == F.col("way_bin")) & (F.col("at") >= F.col("from_nth")) & (F.col("at") < F.col("to_nth")), "left")
    names = [*pieces.columns, "sequence_id", "offset"]
    fixed = placed.filter("slot is not null").withColumn("sequence_id", F.col("at") + F.col("shift"))
    fixed = fixed.withColumn("offset", F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot")) - F.col("length"))
    rest = placed.filter("slot is null").select(*pieces.columns)
    groups = max(1, (total - sum(used.values())) // per_group)

    def greedy(key, frame):
        s, o = best_fit(frame["length"].to_numpy(), window)
        return frame.drop(columns="group").assign(sequence_id=base + (int(key[0]) << 32) + s, offset=o)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = rest.withColumn("group", F.pmod(F.xxhash64(F.lit("rest"), "doc_id", "start", "ids_crc32", "nth"), F.lit(groups))).groupBy("group").applyInPandas(greedy, schema)
    return fixed.select(*names).unionByName(packed.select(*names))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenizes and packs every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    Null and empty texts are the end id alone; other columns of ``docs`` are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    with Scratch(docs.sparkSession) as scratch:
        with small_batches(docs.sparkSession):
            pieces = scratch.stage(tokenized_pieces(docs, tokenizer, window).withColumn("nth", F.monotonically_increasing_id()), "pieces")
        return stage(pack(pieces, window, scratch=scratch).drop("nth"), "packed")


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
