"""Best-fit decreasing packing against the plain fold over pieces, and whole texts through the tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm.best_fit import Rooms, best_fit_plan, pack_tightly

from .helpers import docs, text_of, with_clashes


def plain(lengths: list[int], window: int) -> list[list[int]]:
    """Each piece, longest first, into the sequence with the least room that takes it, by a look at all of them."""
    sequences: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in sequences if sum(s) + n <= window]
        if fits:
            max(fits, key=sum).append(n)
        else:
            sequences.append([n])
    return sequences


def test_tightest_room():
    draw, rooms, have = random.Random(1), Rooms(50), Counter()
    for _ in range(2000):
        room = draw.randint(0, 50)
        n = -1 if have[room] and draw.random() < 0.5 else 1
        have[room] += n
        rooms.add(room, n)
        least = draw.randint(1, 50)
        assert rooms.tightest(least) == min((r for r, k in have.items() if k and r >= least), default=None)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_the_plain_fold(seed):
    draw = random.Random(seed)
    window = draw.choice([7, 16, 50, 100])
    lengths = [draw.randint(1, draw.choice([3, window // 2, window])) for _ in range(draw.choice([0, 1, 40, 300]))] + [draw.randint(1, window)] * draw.choice([0, 200])
    counts = Counter(lengths)
    got = defaultdict(list)
    plan = best_fit_plan(dict(counts), window)
    for k, (first, each, start, used, n) in enumerate(plan.tolist()):
        last = plan[k + 1, 0] if k + 1 < len(plan) else len(lengths)
        for i in range(last - first):
            got[start + i // each].append((used + i % each * n, n))
    for s in got.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
    # which of several sequences with equal room takes a piece is free, so their contents may differ, never how full they are
    assert sorted(sum(n for _, n in s) for s in got.values()) == sorted(map(sum, plain(lengths, window)))


def test_plan_does_not_grow_with_the_pieces():
    draw = random.Random(3)
    counts = {n: draw.randint(1, 50) for n in range(1, 1025)}
    assert len(best_fit_plan({n: k * 10_000 for n, k in counts.items()}, 1024)) < 30 * 1024


def test_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    draw = random.Random(8)
    texts = {i: text_of(draw, draw.choice([0, 3, 40, 300, 900, 2500])) for i in range(60)} | {100: None, 101: "", 102: "naïve café… <|endoftext|>", 103: text_of(draw, 30_000), 104: "b " * 4095}
    got = pack_tightly(with_clashes(docs(spark, [*texts.items(), *[(3, texts[3])] * 40, (None, "x")]))).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in [*texts.items(), (None, "x")]}
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["piece"] * 4096 == r["start"] and len(own) == r["length"] and zlib.crc32(np.asarray(own, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]][r["start"], r["length"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in ids.items():
        assert pieces[d] == Counter({(at, min(4096, len(own) - at)): 41 if d == 3 else 1 for at in range(0, len(own), 4096)})
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(sequences) == len(plain([r["length"] for r in got], 4096))


def test_nothing(spark):
    assert pack_tightly(docs(spark, {1: "x"}).limit(0)).count() == 0
