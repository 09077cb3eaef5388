"""Conversation repair against a brute-force version of the whole contract, and the edits against an enumeration of all of them."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import repair
from corpusflow.llm.repair import damaged, op13_run_length_repair, repair_conversations

from ..conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def edits(symbols: str) -> tuple[int, str]:
    """The cheapest edits of symbols by enumeration: every choice for each row, up to two inserts in each gap, and the pattern itself."""
    gaps = ["", "u", "a", "ua", "au"]
    best = (10**9, "")
    rows = [[("D", "", 4)] + ([] if s == "-" else [("K", s.lower(), 3 * s.isupper()), ("R", "u", 3 + 3 * s.isupper()), ("R", "a", 3 + 3 * s.isupper())]) for s in symbols]
    for own in itertools.product(*rows):
        for inserted in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = inserted[0] + "".join(r + g for (_, r, _), g in zip(own, inserted[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(c for *_, c in own) + 3 * sum(map(len, inserted))
                best = min(best, (cost, "I" * len(inserted[0]) + "".join(e + "I" * len(g) for (e, *_), g in zip(own, inserted[1:], strict=True))))
    return best


def cheapest(symbols: str) -> tuple[int, str]:
    """The same over (row, state) for longer conversations."""
    after = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i: int, last: str, spare: int) -> tuple[int, str]:
        found = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if spare:
            found += [(3 + c, "I" + e) for r, q in after[last].items() if r != "s" for c, e in [best(i, q, spare - 1)]]
        if i < len(symbols):
            s = symbols[i]
            found += [(4 + c, "D" + e) for c, e in [best(i + 1, last, 2)]]
            if s != "-":
                more = 3 * s.isupper()
                if s.lower() in after[last]:
                    found += [(more + c, "K" + e) for c, e in [best(i + 1, after[last][s.lower()], 2)]]
                found += [(3 + more + c, "R" + e) for r, q in after[last].items() if r != "s" for c, e in [best(i + 1, q, 2)]]
        return min(found, default=(10**9, ""))

    return best(0, "", 2)


def digest(conv, role: str, text: str) -> int:
    h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42)
    for x in ("" if conv is None else f"c{conv}", role, text):
        h = xxhash.xxh64_intdigest(x.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def brute(rows: list[tuple]) -> dict:
    spaced = lambda x: " " if x is None else str(x)
    conversations: dict = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        role, text = spaced(role), spaced(text)
        way = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        own += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], digest(conv, r[1], r[2])))  # noqa: B023
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        symbols = "".join("-" if f in ("blank", "duplicate") else (x if x and x in "sua" else "x") if f != "truncated" else (x if x and x in "sua" else "x").upper() for x, f in zip(initials, faults, strict=True))
        cost, audit = cheapest(symbols)
        lines, at, last = [], 0, ""
        for e in audit:
            following = "a" if last == "u" else "u"
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[following] + ":")
                last = following
                continue
            _, role, text = own[at]
            at += 1
            if e == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[following] + f":{text}")
                last = following
        turns = {r[0] for r in own} - {None}
        count = lambda f: faults.count(f)  # noqa: B023, E731
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(frame) -> dict:
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def of_symbols(symbols: str, cut: int | None = None) -> tuple[int, str]:
    runs = repair.collapse((s, 1) for s in symbols)
    audit, state, cost = repair.unroll(runs, repair.NOTHING, repair.LAST)
    return cost, audit + repair.final_inserts(state)


def test_edits_equal_enumeration():
    for n in range(3):
        for own in itertools.product("suaxSUA-", repeat=n):
            assert of_symbols("".join(own)) == edits("".join(own)) == cheapest("".join(own))
    draw = random.Random(2)
    for _ in range(25):
        own = "".join(draw.choice("suaxSUAX-") for _ in range(3))
        assert of_symbols(own) == edits(own) == cheapest(own)


def test_runs_equal_single_rows():
    draw = random.Random(4)
    for _ in range(300):
        own = "".join(draw.choice("suaxSUAX-") * draw.choice([1, 1, 2, 7]) for _ in range(draw.randint(0, 14)))
        assert of_symbols(own) == cheapest(own)
        runs = repair.collapse((s, 1) for s in own)
        assert repair.before(repair.run_matrix(runs), repair.LAST)[repair.NOTHING] == cheapest(own)[0]
    assert repair.run_before("-", 10**12, repair.LAST)[repair.NOTHING] == 4 * 10**12


def made(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", "  \n", None, "What?", "well...", "x" * 40 + "a.", "x" * 40 + "b.", "très bien !", "word " * 400 + "end."]
    rows = [(draw.choice([c, c, None]), draw.choice([t, t, t + 2, None]), draw.choice(["user", "assistant", "system", "tool", None, "", "ukulele", "User"]), draw.choice(texts)) for c in range(40) for t in range(draw.randint(1, 9))]
    # a third of the rows are one conversation, and a tenth one row
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", draw.choice(texts)) for t in range(len(rows) // 2)]
    rows += [(1001, 5, "user", "Again.")] * (len(rows) // 10)
    return rows


@pytest.mark.parametrize(("seed", "per_range"), [(1, 20_000), (2, 7), (3, 50)])
def test_repair_equals_brute_force(spark, seed, per_range):
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("conv", "range", "fault", "n", "k1", "place", "initial", "piece", "way", "copy")})
    assert told(repair_conversations(damaged(frame), frame, per_range)) == brute(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_run_length_repair(spark, SMALL)
    assert told(got) == brute(rows)
    assert [t for _, t in got.select(*COLUMNS).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_nothing_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert told(repair_conversations(damaged(empty), empty)) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "Hello.")], SCHEMA)
    assert told(repair_conversations(damaged(frame), frame)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
