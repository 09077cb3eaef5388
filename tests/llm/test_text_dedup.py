"""Line runs, sentence dedup and the Jaccard join against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corpusflow.llm import jaccard
from corpusflow.llm.common import Scratch
from corpusflow.llm.jaccard import Plan, jaccard_components
from corpusflow.llm.line_runs import OP1_SQL, op1_line_runs, repeated_runs, without_runs
from corpusflow.llm.unit_dedup import ALL, repeated_units, without_units

from ..conftest import SMALL
from .helpers import docs, text_of, with_clashes


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


# -- line runs
def brute_runs(texts, lines, min_chars=8):
    norm = {d: [" ".join(re.split(r"[\x20\x09-\x0d]+", x)).strip(" ").lower() for x in t.split("\n")] for d, t in texts.items() if t is not None}
    seen, gone = {}, defaultdict(set)
    for d in sorted(norm):
        for p in range(len(norm[d]) - lines + 1):
            run = tuple(norm[d][p : p + lines])
            if all(len(x) >= min_chars for x in run):
                if run in seen:
                    gone[d] |= set(range(p, p + lines))
                seen.setdefault(run, (d, p))
    return gone


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_runs_equal_brute_force(spark, lines):
    draw = random.Random(lines)
    pool = [text_of(draw, 4) for _ in range(12)]
    texts = {i: "\n".join(draw.choice(pool) if draw.random() < 0.8 else text_of(draw, 5) for _ in range(draw.randint(1, 20))) for i in range(40)}
    texts |= {100: None, 101: "", 102: "short\nshort", 103: texts[3], 104: "\n".join(["the same line again"] * 9)}
    df = with_clashes(docs(spark, texts))
    runs = repeated_runs(df, min_lines=lines)
    got = defaultdict(set)
    for r in runs.collect():
        got[r["doc_id"]] |= set(range(r["start_line"], r["start_line"] + r["n_lines"]))
    want = brute_runs(texts, lines)
    assert {d: s for d, s in got.items() if s} == {d: s for d, s in want.items() if s}
    left = {r["doc_id"]: r["text"] for r in without_runs(df, runs).collect()}
    assert left[100] is None and len(left) == len(texts)
    for d, t in texts.items():
        if t is not None:
            assert left[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])


def test_runs_where_no_round_splits(spark):
    """Two copies of one text: each line's rank says already what follows."""
    t = "\n".join(f"line number {i}" for i in range(6))
    got = repeated_runs(docs(spark, {1: t, 2: t}), min_lines=3).drop("k1").collect()
    assert [tuple(r) for r in got] == [(2, 0, 6, 1, 0)]


def test_runs_of_nothing(spark):
    assert repeated_runs(docs(spark, {1: "x"}).limit(0)).count() == 0
    twice = docs(spark, [(1, "a long line here\nb long line here"), (1, "a long line here\nb long line here")])
    assert repeated_runs(twice).count() == 0


def test_runs_equal_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = "doc_id, start_line, n_lines, source_doc_id, source_line"
    want = sorted(duckdb.sql(f"SELECT {names} FROM ({OP1_SQL})").fetchall())
    assert sorted(map(tuple, op1_line_runs(spark, SMALL).select(*names.split(", ")).collect())) == want


def brute_maximal(texts, lines):
    """Longest earlier copy at each line, by comparing all places; those within the copy of the line before go."""
    places = [(d, p) for d in sorted(texts) for p in range(len(texts[d]))]
    rows = []
    for k, (d, p) in enumerate(places):
        best, reach = (0, None), 0
        for e, q in places[:k]:
            n = 0
            while p + n < len(texts[d]) and q + n < len(texts[e]) and texts[d][p + n] == texts[e][q + n]:
                n += 1
            best = max(best, (n, (e, q)), key=lambda x: x[0])
        if rows and rows[-1][0] == d:
            reach = max(r[1] + r[2] for r in rows if r[0] == d)
        if best[0] and p + best[0] > reach:
            rows.append((d, p, best[0], *best[1]))
    return [r for r in rows if r[2] >= lines]


def test_runs_are_maximal(spark):
    a, b, c, x, y = (f"this is line {i}" for i in "abcxy")
    texts = {1: [x, a, b], 2: [y, a, b, c], 5: [a, b, c]}
    got = repeated_runs(docs(spark, {d: "\n".join(t) for d, t in texts.items()})).drop("k1").collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2, 1, 1), (5, 0, 3, 2, 1)] == brute_maximal(texts, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_runs_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [text_of(draw, 4) for _ in range(4)]
    texts = {i: [draw.choice(pool) if draw.random() < 0.93 else text_of(draw, 5) for _ in range(draw.randint(1, 25))] for i in range(25)}
    for i in range(25, 40):
        t = list(texts[draw.randrange(25)])
        t[draw.randrange(len(t))] = draw.choice(pool)
        texts[i] = t[draw.randrange(3) :] + texts[draw.randrange(25)]
    texts |= {100: ["the same line again"] * 9, 101: texts[30]}
    got = repeated_runs(docs(spark, {d: "\n".join(t) for d, t in texts.items()})).drop("k1").collect()
    assert sorted(map(tuple, got)) == brute_maximal(texts, 2)


def test_runs_cross_blank_lines_and_one_long_line_is_a_run(spark):
    draw = random.Random(9)
    passage, floor, less = text_of(draw, 60), text_of(draw, 50), " ".join(["word"] * 49)
    texts = {
        1: "first paragraph here\n\nsecond paragraph here\nab\nthird paragraph here",
        2: "opening of the copy\nfirst paragraph here\n\n  \nsecond paragraph here\ncd\nthird paragraph here\nthe end of it",
        3: f"{passage}\nown text of three\n{less}\n{floor}",
        4: f"own text of four\n{passage}\nmore own text of four\n{less}",
        5: floor.upper(),
        6: "あ" * 300,
        7: "あ" * 300 + "\n\nsome more text",
    }
    df = docs(spark, texts)
    runs = repeated_runs(df)
    assert sorted(map(tuple, runs.drop("k1").collect())) == [(2, 1, 6, 1, 0), (4, 1, 1, 3, 0), (5, 0, 1, 3, 3), (7, 0, 1, 6, 0)]
    left = {r["doc_id"]: r["text"] for r in without_runs(df, runs).collect()}
    assert left == texts | {2: "opening of the copy\ncd\nthe end of it", 4: f"own text of four\nmore own text of four\n{less}", 5: "", 7: "\nsome more text"}


def test_runs_of_repeated_and_null_ids(spark):
    """Texts that share an id, and null ids, are documents of their own: unique lines stay whatever id they stand under."""
    shared, own = "first shared line\nsecond shared line", "lines of its own\nand no one else's"
    df = with_clashes(docs(spark, [(1, shared), (2, f"head of two\n{shared}"), (2, own), (None, f"null has\n{shared}"), (None, own.upper() + "!"), (2, own)]))
    runs = repeated_runs(df)
    assert sorted(map(tuple, runs.drop("k1").collect()), key=str) == [(2, 1, 2, 1, 0), (None, 1, 2, 1, 0)]
    left = without_runs(df, runs)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, shared), (2, "head of two"), (2, own), (None, "null has"), (None, own.upper() + "!"), (2, own)])


# -- sentences
def test_units_equal_brute_force(spark):
    draw = random.Random(5)
    pool = [text_of(draw, draw.randint(3, 9)).capitalize() + "." for _ in range(15)]
    texts = {i: draw.choice([" ", "\n"]).join(draw.choice(pool) if draw.random() < 0.7 else text_of(draw, 7) + "." for _ in range(draw.randint(1, 15))) for i in range(30)}
    texts |= {50: None, 51: "", 52: "Größe und Maß sind hier gleich lang. " * 3}
    seen, want = {}, []
    for d in sorted(k for k, t in texts.items() if t):
        at, t = 0, texts[d]
        for m in [*re.finditer(r"[.!?][\x20\t]+|\n+", t), None]:
            s, at = at, m.end() if m else len(t)
            norm = " ".join(t[s:at].lower().split())
            if len(norm.split()) >= 5 and len(norm) >= 24 and at - s >= 24:
                if norm in seen:
                    want.append((d, s, at, seen[norm]))
                seen.setdefault(norm, d)
    df = with_clashes(docs(spark, texts))
    found = repeated_units(df, min_words=5)
    assert sorted(map(tuple, found.drop("k1").collect())) == sorted(want)
    left = {r["doc_id"]: r["text"] for r in without_units(df, found).collect()}
    for d, t in texts.items():
        spans = sorted((s, e) for x, s, e, _ in want if x == d)
        keep, at = "", 0
        for s, e in spans:
            keep, at = keep + t[at:s], e
        assert left[d] == (keep + t[at:] if t is not None else None)
    assert repeated_units(df.limit(0)).count() == 0


def test_units_of_all_kinds(spark):
    """A line or a paragraph of short sentences goes whole; a place counts once, whatever its kinds."""
    line = "Go on. Not yet. Be still. Who is it? Come in. Sit down."
    whole = "Short one.\nShort two.\nShort three here."
    texts = {1: f"\n{line}\nown words of one", 2: f"own words of two\n{line}\nrest", 3: f"{whole}\n\ntail of three", 4: f"head of four\n\n{whole}", 5: f"\n\n{line.lower()}"}
    df = docs(spark, texts)
    removed = repeated_units(df, ALL, min_words=5)
    assert sorted({(r["doc_id"], r["kept_doc_id"]) for r in removed.collect()}) == [(2, 1), (4, 3), (5, 1)]
    left = {r["doc_id"]: r["text"] for r in without_units(df, removed).collect()}
    assert {d: t.strip() for d, t in left.items()} == {1: texts[1].strip(), 2: "own words of two\nrest", 3: texts[3], 4: "head of four", 5: ""}


def test_runs_of_short_units(spark):
    """A passage of short sentences within a line, and one word said many times, are found; within one document they stay."""
    short = " ".join(f"The {w} goes on and on here." for w in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"))
    texts = {1: f"It stands in one. {short} End.", 2: f"Here it is again. {short} And more.", 3: "so " * 60 + "once", 4: "it is " + "so " * 45 + "twice", 5: "Oh. " * 60, 6: "so " * 20 + "short"}
    df = docs(spark, texts)
    assert repeated_units(df, ALL).count() == 0
    removed = repeated_units(df, ALL, run_words=25, same_words=40)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in removed.collect()} == {(2, 1), (4, 3)}
    left = {r["doc_id"]: r["text"] for r in without_units(df, removed).collect()}
    assert left == texts | {2: "Here it is again. And more.", 4: "it is  twice"}


def test_units_of_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(16)) + "." for w in ("alpha", "beta", "gamma"))
    df = docs(spark, [(1, f"{one} {two}"), (2, f"{one} tail"), (2, three), (2, three), (None, f"{two} {three} end"), (None, "its own words " * 6)])
    removed = repeated_units(df)
    assert sorted((r["doc_id"] or 0, r["kept_doc_id"]) for r in removed.collect()) == [(0, 1), (0, 2), (2, 1)]
    left = Counter((r["doc_id"], r["text"].strip()) for r in without_units(df, removed).collect())
    assert left == Counter([(1, f"{one} {two}"), (2, "tail"), (2, three), (2, three), (None, "end"), (None, ("its own words " * 6).strip())])


# -- Jaccard
def shingles(t, words):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def near(draw, t, changes):
    w = t.split()
    for _ in range(changes):
        k = draw.randrange(len(w) or 1)
        w[k : k + 1] = draw.choice([[], ["new" + str(draw.random())], [*w[k : k + 1], "more"]])
    return " ".join(w)


def corpus(seed):
    draw = random.Random(seed)
    texts = {}
    for i in range(25):
        t = text_of(draw, draw.choice([1, 3, 5, 8, 14, 30, 60, 150, 400]))
        for _ in range(draw.randint(1, 6)):
            texts[len(texts)] = near(draw, t, draw.choice([0, 0, 1, 2, 3, 8])) if len(t.split()) > 3 else t
    shared = text_of(draw, 40)
    for i in range(60):
        texts[len(texts)] = shared + " " + text_of(draw, draw.randint(3, 30))
    texts |= {900: None, 901: "", 902: "  \t\n", 903: "Alpha BETA", 904: "alpha beta", 905: "ÀB c d e", 906: "àb c d e"}
    return texts


@pytest.mark.parametrize("words, num, den, direct", [(4, 85, 100, 8), (4, 85, 100, 0), (5, 4, 5, 0), (3, 9, 10, 10**6)])
def test_components_equal_brute_force(spark, monkeypatch, words, num, den, direct):
    """With no pairs to spend every open list goes to deletions and hubs, with many every list is compared as it is."""
    monkeypatch.setattr(jaccard, "DIRECT", direct)
    monkeypatch.setattr(jaccard, "CELL_STEPS", (100, 400, 1600))
    texts = corpus(words * den + min(direct, 128))
    # near copies of one text at the edge of the threshold, some of them with words of their own in common
    draw = random.Random(direct)
    base, extra = text_of(draw, 90), text_of(draw, 12)
    for i in range(70):
        t = near(draw, base, draw.choice([1, 2, 3, 4, 5]))
        texts[2000 + i] = t + " " + extra if i % 3 == 0 else t
    sets = {d: shingles(t, words) for d, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(with_clashes(docs(spark, texts)), words, num, den).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_signatures_never_miss(spark):
    """Sets at the edge of the threshold share a signature, whole or with a deletion, at every size."""
    draw = np.random.default_rng(4)
    for num, den in ((85, 100), (4, 5)):
        plan = Plan(num, den)
        for n in [*range(1, 60), 97, 250, 1001]:
            for _ in range(6):
                m = int(draw.integers(n, n * den // num + 1))
                common = -(-num * (n + m) // (num + den))
                if common > n:
                    continue
                a = draw.integers(0, 2**63, n, dtype=np.uint64)
                b = np.concatenate((a[:common], draw.integers(0, 2**63, m - common, dtype=np.uint64)))
                rows, h = np.repeat([0, 1], [n, m]), np.concatenate((np.sort(a), np.sort(b)))
                for deletions in (False, True):
                    r, s = plan.signatures(rows, h, np.array([n, m]), deletions)
                    assert set(s[r == 0].tolist()) & set(s[r == 1].tolist()), (n, m, deletions)
                # of fine segments the rarest that each needs, by an order in which those in common come last if they can
                groups = list(plan.groups(rows, h, np.array([n, m]), fine=True))
                both = set.intersection(*({x for r, s, _ in groups for x in s[r == k].tolist()} for k in (0, 1)))
                posted = [{x for r, s, need in groups for x in sorted(s[r == k].tolist(), key=lambda x: (x in both, x))[: need[k]]} for k in (0, 1)]
                assert posted[0] & posted[1], (n, m)


def test_join_edges(spark):
    assert jaccard_components(docs(spark, {1: "x"}).limit(0)).count() == 0
    got = jaccard_components(docs(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, None)]))
    assert Counter(map(tuple, got.collect())) == Counter({(3, 2, 2): 2, (2, 2, 2): 1, (None, 2, 2): 1, (None, 1, None): 1, (None, 0, None): 1})
    one, two = "a b c d e f", "u v w x y z"
    got = jaccard_components(docs(spark, [(3, one), (3, two), (1, one), (5, two)]))
    assert Counter(map(tuple, got.collect())) == Counter({(3, 2, 1): 1, (1, 2, 1): 1, (3, 2, 3): 1, (5, 2, 3): 1})
    with pytest.raises(ValueError):
        jaccard.Plan(1, 2)


def test_a_pair_in_many_lists_is_made_once(spark, monkeypatch):
    """Nodes 1 and 2 share ten lists, with 3 and 4 besides in some; a class's own pairs are none."""
    lists = [(s, x, 100, c) for s in range(10) for x, c in ((1, 1), (2, 2), *((3, 3), (4, 3)) * (s > 6))]
    pair, made = jaccard.pair, []
    monkeypatch.setattr(jaccard, "pair", lambda df: made.append(df.count()) or pair(df))
    with Scratch(spark) as scratch:
        found = jaccard._Join(None, None, 4, Plan(85, 100), scratch).across(spark.createDataFrame(lists, "signature long, node long, n long, class long"))
        assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
    assert made == [5]


def test_a_groups_middle_is_its_pivot(spark):
    """Of two groups each, the member nearest to the others, whatever the pivot was."""
    sets = {1: range(100), 2: [*range(10, 100), *range(200, 210)], 3: [*range(90), *range(300, 310)], 4: range(50, 150), 5: range(1000, 1100), 6: range(1010, 1110), 7: range(1020, 1120)}
    member = spark.createDataFrame([(4 if x < 5 else 7, x, 100) for x in sets], "pivot long, node long, n long")
    with Scratch(spark) as scratch:
        found = jaccard._Join(None, None, 4, Plan(85, 100), scratch).centred(member, spark.createDataFrame([(x, [*i]) for x, i in sets.items()], "node long, items array<long>"))
        assert {r["node"]: r["pivot"] for r in found.collect()} == {x: 1 if x < 5 else 6 for x in sets}


def test_a_passage_of_many_texts_makes_no_lists(spark, monkeypatch):
    """Texts of which a third is the same passage have enough segments of their own, and post these from the start."""
    draw = random.Random(8)
    passage, made = text_of(draw, 50), []
    starred = jaccard._Join.starred
    monkeypatch.setattr(jaccard._Join, "starred", lambda self, lists: made.append(lists.count()) or starred(self, lists))
    got = jaccard_components(docs(spark, {i: f"{passage} {text_of(draw, 100)}" for i in range(60)}), words=4, num=85, den=100).collect()
    assert {r["component_id"] for r in got} == set(range(60))
    assert sum(made) == 0
