"""Packs of many cases and their recovery against a plain fold over one case at a time."""

from __future__ import annotations

from collections import defaultdict

from corpusflow.jobs.gate_jobs import RECOVERY, recovered_packs, recovery_tables
from corpusflow.operators.recovery import TYPED, Limits, evidence_packs

from .conftest import SMALL


def plain(elements: list, ranked: list, found: list, limits) -> tuple[list, tuple]:
    """One case: elements as (element, position, section, page, kind, noise, size), ranked elements, (reference, element) pairs."""
    by, at = {e[0]: e for e in elements}, {e[1]: e for e in elements}
    place = {e: i for i, e in enumerate(ranked)}
    references = sorted({r for r, _ in found})
    near = lambda e: [at[p] for p in (by[e][1] - 1, by[e][1] + 1) if p in at and at[p][2] == by[e][2]]

    def prose(e):
        return [x[0] for x in near(e) if by[e][4] in TYPED and x[4] == "paragraph" and not x[5] and by[e][3] in (None, x[3])]

    for k, limit in enumerate(limits, 1):
        protected = []
        for r in references:
            options = [e for q, e in found if q == r and e in place]
            if options and (best := min(options, key=place.get)) not in protected:
                protected.append(best)
        selected = protected + [e for e in ranked if e not in protected][: max(0, limit.candidates - len(protected))]
        primary = protected or selected[:1]
        around = []
        for e in selected:
            around += sorted((x[0] for x in near(e) if not x[5] and x[0] not in selected and x[0] not in around), key=lambda x: by[x][1])
        needed = {p for e in selected + around for p in prose(e)}
        rest = sorted(needed - set(selected) - set(around), key=lambda e: by[e][1])
        every = selected + around + rest
        order = primary + [e for e in every if e in needed and e not in primary] + [e for e in every if e not in needed and e not in primary]
        pack, used = [], 0
        for e in order:
            if len(pack) < limit.blocks and used + by[e][6] <= limit.size:
                pack, used = [*pack, e], used + by[e][6]
        lost = sum(1 for r in references if not any(e in pack for q, e in found if q == r))
        bare = len(needed - set(pack))
        if k == len(limits) or not (lost or bare):
            return pack, (k, len(pack), lost, bare, len(order) > len(pack))


def test_query_equals_the_plain_fold(spark):
    found, ranked, elements = (df.collect() for df in recovery_tables(spark, SMALL))
    cases = defaultdict(lambda: ([], [], []))
    for r in elements:
        cases[r["case"]][0].append((r["element"], r["position"], r["section"], r["page"], r["kind"], r["noise"], r["size"]))
    for r in sorted(ranked, key=lambda r: r["rank"]):
        cases[r["case"]][1].append(r["element"])
    for r in found:
        cases[r["case"]][2].append((r["reference"], r["element"]))
    want = {}
    for c, t in cases.items():
        pack, report = plain(*t, RECOVERY)
        want |= {(c, i): (e, *report) for i, e in enumerate(pack)}
    got = {(r["case"], r["block"]): (r["element"], r["round"], r["blocks"], r["missing_references"], r["missing_context"], r["limited"]) for r in recovered_packs(spark, SMALL).collect()}
    assert got == want and {v[1] for v in want.values()} == {1, 2}


def test_only_cases_that_miss_something_go_on(spark):
    kinds = "element int, position int, section int, page int, kind string, noise boolean, size int"
    rows = [(c, i, i, 1, None, "equation" if i % 2 else "paragraph", False, 10) for c in (1, 2, 3) for i in range(6)]
    elements = spark.createDataFrame(rows, f"case int, {kinds}")
    ranked = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (2, 3, 2), (2, 5, 3)], "case int, element int, rank int")
    found = spark.createDataFrame([(2, 0, 1), (2, 1, 5)], "case int, reference int, element int")
    packs, report = evidence_packs(spark.createDataFrame([(1,), (2,), (3,)], "case int"), ranked, found, elements, (Limits(2, 2, 1000), Limits(3, 9, 1000)))
    got = {r["case"]: (r["round"], r["blocks"], r["missing_references"], r["missing_context"]) for r in report.collect()}
    # the first needs no prose that doesn't fit, the second's equations do, the third has no candidates
    assert got[2][0] == 2 and got[2][2:] == (0, 0) and got[3] == (1, 0, 0, 0)
    assert {r["element"] for r in packs.filter("case = 2").collect()} >= {1, 5, 0, 2, 4}
