"""Programs of expressions: step graphs, bounded iteration, state machines, state sweeps, probes and effect tests, all as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import BOOLEAN, SCALAR, VECTOR, Value, checked, is_valid, need
from ..functions.expressions import Node, compiled, parse

#: The most iterations, and the most states of a sweep.
MAX_STEPS, MAX_STATES = 100, 128


def levels(steps: dict[str, Node]) -> list[list[str]]:
    """Steps by rounds: each needs only inputs and steps of earlier rounds. Raises for a cycle."""
    left, out = dict(steps), []
    while left:
        ready = sorted(n for n, e in left.items() if not e.references() & left.keys())
        need(bool(ready), "the steps depend on each other in a circle")
        out.append(ready)
        for n in ready:
            del left[n]
    return out


def run_program(df: DataFrame, inputs: dict[str, Value], steps: dict[str, str], invariants: list[str] = (), flag: bool = False) -> DataFrame:
    """``df`` with a column for every step and a boolean holds_1, holds_2 ... for every invariant.

    Steps go into one projection for each round, so each is computed once. A step that isn't a finite value is an error; with
    ``flag`` the column ``valid`` says instead whether all are, so that other rows of a sweep live on.
    """
    trees = {n: parse(e) for n, e in steps.items()}
    names, fine = dict(inputs), F.lit(True)
    for ready in levels(trees):
        made = {n: compiled(trees[n], names) for n in ready}
        df = df.withColumns({n: v.col if flag else checked(v, n) for n, v in made.items()})
        names |= {n: Value(v.kind, F.col(n)) for n, v in made.items()}
        for n in ready:
            fine = fine & is_valid(names[n])
    for k, text in enumerate(invariants, 1):
        held = compiled(parse(text), names)
        need(held.kind == BOOLEAN, "an invariant is boolean")
        df = df.withColumn(f"holds_{k}", held.col)
    return df.withColumn("valid", fine) if flag else df


def iterate(initial: dict[str, str], updates: dict[str, str], steps: int, names: dict[str, Value]) -> Column:
    """The history of a bounded iteration: an array of structs, first the initial state, then one after each simultaneous update."""
    need(1 <= steps <= MAX_STEPS and set(initial) == set(updates), "1 to 100 steps, an update for every value")
    order = list(initial)
    first = F.struct(*(compiled(parse(initial[n]), names).col.cast("double").alias(n) for n in order))
    trees = {n: parse(e) for n, e in updates.items()}

    def step(history: Column, _: Column) -> Column:
        now = F.element_at(history, -1)
        bound = names | {n: Value(SCALAR, now[n]) for n in order}
        return F.concat(history, F.array(F.struct(*(compiled(trees[n], bound).col.cast("double").alias(n) for n in order))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(first), step)


def machine(events: Column, start: str, moves: list[tuple[str, str, Callable[[Column], Column]]]) -> Column:
    """The states that a machine passes through over an array of events. A move (from, to, guard) fires where its guard holds; none
    leaves the state as it is, several are an error."""

    def step(history: Column, e: Column) -> Column:
        now = F.element_at(history, -1)
        options = F.filter(F.array(*(F.when((now == a) & guard(e), F.lit(b)) for a, b, guard in moves)), lambda x: x.isNotNull())
        after = F.when(F.size(options) > 1, F.raise_error(F.lit("several moves at once")).cast("string")).when(F.size(options) == 1, options[0]).otherwise(now)
        return F.concat(history, F.array(after))

    return F.aggregate(events, F.array(F.lit(start)), step)


def machine_by_block(df: DataFrame, key: str, block: str, order: list[str], event: str, start: str, moves: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(key, block, n_events, state): the state that a machine is in after each block of a key's events, whose order goes on over all blocks.

    A move (from, to, events) fires on the events named; none leaves the state as it is. Blocks must follow each other in the order of ``block``, and bound
    what one array holds. Each block is reduced to what it makes of every state (a map from state to state), all blocks side by
    side; a key's maps are then composed in order, and only these, one small map for each block, come together.
    """
    states = list(dict.fromkeys([start, *[s for a, b, _ in moves for s in (a, b)]]))
    need(len({(a, e) for a, _, kinds in moves for e in kinds}) == sum(len(kinds) for *_, kinds in moves), "several moves at once")
    number = {s: i for i, s in enumerate(states)}
    by_event: dict[str, list[int]] = {}
    for a, b, kinds in moves:
        for e in kinds:
            by_event.setdefault(e, list(range(len(states))))[number[a]] = number[b]
    same = F.array(*[F.lit(i) for i in range(len(states))])

    def of(e: Column) -> Column:
        out = same
        for kind, to in by_event.items():
            out = F.when(e == kind, F.array(*[F.lit(i) for i in to])).otherwise(out)
        return out

    then = lambda first, second: F.transform(first, lambda i: F.get(second, i))
    blocks = df.groupBy(key, block).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_e")))).alias("_events"))
    # events that change nothing needn't be walked through
    useful = F.filter(F.transform("_events", lambda x: x["_e"]), lambda e: e.isin(*by_event))
    maps = blocks.select(key, block, F.size("_events").cast("long").alias("n_events"), F.aggregate(useful, same, lambda m, e: then(m, of(e))).alias("_map"))
    told = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(block, "n_events", "_map"))).alias("_blocks"))
    now = lambda history: F.coalesce(F.get(history, F.size(history) - 1), F.lit(number[start]))
    after = F.aggregate("_blocks", F.expr("cast(array() as array<int>)"), lambda history, b: F.concat(history, F.array(F.get(b["_map"], now(history)))))
    rows = told.select(key, F.inline(F.arrays_zip(F.col("_blocks").alias("b"), after.alias("s"))))
    return rows.select(key, f"b.{block}", "b.n_events", F.get(F.array(*[F.lit(s) for s in states]), F.col("s")).alias("state"))


def representative_states(low: float, high: float, default: float, integer: bool = False, presets: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """Label and value of the states in which a control is tried: default, ends, middle and presets."""
    middle = (low + high) / 2
    states = [("default", default), ("minimum", low), ("maximum", high), ("middle", float(round(middle)) if integer else middle), *(presets or {}).items()]
    need(len(states) <= MAX_STATES, "too many states")
    return states


def sweep(df: DataFrame, control: str, states: list[tuple[str, float]]) -> DataFrame:
    """Every row once for each state: columns state and ``control``."""
    return df.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("state"), F.lit(float(v)).alias(control)) for n, v in states))))


def dead_controls(swept: DataFrame, key: list[str], targets: list[str], tolerance: float = 1e-8) -> DataFrame:
    """By target: in how many rows some state changes it from the default beyond the tolerance; 0 means that the control is dead.

    ``key`` are the columns of a row before the sweep; rows equal in all of them move alike, and each counts. One aggregate has the default and the extremes of the other states.
    """
    default = F.col("state") == "default"
    ends = {"base": lambda t: F.max(F.when(default, F.col(t))), "high": lambda t: F.max(F.when(~default, F.col(t))), "low": lambda t: F.min(F.when(~default, F.col(t)))}
    rows = swept.groupBy(*key).agg(F.count_if(default).alias("n"), *[f(t).alias(f"{name}_{t}") for t in targets for name, f in ends.items()])
    moved = lambda t: F.coalesce((F.col(f"high_{t}") - F.col(f"base_{t}") > tolerance) | (F.col(f"base_{t}") - F.col(f"low_{t}") > tolerance), F.lit(False))
    sums = rows.agg(*(F.sum(F.when(moved(t), F.col("n")).otherwise(0)).alias(t) for t in targets))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(t).alias("target"), F.coalesce(F.col(t), F.lit(0)).alias("rows_moved")) for t in targets))))


def array_probes(v: Column, low: float, high: float) -> Column:
    """Copies of a vector in which the first, middle or last entry is moved up or down by the larger of 0.25 and a quarter of it,
    within bounds; distinct, and never the vector itself."""
    places = F.array_distinct(F.array(F.lit(0), (F.size(v) / 2).cast("int"), F.size(v) - 1))

    def moved(i: Column, sign: float) -> Column:
        return F.transform(v, lambda x, j: F.when(j == i, F.greatest(F.lit(low), F.least(F.lit(high), x + sign * F.greatest(F.lit(0.25), F.abs(x) * 0.25)))).otherwise(x))

    tried = F.flatten(F.transform(places, lambda i: F.array(moved(i, 1.0), moved(i, -1.0))))
    return F.filter(F.array_distinct(tried), lambda p: p != v)


def one_hot(v: Column) -> Column:
    """Corners of the simplex at the first, middle and last place."""
    places = F.array_distinct(F.array(F.lit(0), (F.size(v) / 2).cast("int"), F.size(v) - 1))
    return F.transform(places, lambda i: F.transform(v, lambda _, j: F.when(j == i, F.lit(1.0)).otherwise(F.lit(0.0))))


def controlled(value: Column, rule: str, low: float, high: float) -> tuple[Column, Column]:
    """(value under the rule, whether it is accepted): clamp moves it into range, reject refuses it outside, warn lets it pass."""
    outside = (value < low) | (value > high)
    if rule == "clamp":
        return F.greatest(F.lit(low), F.least(F.lit(high), value)), F.lit(True)
    if rule == "reject":
        return F.when(~outside, value), ~outside
    need(rule == "warn", "unknown rule")
    return value, F.lit(True)


def in_domain(value: Column, domain: str) -> Column:
    return {
        "real": value.isNotNull(),
        "positive": value > 0,
        "nonnegative": value >= 0,
        "unit_interval": (value >= 0) & (value <= 1),
        "probability": (value >= 0) & (value <= 1),
        "integer": value == F.floor(value),
    }[domain]


__all__ = ["VECTOR", "array_probes", "controlled", "dead_controls", "in_domain", "iterate", "levels", "machine", "machine_by_block", "one_hot", "representative_states", "run_program", "sweep"]
