"""Controls and what they are set to: values under a control's policy, presets against what controls allow, probes of arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import need
from ..shared import Rounds
from .pointers import nodes

#: Policies, kinds of controls, the step of a probe and its share of an entry, the least positive probe.
RULES, KINDS = ("clamp", "reject", "normalize", "warn"), ("slider", "number", "select", "toggle", "vector", "matrix")
STEP, STEP_SHARE, LEAST_POSITIVE = 0.25, 0.25, 1e-6
#: What a setting goes by.
KEY = ("case", "preset", "variable")
#: JSON texts of numbers.
NUMBER = "^-?[0-9]"


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def _within(x: Column, low: Column, high: Column) -> Column:
    """x moved into its bounds, of which a null one is none."""
    return F.least(F.greatest(x, F.coalesce(low, x)), F.coalesce(high, F.greatest(x, F.coalesce(low, x))))


def _outside(x: Column, low: Column, high: Column) -> Column:
    return F.coalesce(x < low, F.lit(False)) | F.coalesce(x > high, F.lit(False))


def normalized(v: Column, distribution: bool) -> Column:
    """A vector over its total (a distribution) or its length; null where that can't be."""
    size = _total(v) if distribution else _norm(v)
    fine = F.forall(v, lambda x: x >= 0) & (size > 0) if distribution else size > 0
    return F.when(fine, F.transform(v, lambda x: x / size))


def under_policy(value: Column, kind: str, rule: str, low: Column, high: Column, options: Column | None = None, strict: bool = False, distribution: bool = False) -> tuple[Column, Column]:
    """(value, whether it is accepted) as a control of ``kind`` takes it: a number, text or boolean, or an array of doubles (vector) or of arrays (matrix).

    ``normalize`` comes first and needs a vector: a scalar or a matrix can't be. Options are looked up in any kind that has some. Bounds (a null one is none) hold for numbers and every entry of arrays: ``clamp`` moves what is
    outside, ``warn`` lets it pass, the others refuse. ``strict`` neither moves, normalises nor lets pass. A refused value is null, and so is a null, which isn't accepted.
    """
    need(rule in RULES, "unknown rule")
    need(kind in KINDS, "unknown kind of control")
    if rule == "normalize" and not strict:
        value = normalized(value, distribution) if kind == "vector" else F.when(F.lit(False), value)
    fine = value.isNotNull()
    if options is not None:
        fine = fine & ((F.size(options) == 0) | F.array_contains(options, value))
    if kind in ("slider", "number", "vector", "matrix"):
        each = {"vector": F.transform, "matrix": lambda m, f: F.transform(m, lambda r: F.transform(r, f))}.get(kind, lambda x, f: f(x))
        flat = {"vector": lambda v: v, "matrix": F.flatten}.get(kind, F.array)(value)
        fine = fine & F.forall(flat, lambda x: x.isNotNull() & ~F.isnan(x))
        if strict or rule in ("reject", "normalize"):
            fine = fine & ~F.exists(flat, lambda x: _outside(x, low, high))
        elif rule == "clamp":
            value = each(value, lambda x: _within(x, low, high))
    fine = F.coalesce(fine, F.lit(False))
    return F.when(fine, value), fine


# -- presets ----------------------------------------------------------------------------------------------------------------------


@dataclass
class Presets:
    """Tables of what presets set. ``settings``: case, preset, variable, value (JSON text), one row for each variable that a preset sets; or case, preset and an array ``settings`` of variable and value, one or more
    rows a preset. ``controls``: case, variable, kind, rule, low, high, options (JSON texts). ``variables``: case, variable, type, dims (texts: numbers, or variables whose values they are).
    ``initial``: case, variable, value (JSON text)."""

    settings: DataFrame
    controls: DataFrame
    variables: DataFrame
    initial: DataFrame


def _as_json(c: Column) -> Column:
    return F.to_json(F.try_parse_json(c))


def _whole_presets(settings: DataFrame) -> DataFrame:
    """(case, preset, settings): one row for each preset, its settings ordered by variable. Only presets that come in several rows are shuffled with their values; a digest finds these, and their own keys group them."""
    if "settings" not in settings.columns:
        return settings.groupBy("case", "preset").agg(F.array_sort(F.collect_list(F.struct("variable", "value"))).alias("settings"))
    rows = settings.select("case", "preset", "settings")
    key = F.xxhash64("case", "preset").alias("_key")
    with Rounds(settings.sparkSession) as rounds:  # a table, so its size is known before the join
        several = rounds.result(rows.select(key).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"))
    keyed = rows.withColumn("_key", key)
    single = keyed.join(several, "_key", "left_anti").drop("_key")
    more = keyed.join(several, "_key", "left_semi").groupBy("case", "preset").agg(F.flatten(F.collect_list("settings")).alias("settings"))
    return single.unionByName(more).withColumn("settings", F.array_sort("settings"))


def _value_shapes(values: DataFrame) -> DataFrame:
    """(value, text, and what ``_shapes`` tells, lengths as doubles): each JSON text of ``values`` once, however many settings have it, with its normal form; other texts are left out."""
    with Rounds(values.sparkSession) as rounds:
        own = rounds.keep(values.filter("value is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
        return rounds.result(own.join(_shapes(nodes(own, "id", "value")), "id").drop("id").withColumns({"text": _as_json(F.col("value")), "shape": F.transform("shape", lambda n: n.cast("double"))}))


def _shapes(leaves: DataFrame) -> DataFrame:
    """Per id of ``nodes``: its shape (lengths by level), whether all its arrays are full and alike, and sums over its leaves.

    Two aggregates, by level and over levels, so a large array is many rows and no list. Places run from 0, so the arrays are alike if and only if there are as many leaves as the shape has places.
    """
    leaf, number = F.col("kind") == "leaf", F.col("value").rlike(NUMBER)
    x = F.when(leaf & number, F.col("value").try_cast("double"))
    levels = leaves.withColumn("_x", x).groupBy("id", F.size("path").alias("depth")).agg(
        F.max(F.get("path", F.size("path") - 1)).alias("last"), F.count_if(leaf).alias("n"), F.count_if(F.col("kind") == "object").alias("objects"),
        F.count_if(leaf & F.col("value").isin("true", "false")).alias("booleans"), F.count_if(leaf & number).alias("numbers"),
        F.count_if(leaf & (F.col("value") == "null")).alias("unknown"),
        F.min("_x").alias("low"), F.max("_x").alias("high"), F.sum("_x").alias("total"), F.sum(F.col("_x") * F.col("_x")).alias("squares"),
    )
    dims = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("depth", F.col("last").alias("at")))), lambda s: s["depth"] > 0), lambda s: s["at"].cast("long") + 1)
    sums = [F.sum(c).alias(c) for c in ("n", "objects", "booleans", "numbers", "unknown", "total", "squares")]
    told = levels.groupBy("id").agg(dims.alias("shape"), F.max(F.when(F.col("n") > 0, F.col("depth"))).alias("at"), F.max("depth").alias("deepest"), *sums, F.min("low").alias("least"), F.max("high").alias("most"))
    places = F.aggregate("shape", F.lit(1).cast("long"), lambda s, n: s * n)
    return told.withColumn("even", F.coalesce((F.col("n") == places) & (F.col("at") == F.col("deepest")), F.lit(False)))


def _by_case(df: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """(case, name): a map of ``columns`` by variable. Its size is seldom guessed well, so it is never broadcast."""
    rows = F.array_sort(F.collect_list(F.struct("variable", F.struct(*columns).alias("it"))))
    first = lambda r, i: (i == 0) | (r["variable"] != F.get("_rows", i - 1)["variable"])
    return df.filter("variable is not null").groupBy("case").agg(rows.alias("_rows")).select("case", F.map_from_entries(F.filter("_rows", first)).alias(name)).hint("merge")


def _number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(NUMBER), c.try_cast("double"))


def _with_controls(s: Column, i: Column) -> Column:
    """A setting of a preset with what is declared of its variable. ``once``: nothing else sets it; ``again``: one before it in the array does."""
    same = lambda at: s["variable"].eqNullSafe(F.get("settings", at)["variable"])
    again = (i > 0) & same(i - 1)
    once = ~again & ~((i + 1 < F.size("settings")) & same(i + 1))
    of = [F.try_element_at(f"_{name}", s["variable"]).alias(name) for name in ("control", "declared")]
    return F.struct(s["variable"].alias("variable"), s["value"].alias("value"), again.alias("again"), once.alias("once"), *of)


def _with_sizes(s: Column) -> Column:
    """A setting with the sizes of its dimensions: a number, or what the preset or else the case sets the variable of that name to (null: neither)."""

    def named(dim: Column) -> Column:
        own = F.get(F.filter("settings", lambda o: (o["variable"] == dim["name"]) & o["once"]), F.lit(0))["value"]
        first = F.try_element_at("_initial", dim["name"])["value"]
        return F.struct(*(dim[c].alias(c) for c in ("fixed", "size")), F.when(~dim["fixed"], F.coalesce(F.when(F.col("case").isNotNull() & F.col("preset").isNotNull(), own), first)).alias("value"))

    return F.struct(*(s[c].alias(c) for c in ("variable", "value", "again", "once", "control")), s["declared"]["type"].alias("type"), F.transform(s["declared"]["dims"], named).alias("dims"))


def preset_findings(t: Presets, tolerance: float = 1e-6, canonical: bool = False) -> DataFrame:
    """(case, preset, variable, code): the first rule, in the order below, that a setting breaks; settings that break none give no row.

    TWICE (set more than once), UNCONTROLLED, UNDECLARED, NOT_A_VALUE (no JSON, null, an object), RAGGED (empty arrays too), DIMENSION (one that isn't a positive whole number), SHAPE,
    then by kind: OPTION (select; equal as JSON), TOGGLE, or NOT_NUMERIC, RANGE, NORMALIZED (only a vector can be normalised, and must be: its total or, ``canonical``, unless it is a distribution, its length
    is 1, and no share of a distribution is below 0). A dimension that names a variable is what the preset sets it to, or else its initial value; ``canonical`` takes the value's own length where
    neither is there, and any shape where none is declared. Controls, variables and initial values are unique by case and variable; columns beside those named are left alone.
    A number beyond a double's range is read as a text, so it isn't numeric.
    """
    bounds = F.col("low").cast("double").alias("from"), F.col("high").cast("double").alias("to")
    controls = _by_case(t.controls, "_control", F.col("kind").alias("control"), "rule", *bounds, F.transform("options", _as_json).alias("options"))
    dims = F.transform(F.coalesce("dims", F.array().cast("array<string>")), lambda d: F.struct(d.alias("name"), d.rlike(NUMBER).alias("fixed"), _number(d).alias("size")))
    declared = _by_case(t.variables, "_declared", F.col("type").alias("type"), dims.alias("dims"))
    values = t.settings.select(F.explode(F.col("settings")["value"]).alias("value")) if "settings" in t.settings.columns else t.settings.select("value")
    shapes = _value_shapes(values)
    # a preset meets what its case declares as one row; its settings meet the shapes of values
    whole = _whole_presets(t.settings).join(controls, "case", "left").join(declared, "case", "left").join(_by_case(t.initial, "_initial", "value"), "case", "left")
    whole = whole.withColumn("settings", F.transform("settings", _with_controls))
    told = whole.select("case", "preset", F.inline(F.transform("settings", _with_sizes))).join(shapes, "value", "left")
    told = told.select(*KEY, "again", "once", *(c for c in shapes.columns if c != "value"), *(f"control.{c}" for c in ("control", "rule", "from", "to", "options")), "type", "dims")

    size = lambda d, i: F.when(d["fixed"], d["size"]).when(F.lit(canonical) & d["value"].isNull(), F.get("shape", i)).otherwise(_number(d["value"]))
    sizes = F.transform("dims", size)
    if canonical:
        sizes = F.when(F.size("dims") == 0, F.col("shape")).otherwise(sizes)
    told = told.withColumn("sizes", sizes)
    distribution = F.coalesce(F.col("type") == "distribution", F.lit(False))
    measure = F.when(distribution | F.lit(not canonical), F.col("total")).otherwise(F.sqrt("squares"))
    one = (F.size("shape") == 1) & ~(distribution & (F.col("least") < 0)) & (F.abs(measure - 1) <= tolerance)
    code = (
        F.when(~F.col("once"), F.when(~F.col("again"), "TWICE"))
        .when(F.col("control").isNull(), "UNCONTROLLED")
        .when(F.col("dims").isNull(), "UNDECLARED")
        .when(F.col("n").isNull() | (F.col("objects") > 0) | (F.col("unknown") > 0), "NOT_A_VALUE")
        .when(~F.col("even"), "RAGGED")
        .when(F.exists("sizes", lambda s: ~F.coalesce((s > 0) & (s == F.floor(s)), F.lit(False))), "DIMENSION")
        .when(F.col("sizes") != F.col("shape"), "SHAPE")
        .when(F.col("control") == "select", F.when(~F.coalesce(F.exists("options", lambda o: o == F.col("text")), F.lit(False)), "OPTION"))
        .when(F.col("control") == "toggle", F.when((F.size("shape") > 0) | (F.col("booleans") != 1), "TOGGLE"))
        .when(F.col("numbers") != F.col("n"), "NOT_NUMERIC")
        .when(_outside(F.col("least"), F.col("from"), F.col("to")) | _outside(F.col("most"), F.col("from"), F.col("to")), "RANGE")
        .when((F.col("rule") == "normalize") & ~F.coalesce(one, F.lit(False)), "NORMALIZED")
    )
    return told.select(*KEY, code.alias("code")).filter("code is not null")


# -- probes -----------------------------------------------------------------------------------------------------------------------


def probes(v: Column, low: Column, high: Column, domain: str = "real", distribution: bool = False, rule: str = "clamp") -> Column:
    """Arrays to try beside a vector: distinct, and never the vector itself.

    First, for a distribution that may hold 0 and 1, all of its mass at the first, the middle or the last place. Then the entry at each of these is moved up and down by the larger of STEP (1 in whole numbers)
    and STEP_SHARE of it, within its bounds (a null one is none) and its domain. Of a distribution the next place, the first after the last, gives or takes what the entry gains or loses, so the total stays. Under
    ``normalize`` the moved vector is scaled instead, to total or length 1, and left out if it can't be. An empty vector has no probes; that of a null is null.
    """
    need(rule in RULES, "unknown rule")
    n = F.size(v)
    places = F.when(n > 0, F.array_distinct(F.array(F.lit(0), (n / 2).cast("int"), n - 1))).otherwise(F.array().cast("array<int>"))
    scaled = rule == "normalize"

    def to(old: Column, sign: float) -> Column:
        x = _within(old + sign * F.greatest(F.lit(1.0 if domain == "integer" else STEP), F.abs(old) * STEP_SHARE), low, high)
        if domain in ("nonnegative", "positive", "probability", "unit_interval"):
            x = F.greatest(x, F.lit(LEAST_POSITIVE if domain == "positive" else 0.0))
        if domain == "unit_interval":
            x = F.least(x, F.lit(1.0))
        return F.rint(x) if domain == "integer" else x

    def moved(i: Column, sign: float) -> Column:
        old, new = F.get(v, i), to(F.get(v, i), sign)
        if not distribution or scaled:
            out = F.transform(v, lambda x, j: F.when(j == i, new).otherwise(x))
            return normalized_total(out, distribution) if scaled else out
        after = (i + 1) % n
        gain = F.greatest(-old, F.least(new - old, F.get(v, after)))
        return F.when(n > 1, F.transform(v, lambda x, j: F.when(j == i, x + gain).when(j == after, x - gain).otherwise(x)))

    tried = F.flatten(F.transform(places, lambda i: F.array(moved(i, 1.0), moved(i, -1.0))))
    if distribution and domain != "positive":
        corners = F.transform(places, lambda i: F.transform(v, lambda _, j: F.when(j == i, 1.0).otherwise(0.0)))
        may = F.coalesce(low <= 0, F.lit(True)) & F.coalesce(high >= 1, F.lit(True))
        tried = F.concat(F.when(may, corners).otherwise(F.array().cast("array<array<double>>")), tried)
    return F.filter(F.array_distinct(tried), lambda p: p.isNotNull() & (p != v))


def normalized_total(v: Column, distribution: bool) -> Column:
    """As ``normalized``, but a share below 0 is no hindrance: it is the control that refuses it."""
    size = _total(v) if distribution else _norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def matrix_probes(m: Column, low: Column, high: Column, domain: str = "real") -> Column:
    """As ``probes`` for a matrix with rows of equal length: its entries in order are moved, never scaled or balanced."""
    width = F.size(F.get(m, F.lit(0)))
    rows = F.sequence(F.lit(0), F.size(m) - 1)
    return F.transform(probes(F.flatten(m), low, high, domain), lambda p: F.transform(rows, lambda r: F.slice(p, r * width + 1, width)))
