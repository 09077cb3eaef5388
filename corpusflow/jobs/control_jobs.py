"""Queries of controls: line items as presets of their parts, embeddings as arrays under each policy and as distributions to probe, conversations as pages of prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.controls import RULES, Presets, preset_findings, probes, under_policy
from ..operators.layout import prose_columns
from .array_jobs import BASE_SQL, base
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _presets(spark: SparkSession, sf_dir: str) -> Presets:
    """Parts are cases, their lines presets: a number, a vector as long as that says, a matrix, an option, a switch, and something without a control."""
    lines = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    share = (F.when(q % 5 == 0, 2.0).otherwise(1.0) / F.least(n, F.lit(4))).cast("double")
    given = {
        "n": n.cast("string"),
        "w": F.to_json(F.array_repeat(share, F.least(n, F.lit(4)))),
        "m": F.when(q % 7 == 0, "[[1,2],[3]]").when(q % 13 == 0, '[[1,2],[3,"4"]]').otherwise("[[1,2],[3,4]]"),
        "s": F.concat(F.lit('"'), "l_returnflag", F.lit('"')),
        "t": F.when(F.col("l_discount") == 0, "1").when(F.col("l_tax") == 0, "null").otherwise("true"),
        "u": F.when(q % 11 == 0, "0"),
    }
    set_to = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("variable"), v.alias("value"))) for k, v in given.items())))
    settings = lines.select(F.col("l_partkey").alias("case"), F.struct("l_orderkey", "l_linenumber").alias("preset"), set_to.alias("settings"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), (F.col("p_size") % 2 == 0).alias("even"))
    scaled = F.when(F.col("even"), "normalize").otherwise("clamp")
    row = lambda *values: F.struct(*(F.lit(v).alias(c) if not hasattr(v, "alias") else v.alias(c) for c, v in zip(("variable", "kind", "rule", "low", "high", "options", "type", "dims"), values, strict=True)))
    none, texts = F.lit(None).cast("double"), lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    declared = parts.select("case", F.inline(F.array(
        row("n", "number", "reject", F.lit(1.0), F.lit(6.0), texts(), "scalar", texts()),
        row("w", "vector", scaled, F.lit(0.0), F.lit(1.0), texts(), "distribution", texts("n")),
        row("m", "matrix", "clamp", none, F.lit(4.0), texts(), "matrix", texts("2", "2")),
        row("s", "select", "reject", none, none, texts('"N"', '"R"'), "scalar", texts()),
        row("t", "toggle", "reject", none, none, texts(), "scalar", texts()),
    )))
    initial = parts.select("case", F.lit("n").alias("variable"), F.lit("1").alias("value"))
    return Presets(settings, declared, declared, initial)


def preset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting of every line that breaks a rule, with the first that it breaks."""
    return preset_findings(_presets(spark, sf_dir)).select("case", "preset.l_orderkey", "preset.l_linenumber", "variable", "code")


#: Bounds of the entries of embeddings.
LOW, HIGH = -0.2, 0.15


def array_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy makes of each whole vector, as it is applied and strictly: whether it is taken, and its total, least and largest entry then."""
    df, _ = base(spark, sf_dir)
    told = []
    for rule in RULES:
        for strict in (False, True):
            value, fine = under_policy(F.col("v"), "vector", rule, F.lit(LOW), F.lit(HIGH), strict=strict)
            told.append(F.struct(F.lit(rule).alias("rule"), F.lit(strict).alias("strict"), fine.alias("accepted"), value.alias("x")))
    rows = df.select("vec_id", F.inline(F.array(*told)))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "rule", "strict", "accepted", F.round(total, 7).alias("total"), F.round(F.array_min("x"), 9).alias("least"), F.round(F.array_max("x"), 9).alias("most"))


def distribution_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of each whole softmax, by moving mass and by scaling: the total, and the entries at the first, middle and last place and the one after each."""
    df, _ = base(spark, sf_dir)
    e = F.transform("v", lambda x: F.exp(x - F.array_max("v")))
    df = df.select("vec_id", e.alias("e")).select("vec_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("p"))
    parts = []
    for rule in ("reject", "normalize"):
        made = probes(F.col("p"), F.lit(0.0), F.lit(1.0), "probability", True, rule)
        parts.append(df.select("vec_id", F.lit(rule).alias("rule"), F.posexplode(made).alias("probe", "x")))
    rows = parts[0].unionByName(parts[1])
    at = lambda i: F.round(F.get("x", F.lit(i)), 9).alias(f"x{i}")
    return rows.select("vec_id", "rule", F.col("probe").cast("long").alias("probe"), F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y), 9).alias("total"), *map(at, (0, 1, 32, 33, 63)))


def prose_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages whose turns are lines: of users on the left, of assistants on the right, the other ones across."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    x0 = F.when(F.col("role") == "assistant", 49.0).otherwise(2.0)
    return prose_columns(lines, "conv_id", F.col("text"), x0, F.when(F.col("role") == "user", 53.0).otherwise(98.0), F.lit(100.0))


QUERIES |= {f.__name__: f for f in (preset_gate, array_policies, distribution_probes, prose_pages)}
ORACLES["preset_gate"] = """
WITH l AS (SELECT l_partkey AS "case", l_orderkey, l_linenumber, l_linenumber AS n, l_quantity AS q, l_returnflag, l_discount, l_tax, p_size % 2 = 0 AS even,
  count(*) OVER same AS times, count(*) FILTER (l_quantity % 11 = 0) OVER same AS times_u FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW same AS (PARTITION BY l_partkey, l_orderkey, l_linenumber)),
f AS (SELECT *, 'n' AS variable, CASE WHEN n > 6 THEN 'RANGE' END AS code FROM l
UNION ALL SELECT *, 'w', CASE WHEN n > 4 THEN 'SHAPE' WHEN n = 1 AND q % 5 = 0 THEN 'RANGE' WHEN even AND q % 5 = 0 THEN 'NORMALIZED' END FROM l
UNION ALL SELECT *, 'm', CASE WHEN q % 7 = 0 THEN 'RAGGED' WHEN q % 13 = 0 THEN 'NOT_NUMERIC' END FROM l
UNION ALL SELECT *, 's', CASE WHEN l_returnflag NOT IN ('N', 'R') THEN 'OPTION' END FROM l
UNION ALL SELECT *, 't', CASE WHEN l_discount = 0 THEN 'TOGGLE' WHEN l_tax = 0 THEN 'NOT_A_VALUE' END FROM l
UNION ALL SELECT *, 'u', CASE WHEN q % 11 = 0 THEN 'UNCONTROLLED' END FROM l)
SELECT "case", l_orderkey, l_linenumber, variable, code FROM f WHERE code IS NOT NULL AND CASE WHEN variable = 'u' THEN times_u ELSE times END = 1
UNION ALL SELECT DISTINCT "case", l_orderkey, l_linenumber, variable, 'TWICE' FROM f WHERE CASE WHEN variable = 'u' THEN times_u ELSE times END > 1 AND (variable <> 'u' OR q % 11 = 0)"""
ORACLES["array_policies"] = BASE_SQL + f""",
r AS (SELECT vec_id, v, rule, strict, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM d, (VALUES ('clamp'), ('reject'), ('normalize'), ('warn')) AS a(rule), (VALUES (FALSE), (TRUE)) AS b(strict)),
y AS (SELECT *, CASE WHEN strict OR rule IN ('reject', 'warn') THEN v WHEN rule = 'normalize' THEN CASE WHEN size > 0 THEN list_transform(v, lambda x: x / size) END ELSE list_transform(v, lambda x: least(greatest(x, {LOW}::DOUBLE), {HIGH}::DOUBLE)) END AS x FROM r),
z AS (SELECT *, x IS NOT NULL AND (NOT strict AND rule IN ('clamp', 'warn') OR list_min(x) >= {LOW}::DOUBLE AND list_max(x) <= {HIGH}::DOUBLE) AS accepted FROM y)
SELECT vec_id, rule, strict, accepted, CASE WHEN accepted THEN round(list_sum(x), 7) END AS total, CASE WHEN accepted THEN round(list_min(x), 9) END AS least, CASE WHEN accepted THEN round(list_max(x), 9) END AS most FROM z"""
ORACLES["distribution_probes"] = BASE_SQL + """,
k AS (SELECT vec_id, p, rule, k, [1, 33, 64][k % 3 + 1] AS i, k // 3 AS way FROM d, (VALUES ('reject'), ('normalize')) AS a(rule), range(9) AS b(k)),
a AS (SELECT *, i % 64 + 1 AS j, greatest(0.25::DOUBLE, p[i] / 4) AS step FROM k),
b2 AS (SELECT *, CASE WHEN way = 0 THEN 1.0::DOUBLE WHEN way = 1 THEN least(p[i] + step, 1.0::DOUBLE) ELSE greatest(p[i] - step, 0.0::DOUBLE) END AS new FROM a),
g AS (SELECT *, greatest(-p[i], least(new - p[i], p[j])) AS gain, 1.0::DOUBLE - p[i] + new AS scale FROM b2),
t AS (SELECT vec_id, rule, k, way, i, list_transform(p, lambda x, spot: CASE WHEN way = 0 THEN (spot = i)::INT::DOUBLE WHEN rule = 'reject' THEN CASE WHEN spot = i THEN x + gain WHEN spot = j THEN x - gain ELSE x END
  ELSE (CASE WHEN spot = i THEN new ELSE x END) / scale END) AS x FROM g)
SELECT vec_id, rule, row_number() OVER (PARTITION BY vec_id, rule ORDER BY way > 0, i, way) - 1 AS probe, round(list_sum(x), 9) AS total, round(x[1], 9) AS x0, round(x[2], 9) AS x1, round(x[33], 9) AS x32, round(x[34], 9) AS x33, round(x[64], 9) AS x63 FROM t"""
ORACLES["prose_pages"] = """
WITH s AS (SELECT conv_id, count(*) FILTER (prose AND role = 'user') AS n_left, count(*) FILTER (prose AND role = 'assistant') AS n_right, count(*) FILTER (prose AND (role IS NULL OR role NOT IN ('user', 'assistant'))) AS n_span
  FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 3, FALSE) AS prose FROM conversations) GROUP BY 1)
SELECT *, n_left > 0 AND n_right > 0 AND n_left + n_right > n_span AS two_columns FROM s"""
