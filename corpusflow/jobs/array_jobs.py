"""Queries of the operation registry, expression nodes and programs, on embeddings, line items, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import BOOLEAN, MATRIX, OLDER, SCALAR, VECTOR, Value, scalar, vector
from ..functions.expressions import column
from ..operators.programs import array_probes, controlled, dead_controls, in_domain, iterate, machine_by_block, one_hot, representative_states, run_program, sweep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: What the queries of operations call: the vector v, its reverse w, its softmax p, its first entry s, 4 rows of 16 as m.
BASE_SQL = """
WITH b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT vec_id, v, list_reverse(v) AS w, v[1] AS s, list_transform(range(4), lambda i: v[i * 16 + 1 : i * 16 + 16]) AS m,
  list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM b),
d AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM c)
"""
V, W, P, M = "v", "w", "p", "m"


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Value]]:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    df = df.withColumns({"w": F.reverse("v"), "s": F.get("v", F.lit(0)), "m": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, F.lit(16)))})
    names = {"v": vector(F.col("v")), "w": vector(F.col("w")), "s": scalar(F.col("s")), "m": Value(MATRIX, F.col("m"))}
    names["p"] = column("softmax(v)", names)
    names["q"] = column("softmax(w)", names)
    return df, names


def shown(x: Value) -> list:
    """A value as flat columns that compare across engines."""
    if x.kind == BOOLEAN:
        return [x.col.alias("result")]
    if x.kind == SCALAR:
        return [F.round(x.col, 9).alias("result")]
    v = F.flatten(x.col) if x.kind == MATRIX else x.col
    weighted = F.aggregate(F.transform(v, lambda a, i: a * (i + 1)), F.lit(0.0), lambda s, a: s + a)
    return [F.size(v).cast("long").alias("n"), F.round(F.get(v, F.lit(0)), 9).alias("head"), F.round(F.element_at(v, -1), 9).alias("tail"), F.round(weighted, 6).alias("weighted")]


def shown_sql(kind: str, e: str) -> str:
    if kind == BOOLEAN:
        return f"SELECT vec_id, {e} AS result FROM d"
    if kind == SCALAR:
        return f"SELECT vec_id, round({e}, 9) AS result FROM d"
    flat = f"flatten({e})" if kind == MATRIX else e
    return f"SELECT vec_id, CAST(len(r) AS BIGINT) AS n, round(r[1], 9) AS head, round(r[len(r)], 9) AS tail, round(list_sum(list_transform(r, lambda x, i: x * i)), 6) AS weighted FROM (SELECT vec_id, {flat} AS r FROM d)"


each = lambda f, v="v": f"list_transform({v}, lambda x, i: {f})"
MEAN = "(list_sum(v) / len(v))"
ROWS = "list_transform(m, lambda r: {f})"
#: Operation: expression, kind of its value, the same in SQL.
OPS: dict[str, tuple[str, str, str]] = {
    "add": ("v + w", VECTOR, each("x + w[i]")),
    "subtract": ("v - s", VECTOR, each("x - s")),
    "multiply": ("v * w", VECTOR, each("x * w[i]")),
    "divide": ("v / (s * s + 1)", VECTOR, each("x / (s * s + 1)")),
    "power": ("v ** 3", VECTOR, each("power(x, 3)")),
    "negate": ("-m", MATRIX, ROWS.format(f="list_transform(r, lambda x: -x)")),
    "abs": ("abs(v)", VECTOR, each("abs(x)")),
    "sqrt": ("sqrt(abs(v))", VECTOR, each("sqrt(abs(x))")),
    "exp": ("exp(v)", VECTOR, each("exp(x)")),
    "log": ("log(abs(v) + 1)", VECTOR, each("ln(abs(x) + 1)")),
    "sin": ("sin(v)", VECTOR, each("sin(x)")),
    "cos": ("cos(v)", VECTOR, each("cos(x)")),
    "sum": ("sum(v)", SCALAR, "list_sum(v)"),
    "mean": ("mean(m)", SCALAR, "list_sum(flatten(m)) / 64"),
    "min": ("min(v)", SCALAR, "list_min(v)"),
    "max": ("max(v)", SCALAR, "list_max(v)"),
    "dot": ("dot(v, w)", SCALAR, f"list_sum({each('x * w[i]')})"),
    "matmul": ("matmul(m, take(w, 16))", VECTOR, ROWS.format(f="list_sum(list_transform(r, lambda x, i: x * w[i]))")),
    "transpose": ("transpose(m)", MATRIX, "list_transform(range(1, 17), lambda j: list_transform(m, lambda r: r[j]))"),
    "norm": ("norm(v)", SCALAR, f"sqrt(list_sum({each('x * x')}))"),
    "normalize": ("normalize(v + s)", VECTOR, f"list_transform({each('x + s')}, lambda y: y / sqrt(list_sum({each('(x + s) * (x + s)')})))"),
    "softmax": ("softmax(v)", VECTOR, "p"),
    "entropy": ("entropy(p)", SCALAR, f"-list_sum({each('x * ln(x)', 'p')})"),
    "cross_entropy": ("cross_entropy(p, q)", SCALAR, f"-list_sum({each('x * ln(p[len(p) + 1 - i])', 'p')})"),
    "xlogx": ("xlogx(abs(v))", VECTOR, each("CASE WHEN x = 0 THEN 0 ELSE abs(x) * ln(abs(x)) END")),
    "take": ("take(v, 5)", VECTOR, "v[1:5]"),
    "approx_equal": ("approx_equal(sum(p), 1)", BOOLEAN, "abs(list_sum(p) - 1) <= 1e-8"),
    "variance": ("", SCALAR, f"list_sum({each(f'(x - {MEAN}) * (x - {MEAN})')}) / len(v)"),
    "sigmoid": ("", VECTOR, each("1 / (1 + exp(-x))")),
    "distance": ("", SCALAR, f"sqrt(list_sum({each('(x - w[i]) * (x - w[i])')}))"),
    "clip": ("", VECTOR, each("greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x))")),
    "argmax": ("", SCALAR, "CAST(list_position(v, list_max(v)) - 1 AS DOUBLE)"),
    "unit_sum": ("", VECTOR, "list_transform(p, lambda x: x / list_sum(p))"),
}
_OLDER_ARGS = {"variance": "v", "sigmoid": "v", "distance": "vw", "argmax": "v", "unit_sum": "p"}


def _operation(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, names = base(spark, sf_dir)
        if name == "clip":
            value = OLDER["clip"][1](names["v"], scalar(F.lit(-0.1)), scalar(F.lit(0.1)))
        elif name in OLDER:
            value = OLDER[name][1](*(names[a] for a in _OLDER_ARGS[name]))
        else:
            value = column(OPS[name][0], names)
        return df.select("vec_id", *shown(value))

    return query


for _name, (_, _kind, _sql) in OPS.items():
    QUERIES[f"op_{_name}"] = _operation(_name)
    ORACLES[f"op_{_name}"] = BASE_SQL + shown_sql(_kind, _sql)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def numbers(*names: str) -> dict[str, Value]:
    return {n.removeprefix("l_").removeprefix("o_"): scalar(F.col(n)) for n in names}


# -- nodes of the language
def node_if_and_or_index_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = numbers("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    text = {
        "a": "extendedprice * (1 - discount) if quantity > 25 and discount < 0.05 else extendedprice",
        "b": "[quantity, discount, tax][2] + [[1, 2], [3, 4]][1][0]",
        "c": "not (tax >= 0.04) or quantity == 1 or discount != 0",
    }
    made = {n: column(e, names) for n, e in text.items()}
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(made["a"].col, 6).alias("a"), F.round(made["b"].col, 9).alias("b"), made["c"].col.alias("c"))


QUERIES["node_if_and_or_index_compare"] = node_if_and_or_index_compare
ORACLES["node_if_and_or_index_compare"] = """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 6) AS a,
  round(l_tax + 3, 9) AS b, (NOT (l_tax >= 0.04) OR l_quantity = 1 OR l_discount <> 0) AS c FROM lineitem"""


# -- iteration and state machines
def _decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    history = iterate({"x": "totalprice", "y": "0"}, {"x": "x * 0.5", "y": "y + x"}, 4, numbers("o_totalprice"))
    return orders.withColumn("history", history)


def iteration_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at("history", -1)
    return _decay(spark, sf_dir).select("o_orderkey", F.round(last["x"], 6).alias("x"), F.round(last["y"], 6).alias("y"))


def iteration_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decay(spark, sf_dir).select("o_orderkey", F.posexplode("history").alias("step", "h"))
    return rows.select("o_orderkey", F.col("step").cast("long").alias("step"), F.round("h.x", 6).alias("x"), F.round("h.y", 6).alias("y"))


QUERIES |= {"iteration_decay": iteration_decay, "iteration_history": iteration_history}
ORACLES["iteration_decay"] = "SELECT o_orderkey, round(o_totalprice * 0.0625, 6) AS x, round(o_totalprice + o_totalprice * 0.5 + o_totalprice * 0.25 + o_totalprice * 0.125, 6) AS y FROM orders"
ORACLES["iteration_history"] = """
WITH RECURSIVE h AS (SELECT o_orderkey, CAST(0 AS BIGINT) AS step, o_totalprice AS x, CAST(0 AS DOUBLE) AS y FROM orders
  UNION ALL SELECT o_orderkey, step + 1, x * 0.5, y + x FROM h WHERE step < 4)
SELECT o_orderkey, step, round(x, 6) AS x, round(y, 6) AS y FROM h"""


def fsm_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and hour, the state that a machine over all of the user's events is in at the end of the hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "event_type")
    moves = [("idle", "active", ["click", "view", "signup"]), ("active", "failed", ["error"]), ("active", "bought", ["purchase"]), ("failed", "active", ["click", "view"])]
    return machine_by_block(events, "user_id", "hour", ["ts", "event_id"], "event_type", "idle", moves)


QUERIES["fsm_user_state"] = fsm_user_state
ORACLES["fsm_user_state"] = """
WITH RECURSIVE e AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'idle' AS state FROM e WHERE n = 1
  UNION ALL SELECT r.user_id, e.n, CASE WHEN r.state = 'idle' AND e.event_type IN ('click', 'view', 'signup') THEN 'active'
    WHEN r.state = 'active' AND e.event_type = 'error' THEN 'failed' WHEN r.state = 'active' AND e.event_type = 'purchase' THEN 'bought'
    WHEN r.state = 'failed' AND e.event_type IN ('click', 'view') THEN 'active' ELSE r.state END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, hour, count(*) AS n_events, arg_max(state, n) AS state FROM r JOIN e USING (user_id, n) GROUP BY 1, 2"""


# -- step graphs and sweeps
#: Net and gross price, the price over the root of a scaled quantity, and the tax.
PRICE = {"net": "extendedprice * (1 - discount)", "gross": "net * (1 + tax)", "spread": "gross / sqrt(quantity * 3.7)", "tax_part": "gross - net"}


def dag_price_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = numbers("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = run_program(lineitem(spark, sf_dir), names, PRICE, ["gross >= net", "approx_equal(spread * spread * quantity * 3.7, gross * gross)"])
    return out.select("l_orderkey", "l_linenumber", *(F.round(n, 7).alias(n) for n in PRICE), "holds_1", "holds_2")


QUERIES["dag_price_chain"] = dag_price_chain
ORACLES["dag_price_chain"] = """
WITH a AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem), b AS (SELECT *, net * (1 + l_tax) AS gross FROM a)
SELECT l_orderkey, l_linenumber, round(net, 7) AS net, round(gross, 7) AS gross, round(gross / sqrt(l_quantity * 3.7::DOUBLE), 7) AS spread, round(gross - net, 7) AS tax_part, gross >= net AS holds_1, TRUE AS holds_2 FROM b"""


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweep(lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), "rate", representative_states(0.0, 0.5, 0.1, presets={"sale": 0.25}))
    names = numbers("l_extendedprice", "l_quantity") | {"rate": scalar(F.col("rate"))}
    return run_program(rows, names, {"price": "extendedprice * (1 - rate)", "odds": "log(rate) * quantity", "volume": "quantity * 2"}, flag=True)


def state_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _swept(spark, sf_dir).groupBy("state")
    return by.agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.sum("price"), 2).alias("price"))


def dead_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_controls(_swept(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], ["price", "volume"])


_STATES = "(VALUES ('default', 0.1), ('minimum', 0.0), ('maximum', 0.5), ('middle', 0.25), ('sale', 0.25)) AS s(state, rate)"
QUERIES |= {"state_sweep": state_sweep, "dead_control": dead_control}
ORACLES["state_sweep"] = f"SELECT state, count(*) AS n, CAST(count(*) FILTER (rate > 0) AS BIGINT) AS n_valid, round(sum(l_extendedprice * (1 - rate::DOUBLE)), 2) AS price FROM lineitem, {_STATES} GROUP BY state"
ORACLES["dead_control"] = """
SELECT 'price' AS target, CAST(count(*) AS BIGINT) AS rows_moved FROM lineitem WHERE l_extendedprice * 0.1 > 1e-8
UNION ALL SELECT 'volume', CAST(0 AS BIGINT)"""


def array_probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = base(spark, sf_dir)
    head = F.slice("v", 1, 5)
    probes = F.concat(array_probes(head, -1.0, 1.0), one_hot(head))
    return df.select("vec_id", F.posexplode(probes).alias("probe", "x")).select("vec_id", F.col("probe").cast("long").alias("probe"), *(F.round(F.get("x", F.lit(i)), 9).alias(f"x{i}") for i in range(5)))


QUERIES["array_probes"] = array_probe_rows
ORACLES["array_probes"] = BASE_SQL + """,
h AS (SELECT vec_id, v[1:5] AS h FROM d),
t AS (SELECT vec_id, k, CASE WHEN k < 6 THEN list_transform(h, lambda x, j: CASE WHEN j = [1, 3, 5][k // 2 + 1] THEN
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x + (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * greatest(0.25::DOUBLE, abs(x) * 0.25))) ELSE x END)
  ELSE list_transform(h, lambda x, j: CASE WHEN j = [1, 3, 5][k - 5] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS x, h FROM h, range(9) AS r(k)),
kept AS (SELECT * FROM t WHERE k >= 6 OR x <> h)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS probe, round(x[1], 9) AS x0, round(x[2], 9) AS x1, round(x[3], 9) AS x2, round(x[4], 9) AS x3, round(x[5], 9) AS x4 FROM kept"""


def control_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    for rule in ("clamp", "reject", "warn"):
        value, accepted = controlled(F.col("l_quantity"), rule, 10.0, 40.0)
        df = df.withColumns({rule: value, f"{rule}_ok": accepted})
    return df.drop("l_quantity")


def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    tests = {"quantity_integer": in_domain(F.col("l_quantity"), "integer"), "price_positive": in_domain(F.col("l_extendedprice"), "positive"), "discount_positive": in_domain(F.col("l_discount"), "positive"), "tax_unit": in_domain(F.col("l_tax"), "unit_interval")}
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), *(F.count_if(t).alias(n) for n, t in tests.items()))


def symbolic_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = base(spark, sf_dir)
    k = F.when(F.col("vec_id") % 3 == 0, 8).otherwise(16)
    return df.select("vec_id", F.size("v").cast("long").alias("n"), (F.size(F.slice("v", F.lit(1), k)) == F.size(F.element_at("m", 1))).alias("same_size"))


QUERIES |= {"control_policy": control_policy, "domain_check": domain_check, "symbolic_shape": symbolic_shape}
ORACLES["control_policy"] = """SELECT l_orderkey, l_linenumber, greatest(10.0::DOUBLE, least(40.0::DOUBLE, l_quantity)) AS clamp, TRUE AS clamp_ok,
  CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END AS reject, l_quantity BETWEEN 10 AND 40 AS reject_ok, l_quantity AS warn, TRUE AS warn_ok FROM lineitem"""
ORACLES["domain_check"] = """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity = floor(l_quantity)) AS quantity_integer, count(*) FILTER (l_extendedprice > 0) AS price_positive,
  count(*) FILTER (l_discount > 0) AS discount_positive, count(*) FILTER (l_tax BETWEEN 0 AND 1) AS tax_unit FROM lineitem GROUP BY l_returnflag"""
ORACLES["symbolic_shape"] = "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, vec_id % 3 <> 0 AS same_size FROM embeddings"


# -- seven programs
def program_query(inputs, steps: dict[str, str], invariants: list[str], key: list[str], show: dict[str, str]):
    """A query that runs a program; ``inputs`` gives a frame and its named values."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, names = inputs(spark, sf_dir)
        out = run_program(df, names, steps, invariants)
        return out.select(*key, *(F.expr(e).alias(n) for n, e in show.items()), *(f"holds_{k}" for k in range(1, len(invariants) + 1)))

    return query


def _adam_inputs(spark, sf_dir):
    names = {"g": scalar(F.col("l_discount")), "t": scalar(F.col("l_linenumber")), "m0": scalar(F.lit(0.0)), "v0": scalar(F.lit(0.0))}
    names |= {n: scalar(F.lit(x)) for n, x in (("b1", 0.9), ("b2", 0.999), ("a", 0.01), ("eps", 1e-8))}
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount"), names


def _attention_inputs(spark, sf_dir):
    df, names = base(spark, sf_dir)
    flag = Value(BOOLEAN, F.col("vec_id") % 2 == 0)
    return df, {"K": names["m"], "V": names["m"], "q": column("take(w, 16)", names), "flag": flag}


def _vector_inputs(spark, sf_dir):
    df, names = base(spark, sf_dir)
    return df, names | {"gamma": scalar(F.lit(1.5)), "beta": scalar(F.lit(0.25)), "eps": scalar(F.lit(1e-3)), "n": scalar(F.lit(4.0))}


def _distillation_inputs(spark, sf_dir):
    df, names = base(spark, sf_dir)
    names |= {"x": column("take(v, 8) * 10", names), "y": column("take(w, 8) * 10", names), "T": scalar(F.lit(2.0)), "weight": scalar(F.lit(0.3))}
    return df, names | {"hard": column("[1, 0, 0, 0, 0, 0, 0, 0]", names)}


def _dropout_inputs(spark, sf_dir):
    df, names = base(spark, sf_dir)
    mask = Value(VECTOR, F.transform("w", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return df, {"a": names["v"], "mask": mask, "keep": scalar(F.lit(0.5))}


def _clock_inputs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return df, {"local": scalar(F.col("user_id")), "msg": scalar(F.floor("value")), "sent": scalar(F.floor("value"))}


PROGRAMS = {
    "prog_adam": program_query(
        _adam_inputs,
        {"m": "b1 * m0 + (1 - b1) * g", "v": "b2 * v0 + (1 - b2) * g * g", "mh": "m / (1 - b1 ** t)", "vh": "v / (1 - b2 ** t)", "update": "a * mh / (sqrt(vh) + eps)"},
        ["v >= 0", "vh >= 0"], ["l_orderkey", "l_linenumber"], {"mh": "round(mh, 9)", "vh": "round(vh, 9)", "update": "round(update, 9)"},
    ),
    "prog_attention": program_query(
        _attention_inputs,
        {"scores": "matmul(K, q)", "scaled": "scores / sqrt(2) if flag else scores", "weights": "softmax(scaled)", "output": "matmul(transpose(V), weights)"},
        ["approx_equal(sum(weights), 1)"], ["vec_id"], {"w0": "round(weights[0], 9)", "w3": "round(weights[3], 9)", "o0": "round(output[0], 9)", "o15": "round(output[15], 9)"},
    ),
    "prog_batchnorm": program_query(
        _vector_inputs,
        {"mu": "mean(v)", "centred": "v - mu", "var": "mean(centred * centred)", "xh": "centred / sqrt(var + eps)", "y": "gamma * xh + beta"},
        ["approx_equal(mean(centred), 0)", "approx_equal(mean(xh * xh), var / (var + eps))"], ["vec_id"], {"mu": "round(mu, 9)", "var": "round(var, 9)", "y0": "round(y[0], 9)", "y63": "round(y[63], 9)"},
    ),
    "prog_distillation": program_query(
        _distillation_inputs,
        {"soft_x": "softmax(x / T)", "soft_y": "softmax(y / T)", "soft": "cross_entropy(soft_x, soft_y)", "hard_y": "softmax(y)", "sharp": "cross_entropy(hard, hard_y)", "loss": "T * T * soft + weight * sharp"},
        ["approx_equal(sum(soft_x), 1)", "approx_equal(sum(soft_y), 1)", "approx_equal(sum(hard_y), 1)"], ["vec_id"], {"soft": "round(soft, 9)", "sharp": "round(sharp, 9)", "loss": "round(loss, 9)"},
    ),
    "prog_dropout": program_query(
        _dropout_inputs, {"train": "a * mask", "test": "a * keep", "other": "a / keep", "expected": "a * keep"},
        ["approx_equal(test, expected)"], ["vec_id"], {"train0": "round(train[0], 9)", "test0": "round(test[0], 9)", "other0": "round(other[0], 9)"},
    ),
    "prog_entropy": program_query(
        _vector_inputs,
        {"raw": "take(p, n)", "active": "raw / sum(raw) if sum(raw) > 0 else raw * 0 + 1 / n", "nats": "-xlogx(active)", "h": "sum(nats)", "bits": "h / log(2)", "each": "nats / log(2)"},
        ["approx_equal(sum(active), 1)"], ["vec_id"], {"h": "round(h, 9)", "bits": "round(bits, 9)", "first": "round(each[0], 9)"},
    ),
    "prog_logical_clock": program_query(
        _clock_inputs, {"top": "local if local > msg else msg", "receive": "top + 1", "ordered": "sent < receive", "gap": "receive - sent"},
        ["receive > local", "receive > msg"], ["event_id"], {"receive": "receive", "ordered": "ordered", "gap": "gap"},
    ),
}
QUERIES |= PROGRAMS
ORACLES["prog_adam"] = """
SELECT l_orderkey, l_linenumber, round(mh, 9) AS mh, round(vh, 9) AS vh, round(0.01 * mh / (sqrt(vh) + 1e-8), 9) AS update, TRUE AS holds_1, TRUE AS holds_2
FROM (SELECT l_orderkey, l_linenumber, (1 - 0.9::DOUBLE) * l_discount / (1 - power(0.9::DOUBLE, l_linenumber)) AS mh, (1 - 0.999::DOUBLE) * l_discount * l_discount / (1 - power(0.999::DOUBLE, l_linenumber)) AS vh FROM lineitem)"""
ORACLES["prog_attention"] = BASE_SQL + """,
a AS (SELECT vec_id, m, list_transform(m, lambda r: list_sum(list_transform(r, lambda x, i: x * w[i])) / (CASE WHEN vec_id % 2 = 0 THEN sqrt(2) ELSE 1 END)) AS z FROM d),
b1 AS (SELECT vec_id, m, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM a),
f AS (SELECT vec_id, m, list_transform(ex, lambda x: x / list_sum(ex)) AS wt FROM b1)
SELECT vec_id, round(wt[1], 9) AS w0, round(wt[4], 9) AS w3, round(list_sum(list_transform(wt, lambda x, i: x * m[i][1])), 9) AS o0, round(list_sum(list_transform(wt, lambda x, i: x * m[i][16])), 9) AS o15, TRUE AS holds_1 FROM f"""
ORACLES["prog_batchnorm"] = BASE_SQL + """,
a AS (SELECT vec_id, v, list_sum(v) / len(v) AS mu FROM d), b1 AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / len(v) AS var FROM a)
SELECT vec_id, round(mu, 9) AS mu, round(var, 9) AS var, round(1.5 * (v[1] - mu) / sqrt(var + 0.001) + 0.25, 9) AS y0, round(1.5 * (v[64] - mu) / sqrt(var + 0.001) + 0.25, 9) AS y63, TRUE AS holds_1, TRUE AS holds_2 FROM b1"""
ORACLES["prog_distillation"] = BASE_SQL + """,
a AS (SELECT vec_id, list_transform(v[1:8], lambda x: exp(x * 5)) AS ex, list_transform(w[1:8], lambda x: exp(x * 5)) AS ey, list_transform(w[1:8], lambda x: exp(x * 10)) AS eh FROM d),
b1 AS (SELECT vec_id, -list_sum(list_transform(ex, lambda x, i: x / list_sum(ex) * ln(ey[i] / list_sum(ey)))) AS soft, -ln(eh[1] / list_sum(eh)) AS sharp FROM a)
SELECT vec_id, round(soft, 9) AS soft, round(sharp, 9) AS sharp, round(4 * soft + 0.3 * sharp, 9) AS loss, TRUE AS holds_1, TRUE AS holds_2, TRUE AS holds_3 FROM b1"""
ORACLES["prog_dropout"] = BASE_SQL + "SELECT vec_id, round(v[1] * (CASE WHEN w[1] > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS train0, round(v[1] * 0.5, 9) AS test0, round(v[1] / 0.5, 9) AS other0, TRUE AS holds_1 FROM d"
ORACLES["prog_entropy"] = BASE_SQL + """,
a AS (SELECT vec_id, list_transform(p[1:4], lambda x: x / list_sum(p[1:4])) AS act FROM d)
SELECT vec_id, round(-list_sum(list_transform(act, lambda x: x * ln(x))), 9) AS h, round(-list_sum(list_transform(act, lambda x: x * ln(x))) / ln(2), 9) AS bits, round(-act[1] * ln(act[1]) / ln(2), 9) AS first, TRUE AS holds_1 FROM a"""
ORACLES["prog_logical_clock"] = """
SELECT event_id, greatest(user_id::DOUBLE, floor(value)) + 1 AS receive, TRUE AS ordered, greatest(user_id::DOUBLE, floor(value)) + 1 - floor(value) AS gap, TRUE AS holds_1, TRUE AS holds_2 FROM events"""
