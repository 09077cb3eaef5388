"""The registry of scalar, vector and matrix operations as Spark columns.

A scalar is a DOUBLE, a vector an ARRAY<DOUBLE>, a matrix an ARRAY<ARRAY<DOUBLE>> of rows. Values outside an operation's domain come out
as null, NaN or infinite and are caught where a step's result is checked (``checked`` or ``is_valid``), so errors never pass as numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALAR, VECTOR, MATRIX, BOOLEAN, TEXT = "scalar", "vector", "matrix", "boolean", "text"
#: Largest number, largest exponent, tolerance.
LARGEST, EXPONENT, TOLERANCE = 1e300, 128.0, 1e-8


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column


def scalar(col: Column) -> Value:
    return Value(SCALAR, col.cast("double"))


def vector(col: Column) -> Value:
    return Value(VECTOR, col.cast("array<double>"))


def matrix(col: Column) -> Value:
    return Value(MATRIX, col.cast("array<array<double>>"))


def let(bound: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(bound), body), 1)


def exact_sum(v: Column) -> Column:
    """Sum of a vector with Neumaier's compensation; null if an entry is null."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(v, zero, step, lambda a: a["s"] + a["c"])


def entries(x: Value) -> Column:
    return F.flatten(x.col) if x.kind == MATRIX else F.array(x.col) if x.kind == SCALAR else x.col


def need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def unary(x: Value, f: Callable[[Column], Column]) -> Value:
    need(x.kind in (SCALAR, VECTOR, MATRIX), "a number or array is needed")
    if x.kind == SCALAR:
        return Value(SCALAR, f(x.col))
    if x.kind == VECTOR:
        return Value(VECTOR, F.transform(x.col, f))
    return Value(MATRIX, F.transform(x.col, lambda r: F.transform(r, f)))


def binary(x: Value, y: Value, f: Callable[[Column, Column], Column]) -> Value:
    """Equal shapes, or a scalar with either; zip_with pads unequal lengths with nulls, which checks catch."""
    need({x.kind, y.kind} <= {SCALAR, VECTOR, MATRIX}, "numbers or arrays are needed")
    if y.kind == SCALAR:
        return unary(x, lambda a: f(a, y.col))
    if x.kind == SCALAR:
        return unary(y, lambda b: f(x.col, b))
    need(x.kind == y.kind, "a vector doesn't go with a matrix")
    if x.kind == VECTOR:
        return Value(VECTOR, F.zip_with(x.col, y.col, f))
    return Value(MATRIX, F.zip_with(x.col, y.col, lambda r, s: F.zip_with(r, s, f)))


def power(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) <= EXPONENT, F.pow(a, b))


def xlogx(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).when(x > 0, x * F.ln(x))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def _vector_op(f: Callable[[Column], Column], kind: str) -> Callable[[Value], Value]:
    def op(x: Value) -> Value:
        need(x.kind == VECTOR, "a vector is needed")
        return Value(kind, f(x.col))

    return op


def dot_columns(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), exact_sum(F.zip_with(a, b, lambda x, y: x * y)))


def dot(x: Value, y: Value) -> Value:
    need(x.kind == y.kind == VECTOR, "two vectors are needed")
    return Value(SCALAR, dot_columns(x.col, y.col))


def transpose_column(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda r: r[j]))


def transpose(x: Value) -> Value:
    need(x.kind == MATRIX, "a matrix is needed")
    return Value(MATRIX, transpose_column(x.col))


def matmul(x: Value, y: Value) -> Value:
    need(x.kind == MATRIX and y.kind in (VECTOR, MATRIX), "a matrix and a vector or matrix are needed")
    if y.kind == VECTOR:
        return Value(VECTOR, F.transform(x.col, lambda r: dot_columns(r, y.col)))
    return Value(MATRIX, let(transpose_column(y.col), lambda t: F.transform(x.col, lambda r: F.transform(t, lambda c: dot_columns(r, c)))))


def norm_column(v: Column) -> Column:
    """Scaled by the largest entry, so that squares neither overflow nor vanish."""
    scaled = let(F.array_max(F.transform(v, F.abs)), lambda m: F.when(m == 0, F.lit(0.0)).otherwise(m * F.sqrt(exact_sum(F.transform(v, lambda x: (x / m) * (x / m))))))
    return scaled


def normalize(v: Column) -> Column:
    return let(norm_column(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def softmax(v: Column) -> Column:
    raised = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(raised, lambda e: let(exact_sum(e), lambda z: F.transform(e, lambda x: x / z)))


def is_distribution(v: Column) -> Column:
    return F.forall(v, lambda x: (x >= 0) & (x <= 1)) & (F.abs(exact_sum(v) - 1) <= TOLERANCE)


def entropy(v: Column) -> Column:
    return F.when(is_distribution(v), -exact_sum(F.transform(v, xlogx)))


def cross_entropy(x: Value, y: Value) -> Value:
    need(x.kind == y.kind == VECTOR, "two distributions are needed")
    terms = F.zip_with(x.col, y.col, lambda p, q: F.when(p == 0, F.lit(0.0)).when(q > 0, p * F.ln(q)))
    return Value(SCALAR, F.when(is_distribution(x.col) & is_distribution(y.col) & (F.size(x.col) == F.size(y.col)), -exact_sum(terms)))


def take(x: Value, n: Value) -> Value:
    need(x.kind == VECTOR and n.kind == SCALAR, "a vector and a count are needed")
    fits = (n.col == F.floor(n.col)) & (n.col >= 1) & (n.col <= F.size(x.col))
    return Value(VECTOR, F.when(fits, F.slice(x.col, F.lit(1), n.col.cast("int"))))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def approx_equal(x: Value, y: Value) -> Value:
    if x.kind != y.kind:
        return Value(BOOLEAN, F.lit(False))
    if x.kind == SCALAR:
        return Value(BOOLEAN, close(x.col, y.col))
    same = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda t: F.coalesce(t, F.lit(False)))
    if x.kind == VECTOR:
        return Value(BOOLEAN, same(x.col, y.col))
    rows = F.zip_with(x.col, y.col, lambda r, s: F.coalesce(same(r, s), F.lit(False)))
    return Value(BOOLEAN, (F.size(x.col) == F.size(y.col)) & F.forall(rows, lambda t: t))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def variance(x: Value) -> Value:
    mean = exact_sum(entries(x)) / F.size(entries(x))
    return Value(SCALAR, let(mean, lambda m: exact_sum(F.transform(entries(x), lambda e: (e - m) * (e - m))) / F.size(entries(x))))


def distance(x: Value, y: Value) -> Value:
    return Value(SCALAR, norm_column(binary(x, y, lambda a, b: a - b).col))


def clip(x: Value, low: Value, high: Value) -> Value:
    return unary(x, lambda a: F.greatest(low.col, F.least(high.col, a)))


def unit_sum(v: Column) -> Column:
    return let(exact_sum(v), lambda z: F.when(z != 0, F.transform(v, lambda x: x / z)))


#: Name to (number of arguments, function of values).
OPERATIONS: dict[str, tuple[int, Callable[..., Value]]] = {
    "add": (2, lambda x, y: binary(x, y, lambda a, b: a + b)),
    "subtract": (2, lambda x, y: binary(x, y, lambda a, b: a - b)),
    "multiply": (2, lambda x, y: binary(x, y, lambda a, b: a * b)),
    "divide": (2, lambda x, y: binary(x, y, lambda a, b: F.try_divide(a, b))),
    "power": (2, lambda x, y: binary(x, y, power)),
    "negate": (1, lambda x: unary(x, lambda a: -a)),
    "abs": (1, lambda x: unary(x, F.abs)),
    "sqrt": (1, lambda x: unary(x, F.sqrt)),
    "exp": (1, lambda x: unary(x, F.exp)),
    "log": (1, lambda x: unary(x, log)),
    "sin": (1, lambda x: unary(x, F.sin)),
    "cos": (1, lambda x: unary(x, F.cos)),
    "sum": (1, lambda x: Value(SCALAR, exact_sum(entries(x)))),
    "mean": (1, lambda x: Value(SCALAR, exact_sum(entries(x)) / F.size(entries(x)))),
    "min": (1, _vector_op(F.array_min, SCALAR)),
    "max": (1, _vector_op(F.array_max, SCALAR)),
    "dot": (2, dot),
    "matmul": (2, matmul),
    "transpose": (1, transpose),
    "norm": (1, lambda x: Value(SCALAR, norm_column(entries(x)))),
    "normalize": (1, _vector_op(normalize, VECTOR)),
    "softmax": (1, _vector_op(softmax, VECTOR)),
    "entropy": (1, _vector_op(entropy, SCALAR)),
    "cross_entropy": (2, cross_entropy),
    "xlogx": (1, lambda x: unary(x, xlogx)),
    "take": (2, take),
    "approx_equal": (2, approx_equal),
}
#: Operations of the older expression form alone.
OLDER: dict[str, tuple[int, Callable[..., Value]]] = {
    "variance": (1, variance),
    "sigmoid": (1, lambda x: unary(x, sigmoid)),
    "distance": (2, distance),
    "clip": (3, clip),
    "argmax": (1, _vector_op(lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("double"), SCALAR)),
    "unit_sum": (1, _vector_op(unit_sum, VECTOR)),
}


def is_valid(x: Value) -> Column:
    """Whether every entry is a finite number of at most ``LARGEST``, and arrays are neither empty nor ragged."""
    fine = lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) <= LARGEST), F.lit(False))
    if x.kind == SCALAR:
        return fine(x.col)
    if x.kind == VECTOR:
        return F.coalesce((F.size(x.col) > 0) & F.forall(x.col, fine), F.lit(False))
    if x.kind == MATRIX:
        width = F.size(x.col[0])
        return F.coalesce((F.size(x.col) > 0) & F.forall(x.col, lambda r: (F.size(r) == width) & F.forall(r, fine)), F.lit(False))
    return x.col.isNotNull()


def checked(x: Value, name: str) -> Column:
    """The value, or an error where it isn't valid."""
    return F.when(is_valid(x), x.col).otherwise(F.raise_error(F.lit(f"{name} is not a finite value")))
