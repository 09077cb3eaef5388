"""A small expression language compiled on the driver to Spark columns; nothing of it runs in Python on executors."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F

from .arrays import BOOLEAN, MATRIX, OLDER, OPERATIONS, SCALAR, TEXT, VECTOR, Value, need

#: The limits of an expression.
MAX_CHARS, MAX_NODES, MAX_DEPTH, MAX_TEXT = 4096, 256, 32, 128
_BINARY = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide", ast.Pow: "power"}
_COMPARE = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}


#: What a node of each kind holds: whether its value may be so, and the least and most arguments (None: any number).
KINDS = {
    "literal": (lambda v: isinstance(v, bool) or isinstance(v, str) and len(v) <= MAX_TEXT or isinstance(v, int | float) and abs(v) <= 1e300, 0, 0),
    "variable": (lambda v: isinstance(v, str) and v.isidentifier(), 0, 0),
    "array": (lambda v: v is None, 1, None),
    "call": (lambda v: isinstance(v, str) and v in OPERATIONS, 0, None),
    "index": (lambda v: type(v) is int and v >= 0, 1, 1),
    "compare": (lambda v: v in _COMPARE.values(), 2, 2),
    "if": (lambda v: v is None, 3, 3),
    "not": (lambda v: v is None, 1, 1),
    "and": (lambda v: v is None, 2, None),
    "or": (lambda v: v is None, 2, None),
}


@dataclass(frozen=True)
class Node:
    """A tree of the language; ``Node.of`` accepts nothing that ``KINDS`` doesn't allow, whether it comes from a text or from stored JSON."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()

    @staticmethod
    def of(kind: object, value: object, args: list[Node]) -> Node:
        need(isinstance(kind, str) and kind in KINDS, f"no node of kind {kind}")
        fine, least, most = KINDS[kind]
        need(fine(value), f"{kind} can't hold {value!r}")
        need(least <= len(args) and (most is None or len(args) <= most), f"{kind} of {len(args)} arguments")
        need(kind != "call" or OPERATIONS[value][0] == len(args), f"{value} of {len(args)} arguments")
        return Node(kind, value, tuple(args))

    @staticmethod
    def from_dict(d: dict) -> Node:
        need(isinstance(d, dict) and d.keys() == {"kind", "value", "args"} and isinstance(d["args"], list), "not a node")
        return Node.of(d["kind"], d["value"], [Node.from_dict(x) for x in d["args"]])

    def to_dict(self) -> dict:
        return {"kind": self.kind, "value": self.value, "args": [a.to_dict() for a in self.args]}

    def canonical(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def nodes(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.nodes()

    def references(self) -> set[str]:
        return {n.value for n in self.nodes() if n.kind == "variable"}

    def renamed(self, names: dict[str, str]) -> Node:
        value = names.get(self.value, self.value) if self.kind == "variable" else self.value
        return Node(self.kind, value, tuple(a.renamed(names) for a in self.args))


#: By form of syntax: kind, value and parts of its node. What has no such form gives a value that its kind can't hold.
_OTHER = object()
SYNTAX = {
    ast.Constant: lambda t: ("literal", t.value, []),
    ast.Name: lambda t: ("variable", t.id, []),
    ast.List: lambda t: ("array", None, t.elts),
    ast.Tuple: lambda t: ("array", None, t.elts),
    ast.Call: lambda t: ("call", t.func.id if isinstance(t.func, ast.Name) and not t.keywords else _OTHER, t.args),
    ast.BinOp: lambda t: ("call", _BINARY.get(type(t.op), _OTHER), [t.left, t.right]),
    ast.UnaryOp: lambda t: ("not", None, [t.operand]) if isinstance(t.op, ast.Not) else ("call", "negate" if isinstance(t.op, ast.USub) else _OTHER, [t.operand]),
    ast.BoolOp: lambda t: ("and" if isinstance(t.op, ast.And) else "or", None, t.values),
    ast.Compare: lambda t: ("compare", _COMPARE.get(type(t.ops[0]), _OTHER) if len(t.ops) == 1 else _OTHER, [t.left, t.comparators[0]]),
    ast.IfExp: lambda t: ("if", None, [t.test, t.body, t.orelse]),
    ast.Subscript: lambda t: ("index", t.slice.value if isinstance(t.slice, ast.Constant) else _OTHER, [t.value]),
}


def parse(text: str) -> Node:
    """The canonical tree of an expression; raises ValueError for anything outside the language."""
    need(isinstance(text, str) and 0 < len(text.strip()) and len(text) <= MAX_CHARS, f"an expression is 1 to {MAX_CHARS} characters")
    try:
        top = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, MemoryError, RecursionError) as e:
        raise ValueError(f"not an expression: {e}") from e
    room = iter(range(MAX_NODES))

    def node(t: ast.AST, deeper: int) -> Node:
        need(next(room, None) is not None and deeper >= 0, "the expression is too large")
        if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.UAdd):
            return node(t.operand, deeper - 1)
        need(type(t) in SYNTAX, f"{type(t).__name__} is not in the language")
        kind, value, parts = SYNTAX[type(t)](t)
        return Node.of(kind, value, [node(x, deeper - 1) for x in parts])

    return node(top, MAX_DEPTH)


def compiled(node: Node, names: dict[str, Value]) -> Value:
    """The column of a tree over named values."""
    args = [compiled(a, names) for a in node.args] if node.kind != "if" else []
    match node.kind:
        case "literal":
            v = node.value
            return Value(BOOLEAN, F.lit(v)) if isinstance(v, bool) else Value(TEXT, F.lit(v)) if isinstance(v, str) else Value(SCALAR, F.lit(float(v)))
        case "variable":
            need(node.value in names, f"{node.value} is not bound")
            return names[node.value]
        case "array":
            need(len({a.kind for a in args}) == 1 and args[0].kind in (SCALAR, VECTOR), "an array holds numbers or equal rows")
            return Value(VECTOR if args[0].kind == SCALAR else MATRIX, F.array(*(a.col for a in args)))
        case "call":
            return (OPERATIONS | OLDER)[node.value][1](*args)
        case "index":
            need(args[0].kind in (VECTOR, MATRIX), "only arrays have entries")
            return Value(SCALAR if args[0].kind == VECTOR else VECTOR, F.get(args[0].col, F.lit(node.value)))
        case "compare":
            a, b = args
            kinds = {a.kind, b.kind}
            need(not kinds & {VECTOR, MATRIX}, "arrays don't compare")
            x, y = (v.col.cast("double") if v.kind == BOOLEAN and kinds == {BOOLEAN, SCALAR} else v.col for v in args)
            need(len(kinds) == 1 or kinds == {BOOLEAN, SCALAR} or node.value in ("eq", "ne"), "unlike values have no order")
            if TEXT in kinds and len(kinds) == 2:
                return Value(BOOLEAN, F.lit(node.value == "ne"))
            return Value(BOOLEAN, {"lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y, "eq": x == y, "ne": x != y}[node.value])
        case "if":
            c, a, b = (compiled(x, names) for x in node.args)
            need(c.kind == BOOLEAN and a.kind == b.kind, "a condition is boolean, its branches alike")
            return Value(a.kind, F.when(c.col, a.col).otherwise(b.col))
        case "not" | "and" | "or":
            need(all(a.kind == BOOLEAN for a in args), "booleans are needed")
            out = ~args[0].col if node.kind == "not" else args[0].col
            for a in args[1:]:
                out = out & a.col if node.kind == "and" else out | a.col
            return Value(BOOLEAN, out)
    raise ValueError(f"no node of kind {node.kind}")


def column(text: str, names: dict[str, Value]) -> Value:
    return compiled(parse(text), names)
