"""Whether computations execute the equations that they are linked to: trees as node rows, equality as a join of digests, symbols bound by joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Node, parse
from ..shared import Rounds

IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_]*$"
NODES = "text string, node int, parent int, place int, depth int, kind string, value string"
#: The kind of the one row of a text that isn't an expression.
INVALID = "invalid"


def _rows(text: str) -> Iterator[tuple]:
    """Nodes in the order of writing, numbered from 0; the root's parent is -1. Numbers are compared as doubles."""
    todo, n = [(parse(text), -1, 0, 0)], 0
    while todo:
        node, parent, place, depth = todo.pop()
        value = node.value if isinstance(node.value, str) or node.value is None else repr(float(node.value))
        yield text, n, parent, place, depth, node.kind, f"'{value}'" if node.kind == "literal" and isinstance(node.value, str) else value
        todo += [(child, n, k, depth + 1) for k, child in reversed(list(enumerate(node.args)))]
        n += 1


def node_rows(texts: DataFrame) -> DataFrame:
    """(text, node, parent, place, depth, kind, value): the trees of the different expressions in ``text``; each is parsed once, however many programs hold it. What isn't an
    expression is one row of kind ``invalid``; null is left out."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for frame in batches:
            rows: list[tuple] = []
            for text in frame["text"]:
                try:
                    rows += _rows(text)
                except ValueError as e:
                    rows.append((text, 0, -1, 0, 0, INVALID, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return texts.select("text").filter("text is not null").distinct().mapInPandas(walk, NODES)


def shapes(nodes: DataFrame, rounds: Rounds) -> DataFrame:
    """(text, shape, symbols) of every valid text: the digest of its tree without the names of its variables, and these names in the order of writing.

    Digests go up from the leaves, a level a round: a node's is that of its kind, its value and its children's digests. Two trees are equal after binding if their shapes are and
    their bound variables are, one after another. A tree has at most a few hundred nodes, so arrays of names are bounded.
    """
    sound = nodes.filter(F.col("kind") != INVALID)
    deepest = sound.agg(F.max("depth")).first()[0]
    below: DataFrame | None = None
    own_value = F.when(F.col("kind") == "variable", "").otherwise(F.coalesce("value", F.lit("")))
    for depth in range(deepest or 0, -1, -1):
        level = sound.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.array().cast("array<string>"))
        else:
            parts = below.groupBy("text", F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("children"))
            level = level.join(parts, ["text", "node"], "left")
        digest = F.sha2(F.to_json(F.struct("kind", own_value.alias("value"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))), 256)
        below = rounds.keep(level.select("text", "node", "parent", "place", digest.alias("digest")))
    roots = below.select("text", F.col("digest").alias("shape"))
    names = sound.filter("kind = 'variable'").groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "value"))), lambda x: x["value"]).alias("symbols"))
    return rounds.keep(roots.join(names, "text", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>"))))


@dataclass
class Equations:
    """Tables over any number of cases; each has ``case``, and:

    computations: id, kind, expression. bindings: id, alias, variable. outputs: id, variable. links: id, equation. equations: equation, expression.
    equation_variables: equation, variable. variables: variable, source_symbol, display_symbol. scope: equation, scope.
    """

    computations: DataFrame
    bindings: DataFrame
    outputs: DataFrame
    links: DataFrame
    equations: DataFrame
    equation_variables: DataFrame
    variables: DataFrame
    scope: DataFrame


def _symbols(variables: DataFrame) -> DataFrame:
    own = variables.select("case", "variable", F.explode(F.array_distinct(F.array_compact(F.array("source_symbol", "display_symbol")))).alias("symbol"))
    return own.filter("symbol != ''")


def _bound(links: DataFrame, text: str, shape: DataFrame, names: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Per link: the shape of its ``text``, its variables as bound by ``names`` (keys, symbol, variable, n) in order, and the first symbol without a variable or with several."""
    placed = links.select("case", "id", "equation", F.col(text).alias("text")).join(shape, "text")
    each = placed.select("case", "id", "equation", "shape", F.posexplode_outer("symbols").alias("at", "symbol")).join(names, [*keys, "symbol"], "left")
    code = F.when(F.col("n").isNull(), "SYMBOL_UNMAPPED").when(F.col("n") > 1, "SYMBOL_AMBIGUOUS")
    odd = F.when(F.col("symbol").isNotNull() & code.isNotNull(), F.struct("at", code.alias("code"), F.col("symbol").alias("detail")))
    bound = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "variable"))))
    return each.groupBy("case", "id", "equation", "shape").agg(bound.alias(f"{side}_bound"), F.min(odd).alias(f"{side}_odd")).withColumnRenamed("shape", f"{side}_shape")


def right_side(expression: Column) -> tuple[Column, Column, Column]:
    """What is left and right of an equation's sign (left is null where there is none), and whether its notation is one that is known."""
    assigned = F.contains(expression, F.lit("=")) & ~expression.rlike("==|<=|>=|!=")
    left = F.when(assigned, F.trim(F.substring_index(expression, "=", 1)))
    right = F.when(assigned, F.trim(F.substring(expression, F.instr(expression, "=") + 1, F.length(expression)))).otherwise(expression)
    return left, right, ~assigned | (F.coalesce(left.rlike(IDENTIFIER), F.lit(False)) & ~F.contains(right, F.lit("=")))


def equation_findings(t: Equations) -> DataFrame:
    """(case, code, target, detail): links to equations that don't exist or can't be linked, symbols without a variable or with several, equations that differ from what is computed
    after binding, and equations that nothing executes. Each link has its first finding only, in the order of these rules.

    Renaming by bindings is no difference; another order of operands is. A symbol means the variables of the equation that have it as source or display symbol; the computation's own aliases,
    where they name a variable of the equation, settle which of several. Null expressions are invalid.
    """
    with Rounds(t.links.sparkSession) as rounds:
        left, right, known = right_side(F.col("equation_text"))
        of = t.equations.select("case", "equation", F.col("expression").alias("equation_text"), F.lit(True).alias("exists"))
        links = t.links.distinct().join(of, ["case", "equation"], "left").join(t.computations.select("case", "id", "kind", F.col("expression").alias("computed")), ["case", "id"])
        links = rounds.keep(links.withColumns({"left": left, "right": right, "known": known}))
        nodes = rounds.keep(node_rows(links.select(F.col("right").alias("text")).union(links.select("computed"))))
        shape = shapes(nodes, rounds)

        meant = t.equation_variables.join(_symbols(t.variables), ["case", "variable"]).groupBy("case", "equation", "symbol").agg(F.count_distinct("variable").alias("n"), F.min("variable").alias("variable"))
        aliases = t.links.distinct().join(t.bindings, ["case", "id"]).join(t.equation_variables.distinct(), ["case", "equation", "variable"]).groupBy("case", "id", "equation", F.col("alias").alias("symbol")).agg(F.min("variable").alias("aliased"))
        of_link = t.links.distinct().join(meant, ["case", "equation"])
        both = of_link.join(aliases, ["case", "id", "equation", "symbol"], "full_outer")
        names = both.select("case", "id", "equation", "symbol", F.coalesce("aliased", "variable").alias("variable"), F.when(F.col("aliased").isNotNull(), 1).otherwise(F.col("n")).alias("n"))
        clash = both.filter((F.col("n") == 1) & (F.col("aliased") != F.col("variable"))).groupBy("case", "id", "equation").agg(F.min("symbol").alias("clash"))
        own = t.bindings.groupBy("case", "id", F.col("alias").alias("symbol")).agg(F.count_distinct("variable").alias("n"), F.min("variable").alias("variable"))

        expected = _bound(links, "right", shape, names, ["case", "id", "equation"], "e")
        actual = _bound(links, "computed", shape, own, ["case", "id"], "c")
        outputs = t.outputs.join(_symbols(t.variables), ["case", "variable"]).select("case", "id", F.col("symbol").alias("left")).distinct().withColumn("named", F.lit(True))
        judged = links.join(outputs, ["case", "id", "left"], "left").join(clash, ["case", "id", "equation"], "left").join(expected, ["case", "id", "equation"], "left").join(actual, ["case", "id", "equation"], "left")
        told = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
        col = F.col
        rules = [
            (col("exists").isNull(), told("EQUATION_UNKNOWN", col("equation"))),
            (~col("kind").eqNullSafe("expression"), told("LINK_KIND_UNSUPPORTED", col("kind"))),
            (~F.coalesce(col("known"), F.lit(False)), told("NOTATION_UNSUPPORTED", col("equation_text"))),
            (col("left").isNotNull() & col("named").isNull(), told("OUTPUT_SYMBOL_DIFFERS", col("left"))),
            (col("clash").isNotNull(), told("BINDING_AMBIGUOUS", col("clash"))),
            (col("e_shape").isNull(), told("EXPRESSION_INVALID", col("right"))),
            (col("c_shape").isNull(), told("EXPRESSION_INVALID", col("computed"))),
            (col("c_odd").isNotNull(), F.struct("c_odd.code", "c_odd.detail")),
            (col("e_odd").isNotNull(), F.struct("e_odd.code", "e_odd.detail")),
            ((col("e_shape") != col("c_shape")) | (col("e_bound") != col("c_bound")), told("EQUATION_DIFFERS", col("computed"))),
        ]
        first = F.lit(None).cast("struct<code:string, detail:string>")
        for rule, value in reversed(rules):
            first = F.when(rule, value).otherwise(first)
        of_links = judged.withColumn("f", first).filter("f is not null").select("case", "f.code", F.concat_ws(":", "id", "equation").alias("target"), "f.detail")
        linked = t.links.select("case", "equation").distinct()
        context = t.scope.filter("scope = 'context_only'").select("case", "equation").distinct()
        loose = t.equations.select("case", "equation").join(linked, ["case", "equation"], "left_anti").join(context, ["case", "equation"], "left_anti").select("case", F.lit("EQUATION_UNLINKED").alias("code"), F.col("equation").alias("target"), F.lit(None).cast("string").alias("detail"))
        absent = t.scope.select("case", "equation").distinct().join(t.equations.select("case", "equation"), ["case", "equation"], "left_anti").select("case", F.lit("SCOPE_UNKNOWN").alias("code"), F.col("equation").alias("target"), F.lit(None).cast("string").alias("detail"))
        return rounds.result(of_links.unionByName(loose).unionByName(absent))
