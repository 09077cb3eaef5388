"""JSON documents as rows of pointers and leaves, patched and restored there, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Rounds

#: The most patches of a document, and names that no patch may go through.
MAX_PATCHES = 8
PROTECTED = "id claim_id source_id focus audience ast_version canonical_ast".split()
#: A place after all children.
_LAST = 2**31 - 1


def _kind(v: Column) -> Column:
    text = F.schema_of_variant(v)
    return F.when(text.startswith("OBJECT"), "object").when(text.startswith("ARRAY"), "array").otherwise("leaf")


def nodes(df: DataFrame, key: str, json: str, maps: tuple[str, ...] = ()) -> DataFrame:
    """(id, pointer, pattern, path, name, kind, value): every node of the documents in column ``json`` of ``df``, texts that aren't JSON left out.

    A round unfolds the objects and arrays that the last one came upon, so there are as many rounds as levels, each a written table. ``pointer`` escapes ~ and / in names,
    ``pattern`` is the pointer with * for places in arrays, and for names in the objects at the patterns ``maps``; ``path`` are the places from the root, by which nodes are ordered;
    ``value`` is a leaf's JSON text (an empty object or array is an inner node without children). Names come in the order of VARIANT, by code point.
    """
    spark = df.sparkSession
    with Rounds(spark) as rounds:
        root = df.select(F.col(key).alias("id"), F.lit("").alias("pointer"), F.lit("").alias("pattern"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(json).alias("v")).filter("v is not null")
        now, parts = rounds.keep(root.withColumn("kind", _kind(F.col("v")))), []
        while not now.isEmpty():
            parts.append(now.select("id", "pointer", "pattern", "path", "name", "kind", F.when(F.col("kind") == "leaf", F.to_json("v")).alias("value")))
            inner = now.filter("kind != 'leaf'").select("id", "pointer", "pattern", "path", "kind", "v")
            below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "child"))
            step = F.coalesce(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
            any_name = (F.col("kind") == "array") | F.col("pattern").isin(*maps)
            below = below.select(
                "id", F.concat_ws("/", "pointer", step).alias("pointer"), F.concat_ws("/", "pattern", F.when(any_name, "*").otherwise(step)).alias("pattern"),
                F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"), F.col("key").alias("name"), _kind(F.col("child")).alias("kind"), F.col("child").alias("v"),
            )
            now = rounds.keep(below)
        out = parts[0] if parts else root.select("id", "pointer", "pattern", "path", "name", F.lit("").alias("kind"), F.lit("").alias("value"))
        for part in parts[1:]:
            out = out.unionByName(part)
        return rounds.result(out)


def assembled(nodes: DataFrame) -> DataFrame:
    """(id, json): the documents again. A node gives what comes before its children, an inner one also what comes after them; ordered by path these are the text, so
    one shuffle puts any depth together. A document's text is one value, as it was."""
    quoted = F.to_json(F.to_variant_object(F.array("name")))
    start = F.concat(
        F.when((F.size("path") > 0) & (F.element_at("path", -1) > 0), ",").otherwise(""),
        F.when(F.col("name").isNotNull(), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"))).otherwise(""),
        F.when(F.col("kind") == "object", "{").when(F.col("kind") == "array", "[").otherwise(F.col("value")),
    )
    end = F.struct(F.concat("path", F.array(F.lit(_LAST))).alias("path"), F.when(F.col("kind") == "object", "}").otherwise("]").alias("text"))
    both = F.array(F.struct("path", start.alias("text")), F.when(F.col("kind") != "leaf", end))
    tokens = nodes.withColumn("path", F.when(F.size("path") > 0, F.col("path")).otherwise(F.array().cast("array<int>"))).select("id", F.explode(F.array_compact(both)).alias("t"))
    return tokens.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("json"))


def patched_documents(nodes: DataFrame, patches: DataFrame, allowed: DataFrame, owned: list[str], escaped: bool = False) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the values of ``patches`` (id, op, path, value: JSON text), and the findings (id, path, code) on patches that can't be made.

    A patch replaces one leaf that ``allowed`` (id, path) names and that lies at least two steps down in a part in ``owned``; none goes through a protected name, and none with an escape unless
    ``escaped``. A document takes all its patches or, if one is refused or they are more than MAX_PATCHES, none.
    """
    steps = F.slice(F.split("path", "/", -1), 2, F.greatest(F.size(F.split("path", "/", -1)) - 1, F.lit(0)))
    told = patches.withColumns({"_steps": steps, "_twice": F.count(F.lit(1)).over(W.partitionBy("id", "path")), "_n": F.count(F.lit(1)).over(W.partitionBy("id"))})
    told = told.join(allowed.select("id", "path").distinct().withColumn("_allowed", F.lit(True)), ["id", "path"], "left")
    told = told.join(nodes.select("id", F.col("pointer").alias("path"), F.col("kind").alias("_kind")), ["id", "path"], "left")
    broad = ~F.col("path").startswith("/") | (F.size("_steps") < 2) | F.exists("_steps", lambda s: (s == "") | s.isin(*PROTECTED) | (F.lit(not escaped) & F.contains(s, F.lit("~"))))
    code = (
        F.when(F.col("_n") > MAX_PATCHES, "TOO_MANY")
        .when(~F.coalesce(F.col("op") == "replace", F.lit(False)) | F.try_parse_json("value").isNull(), "NOT_A_REPLACE")
        .when(F.coalesce(broad, F.lit(True)) | ~F.col("_steps")[0].isin(*owned), "PATH_REFUSED")
        .when(F.col("_allowed").isNull(), "NOT_ALLOWED")
        .when(F.col("_twice") > 1, "TWICE")
        .when(F.col("_kind").isNull(), "NO_SUCH_NODE")
        .when(F.col("_kind") != "leaf", "INNER_NODE")
    )
    judged = told.withColumn("code", code)
    findings = judged.filter("code is not null").select("id", "path", "code")
    fine = judged.join(findings.select("id").distinct(), "id", "left_anti").select("id", F.col("path").alias("pointer"), F.to_json(F.try_parse_json("value")).alias("_new"))
    out = nodes.join(fine, ["id", "pointer"], "left")
    return out.withColumn("value", F.coalesce("_new", "value")).drop("_new").select(nodes.columns), findings


def restored_documents(nodes: DataFrame, containers: dict[str, str], enums: dict[str, list[str]]) -> DataFrame:
    """``nodes`` with null replaced by an empty object or array at the patterns of ``containers`` ("object" or "array"), and names in another case by their own at those of ``enums``,
    where just one fits. Nothing else is touched."""
    empty = F.lit(None).cast("string")
    for pattern, kind in containers.items():
        empty = F.when((F.col("pattern") == pattern) & (F.col("value") == "null"), kind).otherwise(empty)
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    name = F.lit(None).cast("string")
    for pattern, names in enums.items():
        fits = F.filter(F.array(*map(F.lit, names)), lambda n: F.lower(n) == F.lower(text))
        name = F.when((F.col("pattern") == pattern) & F.startswith("value", F.lit('"')) & (F.size(fits) == 1), F.concat(F.lit('"'), F.get(fits, F.lit(0)), F.lit('"'))).otherwise(name)
    return nodes.withColumns({"kind": F.coalesce(empty, "kind"), "value": F.when(empty.isNotNull(), None).otherwise(F.coalesce(name, "value"))})
