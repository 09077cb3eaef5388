"""JSON columns: strict decoding, extra keys, and conservative recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 250_000
#: A fence around the whole text, and a comma before a closing bracket. Strings are stepped over, so their commas stay.
_FENCE = r"(?s)^\s*```(?:json)?\s*\n(.*?)\n?\s*```\s*$"
_COMMA = r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])'


def extra_keys(text: Column, expected: list[str]) -> Column:
    """Keys of an object that are not expected; empty for what is no object."""
    return F.coalesce(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, expected))), F.expr("cast(array() as array<string>)"))


def strict(text: Column, fields: dict[str, str]) -> tuple[Column, Column]:
    """(struct or null, fault or null): an object of exactly these fields and types. Unlike from_json alone, repeated, unknown and
    missing keys, and values of another type, are faults."""
    decoded = F.from_json(text, ", ".join(f"{n} {t}" for n, t in fields.items()))
    keys = F.json_object_keys(text)
    wanted = F.array(*map(F.lit, fields))
    typed = F.lit(True)
    for n in fields:
        typed = typed & (decoded[n].isNotNull() | (F.get_json_object(text, f"$.{n}").isNull()))
    fault = (
        F.when(F.try_parse_json(text).isNull(), "not_json")
        .when(keys.isNull(), "not_an_object")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unknown_field")
        .when(F.size(F.array_except(wanted, keys)) > 0, "missing_field")
        .when(~typed, "wrong_type")
    )
    return F.when(fault.isNull(), decoded), fault


def recovered(text: Column) -> Column:
    """The text without a fence, a byte order mark and trailing commas; null if it still isn't JSON, or has repeated keys, or is too long."""
    bare = F.regexp_replace(text, r"^\x{FEFF}", "")
    bare = F.when(bare.rlike(_FENCE), F.regexp_extract(bare, _FENCE, 1)).otherwise(bare)
    bare = F.regexp_replace(bare, _COMMA, "$1")
    return F.when((F.length(text) <= MAX_CHARS) & F.try_parse_json(bare).isNotNull(), bare)
