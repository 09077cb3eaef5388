"""Every registered query of the reference's own operators against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from corpusflow.jobs import catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(values):
    return sorted(repr(tuple(round(x, 7) + 0.0 if isinstance(x, float) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    found = rows(map(tuple, frame.select(*columns).collect()))
    if name not in catalogue.ORACLES:
        assert found
        return
    names = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(catalogue.ORACLES[name]).columns) == columns
    assert found == rows(duck.sql(f"SELECT {names} FROM ({catalogue.ORACLES[name]})").fetchall())


def test_every_query_without_sql_is_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"page_elements", "page_sections", "recovered_packs"}
