import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from siltloom.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _canonical(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert _canonical(df.select(*columns).collect()) == _canonical(expected)


def test_entry_and_names(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p3_found", "p3_instants"])
def test_queries_without_sql_give_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_core_does_not_import_the_subpackage():
    for p in (ROOT / "siltloom").rglob("*.py"):
        if p.relative_to(ROOT / "siltloom").parts[0] != "llm":
            assert not re.search(r"siltloom\.llm|from \.+llm", p.read_text()), p
