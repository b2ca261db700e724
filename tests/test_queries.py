"""Every registered query against its SQL twin on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from pagelake.sources.tables import FIXTURE_TABLES

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in FIXTURE_TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if isinstance(v, dt.datetime) else str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.OWN_QUERIES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 50 and "reason" in df.columns


def test_every_query_has_a_twin():
    assert set(entry.OWN_QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_parts_are_left_out_and_broken_ones_are_not(tmp_path, monkeypatch):
    (tmp_path / "part_with_a_fault.py").write_text("import no_such_module_at_all\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("pagelake_part_that_is_not_there") is None
    with pytest.raises(ModuleNotFoundError, match="no_such_module_at_all"):
        entry._optional("part_with_a_fault")
