"""Every registered deliverable vs its DuckDB oracle (row count, columns, values)."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, make_duck

QUERIES = {k: f for k, f in E.queries().items() if k in E.ENTRIES}
SQL = {k: s for k, s in E.oracle_sql().items() if k in E.ENTRIES}


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in recs), sorted(cols)


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF_SMALL)


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = set(QUERIES) - set(SQL)
    assert not rows_only


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    s_rows, s_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[key])
    o_rows, o_cols = _rows([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == o_cols
    assert s_rows == o_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.collect()) > 0
    assert "college_id" in df.columns


def test_output_type_map_is_in_sync(spark, wh_small):
    from ledgerlens.oracle.output_types import OUTPUT_TYPES
    from ledgerlens.plans.catalog import ENTRIES
    from ledgerlens.plans.registry import column_kinds

    for key, entry in ENTRIES.items():
        assert OUTPUT_TYPES[key] == column_kinds(entry.spark_fn(wh_small).schema), key
