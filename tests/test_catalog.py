"""Every registered query against its SQL on the smallest tables; the rest must run and give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from meterlake.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return None
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 4)
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        (columns, got), (names, expect) = rows(found), rows(duck.execute(SQL[name]).df())
        assert columns == names and len(got) == len(expect)
        for a, b in zip(got, expect, strict=True):
            assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-3 * max(1, abs(y)) for x, y in zip(a, b, strict=True))
    else:
        assert len(found)


@pytest.mark.parametrize("name", ["e1_experiment", "m13_f1_macro", "r1_metrics_per_step"])
def test_a_state_that_never_occurs(spark, tmp_path, name):
    """Readings that are on in every hour: the state off occurs neither in truth nor in prediction."""
    con = duckdb.connect()
    con.execute("create table events as select i as event_id, timestamp '2024-01-01' + to_seconds(cast(i // 4 * 3600 as bigint)) as ts, i % 4 as user_id, 'view' as event_type, 100.0::double + i % 7 as value from range(4 * 48) t(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    found, expect = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df()
    assert rows(found) == rows(expect) and len(found)


def test_names_are_whole():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 110


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["house", "appliance", "start_k", "end_k", "steps", "energy"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
