"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from readforge.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if isinstance(x, float):
        return f"{x:.8g}"
    return "[" + ",".join(map(text, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def lines(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_same_rows(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert lines([tuple(r) for r in got.collect()], got.columns) == lines(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
