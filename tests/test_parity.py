"""Every query of the catalog against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


#: On the smallest tables no seller has enough peers for these.
LARGER = {"seller_metrics", "seller_score"}


def place(name):
    return "/root/testdata/sf0.01" if name in LARGER else SF


def connect(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in row))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, place(name))
    columns = sorted(df.columns)
    want = connect(place(name)).execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = ordered([tuple(row[names.index(c)] for c in columns) for row in want.fetchall()])
    got = ordered([tuple(row) for row in df.select(columns).collect()])
    assert len(got) == len(rows) and got
    for a, b in zip(got, rows, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (dict(zip(columns, a)), dict(zip(columns, b)))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0
