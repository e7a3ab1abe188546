"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from strandline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, r.fetchall())


def test_every_query_but_sequential_ones_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"tracker_batch", "tracker_stream", "track_intervals", "team_clustering", "end_to_end"}
    assert os.path.isdir(SF)
