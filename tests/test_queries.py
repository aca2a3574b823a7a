"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from flowtide.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # iterative, sketching and keyed work has no SQL
    assert set(QUERIES) - set(ORACLES) == {
        "unique_counts_approximate", "anonymised_flows", "kmeans_clusters", "principal_components",
    }


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    want_rel = duck.sql(ORACLES[name])
    assert sorted(want_rel.columns) == columns
    order = [want_rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in want_rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
        assert not any(isinstance(v, float) and (math.isnan(v) or str(v) == "-0.0") for v in g)


def test_entry(spark):
    import __spark_entry__ as entry_points

    df = entry_points.entry(spark)
    assert df.columns == ["slot", "entropy", "alarm"] and df.count() > 0
