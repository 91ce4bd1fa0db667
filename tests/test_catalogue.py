"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import math
import os

import duckdb
import pytest

from tabularium.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def same(df, sql, sf_dir):
    names, rows = oracle(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=str)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
