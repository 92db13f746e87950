"""Holds a query against its SQL."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def same_rows(spark, query, sql):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = query(spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    rows = [tuple(map(_plain, r)) for r in got.select(*names).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(_plain, r)) for r in want), key=repr)
