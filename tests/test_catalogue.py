"""Each catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from treeloom import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, tmp_path, name):
    out = str(tmp_path / "out")
    catalogue.QUERIES[name](spark, DATA).write.parquet(out)
    got = con.execute(f"SELECT * FROM '{out}/*.parquet'")
    columns = sorted(d[0] for d in got.description)
    con.execute(f"CREATE OR REPLACE TABLE oracle AS {catalogue.ORACLE_SQL[name]}")
    assert columns == sorted(r[0] for r in con.execute("DESCRIBE oracle").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    diff = f"SELECT count(*) FROM ((SELECT {cols} FROM oracle EXCEPT ALL SELECT {cols} FROM '{out}/*.parquet') UNION ALL (SELECT {cols} FROM '{out}/*.parquet' EXCEPT ALL SELECT {cols} FROM oracle))"
    assert con.execute(diff).fetchone()[0] == 0
