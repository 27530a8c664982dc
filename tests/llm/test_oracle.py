import duckdb
import pytest

from weft.llm.registry import QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [k for k, v in QUERIES.items() if v[1]])
def test_equals_sql(spark, name):
    f, sql = QUERIES[name]
    got = f(spark, D)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(f"SELECT {','.join(got.columns)} FROM ({sql})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
