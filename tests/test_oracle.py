from pathlib import Path

import duckdb
import pytest

from weft.plans.registry import QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [k for k, v in QUERIES.items() if v[1]])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, sql = QUERIES[name][0](spark, D), con.execute(QUERIES[name][1])
    cols = [x[0] for x in sql.description]
    assert sorted(cols) == sorted(got.columns)
    rows = sql.fetchall()
    assert rows
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in got.select(cols).collect()) == key(rows)


def test_cogroup_example(spark):
    from weft.operators.collections import cogroup

    mk = lambda *v: spark.createDataFrame([("fruit", x) for x in v], "k string, v string")
    assert cogroup(mk("apple", "banana"), mk("cherry", "date", "fig")).first()["v"] == "[apple,banana],[cherry,date,fig]"


def test_pagerank_stops(spark):
    """Rounds of a loop over a small graph, until 80% of the nodes move less than 0.01."""
    from weft.plans.more import pagerank_until

    e = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    rank = dict.fromkeys("abcd", 1.0)
    while True:
        new = {n: 0.15 + sum(0.85 * rank[s] / sum(x == s for x, _ in e) for s, d in e if d == n) for n in rank}
        still, rank = sum(abs(new[n] - rank[n]) < 0.01 for n in rank), new
        if still >= 0.8 * len(rank):
            break
    got = dict(map(tuple, pagerank_until(spark.createDataFrame(e, "src string, dst string")).collect()))
    assert got == {n: round(r, 6) for n, r in rank.items()}
