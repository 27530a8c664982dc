"""Graph queries on small tables with long ways, hubs and missing keys."""
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.operators import storage
from weft.plans import crawl as K, graph as G
from weft.plans.registry import QUERIES


def _tables(spark, path):
    """A way of 14 customers over suppliers with links back, so that c1 is far from the last."""
    back = [k for k in range(1, 200) if hashlib.md5(f"s{k}".encode()).hexdigest()[0] in "01234"][:13]
    served = [(c, s) for i, s in enumerate(back) for c in (i + 1, i + 2)] + [(3, 900), (3, 900), (4, 901), (20, 901)]
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(served)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, s) for i, (_, s) in enumerate(served)], "l_orderkey long, l_suppkey long").coalesce(1).write.parquet(f"{path}/lineitem.parquet")


@pytest.mark.parametrize("name", ["crawl_frontier", "pagerank_fixed"])
def test_long_ways_match_sql(spark, tmp_path, name):
    _tables(spark, tmp_path)
    con = duckdb.connect()
    for n in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    got, sql = QUERIES[name][0](spark, str(tmp_path)), con.execute(QUERIES[name][1])
    cols, rows = [x[0] for x in sql.description], sql.fetchall()
    assert rows and sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.select(cols).collect())


def test_pages_and_links_are_read_once(spark, monkeypatch):
    """Rounds read written tables: the page table is computed once, not once a round."""
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(len(b))
            yield b

    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    web = spark.createDataFrame([(str(i),) for i in range(7)], "url string").mapInPandas(seen, "url string")
    start = spark.createDataFrame([("0",)], "url string")
    assert sorted((r.url, r.round) for r in K.crawl(start, web, e).collect()) == [(str(i), i) for i in range(7)]
    assert n.value == 7


def test_hubs_are_gathered_in_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 10)
    e = spark.range(1000).select(F.lit("a").alias("src"), F.col("id").cast("string").alias("dst")).union(spark.createDataFrame([("a", None), (None, "b"), ("b", "a")], "src string, dst string"))
    held = []
    rows = G.gathered(e, held).collect()
    storage.clear(spark, held)
    assert {r.src: r.deg for r in rows} == {"a": 1001, "b": 1} and max(len(r.out) for r in rows) < 100
    assert sorted(x for r in rows if r.src == "a" for x in r.out) == sorted(map(str, range(1000)))
