"""Queries on pages that share a URL, as larger tables have them, against their SQL."""
import duckdb
import pytest

from weft.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["page_by_hash", "search_older", "search_combined"])
def test_repeated_urls(spark, tmp_path, name):
    words = ["with", "from", "than", "more"]
    pages = [(i, f"http://h.org/{i // 2}", f"<p>{' '.join(words[: i % 4 + 1])} {'with ' * (i % 3)}</p>") for i in range(21)]
    spark.createDataFrame(pages + [(40, None, "<p>x</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, sql = QUERIES[name][0](spark, str(tmp_path)), con.execute(QUERIES[name][1])
    cols, rows = [x[0] for x in sql.description], sql.fetchall()
    assert rows and sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.select(cols).collect())
