"""Queries of the reference operators, each with its SQL."""
from pyspark.sql import functions as F
from weft.operators import collections as C
from weft.plans import search as S
from weft.plans import engine, extra, more
from weft.sources.tables import table as t

_P = "[\\t\\r\\n.,:;!?’''\"()-]"
_POST = f"""t AS (SELECT url, unnest(string_split_regex(lower(regexp_replace(regexp_replace(html,'<.*?>',' ','g'),'{_P}',' ','g')),' +')) AS term FROM pages),
c AS (SELECT term,url,count(*) AS c FROM t WHERE regexp_matches(term,'^([a-z]+|[0-9]{{1,3}})$') AND length(term)<=100 GROUP BY ALL),
p AS (SELECT term,url,c,0.4::DOUBLE+0.6::DOUBLE*c/max(c) OVER (PARTITION BY term) AS tf FROM c)"""


def _kv(s, d, tab, k, v):
    return t(s, d, tab).select(F.col(k).cast("string").alias("k"), F.col(v).cast("string").alias("v"))


QUERIES = {
    "inverted_index": (lambda s, d: S.postings(t(s, d, "pages")).withColumn("tf", F.round("tf", 6)), f"WITH {_POST} SELECT term,url,c,round(tf,6) AS tf FROM p"),
    "pair_join": (lambda s, d: C.pair_join(_kv(s, d, "customer", "c_custkey", "c_name"), _kv(s, d, "orders", "o_custkey", "o_orderkey")), "SELECT c_custkey::VARCHAR AS k, c_name||','||o_orderkey AS v FROM customer JOIN orders ON c_custkey=o_custkey"),
    "pair_cogroup": (lambda s, d: C.cogroup(_kv(s, d, "customer", "c_custkey", "c_name"), _kv(s, d, "orders", "o_custkey", "o_orderkey")), """WITH a AS (SELECT c_custkey::VARCHAR AS k, string_agg(c_name,',' ORDER BY c_name) AS x FROM customer GROUP BY 1), b AS (SELECT o_custkey::VARCHAR AS k, string_agg(o_orderkey::VARCHAR,',' ORDER BY o_orderkey::VARCHAR) AS y FROM orders GROUP BY 1)
SELECT k, '['||coalesce(x,'')||'],['||coalesce(y,'')||']' AS v FROM a FULL JOIN b USING (k)"""),
    "rdd_distinct": (lambda s, d: t(s, d, "events").select(F.col("event_type").alias("value")).distinct(), "SELECT DISTINCT event_type AS value FROM events"),
    "rdd_filter": (lambda s, d: t(s, d, "customer").where(F.col("c_name").endswith("7")).select(F.col("c_name").alias("value")), "SELECT c_name AS value FROM customer WHERE c_name LIKE '%7'"),
    "rdd_flat_map": (lambda s, d: t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("value")), "SELECT unnest(string_split(p_name,' ')) AS value FROM part"),
    "rdd_count": (lambda s, d: t(s, d, "events").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events"),
    "rdd_group_by": (lambda s, d: C.group_by(t(s, d, "nation").select(F.col("n_name").alias("value"), "n_regionkey"), F.col("n_regionkey").cast("string")), "SELECT n_regionkey::VARCHAR AS k, string_agg(n_name,',' ORDER BY n_name) AS v FROM nation GROUP BY 1"),
    "rdd_intersection": (lambda s, d: t(s, d, "customer").select(F.col("c_nationkey").alias("value")).intersect(t(s, d, "supplier").select("s_nationkey")), "SELECT c_nationkey AS value FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "pair_fold_by_key_sum": (lambda s, d: t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("v")), "SELECT l_suppkey AS k, round(sum(l_quantity),2) AS v FROM lineitem GROUP BY 1"),
    "kv_range_scan": (lambda s, d: t(s, d, "orders").where("o_orderkey >= 100 and o_orderkey < 300").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey,o_orderstatus FROM orders WHERE o_orderkey>=100 AND o_orderkey<300"),
    "kv_last_write_wins": (lambda s, d: t(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value")), "SELECT user_id,event_type,arg_max(value,event_id) AS value FROM events GROUP BY ALL"),
    "kv_view_page": (lambda s, d: t(s, d, "customer").where("c_name >= 'Customer'").orderBy("c_name", "c_custkey").limit(10).select("c_custkey", "c_name"), "SELECT c_custkey,c_name FROM customer WHERE c_name >= 'Customer' ORDER BY c_name,c_custkey LIMIT 10"),
}
QUERIES |= extra.QUERIES | more.QUERIES | engine.QUERIES
