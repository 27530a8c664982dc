"""URL, page and link queries, each with its SQL."""
from pyspark.sql import DataFrame, functions as F
from weft.sources.tables import table as t

# Fixed value: scheme, host, port, path.
URL = "^([^/].*?)://([^/:]*)(?::([^/]*))?(/.*)?$"


def url_parts(df: DataFrame) -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract("url", URL, i), F.lit(""))
    return df.select("url", part(1).alias("protocol"), part(2).alias("host"), part(3).alias("port"), F.when(F.col("url").rlike(URL), F.coalesce(part(4), F.lit("/"))).otherwise(F.col("url")).alias("path"))


def edges(s, d) -> DataFrame:
    return t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


QUERIES = {
    "url_parse": (lambda s, d: url_parts(t(s, d, "pages")), f"SELECT url, nullif(regexp_extract(url,'{URL}',1),'') AS protocol, nullif(regexp_extract(url,'{URL}',2),'') AS host, nullif(regexp_extract(url,'{URL}',3),'') AS port, CASE WHEN regexp_matches(url,'{URL}') THEN coalesce(nullif(regexp_extract(url,'{URL}',4),''),'/') ELSE url END AS path FROM pages"),
}
