"""Inverted index."""
from pyspark.sql import DataFrame, functions as F
from weft.functions.text import tokens


def postings(pages: DataFrame) -> DataFrame:
    """(term, url, c, tf): tf = 0.4 + 0.6 * c / the term's largest count."""
    c = pages.select("url", F.explode(tokens(F.col("html"))).alias("term")).where("length(term) <= 100").groupBy("term", "url").agg(F.count("*").alias("c"))
    top = c.groupBy("term").agg(F.max("c").alias("m"))
    return c.join(top, "term").select("term", "url", "c", (F.lit(0.4) + F.lit(0.6) * F.col("c") / F.col("m")).alias("tf"))
