"""Links of a graph, gathered by source and written once, for operators that go over them in rounds."""
from pyspark.sql import DataFrame, functions as F

from weft.operators.storage import clear, written

HUB = 100_000  # targets of a source in one row, about


def gathered(e: DataFrame, held: list[str]) -> DataFrame:
    """(src, deg, out) of the links e (src, dst): the targets of a source, those of a hub in several rows; links without a source are left out."""
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / HUB))
    return written(e.join(deg, "src").groupBy("src", "deg", part.alias("part")).agg(F.collect_list("dst").alias("out")).drop("part"), held)


def pagerank(e: DataFrame, done) -> DataFrame:
    """(id, rank) from 1.0 over the links e (src, dst), ids of any type, after the first round for which done(rounds, ranks id, rank, prev) holds.

    The mass of dangling nodes is lost. Links and the last ranks are written to the shared folder; only the result's table stays.
    """
    spark, held, last, rounds = e.sparkSession, [], [], 0
    e = written(e.where("src is not null"), held)
    links = gathered(e, held)
    rank = written(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("rank", F.lit(1.0)).withColumn("prev", F.lit(0.0)), last)
    while not done(rounds, rank):
        rounds += 1
        old, last = last, []
        got = links.join(rank, F.col("src") == F.col("id")).select(F.explode("out").alias("dst"), (0.85 * F.col("rank") / F.col("deg")).alias("g")).groupBy("dst").agg(F.sum("g").alias("g"))
        rank = written(rank.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.coalesce("g", F.lit(0.0)) + 0.15).alias("rank"), F.col("rank").alias("prev")), last)
        clear(spark, old)
    clear(spark, held)
    return rank.select("id", F.round("rank", 6).alias("rank"))
