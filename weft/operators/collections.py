"""Bag and pair operators: DataFrames `value` and `k, v`.

Functions that take a Column function keep the plan in the JVM; those with a Python function (fold_by_key_python,
map_partitions) go through Arrow or pandas. Null results drop the element, as in every operator here.
"""
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Fn = Callable[[Column], Column]
Fn2 = Callable[[Column, Column], Column]
PAIR = "struct<k:string,v:string>"


def parallelize(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """A bag of the given strings, duplicates kept."""
    return spark.createDataFrame([(x,) for x in values], "value string")


def from_table(table: DataFrame, to_string: Column) -> DataFrame:
    """A bag of a string of each row; rows whose string is null are dropped."""
    return table.select(to_string.cast("string").alias("value")).where("value is not null")


def flat_map(bag: DataFrame, f: Fn) -> DataFrame:
    """f gives an array of strings; null and empty arrays give nothing."""
    return bag.select(F.explode(f(F.col("value"))).alias("value")).where("value is not null")


def map_to_pair(bag: DataFrame, f: Fn) -> DataFrame:
    """f gives a struct k, v or null."""
    return bag.select(f(F.col("value")).cast(PAIR).alias("p")).where("p is not null").select("p.k", "p.v")


def flat_map_to_pair(bag: DataFrame, f: Fn) -> DataFrame:
    """f gives an array of structs k, v."""
    return bag.select(F.inline(f(F.col("value")).cast(f"array<{PAIR}>")))


def pair_flat_map(pairs: DataFrame, f: Fn2) -> DataFrame:
    """f gives an array of strings of each single pair."""
    return pairs.select(F.explode(f(F.col("k"), F.col("v"))).alias("value")).where("value is not null")


def pair_flat_map_to_pair(pairs: DataFrame, f: Fn2) -> DataFrame:
    """f gives an array of structs k, v of each single pair."""
    return pairs.select(F.inline(f(F.col("k"), F.col("v")).cast(f"array<{PAIR}>")))


def keep(bag: DataFrame, test: Fn) -> DataFrame:
    return bag.where(test(F.col("value")))


def map_partitions(bag: DataFrame, f: Callable[[Iterable[str]], Iterable[str]]) -> DataFrame:
    """f gets the strings of a partition as an iterator, batch by batch, and yields strings."""

    def run(batches):
        import pandas as pd

        def values():
            for b in batches:
                yield from b["value"]

        held: list[str] = []
        for x in f(values()):
            held.append(x)
            if len(held) == 4096:
                yield pd.DataFrame({"value": held})
                held = []
        if held:
            yield pd.DataFrame({"value": held})

    return bag.mapInPandas(run, "value string")


def sample(bag: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each element with probability `share`, drawn by instance."""
    return bag.sample(False, share, seed)


def hash_sample(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Rows whose key's hash lies below `share`: the same rows in every run and layout."""
    return df.where(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def fold(bag: DataFrame, zero: Column, f: Fn2) -> DataFrame:
    """One row `value`: a left fold from zero, applied once, over the sorted elements.

    All elements meet in one array; where f is a sum, minimum, maximum or count, use the aggregate instead.
    """
    return bag.agg(F.aggregate(F.array_sort(F.collect_list("value")), zero, f).alias("value"))


def fold_by_key(pairs: DataFrame, zero: Column, f: Fn2) -> DataFrame:
    """One pair a key: a left fold from zero over the key's sorted values, which meet in one array.

    Where f is a sum, minimum, maximum or count, use fold_known, which combines before the shuffle.
    """
    return pairs.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list("v")), zero, f).alias("v"))


def fold_known(pairs: DataFrame, kind: str) -> DataFrame:
    """fold_by_key for kind sum, min, max (of numbers) or count."""
    number = F.col("v").cast("double")
    known = {"sum": F.sum(number), "min": F.min(number), "max": F.max(number), "count": F.count("v")}
    return pairs.groupBy("k").agg(known[kind].alias("v"))


def fold_by_key_python(pairs: DataFrame, zero: str, f: Callable[[str, str], str]) -> DataFrame:
    """fold_by_key for a Python function; the values of a key are folded in one task."""

    def run(table):
        import pandas as pd

        acc = zero
        for x in sorted(table["v"]):
            acc = f(acc, x)
        return pd.DataFrame({"k": [table["k"].iloc[0]], "v": [acc]})

    return pairs.groupBy("k").applyInPandas(run, "k string, v string")


def concat_fold(pairs: DataFrame) -> DataFrame:
    """The values of a key, sorted and comma-joined."""
    return fold_by_key(pairs, F.lit(""), lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(","), b)))


def take(df: DataFrame, n: int) -> DataFrame:
    """Any n rows."""
    return df.limit(n)


def pair_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join; values are comma-joined, those of a missing side left out."""
    return a.join(b.withColumnRenamed("v", "w"), "k", how).select("k", F.concat_ws(",", "v", "w").alias("v"))


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer by key, as '[x1,x2],[y1]'; a key's values are sorted.

    A key's values meet in one row, as the text form demands; cogroup_rows has no such row.
    """
    g = lambda d, n: d.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(n))
    side = lambda n: F.concat(F.lit("["), F.coalesce(n, F.lit("")), F.lit("]"))
    return g(a, "x").join(g(b, "y"), "k", "full").select("k", F.concat(side("x"), F.lit(","), side("y")).alias("v"))


def cogroup_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cogroup as rows (k, side, v), for keys of any size."""
    return a.select("k", F.lit("left").alias("side"), "v").union(b.select("k", F.lit("right").alias("side"), "v"))


def group_by(df: DataFrame, key: Column) -> DataFrame:
    """(key, values sorted and comma-joined); a key's values meet in one row."""
    return df.groupBy(key.alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("v"))
