"""Mixing sources to target weights, natively.

Sizes are words of the text (null: 0). Sources by code point, null last, weigh
5, 2, 1, repeating; a target stops at `cap` times its source and the excess goes to
the others by weight. A source without words has the target 0. A document is taken
floor(rate) times and once more if its seeded hash falls below the fraction. Rows equal in
id and text are numbered (in 32 parts, so that no task numbers a hot one alone) and the numbers
spread the fraction evenly over them. Sources are ranked in one task, on a row a source.
"""
from pyspark.sql import DataFrame, Window as W, functions as F


def taken(docs: DataFrame, cap: int = 3, seed: int = 17, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row; where docs are kept, their columns as struct `row` instead of doc_id."""
    own = "row" if keep else "doc_id"
    d = docs.select(F.struct(*docs.columns).alias("row") if keep else "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    # equal rows would fare alike; they are few, as a rule none
    more = d.groupBy("h").count().where("count > 1").select(F.col("h").alias("h2"))
    s = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source; sums of that table only
    w = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(F.lit(1), F.lit(5), F.lit(2)), (w % 3 + 1).cast("int")).cast("long"))
    up = W.orderBy(F.col("source_size") / F.col("w"), "w", F.col("source").asc_nulls_last())
    rest = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = up.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("S", F.sum("source_size").over(W.partitionBy())).withColumn("R", F.col("S").cast("decimal(38,0)") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("V", F.sum("w").over(rest))
    s = s.withColumn("full", F.col("R") * F.col("w") >= cap * F.col("source_size").cast("decimal(38,0)") * F.col("V"))
    # the sources at their cap come first; the first below it sets the level of all others
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "w", F.col("source").isNull(), "source", "R", "V"))).over(W.partitionBy())
    s = s.withColumn("l", level).select(F.col("source").alias("src"), "source_size", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("l.R") * F.col("w")).cast("double") / F.col("l.V")).alias("target"))
    rate = F.least(F.lit(float(cap)), F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
    same = F.col("h") == F.col("h2")
    part = F.pmod(F.monotonically_increasing_id(), F.lit(32))
    nth = F.row_number().over(W.partitionBy("h", "part").orderBy("part")) - 1
    again = d.join(more, same, "left_semi").withColumn("part", part).withColumn("nth", nth.cast("double") + F.pmod(F.xxhash64("h", "part"), F.lit(1 << 30)) / F.lit(float(1 << 30))).drop("part")
    d = d.join(more, same, "left_anti").withColumn("nth", F.lit(0.0)).unionByName(again)
    j = d.join(s, F.col("source").eqNullSafe(F.col("src")))
    u = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = rate - F.floor(rate)
    # nth 0: one if u lies below the fraction; of equal rows in all a fraction
    u = u + F.col("nth") * part
    copies = (F.floor(rate) + F.floor(u + part) - F.floor(u)).cast("long")
    return j.select(own, "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, cap: int = 3, seed: int = 17) -> DataFrame:
    """docs as often as the mix takes each row, `copy` counting from 1, with source_size, target
    and copies. Rows without words are taken as their source's rate says. Rows that are equal
    in id, text and source share the rate among them. A new column whose name docs has already
    gets underscores appended."""
    new = {}
    for c in ("source_size", "target", "copies", "copy"):
        new[c] = c
        while new[c] in docs.columns:
            new[c] += "_"
    m = taken(docs, cap, seed, keep=True).where("copies > 0")
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return m.select(*own, *(F.col(c).alias(new[c]) for c in list(new)[:3]), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(new["copy"]))
