"""Benchmark passages in documents by containment search, native.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; an item is its set of distinct WORDS-word runs (of
fewer words, the whole sequence as one run). Items are partitioned by set size, doubling. Each
has a MinHash sketch of its smallest run hashes, as many as its partition's largest size can
miss and one more; so a document that contains enough of an item meets its sketch. Candidates
are confirmed by the exact share of the item's runs, compared as strings. Null or wordless
items and documents match nothing. Documents equal in id and text are one.
"""
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import cut

WORDS = 5
BOUND = 200_000  # sketch rows that may be broadcast; beyond it the join shuffles


def words(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def runs(df: DataFrame, n: int) -> DataFrame:
    """Each run of n of the array w in a row of its own, as string g; other columns stay."""
    keep = [c for c in df.columns if c != "w"]
    last = F.size("w") - (n - 1)
    cols = [F.slice("w", i + 1, last).alias(f"w{i}") for i in range(n)]
    d = df.where(last > 0).select(*keep, F.inline(F.arrays_zip(*cols)).alias(*[f"w{i}" for i in range(n)]))
    return d.select(*keep, F.concat_ws(" ", *[f"w{i}" for i in range(n)]).alias("g"))


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, row_hash, item_id, matched, item_size of each document and item with
    matched >= least * item_size; row_hash is xxhash64(doc_id, text)."""
    it = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.least(F.lit(WORDS), F.size("w")).alias("n"))
    lengths = [r[0] for r in it.select("n").distinct().collect()]  # at most WORDS values
    raw = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    split = lambda x: x.select("doc_id", "row_hash", words(F.col("text")).alias("w"))
    d = split(raw)
    if not lengths:
        return d.select("doc_id", "row_hash").crossJoin(items.select("item_id").limit(0)).withColumns({"matched": F.lit(0).cast("long"), "item_size": F.lit(0).cast("long")})

    def over(df, f):
        out = f(df, lengths[0])
        for n in lengths[1:]:
            out = out.unionByName(f(df, n))
        return out

    grams = over(it, lambda x, n: runs(x.where(F.col("n") == n), n)).distinct()
    sizes = grams.groupBy("item").agg(F.count("*").alias("item_size"))
    grams = grams.join(sizes, "item").withColumn("h", F.xxhash64("g"))
    # a partition's sizes are below twice a power of two
    top = F.pow(F.lit(2.0), F.floor(F.log2("item_size")) + 1) - 1
    most = (F.floor(top * (1 - least) + 1e-9) + 1).cast("int")
    sketch = grams.groupBy("item", "item_size").agg(F.sort_array(F.collect_set("h")).alias("h")).select("item", F.explode(F.slice("h", F.lit(1), most)).alias("h"))
    small = sketch.limit(BOUND + 1).count() <= BOUND
    probe = over(d, lambda x, n: runs(x, n)).select("row_hash", F.xxhash64("g").alias("h"))
    # written, so that its size is known: few candidates are broadcast and no text is shuffled
    found = cut(probe.join(F.broadcast(sketch) if small else sketch, "h").select("row_hash", "item").distinct())
    again = over(split(raw.join(found.select("row_hash").distinct(), "row_hash", "left_semi")), lambda x, n: runs(x, n))
    g = grams.select("item", "item_id", "item_size", "g")
    hits = again.join(F.broadcast(g) if small and _small(g) else g, "g").select("doc_id", "row_hash", "item", "item_id", "item_size", "g").join(found, ["row_hash", "item"], "left_semi")
    hits = hits.groupBy("doc_id", "row_hash", "item", "item_id", "item_size").agg(F.count_distinct("g").alias("matched"))
    return hits.where(F.col("matched") >= F.ceil(F.col("item_size") * least - 1e-9)).select("doc_id", "row_hash", "item_id", "matched", "item_size")


def _small(g: DataFrame) -> bool:
    return g.limit(BOUND + 1).count() <= BOUND


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item."""
    bad = cut(contained(docs, items, least).select(F.col("row_hash").alias("_bad")).distinct())
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")


SQL = r"""WITH i AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item, item_id, array_to_string(w[k:k+least(5,len(w))-1], ' ') AS g, least(5,len(w)) AS n FROM (SELECT *, unnest(range(1, len(w)-least(5,len(w))+2)) AS k FROM i WHERE len(w)>0)),
s AS (SELECT item, item_id, count(*) AS item_size FROM ig GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM d),
dg AS (SELECT DISTINCT doc_id, r, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w)-n+2)) AS k FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w)>=n))
SELECT doc_id, item_id, count(*) AS matched, item_size FROM dg JOIN ig USING (g, n) JOIN s USING (item, item_id) GROUP BY doc_id, r, item, item_id, item_size HAVING count(*) >= ceil(item_size*0.8-1e-9)"""
