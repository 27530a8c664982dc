"""The stored inverted index and searches that read it."""
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from weft.functions import page, text
from weft.functions.stem import stem, stems
from weft.functions.web import query_terms
from weft.operators.storage import written
from weft.plans.more import field_terms

STEMMED = 0.7  # weight of a term that comes from stemming


def weighted(counts: DataFrame, df: bool = False, held: list[str] | None = None) -> DataFrame:
    """(term, url, c, tf) from counts (term, url, c): tf = 0.4 + 0.6 * c / the term's largest count; with df also the document frequency.

    The counts are written once; held gets the table's path."""
    c = written(counts.where("length(term) <= 100"), held)
    top = c.groupBy("term").agg(F.max("c").alias("m"), F.count("*").alias("df"))
    return c.join(top, "term").select("term", "url", "c", (F.lit(0.4) + F.lit(0.6) * F.col("c") / F.col("m")).alias("tf"), *(["df"] if df else []))


def counts(pages: DataFrame, fields: bool = False, stemmed: bool = False, lexicon: DataFrame | None = None) -> DataFrame:
    """(term, url, c): occurrences; with fields also the weights of titles, headings and URLs; with stemmed,
    stems that differ from their word count too, additively. Words that a lexicon (term) lacks are left out, numbers stay."""
    if fields:
        plain = F.transform(text.tokens(F.col("html")), lambda x: F.struct(x.alias("term"), F.lit(1).alias("w")))
        none = F.array().cast("array<struct<term:string,w:int>>")
        c = pages.select("url", F.inline(F.concat(F.coalesce(plain, none), F.coalesce(field_terms(), none)))).groupBy("term", "url").agg(F.sum("w").alias("c"))
    else:
        c = pages.select("url", F.explode(text.split_words(F.col("html"))).alias("term")).where(F.col("term").rlike(text.WORD)).groupBy("term", "url").agg(F.count("*").alias("c"))
    if lexicon is not None:
        number = F.col("term").rlike("^[0-9]+$")
        c = c.where(number).unionByName(c.where(~number).join(lexicon.select("term").distinct(), "term", "left_semi"))
    if stemmed:
        c = written(c)
        s = stems(c).where("stem <> term")
        c = c.unionByName(c.join(s, "term").select(F.col("stem").alias("term"), "url", "c"))
        c = c.groupBy("term", "url").agg(F.sum("c").alias("c"))
    return c


def from_pairs(pairs: DataFrame) -> DataFrame:
    """The index from saved pairs k = term, v = 'url:count'."""
    c = F.regexp_extract("v", ":([0-9]+)$", 1).cast("long")
    return weighted(pairs.select(F.col("k").alias("term"), F.regexp_extract("v", "^(.*):[0-9]+$", 1).alias("url"), c.alias("c")))


def from_texts(bag: DataFrame) -> DataFrame:
    """The index from saved strings 'url,page'; the URL ends at the first comma."""
    return weighted(counts(bag.select(F.substring_index("value", ",", 1).alias("url"), F.regexp_extract("value", "(?s)^[^,]*,(.*)$", 1).alias("html"))))


def packed(postings: DataFrame) -> DataFrame:
    """(term, list): 'url:tf,...' by falling tf, then URL; a term's postings meet in one row, as the text form demands."""
    one = lambda x: F.concat_ws(":", x["url"], F.round(-x["tf"], 6).cast("string"))
    return postings.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("tf")).alias("tf"), "url"))), one), ",").alias("list"))


def save(postings: DataFrame, path: str) -> None:
    """Writes postings clustered by term with the document frequency, so that a search reads few row groups."""
    if "df" not in postings.columns:
        postings = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term")
    # a frequent term may fill several files
    postings.repartitionByRange("term", F.desc("tf"), "url").sortWithinPartitions("term", F.desc("tf"), "url").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def idf(n: Column, df: Column, kind: str = "log500") -> Column:
    """Inverse document frequency: log500 and ln_div divide as integers, ln and log10 do not."""
    whole, ratio = F.floor(n / df).cast("double"), n / df
    return {"log500": F.log(whole) / F.log(F.lit(500.0)), "ln_div": F.log(whole), "ln": F.log(ratio), "log10": F.log10(ratio)}[kind]


def terms_of(query: str, stemming: bool = True) -> dict[str, float]:
    """Terms of a query with their factors; a stem that differs from its word is a term of factor STEMMED, also where another word of the query equals it."""
    words = query_terms(query)
    out = dict.fromkeys(words, 1.0)
    if stemming:
        out |= {stem(w): STEMMED for w in words if stem(w) != w}
    return out


def search(postings: DataFrame, n: int, query: str, stemming: bool = True, kind: str = "log500", cap: int = 200, limit: int = 200, ranks: DataFrame | None = None, mix: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(url, score) by falling score, then URL: the OR-sum of tf * idf * factor over at most `cap` valid postings a term.

    n is the number of pages. With ranks (url, rank) each term adds mix[0] * tf * idf + mix[1] * rank.
    """
    terms = terms_of(query, stemming)
    p = postings.where(F.col("term").isin(list(terms)))
    if "df" not in postings.columns:
        p = p.join(p.groupBy("term").agg(F.count("*").alias("df")), "term")
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in terms.items() for x in kv)), F.col("term")) if terms else F.lit(1.0)
    p = p.withColumn("idf", idf(F.lit(n), F.col("df"), kind)).where(F.col("idf") != 0).where(page.control_free(F.col("url")))
    p = p.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy(F.desc("tf"), "url"))).where(F.col("r") <= cap)
    one = F.col("tf") * F.col("idf") * factor
    if ranks is not None:
        one = mix[0] * one
        if mix[1]:  # without weight no rank is read: a URL with several ranks would count as often
            p = p.join(ranks.select("url", "rank"), "url", "left")
            one = one + mix[1] * F.coalesce("rank", F.lit(0.0))
    return p.groupBy("url").agg(F.round(F.sum(one), 6).alias("score")).orderBy(F.desc("score"), "url").limit(limit)


def term_weights(postings: DataFrame, n: int, query: str) -> DataFrame:
    """(term, weight) of the query's terms by rising idf: 1.0, 0.9, ... as doubles, no further once a weight is at most 0.7."""
    p = postings.where(F.col("term").isin(query_terms(query))).groupBy("term").agg(F.count("*").alias("df"))
    steps = [1.0]
    while steps[-1] > 0.7:
        steps.append(steps[-1] - 0.1)
    place = F.row_number().over(W.orderBy(idf(F.lit(n), F.col("df")), "term"))  # the terms of one query
    return p.select("term", F.round(F.element_at(F.array(*map(F.lit, steps)), F.least(place, F.lit(len(steps)))), 6).alias("weight"))


def result_page(hits: DataFrame, number: int, size: int = 10) -> DataFrame:
    return hits.orderBy(F.desc("score"), "url").offset((number - 1) * size).limit(size)


def page_info(pages: DataFrame) -> DataFrame:
    """(url, title, abstract): the title is the URL; the abstract the page's title if it has a non-empty one."""
    found = F.nullif(page.title(F.col("html")), F.lit(""))
    return pages.select("url", F.col("url").alias("title"), F.coalesce(found, F.lit("No Information Available")).alias("abstract"))


def described(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with the page info of each, in one join; a URL without a page gets the defaults."""
    info = page_info(pages.join(hits.select("url"), "url", "left_semi"))
    return hits.join(info, "url", "left").select("url", "score", F.coalesce("title", "url").alias("title"), F.coalesce("abstract", F.lit("No Information Available")).alias("abstract"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, in column `json`."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
