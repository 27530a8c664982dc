"""Remaining collection, table and page queries, each with its SQL where SQL can express it."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from weft.functions import text, web
from weft.plans.extra import edges, url_parts
from weft.plans.graph import pagerank
from weft.sources.tables import table as t

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
RULES = [(False, "/*archive*"), (True, "/a*"), (False, "/*1*")]


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def field_terms() -> Column:
    """array<struct<term, w>> of a row's url and html: words of titles, headings and URLs with the weight of the field they stand in."""
    words = lambda col: F.filter(text.tokens(col), lambda x: x.rlike("^[a-z]+$"))
    weighed = lambda terms, w: F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))
    parts = [weighed(words(F.array_join(F.regexp_extract_all("html", F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1)), " ")), w) for tag, w in web.WEIGHTS.items()]
    parts.append(weighed(F.filter(words(F.col("url")), lambda x: ~x.isin("http", "https")), web.URL_WEIGHT))
    return F.concat(*parts)


def field_weights(pages: DataFrame) -> DataFrame:
    """(url, term, weight): the sums of `field_terms`, in one pass over the pages."""
    return pages.select("url", F.inline(field_terms())).groupBy("url", "term").agg(F.sum("w").alias("weight"))


def pagerank_until(e: DataFrame, step: float = 0.01, share: float = 0.8, most: int | None = None) -> DataFrame:
    """PageRank from 1.0 until `share` of the nodes move less than `step`: (id, rank).

    The mass of dangling nodes is lost. With `most`, ranks that have not settled after so many rounds
    raise an error. Every round is written out, so plans stay small.
    """

    def done(rounds: int, rank: DataFrame) -> bool:
        if not rounds:
            return False
        still = rank.agg(F.avg((F.abs(F.col("rank") - F.col("prev")) < step).cast("double"))).first()[0]
        if still is None or still >= share:
            return True
        if rounds == most:
            raise RuntimeError(f"after {most} rounds {still:.2%} of the nodes had settled")
        return False

    return pagerank(e, done)


def _upper(batches):
    for b in batches:
        yield b.assign(value=b["value"].str.upper())


_KEEP = "CASE WHEN regexp_matches(c,'^[A-Za-z0-9-]$') THEN c ELSE '_'||format('{:x}',unicode(c)) END"
_WORDS = "string_split_regex(lower(regexp_replace(regexp_replace({x},'<.*?>',' ','g'),'[\\t\\r\\n.,:;!?’''\"()-]',' ','g')),' +')"
_FIELDS = " UNION ALL ".join([f"SELECT url, unnest({_WORDS.format(x=f'''array_to_string(regexp_extract_all(html,'<{g}>(.*?)</{g}>',1),' ')''')}) AS term, {w} AS w FROM pages" for g, w in web.WEIGHTS.items()] + [f"SELECT * FROM (SELECT url, unnest({_WORDS.format(x='url')}) AS term, {web.URL_WEIGHT} AS w FROM pages) WHERE term NOT IN ('http','https')"])
_ALLOWED = "CASE " + " ".join(f"WHEN regexp_full_match(path,'{web.rule_pattern(r)}') THEN {ok}" for ok, r in RULES) + " ELSE true END"
QUERIES = {
    "pair_map_to_pair": (lambda s, d: t(s, d, "nation").select(F.expr("case when n_regionkey > 0 then cast(n_regionkey as string) end").alias("k"), F.col("n_name").alias("v")).where("k is not null"), "SELECT n_regionkey::VARCHAR AS k, n_name AS v FROM nation WHERE n_regionkey>0"),
    "pair_flat_map_to_pair": (lambda s, d: t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("k"), F.col("p_partkey").cast("string").alias("v")), "SELECT unnest(string_split(p_name,' ')) AS k, p_partkey::VARCHAR AS v FROM part"),
    "rdd_map_partitions": (lambda s, d: t(s, d, "customer").select(F.col("c_name").alias("value")).mapInPandas(_upper, "value string"), "SELECT upper(c_name) AS value FROM customer"),
    "rdd_sample": (lambda s, d: t(s, d, "orders").select("o_orderkey").where(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4) < "4000"), "SELECT o_orderkey FROM orders WHERE substr(md5(o_orderkey::VARCHAR),1,4) < '4000'"),
    "rdd_fold": (lambda s, d: t(s, d, "lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.max("l_quantity").alias("most")), "SELECT round(sum(l_quantity),2) AS total, max(l_quantity) AS most FROM lineitem"),
    "kv_get_row": (lambda s, d: t(s, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_nationkey"), "SELECT c_custkey,c_name,c_nationkey FROM customer WHERE c_custkey=7"),
    "kv_get_cell": (lambda s, d: t(s, d, "customer").where("c_custkey = 7").select(F.col("c_name").alias("value")), "SELECT c_name AS value FROM customer WHERE c_custkey=7"),
    "kv_exists_row": (lambda s, d: t(s, d, "customer").where("c_custkey = 7").agg((F.count("*") > 0).alias("found")), "SELECT count(*)>0 AS found FROM customer WHERE c_custkey=7"),
    "kv_put_row": (lambda s, d: upsert(t(s, d, "nation").select("n_nationkey", "n_name"), t(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name")), "n_nationkey"), "SELECT s_suppkey::INT AS n_nationkey, s_name AS n_name FROM supplier UNION ALL SELECT n_nationkey,n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "kv_table_summary": (lambda s, d: reduce(DataFrame.union, (t(s, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in TABLES)), " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES)),
    "letter_hash": (lambda s, d: t(s, d, "pages").select("url", web.letter_hash(F.col("url")).alias("h")), "WITH b AS (SELECT page_id, url, i, ('0x'||substr(sha1(url),2*i+1,2))::INT AS b FROM pages, range(20) r(i)), n AS (SELECT *, CASE WHEN b=0 THEN 255 WHEN b>127 THEN b-1 ELSE b END AS n FROM b) SELECT url, string_agg(chr((97+n%26)::INT)||chr((97+2*(n//26))::INT),'' ORDER BY i) AS h FROM n GROUP BY page_id, url"),
    "key_encode": (lambda s, d: t(s, d, "pages").select("url", web.key_encode(F.col("url")).alias("k")), f"SELECT url, array_to_string(list_transform(string_split(url,''), lambda c: {_KEEP}),'') AS k FROM pages"),
    "robots_decision": (lambda s, d: url_parts(t(s, d, "pages")).select("url", web.allowed(F.col("path"), RULES).alias("ok")), "SELECT url, " + _ALLOWED + " AS ok FROM (SELECT url, regexp_extract(url,'^[^/].*?://[^/]*(/.*)$',1) AS path FROM pages)"),
    "field_weights": (lambda s, d: field_weights(t(s, d, "pages")), f"SELECT url, term, sum(w)::BIGINT AS weight FROM ({_FIELDS}) WHERE regexp_matches(term,'^[a-z]+$') GROUP BY ALL"),
    "pagerank_until": (lambda s, d: pagerank_until(edges(s, d)), None),
}
