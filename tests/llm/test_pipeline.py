import corpus_pipeline as P
from tests.llm.test_neardup import brute
from weft.llm.common import cut
from weft.llm.decontam import contained
from weft.llm.secrets import scan

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    held = []
    for name, f in P.STAGES:
        docs = cut(f(spark, docs, D))
        held.append(docs)
        print(name, docs.count())
        assert docs.columns[: len(columns)] == columns and (name == "mix" or docs.columns == columns)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in held]
    rows = [(r.doc_id, r.text) for r in held[0].select("doc_id", "text").collect()]
    assert ids[1] == {r[0] for r in brute(rows, 5, 80) if r[3]} and held[1].count() == len(ids[1])
    bad = {r.doc_id for r in contained(held[1], spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert ids[2] == ids[1] - bad and bad
    spans = [{r.doc_id: r.spans for r in scan(x).collect()} for x in held[2:4]]
    after = {r.doc_id: r.text for r in held[3].collect()}
    assert spans[0].keys() == spans[1].keys() and any(spans[0].values()) and not any(spans[1].values())
    assert all((after[r.doc_id] == r.text) == (not spans[0][r.doc_id]) for r in held[2].collect())
    assert held[4].groupBy("doc_id").count().where("count > 3").count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1, 2)] * 2 + [(1, "", "en", None, 0, 1, 2), (2, "a b c", "en", "s", 5, 1, 2), (2, "a b c", "en", "s", 5, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, size int, score int")
    for d in (docs, docs.limit(0)):
        for _, f in P.STAGES:
            d = cut(f(spark, d, D))
        assert d.columns[:7] == docs.columns
