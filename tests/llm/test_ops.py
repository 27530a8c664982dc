import public_tokenizers as P
from tokenizers import Tokenizer

from weft.llm.mixing import taken
from weft.llm.registry import QUERIES
from weft.llm.tokens import token_counts

D = "/root/testdata/sf0.001"


def test_tokens_equal_library(spark):
    own = [None, "", "a" * 3000, "x<|endoftext|>y", "  \n\n é漢字🙂 don't 12345", "aaaa aaa", "\x00\x01"]
    texts = own + [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(texts)}


def test_targets_equal_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = taken(docs).collect()
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {}
    for r in rows:
        size[src[r["doc_id"]]] = r["source_size"]
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full, left = set(), sum(size.values())
    while over := [n for n in names if n not in full and left * w[n] / sum(w[m] for m in names if m not in full) > 3 * size[n]]:
        full |= set(over)
        left = sum(size.values()) - sum(3 * size[n] for n in full)
    free = sum(w[m] for m in names if m not in full)
    for r in rows:
        n = src[r["doc_id"]]
        assert abs(r["target"] - (3 * size[n] if n in full else left * w[n] / free)) < 1e-6
        assert r["taken"] <= 3 * r["size"]
    assert len(rows) == docs.count()
    assert rows == taken(docs).collect()


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken(e).count() == 0 and QUERIES
