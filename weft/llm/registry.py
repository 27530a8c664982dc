"""Queries of this subpackage: name -> (function, SQL or None)."""
from weft.llm.decontam import SQL as LEAKS, contained
from weft.llm.embeddings import near_embeddings
from weft.llm.extract import extract
from weft.llm.licenses import license_spans
from weft.llm.mixing import taken
from weft.llm.neardup import near_duplicates
from weft.llm.passages import repeated_passages
from weft.llm.quality import quality
from weft.llm.secrets import scan
from weft.llm.tokens import token_counts


def _tokens(spark, d):
    import public_tokenizers as P

    return token_counts(spark.read.parquet(f"{d}/documents.parquet"), P.path("byte_bpe_50k.json"), P.PATTERN)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES = {
    "op1_token_counts": (_tokens, None),
    "op2_embedding_near_dedup": (lambda spark, d: near_embeddings(_t(spark, d, "embeddings")), None),
    "op3_mix_sources": (lambda spark, d: taken(spark.read.parquet(f"{d}/documents.parquet")), None),
    "op4_substring_dedup": (lambda spark, d: repeated_passages(_t(spark, d, "documents")), None),
    "op5_html_extraction": (lambda spark, d: extract(_t(spark, d, "pages")), None),
    "op6_benchmark_decontamination": (lambda spark, d: contained(_t(spark, d, "documents"), _t(spark, d, "benchmark")).drop("row_hash"), LEAKS),
    "op10_quality_classifier": (lambda spark, d: quality(_t(spark, d, "documents"), _t(spark, d, "labels")), None),
    "op7_minhash_near_dedup": (lambda spark, d: near_duplicates(spark.read.parquet(f"{d}/documents.parquet")), None),
    "op8_license_scans": (lambda spark, d: license_spans(_t(spark, d, "documents")), None),
    "op9_secret_scans": (lambda spark, d: scan(spark.read.parquet(f"{d}/documents.parquet")), None),
}
