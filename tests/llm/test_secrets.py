import hashlib
import re

from weft.llm.secrets import redact, scan

P = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def brute(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(P) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_spans(spark):
    texts = [None, "", "secret=token:abcdef12", "é🙂 Password = 'hunter22' AKIA" + "A" * 16, "token=abc token=abcdefg", "0" * 24 + "x" + "a" * 23, "AKIAAKIA" + "B" * 20]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan(df).collect():
        want = brute(texts[r["doc_id"]])
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("random"))
        assert base == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_battery(spark):
    import base64
    import random

    g = random.Random(3)
    raw = [base64.b64encode(g.randbytes(30)).decode().rstrip("=") for _ in range(200)]
    plain = ["getUserAccountById2FromCache", "Sha256MessageDigestImpl", "Base64EncoderOutputStream", "word2vecgooglenews300model", "Chapter1Chapter1Chapter1Chapter1", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzB1", "A1b2A1b2A1b2A1b2A1b2A1b2A1b2", "thisIsAVeryVeryLongNameOfAMethod1"]
    texts = [f"é see {x} here" for x in raw + plain] + ["words only, thisisaverylongwordwithoutdigits"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in scan(df).collect()}
    hits = [got[i] == f"random:6:{6 + len(x)}" for i, x in enumerate(raw)]
    assert sum(hits) > 0.9 * len(raw)
    assert not any(got[len(raw) + i] for i in range(len(plain) + 1))


def test_redact(spark):
    df = spark.createDataFrame([(1, "é token=abcdef12, then " + "0f" * 12 + "!", 99, 5), (2, None, None, 5), (3, "clean", 5, 5), (4, "secret=" + "AKIA" + "A" * 20, 1, 5)], "doc_id long, text string, n_chars long, _extra int")
    got = {r.doc_id: (r.text, r.n_chars) for r in redact(df).collect()}
    assert got == {1: ("é [SECRET], then [SECRET]!", 26), 2: (None, None), 3: ("clean", 5), 4: ("[SECRET]", 8)}
