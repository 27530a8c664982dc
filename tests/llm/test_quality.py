import tracemalloc
from zlib import crc32

from weft.llm.quality import learn, quality

D = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = ([s for s, _, q in held if q == k] for k in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    wrong = [sum(p != q for _, p, q in held if q == k) for k in (0, 1)]
    print("auc", auc, "of", len(neg), len(pos), "wrong", wrong)
    assert auc > 0.95 and sum(wrong) / len(held) < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality(docs, none).collect()] == [1.0] * 3
    one = spark.createDataFrame([(1, 1), (None, 1), (1, None)], "doc_id long, quality int")
    assert quality(docs, one).count() == 3 and quality(docs.limit(0), one).count() == 0


def test_driver_holds_no_sample(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    tracemalloc.start()
    w, bias = learn(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6, peak
    again, other = learn(docs.repartition(7), labels)
    assert (w == again).all() and bias == other
