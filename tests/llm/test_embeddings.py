import numpy as np
import pytest

from weft.llm.embeddings import near_embeddings


def brute(ids, x, least=0.95):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = u @ u.T >= least
    n = hit.sum(1) - 1
    label = np.array(ids)
    while True:
        new = np.array([label[h].min() for h in hit])
        if (new == label).all():
            return {(i, int(k), int(c), i == c) for i, k, c in zip(ids, n, label)}
        label = new


def bigger(spark):
    """Seeded clusters about a shared mean direction, one of which holds a third of all rows."""
    g = np.random.default_rng(4)
    centre = g.standard_normal((400, 32)) + 1
    which = np.where(g.random(4000) < 1 / 3, 0, g.integers(0, 400, 4000))
    x = centre[which] + g.standard_normal((4000, 32)) * g.choice([0.02, 0.25, 0.4], 4000)[:, None]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("path", ["/root/testdata/sf0.01/embeddings.parquet", None])
def test_equals_brute_force(spark, path):
    df = spark.read.parquet(path) if path else bigger(spark)
    rows = [r for r in df.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    got = [tuple(r) for r in near_embeddings(df).collect()]
    assert len(got) == df.count()
    if path:
        bad = want - set(got)
        assert not bad, sorted(bad)[:5]
        return
    # hyperplane tables may miss links, each with a probability of at most 1 in 10,000; none is made up
    links = {w[0]: w[1] for w in want}
    lost = [links[g[0]] - g[1] for g in got]
    assert min(lost) >= 0 and sum(lost) <= 1e-4 * sum(links.values())
    assert {(w[0], w[2]) for w in want} == {(g[0], g[2]) for g in got}


def test_edges(spark):
    s = "vec_id long, embedding array<float>, x int"
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0), (7, [], 0), (8, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [-1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in near_embeddings(spark.createDataFrame(rows, s)).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert near_embeddings(spark.createDataFrame([], s)).count() == 0
