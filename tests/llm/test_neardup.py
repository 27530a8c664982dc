from itertools import combinations

from weft.llm.neardup import near_duplicates


def brute(rows, words=3, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {p for v in where.values() for p in combinations(v, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[top(a)] = top(b)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return {(r[0], len(sets[i]), least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows)}


def test_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{i}" for i in range(90)]
    rows += [(10**6 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(60)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "A b"), (10**7 + 3, " a\tB "), (10**7 + 4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(rows)


def test_nulls_and_none(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(e).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "x y z"), (0, "x y z")], "doc_id long, text string")
    got = sorted((str(r[0]), r[2]) for r in near_duplicates(df).collect())
    assert got == [("0", 0), ("1", 0), ("1", 1), ("1", 1), ("None", None)]


def test_star(spark):
    """Copies that are linked through their original only."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if (j * 7 + i * 13) % 50 else f"c{i}x{j}" for j, w in enumerate(base))) for i in range(1, 50)] + [(77, " ".join(base))]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_full_meeting(spark, monkeypatch):
    """With one round of leaders most classes meet in full; no link is lost."""
    from weft.llm import neardup

    monkeypatch.setattr(neardup, "ROUNDS", 1)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if (j * 7 + i * 13) % 20 else f"c{i}x{j}" for j, w in enumerate(base))) for i in range(1, 40)]
    rows += [(100 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(30)]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)
