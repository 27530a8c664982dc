import random
import time

import numpy as np
import pyarrow as pa

from weft.llm.common import Words, shingles, words_of
from weft.llm.passages import PART, common, keyed, keyed_all, own_repeats, repeated_passages, tokens_of, windows


def test_planted(spark):
    g = random.Random(5)
    word = lambda: f"w{g.randrange(10**6)}"
    fill = lambda n: [word() for _ in range(n)]
    passage, near = fill(60), fill(120)
    rows, want = [], {}
    for i in range(12):
        head = fill(g.randrange(0, 150))
        rows.append((i, " ".join(head + passage + fill(40))))
        want[i] = (len(head), len(head) + 60)
    edited = near[:60] + ["new"] + near[61:]
    rows += [(20, " ".join(fill(30) + near + fill(30))), (21, " ".join(fill(10) + edited + fill(10)))]
    twice = fill(55)
    rows += [(30, " ".join(twice + fill(100) + twice))]
    rows += [(40, " ".join(fill(300))), (41, " ".join(passage[:30])), (42, ""), (43, None), (None, None)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in want.items():
        assert got[i].spans == f"{a}:{b}" and got[i].component_id == 0
    assert got[21].spans == "10:130" and got[21].component_id == 20
    assert got[30].spans == "0:55,155:210"
    assert all(got[i].n_passages == 0 and got[i].component_id == i for i in (40, 41, 42, 43, None))
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_that_no_leader_shows(spark):
    g = random.Random(8)
    word = lambda: f"w{g.randrange(10**6)}"
    fill = lambda n: [word() for _ in range(n)]
    base = fill(60)

    def version():
        out = list(base)
        for i in g.sample(range(60), 4):
            out[i] = word()
        return out

    # every version is its own, but for 20 that stand in two rows each
    versions = [version() for _ in range(200)]
    texts = [fill(20) + v + fill(20) for v in versions + versions[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(20):
        for k in (i, 200 + i):
            spans = [tuple(map(int, x.split(":"))) for x in got[k].spans.split(",") if x]
            assert any(a <= 20 and b >= 80 for a, b in spans), k
        assert got[i].component_id == got[200 + i].component_id


def test_recall_of_short_near_passages():
    g = random.Random(1)
    word = lambda: f"w{g.randrange(10**6)}".encode()
    met = 0
    for _ in range(200):
        base = [word() for _ in range(50)]
        other = list(base)
        other[g.randrange(5, 45)] = word()  # similarity of at least 0.8
        texts = ([word() for _ in range(30)] + t + [word() for _ in range(30)] for t in (base, other))
        x, y = (set(keyed(shingles(Words()(t), 5), 46)[:, 0].tolist()) for t in texts)
        met += bool(x & y)
    assert met >= 196


def test_repeated_lines_stay_few():
    line = np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(keyed(np.tile(line, 1000), 46)) < 5000


def test_windows_are_those_of_the_tree():
    """Against every subsequence: its first minimum is the node of exactly one window that holds it."""
    g = np.random.default_rng(2)
    for n, top in ((30, 5), (40, 1000), (25, 2)):
        v = g.integers(0, top, n).astype(np.uint64)
        lo, c, hi = windows(v, 6)
        for a in range(n):
            for b in range(a + 6, n + 1):
                node = a + int(v[a:b].argmin())
                assert ((c == node) & (lo <= a) & (hi >= b - 1)).sum() == 1


def test_very_long_repeated_line():
    t = time.time()
    keyed(np.tile(np.arange(1, 11, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2000), 46)
    assert time.time() - t < 5


def _texts():
    g = random.Random(3)
    words = ["w%d" % g.randrange(3000) for _ in range(4000)]
    line = " ".join(words[:60])
    odd = ["", " ", "one", "\x0b A\x1fB \t\n é\u00a0x ", "x" * (PART + 5) + " y", "a" + " " * (PART + 9) + "b", line + " - " + line, line.upper()]
    return odd + [" ".join(g.choice(words) for _ in range(g.randrange(400))) for _ in range(60)]


def test_tokens_are_those_of_the_words():
    texts, run = _texts(), 5
    seen, back = {}, {}
    column = pa.array(["cut off", *texts])[1:]
    for x, y, s, starts in tokens_of(column, run):
        for k in range(x, y):
            w = words_of(texts[k])
            assert starts[k - x + 1] - starts[k - x] == len(w)
            for i in range(len(w) - run + 1):
                token, words = int(s[starts[k - x] + i]), tuple(w[i : i + run])
                assert seen.setdefault(words, token) == token and back.setdefault(token, words) == words
    assert len(seen) > 5000


def test_windows_of_many_texts_are_those_of_each():
    least, run = 46, 5
    for x, y, s, starts in tokens_of(pa.array(_texts()), run):
        rows, twice = keyed_all(s, starts, least, run)
        for k in range(y - x):
            own = s[starts[k] : max(starts[k], starts[k + 1] - run + 1)]
            assert sorted(map(tuple, keyed(own, least).tolist())) == sorted(map(tuple, rows[rows[:, 0] == k][:, 1:].tolist()))
            assert k in twice or not own_repeats(own, least)


def test_common_of_numbered_tokens():
    g, found = np.random.default_rng(4), 0
    for top in (10**6, 150, 60):
        for _ in range(100):
            a, b = g.integers(0, top, 150), g.integers(0, top, 40)
            near = a[20:120].copy()
            near[g.random(100) < 0.05] = top
            b = np.r_[b, near]
            got = common(a, b, 46, 80)
            _, code = np.unique(np.r_[a, b], return_inverse=True)
            assert got == common(code[: len(a)], code[len(a) :], 46, 80, int(code.max()) + 1)
            for f, t, h, u in got:
                x, y = set(a[f : t + 1].tolist()), set(b[h : u + 1].tolist())
                assert t - f >= 45 and u - h >= 45 and 100 * len(x & y) >= 80 * len(x | y)
            found += bool(got)
    assert found > 200


def test_windows_take_less_time_than_sorting_the_tokens():
    """Hashing the words and making all windows, against sorting as many tokens once a hash."""
    g = random.Random(6)
    texts = pa.array([" ".join("w%d" % g.randrange(20000) for _ in range(300)) for _ in range(1500)])
    v = np.random.default_rng(7).integers(0, 1 << 62, 450_000)
    took = []
    for _ in range(3):
        t = time.process_time()
        for _ in range(4):
            np.argsort(v, kind="stable")
        u = time.process_time()
        n = sum(len(keyed_all(s, starts, 46, 5)[0]) for _, _, s, starts in tokens_of(texts, 5))
        took.append((time.process_time() - u) / (u - t))
    assert n > 40_000 and min(took) < 1.5, took


def test_large_keys_meet_in_rounds(spark, monkeypatch):
    """Blocks of few windows: no job sends more than about twice the windows, and the results stay."""
    from weft.llm import passages as P

    g = random.Random(8)
    word = lambda n: " ".join("w%d" % g.randrange(10**6) for _ in range(n))
    line, other = word(30), word(70)  # a line too short for a passage, so its windows stay open
    docs = [(i, f"{word(60)} {line} {word(60)}" + (f" {other if i % 2 else word(70)}" if i % 3 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, P.repeated_passages(df).collect()))
    assert any(r[1] for r in want)
    sent, blocks = [], P._blocks

    def counted(*a):
        out = blocks(*a)
        sent.append((out.count(), a[0].count() if len(sent) < 2 else 0))
        return out

    monkeypatch.setattr(P, "BLOCK", 10)
    monkeypatch.setattr(P, "SENT", 1)
    monkeypatch.setattr(P, "_blocks", counted)
    assert sorted(map(tuple, P.repeated_passages(df).collect())) == want
    n = sum(k for _, k in sent)
    assert len(sent) > 2 and all(rows <= 2 * n for rows, _ in sent)
