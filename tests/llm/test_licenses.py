import re

from pyspark.sql import functions as F

from weft.llm.licenses import TEMPLATES, WORD, Scanner, license_spans


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = license_spans(docs).collect()
    assert len(rows) == len(text)
    lines = {k: TEMPLATES[k].rstrip(".") for k in ("mit_line", "apache_2_line", "gpl_3_line")}
    hits = 0
    for r in rows:
        for k, line in lines.items():
            want = {m.span() for m in re.finditer(re.escape(line), text[r.doc_id])}
            got = {(s.start, s.end) for s in r.spans if s.license == k and s.coverage == 1}
            assert want <= got
            hits += len(want)
        for s in r.spans:
            t = [w.lower() for w in WORD.findall(TEMPLATES[s.license])]
            d = [w.lower() for w in WORD.findall(text[r.doc_id][s.start : s.end])]
            assert abs(longest(t, d) / len(t) - s.coverage) < 1e-9 and s.coverage >= 0.8
    assert hits


def test_edits_and_edges(spark):
    s = Scanner(TEMPLATES, 0.8)
    t = TEMPLATES["mit_grant"]
    changed = "é " + t.replace("free of charge", "free of any charge").replace("without restriction, ", "") + " end"
    (hit,) = [x for x in s.scan(changed) if x["license"] == "mit_grant"]
    assert hit["start"] == 2 and hit["end"] == len(changed) - 4 and 0.9 < hit["coverage"] < 1
    assert not s.scan("the MIT campus was under the trees")
    assert len(s.scan("Released under the MIT License. " * 3)) == 3
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "Released  under the mit LICENSE", 1)], "doc_id long, text string, spans int")
    assert [r.n_hits for r in license_spans(df).collect()] == [0, 0, 1]
    assert license_spans(df.limit(0)).count() == 0


def test_every_line_of_the_tables(spark):
    lines = {"mit_line": "Released under the MIT License.", "apache_2_line": "Licensed under the Apache License, Version 2.0.", "gpl_3_line": "This work is licensed under the GNU General Public License, version 3.", "cc_by_nc_4_short": "Licensed under CC BY-NC 4.0."}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '(?i)licen[cs]e'").select("text", F.col("text").alias("t"))
    seen = set()
    for r in license_spans(docs, id_col="text", text_col="t").collect():
        want = {(k, m.start(), m.end() - 1) for k, t in lines.items() for m in re.finditer(re.escape(t), r.text)}
        assert want <= {(s.license, s.start, s.end) for s in r.spans}
        seen |= {k for k, _, _ in want}
        # and there is no other line of a license in the tables
        assert len(re.findall("(?i)(?:licensed|released) under", r.text)) == len(want)
    assert seen == set(lines)


def test_whole_texts_and_kin():
    s = Scanner(TEMPLATES, 0.8)
    for k in (k for k in TEMPLATES if k.endswith("_text")):
        text = "some words before. " + TEMPLATES[k] + " and some after"
        (hit,) = [x for x in s.scan(text) if x["license"].endswith("_text")]
        assert hit["license"] == k and hit["coverage"] == 1 and text[hit["start"] :].startswith(WORD.search(TEMPLATES[k])[0])
    for k in (k for k in TEMPLATES if k.split("_")[-1] in ("line", "short", "url") or k.startswith("spdx")):
        got = [x["license"] for x in s.scan("é here: " + TEMPLATES[k] + " Then more.")]
        assert k in got and {x.rsplit("_", 1)[0] for x in got} == {k.rsplit("_", 1)[0]}, k
    t = TEMPLATES["mit_text"].split()
    twice = " ".join(t[:60] + ["inserted"] * 30 + t[60:] + ["between"] * 9 + t)
    assert [round(x["coverage"], 6) for x in s.scan(twice) if x["license"] == "mit_text"] == [1, 1]
    assert not s.scan("Released under the Other License.")
    assert [x["license"] for x in s.scan("Licensed under the Apache License, Version 2")] == ["apache_2_line"]
    assert [x["license"] for x in s.scan("This work is licensed under the GNU Public License, version 3.")] == ["gpl_3_line"]
