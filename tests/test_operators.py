import tempfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weft.functions import links, page
from weft.functions.stem import stem
from weft.operators import collections as C
from weft.operators.catalog import Catalog, Conflict
from weft.plans import crawl as K, index as I


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def test_catalog_rules(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    cell = lambda v, q: spark.createDataFrame([("r", "c", v, q)], "row_key string, col string, value string, seq long")
    assert c.scan("pt-none").count() == 0 and c.get("pt-none", "r", "c") is None
    c.put("pt-a", cell("old", 1))
    c.put("pt-a", cell("new", 2))
    c.put("b", cell("x", 1))
    assert c.get("pt-a", "r", "c") == "new" and c.exists_row("pt-a", "r") and not c.exists_row("pt-a", "q")
    assert c.get_row("pt-a", "r").first()["values"] == {"c": "new"} and c.count("pt-a") == 1
    with pytest.raises(Conflict):
        c.rename("pt-a", "z")
    with pytest.raises(LookupError):
        c.rename("nothing", "z")
    with pytest.raises(Conflict):
        c.rename("b", "pt-a")
    c.rename("b", "pt-b")
    assert c.tables() == ["pt-a", "pt-b"]
    c.delete("pt-b")
    with pytest.raises(LookupError):
        c.scan("pt-b")
    assert c.result() == "There was no output"
    c.output("a")
    c.output("b")
    assert c.result() == "ab"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 99)), max_size=8))
def test_last_write_wins(spark, writes):
    rows = [(r, "c", str(v), k) for k, (r, v) in enumerate(writes)]
    c = Catalog(spark, tempfile.mkdtemp())
    c.put("x", spark.createDataFrame(rows, "row_key string, col string, value string, seq long"))
    assert {r.row_key: r.value for r in c.latest("x").collect()} == {r: str(v) for r, v in writes}


def test_links(spark):
    base = "https://h.org/a/b/c.html"
    cases = {"x.html": "https://h.org:443/a/b/x.html", "../x": "https://h.org:443/a/x", "/q/../r#f": "https://h.org:443/r", "../../../x": None, "#top": None, "": None, "mailto:a@b": None, "ftp://x/y": None, "http://k.org": "http://k.org:80/", "http://k.org:8080/z": "http://k.org:8080/z", "/a/../../b": None}
    for raw, want in cases.items():
        assert one(spark, links.normalised(F.col("b"), F.col("r")), b=base, r=raw) == want, raw
    assert one(spark, links.normalised(F.col("b"), F.col("r"), "rank"), b=base, r="x.jpg") is None
    html = '<a href="/1">x</a><ARTICLE class=q HREF=\'/2\'><abbr href="/3.png"></a href="/4"><p href="/5=6">'
    assert one(spark, links.anchors(F.col("h")), h=html) == ["/1"]
    # what follows a second = is lost, and with it the closing quote; so is a word's last letter
    assert one(spark, links.any_anchors(F.col("h")), h=html) == ["/1", "/2", "/3.png", "/"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nUser-agent: me\nAllow: /a*\nDisallow: /*\nCrawl-delay: x\n"
    r = one(spark, links.robots(F.col("t"), "me"), t=text)
    assert [tuple(x) for x in r["rules"]] == [(True, "/a*"), (False, "/*")] and r["delay"] is None
    assert one(spark, links.robots(F.col("t"), "you"), t=text)["delay"] == 1.0
    for path, want in (("/private", False), ("/private/x", True), ("/a", True)):
        assert one(spark, links.ruled(F.col("p"), links.robots(F.col("t"), "you")["rules"]), t=text, p=path) is want
    assert one(spark, links.robots(F.col("t"), "me"), t=None)["rules"] == []


def test_titles(spark):
    for html, want in (("<h2 id=x>A, <b>b</b>\\\n c</h2>", "A b c"), ("<title></title><h1>x</h1>", ""), ("<p>none", None), ("<title lang='en'>T</title>", "T")):
        assert one(spark, page.title(F.col("h")), h=html) == want
    assert one(spark, page.abstract(F.col("h")), h="<p>" + "ab " * 80).endswith("...")
    assert one(spark, page.abstract(F.col("h")), h="<p>short") is None


def test_stems():
    want = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop falling fall filing file happy happi sky sky relational relat conditional condit digitizer digit triplicate triplic hopeful hope goodness good revival reviv adjustable adjust adoption adopt effective effect rate rate controll control roll roll".split()
    assert [stem(w) for w in want[::2]] == want[1::2]


def test_terms():
    assert I.terms_of("Running run, x") == {"running": 1.0, "run": 0.7, "x": 1.0}


def test_polite_and_crawl(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d.jpg"), ("c", "x")], "src string, dst string")
    web = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d.jpg")], "url string")
    got = {r.url: r.round for r in K.crawl(web.where("url = 'a'"), web, e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert K.crawl(web.limit(0), web, e).count() == 0
    assert {r.url for r in K.crawl(web.where("url = 'a'"), web, e, rounds=1).collect()} == {"a", "b"}


def test_folds(spark):
    bag = C.parallelize(spark, ["b", "a"])
    assert C.fold(bag, F.lit("z"), lambda a, b: F.concat(a, b)).first()["value"] == "zab"
    assert C.map_to_pair(bag, lambda x: F.when(x == "a", F.struct(x.alias("k"), x.alias("v")))).collect() == [("a", "a")]
    assert sorted(r.value for r in C.flat_map(bag, lambda x: F.array(x, F.lit(None))).collect()) == ["a", "b"]
    assert 0 < C.sample(spark.range(1000).select(F.col("id").cast("string").alias("value")), 0.5, 3).count() < 1000
