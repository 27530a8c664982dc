import html
import re
import time

from hypothesis import given, settings, strategies as st

from weft.llm.extract import blocks, extract, main_text, shared


def plain(h):
    """The article of the test tables' pages by patterns."""
    a = re.search(r"(?s)<article>(.*?)(?:</article>|$)", h or "")
    parts = re.split(r"</?(?:p|h1)>", a[1]) if a else []
    parts = (" ".join(html.unescape(re.sub(r"<(?:/?b|br)>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts)
    return "\n\n".join(x for x in parts if x)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    bad = [(r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id]]
    assert not bad, (len(bad), bad[0])


def test_structure():
    h = '<header>H</header><div class="cookie-notice">C</div><main><header><h1>T &amp; U</h1></header><p>a <b>b\n c</b><p>d<br>e<form>f</form><aside>g</aside><section id=comments><p>h</section><script>"</p>"</script></main><footer>F'
    assert main_text(blocks(h)) == "T & U\n\na b c\n\nd e"


def test_differencing(spark):
    rows = [(1, "http://a/x/1", "<p>Menu<p>one<p>End"), (2, "http://a/x/2", "<p>Menu<p>two<p>End"), (3, "http://b/", "<p>Menu<p>three"), (4, None, None), (None, "http://c", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: r.text for r in extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {1: "one", 2: "two", 3: "Menu\n\nthree", 4: "", None: ""}
    assert extract(df.limit(0)).count() == 0


def test_differencing_finds_the_article():
    story, teasers = "<article><h1>T</h1><p>a long story of its own<p>Shared passage</article>", "<article><p>More</article><article><p>News</article>"
    other = "<article><p>another one<p>Shared passage</article>" + teasers
    assert main_text(blocks(story + teasers), blocks(other)) == "T\n\na long story of its own\n\nShared passage"
    # a copy keeps its text, with teasers of its own too, and so does a page without neighbours
    assert main_text(blocks(story), blocks(story)) == main_text(blocks(story)) == "T\n\na long story of its own\n\nShared passage"
    assert main_text(blocks(story + "<article><p>x</article>"), blocks(story + "<article><p>y</article>")).startswith("T\n\na long story")


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://{'ab'[i % 2]}/x/{i:03}", f"<p>Menu<p>own {i}<p>End") for i in range(60)] + [(99, None, "<p>alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"own {i}" for i in range(60)} | {99: "alone"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 8, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = [(r.page_id, r.text) for r in extract(df.repartition(5)).collect()]
            assert len(got) == 61 and dict(got) == want, n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_many_equal_lines():
    a, b = ["x", "y"] * 10_000, ["y", "x", "x"] * 6_000
    t = time.time()
    assert len(shared(a, b)) >= 12_000 and time.time() - t < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(shared(a, b)) == best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<", ">", "<![foo[x]]>", "<![", "<!", "<?", "</", "&#x", "&amp", "<div class=", '"', "'", "<script>", "</script", "text", "<!--", "-->", "=", "]]>", "<article>", "</main>"]), max_size=14).map("".join))
def test_any_markup(h):
    assert isinstance(main_text(blocks(h)), str)
