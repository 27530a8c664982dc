"""The pages are read once for an index, however many steps follow."""
import pytest

from weft.plans import index as I


@pytest.mark.parametrize("more", [{}, {"fields": True, "stemmed": True}])
def test_pages_are_read_once(spark, tmp_path, more):
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(len(b))
            yield b

    pages = spark.createDataFrame([(f"http://h.org/{i}", f"<title>running {i}</title> run with {i}") for i in range(9)] + [(None, "run"), ("u", None)], "url string, html string")
    I.save(I.weighted(I.counts(pages.mapInPandas(seen, "url string, html string"), **more), df=True), str(tmp_path / "x"))
    assert n.value == 11
    rows = {(r.term, r.url): (r.c, r.df) for r in I.load(spark, str(tmp_path / "x")).collect()}
    assert rows["run", None] == (1, 10) and rows["run", "http://h.org/1"][1] == 10
    assert rows["run", "http://h.org/1"][0] == (1 if not more else 1 + 51)
