"""Main text of HTML pages: differencing against the nearest URL, then a check by structure.

Each page is read as blocks. Blocks in elements for menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles are left out. On every page, the longest common
subsequence with the page nearest by URL path within the host tells the lines that both have from
the page's own. The article is where the page's own lines are: of several article elements those
that only have shared lines are left out, as teasers that the host repeats, if the others hold more
text. The check gives back shared lines inside the article, as they can be real passages, and takes
away lines beside an article or main element. In pages without one the page's own lines are the text.
"""
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements without an end, elements whose text is no content, elements that
# end a block, and words of class, id or role that mark what is around the content.
VOID = "area base br col embed hr img input link meta source track wbr".split()
OUT = "nav header footer aside form script style noscript template svg iframe button select textarea dialog menu title head".split()
BLOCK = "address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul nav header footer aside form dialog menu head title".split()
AROUND = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|promo|sponsored|sponsor|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|header|cookie|cookies|consent|notice|popup|newsletter|subscribe|share|social|related|comment|comments|complementary|contentinfo)(?:$|[\s_-])", re.I)

STEP = 256  # rows of a table of lengths between two that are held
SAMPLE = 100


class Page(HTMLParser):
    """Blocks of a page as (text, place): the number of the outermost article, -1 elsewhere in main, 0 outside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, left out, place
        self.blocks: list[tuple[str, int]] = []
        self.articles = 0
        self.text: list[str] = []

    def parse_marked_section(self, i, report=1):
        """Marked sections of any kind are read as comments, up to their first >; an open one ends the page."""
        k = self.rawdata.find(">", i + 3)
        return len(self.rawdata) if k < 0 else k + 1

    def flag(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def end_block(self):
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.blocks.append((t, self.flag()[1]))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_block()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        out, main = self.flag()
        a = dict(attrs)
        if tag == "p":  # a new paragraph ends one left open
            self.close_to("p", stop=("article", "main", "div", "section", "td", "li", "blockquote", "body"))
            out, main = self.flag()
        said = " ".join(a.get(k) or "" for k in ("class", "id", "role"))
        kept = tag in ("article", "main", "body", "html")
        # a header inside an article may hold its headline
        out = out or (tag in OUT and not (tag == "header" and main)) or (not kept and bool(AROUND.search(said)))
        if tag == "article" and main <= 0:
            self.articles += 1
            main = self.articles
        elif tag == "main" and not main:
            main = -1
        self.open.append((tag, out, main))

    def close_to(self, tag, stop=()):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.end_block() if tag in BLOCK else None
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag):
        # inline ends do not reach past the block they stand in
        self.close_to(tag, () if tag in BLOCK or tag in OUT else tuple(BLOCK))
        if tag in BLOCK:
            self.end_block()

    def handle_data(self, data):
        if not self.flag()[0]:
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, int]]:
    p = Page()
    p.feed(html or "")
    p.close()
    p.end_block()
    return p.blocks


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a in a longest common subsequence of a and b.

    Rows of the table of lengths as bits of one number each; every STEP-th is held, the others are
    made again on the way back, so lines that occur often cost no more than others.
    """
    both = set(a) & set(b)
    own, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    start, end = 0, 0
    while start < min(len(own), len(b)) and a[own[start]] == b[start]:
        start += 1
    while end < min(len(own), len(b)) - start and a[own[-1 - end]] == b[-1 - end]:
        end += 1
    out = set(own[:start] + own[len(own) - end :])
    own, b = own[start : len(own) - end], b[start : len(b) - end]
    bits, full = defaultdict(int), (1 << len(b)) - 1
    for j, x in enumerate(b):
        bits[x] |= 1 << j

    def steps(v, rows):
        yield v
        for i in rows:
            u = v & bits[a[i]]
            v = ((v + u) | (v - u)) & full
            yield v

    held = [full]
    for z in range(0, len(own), STEP):
        *_, v = steps(held[-1], own[z : z + STEP])
        held.append(v)
    i, j, base, rows = len(own), len(b), len(own), []
    while i and j:
        if i <= base or not rows:
            base = (i - 1) // STEP * STEP
            rows = list(steps(held[base // STEP], own[base : base + STEP]))
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if rows[i - base] >> (j - 1) & 1:
            out.add(own[i])
            j -= 1
    return out


def main_text(found: list[tuple[str, int]], near: list[tuple[str, int]] | None = None) -> str:
    lines = [t for t, _ in found]
    drop = shared(lines, [t for t, _ in near]) if near else set()
    if not any(at for _, at in found):
        return "\n\n".join(t for i, t in enumerate(lines) if i not in drop)
    mine = {at for i, (_, at) in enumerate(found) if at > 0 and i not in drop}
    others = {at for _, at in found if at > 0} - mine
    # of a copy with teasers of its own the teasers are the smaller part
    if sum(len(t) for t, at in found if at in mine) <= sum(len(t) for t, at in found if at in others):
        others = set()
    return "\n\n".join(t for t, at in found if at and at not in others)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every row; null html counts as empty.

    Pages lie in the order of host, path, URL and id; a page's nearest is whichever of its two
    neighbours of the same host shares the longer start of the path, the one before if both do.
    The order is cut into parts at URLs of a sample of about SAMPLE a part; the first and last URL of a
    part are also sent to the part beside it, so the cuts do not change results. Rows of one URL are
    each other's neighbours, and lie in one part; null URLs have no neighbours. Malformed markup
    never fails: open elements end with the page, ends without a start are passed over, marked
    sections are comments.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    p = p.toDF("id", "u", "html").withColumn("host", F.lower(F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))).withColumn("path", F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    kinds = [p.schema[c].dataType.simpleString() for c in ("id", "u")]
    p = p.withColumn("key", F.when(F.col("host") != "", F.concat_ws("\0", "host", "path", "u")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = p.where("key is not null").select("key", "id")
    every = max(1, keys.count() // (SAMPLE * parts))
    sample = sorted((r.key for r in keys.where(F.pmod(F.xxhash64("key", "id"), F.lit(every)) == 0).collect()), key=str.encode)
    cuts = sorted({sample[k * len(sample) // parts] for k in range(1, parts)} if sample else (), key=str.encode)
    part = F.size(F.filter(F.lit(cuts), lambda x: x <= F.col("key"))) if cuts else F.lit(0)
    edges = sorted(keys.groupBy(part.alias("part")).agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    beside = defaultdict(list)
    for x, y in zip(edges, edges[1:]):
        beside[x["last"]].append(y["part"])
        beside[y["first"]].append(x["part"])
    p = p.withColumn("own", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("id", "u"), F.lit(parts)).cast("int")).otherwise(part))
    to = F.array("own")
    if beside:
        said = F.create_map(*[F.lit(x) for k, v in beside.items() for x in (k, v)])
        to = F.concat(to, F.coalesce(F.element_at(said, F.coalesce("key", F.lit(""))), F.array().cast("array<int>")))
    p = p.withColumn("part", F.explode(to)).withColumn("sent", F.col("part") != F.col("own"))
    p = p.select("id", "u", "html", "host", "path", "part", "sent", "key", F.xxhash64("html").alias("tie"))
    p = p.repartitionById(parts, "part").sortWithinPartitions("part", "key", "id", "tie").select("id", "u", "html", "host", "path", "part", "sent")

    def like(a, b):
        if a is None or b is None or not a[2] or (a[2], a[4]) != (b[2], b[4]):
            return -1
        return next((k for k, (x, y) in enumerate(zip(a[3], b[3])) if x != y), min(len(a[3]), len(b[3])))

    def rows(batches):
        for b in batches:
            for k in range(b.num_rows):
                i, u, html, host, path, part, sent = (b.column(c)[k].as_py() for c in range(7))
                yield i, u, host, path, part, sent, blocks(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            last = now = None
            for new in rows(batches):
                if now is not None:
                    yield now, max((last, new), key=lambda x: like(now, x))
                last, now = now, new
            if now is not None:
                yield now, last

        held = []

        def batch():
            ids, urls, out = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "u", "text", "n_chars"])

        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(id_kind)
        for now, near in texts():
            if now[5]:
                continue
            held.append((now[0], now[1], main_text(now[6], near[6] if like(now, near) >= 0 else None)))
            if len(held) == 200:
                yield batch()
                held.clear()
        if held:
            yield batch()

    id_kind = p.schema["id"].dataType
    out = p.mapInArrow(run, f"id {kinds[0]}, u {kinds[1]}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
