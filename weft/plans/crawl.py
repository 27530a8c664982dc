"""A crawl over a table of pages in place of the network: rounds of a frontier, robots rules and politeness."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from weft.functions import links
from weft.operators.storage import clear, written
from weft.plans.graph import gathered


def polite(frontier: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """frontier (url) with `wait`: whether the host was visited (hosts: host, last_ts in ms, delay in s) within its delay."""
    f = frontier.withColumn("host", links.part(F.col("url"), 2))
    due = F.col("last_ts").isNotNull() & (F.lit(now) - F.col("last_ts") <= F.col("delay") * 1000)
    return f.join(hosts, "host", "left").select(*frontier.columns, F.coalesce(due, F.lit(False)).alias("wait"))


def links_of(pages: DataFrame, kind: str = "crawl") -> DataFrame:
    """(src, dst): distinct normalised links of the pages, src with its port."""
    raw = links.anchors(F.col("html")) if kind == "crawl" else links.any_anchors(F.col("html"))
    e = pages.select("url", F.explode(raw).alias("raw"))
    e = e.select(links.default_port(F.regexp_replace("url", "#.*$", "")).alias("src"), links.normalised(F.col("url"), F.col("raw"), kind).alias("dst"))
    return e.where("src is not null and dst is not null").distinct()


def crawl(seeds: DataFrame, web: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, rounds: int | None = None, name: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(url, round): the pages of web (url) reached from seeds (url) over edges (src, dst), with their first round.

    Runs until the frontier is empty, or `rounds` rounds as its time limit. allowed (url) restricts what is fetched.
    Pages may stand for URLs by numbers, of which `name` gives the URL. Links, pages and every round are written once,
    so each link is followed once.
    """
    held: list[str] = []
    can = web.select("url").where(~links.skipped(name(F.col("url")), "fetch"))
    if allowed is not None:
        can = can.join(allowed, "url", "left_semi")
    can, out = written(can, held), gathered(edges, held)
    front = written(seeds.select("url").distinct().join(can, "url", "left_semi").withColumn("round", F.lit(0)))
    seen, k = front, 0
    while not front.isEmpty() and (rounds is None or k < rounds):
        k += 1
        new = out.join(front, F.col("src") == F.col("url"), "left_semi").select(F.explode("out").alias("url")).distinct()
        front = written(new.join(can, "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(k)))
        seen = seen.union(front)
    clear(web.sparkSession, held)
    return seen
