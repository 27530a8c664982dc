"""Ports, normal forms of links, anchors, suffix sets and robots files as Column expressions."""
from pyspark.sql import Column, functions as F

# Fixed value: scheme, host, port, path.
URL = "^([^/].*?)://([^/:]*)(?::([^/]*))?(/.*)?$"
# Suffixes that crawling, fetching and ranking leave out.
SUFFIXES = {
    "crawl": ["jpg", "jpeg", "gif", "png", "txt", "ico"],
    "fetch": ["jpg", "jpeg", "gif", "png", "txt", "ico", "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "rar", "mp3", "mp4"],
    "rank": ["jpg", "jpeg", "gif", "png", "txt"],
}
ANCHORS = 50  # anchors of a page that are followed


def skipped(url: Column, kind: str) -> Column:
    return url.rlike(r"\.(" + "|".join(SUFFIXES[kind]) + ")$")


def part(url: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(url, URL, i), F.lit(""))


def default_port(url: Column) -> Column:
    """The URL with a port; null for schemes other than http and https and without a host."""
    scheme = part(url, 1)
    port = F.coalesce(part(url, 3), F.when(scheme == "http", "80").when(scheme == "https", "443"))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), part(url, 2), F.lit(":"), port, F.coalesce(part(url, 4), F.lit("/"))))


def resolved(path: Column) -> Column:
    """The path without `/segment/../`; null if `..` leads above the root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc, x):
        up = x == ".."
        less = F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))
        return F.struct(F.when(up, less).otherwise(F.concat(acc["p"], F.array(x))).alias("p"), (acc["ok"] & ~(up & (F.size(acc["p"]) == 0))).alias("ok"))

    plain = F.when(~path.contains("/.."), path)
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    full = F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.concat(F.lit("/"), F.array_join(a["p"], "/"))))
    return F.coalesce(plain, full)


def normalised(base: Column, raw: Column, kind: str = "crawl") -> Column:
    """The link raw of page base as a URL with a port, without fragment; null for links that are not followed.

    kind rank also drops links that start with `#` and those with its suffixes.
    """
    link = F.regexp_replace(raw, "#.*$", "")
    home = default_port(base)
    front = F.concat(part(home, 1), F.lit("://"), part(home, 2), F.lit(":"), part(home, 3))
    folder = F.regexp_extract(part(home, 4), "^(.*/)", 1)
    own = F.when(link.startswith("/"), F.concat(front, resolved(link))).otherwise(F.concat(front, resolved(F.concat(folder, link))))
    out = F.when(link == "", None).when(link.contains("://"), default_port(link)).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(own)
    return F.when(~(raw.startswith("#") | skipped(link, "rank")), out) if kind == "rank" else out


def anchors(html: Column) -> Column:
    """href values in double quotes of tags whose name starts with a, without the crawl suffixes, the first ANCHORS."""
    tags = F.filter(F.split(html, "<"), lambda x: x.rlike("^[\\x00-\\x20]*a"))
    urls = F.filter(F.transform(tags, lambda x: F.regexp_extract(x, 'href="([^"]*)"', 1)), lambda x: (x != "") & ~skipped(x, "crawl"))
    return F.slice(urls, 1, ANCHORS)


def any_anchors(html: Column) -> Column:
    """href values of any opening tag: its words split at =, quotes cut off, what follows a second = left out."""
    tags = F.transform(F.filter(F.split(html, "<"), lambda x: ~x.startswith("/") & x.contains(">")), lambda x: F.substring_index(x, ">", 1))
    words = F.flatten(F.transform(tags, lambda x: F.split(x, " ")))
    found = F.filter(F.transform(words, lambda x: F.split(x, "=")), lambda x: (F.lower(x[0]) == "href") & (F.size(x) > 1))
    return F.filter(F.transform(found, lambda x: F.substring(x[1], F.lit(2), F.greatest(F.length(x[1]) - 2, F.lit(0)))), lambda x: x != "")


def robots(text: Column, agent: str) -> Column:
    """struct rules array<struct<allow, pattern>> in file order, delay double: of the agent's own section, else of `*`."""
    kind = "struct<who:string,own:boolean,mine:array<struct<allow:boolean,pattern:string>>,all:array<struct<allow:boolean,pattern:string>>,delay:string,delay_all:string>"
    empty = F.lit(None).cast(kind)
    start = F.struct(F.lit("").alias("who"), F.lit(False).alias("own"), F.array().cast("array<struct<allow:boolean,pattern:string>>").alias("mine"), F.array().cast("array<struct<allow:boolean,pattern:string>>").alias("all"), F.lit("1").alias("delay"), F.lit("1").alias("delay_all"))

    def step(acc, x):
        who = F.when(x.startswith("User-agent: "), F.trim(F.substring(x, 13, 1000))).otherwise(acc["who"])
        mine, every = who == agent, who == "*"
        rule = F.when(x.startswith("Allow: "), F.array(F.struct(F.lit(True).alias("allow"), F.trim(F.substring(x, 8, 10000)).alias("pattern")))).when(x.startswith("Disallow: "), F.array(F.struct(F.lit(False).alias("allow"), F.trim(F.substring(x, 11, 10000)).alias("pattern"))))
        wait = F.when(x.startswith("Crawl-delay: "), F.trim(F.substring(x, 14, 100)))
        grow = lambda name, on: F.when(on & rule.isNotNull(), F.concat(acc[name], rule)).otherwise(acc[name])
        return F.struct(who.alias("who"), (acc["own"] | mine).alias("own"), grow("mine", mine).alias("mine"), grow("all", every).alias("all"), F.when(mine, F.coalesce(wait, acc["delay"])).otherwise(acc["delay"]).alias("delay"), F.when(every, F.coalesce(wait, acc["delay_all"])).otherwise(acc["delay_all"]).alias("delay_all"))

    end = lambda a: F.struct(F.when(a["own"], a["mine"]).otherwise(a["all"]).alias("rules"), F.when(a["own"], a["delay"]).otherwise(a["delay_all"]).try_cast("double").alias("delay"))
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\r?\n"), F.coalesce(empty, start), step, end)


def ruled(path: Column, rules: Column) -> Column:
    """The first of the rules that matches the whole path decides; without one the path is allowed."""
    escape = lambda r: F.regexp_replace(F.regexp_replace(r, r"([\[\](){}+.^$|\\?])", r"\\$1"), r"\*", ".*")
    hit = F.filter(rules, lambda r: F.regexp_like(path, F.concat(F.lit("^(?:"), escape(r["pattern"]), F.lit(")$"))))
    return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))
