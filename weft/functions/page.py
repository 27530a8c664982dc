"""Titles and abstracts of pages as Column expressions."""
from functools import reduce

from pyspark.sql import Column, functions as F

from weft.functions.text import PUNCTUATION

HEADS = ["title", "h1", "h2", "h3", "h4", "h5", "h6"]
ABSTRACT = 200  # characters of an abstract


def cleaned(text: Column) -> Column:
    """Tags, punctuation, backslashes and control characters as spaces, runs of spaces as one, trimmed."""
    for pattern in ("<.*?>", PUNCTUATION, r"\\", r"[\x00-\x1F\x7F]"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def title(html: Column) -> Column:
    """The cleaned content of the first kind of title, h1, ..., h6 that the page has, attributes allowed; an empty one counts. Null without any."""
    one = lambda tag: (F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"))
    return F.coalesce(*(F.when(F.regexp_like(html, one(tag)), cleaned(F.regexp_extract(html, f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1))) for tag in HEADS))


def abstract(html: Column) -> Column:
    """The cleaned first ABSTRACT characters after the first <p>, and dots; null with fewer or without one."""
    at = F.locate("<p>", html)
    return F.when((at > 0) & (F.length(html) - at - 2 >= ABSTRACT), F.concat(cleaned(F.substring(html, at + 3, F.lit(ABSTRACT))), F.lit("...")))


def control_free(url: Column) -> Column:
    """Whether a posting's URL may be shown: not empty, no control character, no quote, not the text null."""
    return reduce(lambda a, b: a & b, (url.isNotNull(), url != "", url != "null", ~url.rlike(r'[\x00-\x1F"]')))
