"""Hashes, keys, URLs, headings and robots rules as Column expressions."""
from pyspark.sql import Column, functions as F

# Suffixes that are not fetched; weights of words in titles and headings; weight of a word of the URL.
SKIPPED = ["jpg", "jpeg", "gif", "png", "txt", "ico"]
WEIGHTS = {"title": 50, "h1": 30, "h2": 20, "h3": 10, "h4": 5, "h5": 3}
URL_WEIGHT = 30


def letter_hash(c: Column) -> Column:
    """SHA-1 of the UTF-8 bytes, two letters a byte; null stays null."""
    def letters(i: Column) -> Column:
        b = F.conv(F.substring(F.sha1(c), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        n = F.when(b == 0, 255).when(b > 127, b - 1).otherwise(b)
        return F.concat(F.char(n % 26 + 97), F.char(F.floor(n / 26) * 2 + 97))

    return F.when(c.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), letters), ""))


def key_encode(c: Column) -> Column:
    """Letters, digits and hyphens stay; another character becomes _ and its code point in hex."""
    keep = lambda x: F.when(x.rlike("^[A-Za-z0-9-]$"), x).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.ascii(x)))))
    return F.array_join(F.transform(F.split(c, ""), keep), "")


def fetchable(url: Column) -> Column:
    return ~url.rlike(r"\.(" + "|".join(SKIPPED) + ")$")


def rule_pattern(rule: str) -> str:
    """A robots rule as a pattern for whole paths: * stands for anything, all else for itself."""
    return "".join(".*" if ch == "*" else "\\" + ch if ch in "[](){}+.^$|\\" else ch for ch in rule)


def allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The first rule that matches decides; without one the path is allowed."""
    return F.coalesce(*(F.when(path.rlike("^(?:" + rule_pattern(r) + ")$"), F.lit(ok)) for ok, r in rules), F.lit(True))


def query_terms(query: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits."""
    return "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split()
