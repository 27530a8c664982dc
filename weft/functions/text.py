"""Text functions as Column expressions."""
from pyspark.sql import Column, functions as F

# Fixed value: punctuation that the tokenizer turns into spaces.
PUNCTUATION = "[\\t\\r\\n.,:;!?’'\"()-]"


WORD = "^([a-z]+|[0-9]{1,3})$"


def split_words(html: Column) -> Column:
    """The text's parts between spaces, of which `WORD` tells the tokens."""
    plain = F.regexp_replace(F.regexp_replace(html, "<.*?>", " "), PUNCTUATION, " ")
    return F.split(F.lower(plain), " +")


def tokens(html: Column) -> Column:
    return F.filter(split_words(html), lambda w: w.rlike(WORD))
