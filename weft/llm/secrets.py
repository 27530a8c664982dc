"""Secret scans, native: base kinds by pattern, others by a battery of randomness tests.

Tokens of 20 or more characters are read in the smallest alphabet that holds them: hexadecimal,
base 32, base 36, base 62 or base 64. They are spans of kind `random`, unless they overlap a base
span, if they are shown not to be words, with the false discoveries of secrets in a text held at a
level, and if tests of uniformity, runs and serial correlation do not show them to be non-random.

Null texts count as empty; every row gives a row; repeated ids are kept.
"""
from pyspark.sql import Column, DataFrame, functions as F

# Kind, pattern, what a match must also fulfil.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}


# Alphabets of the inferred encodings, and what a candidate token is.
HEX = "0123456789abcdef"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WORD, CHANGE = 0.45, 0.12  # rates of words, see _words
TOKEN = (r"([A-Za-z0-9+/_-]{20,}+)", 1, 20)


def spans(text: Column, kind: str) -> Column:
    """array<struct<s,o,k,e>> of a kind's leftmost matches, code points, end exclusive."""
    pattern, group, least = KINDS.get(kind, TOKEN)
    order = [*KINDS, kind].index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    seg = F.zip_with(F.zip_with(whole, part, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("p"))), F.slice(gaps, 1, F.size(whole)), lambda m, g: F.struct(m["n"].alias("n"), m["p"].alias("p"), F.length(g).alias("g")))
    kind_t = "array<struct<s:int,o:int,k:string,e:int,p:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_t).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("k"), (acc["at"] + x["g"] + x["n"]).alias("e"), x["p"].alias("p")))).alias("out"))
    found = F.filter(F.aggregate(seg, start, step)["out"], lambda x: x["p"] >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind_t))


def _normal_tail(z: Column) -> Column:
    """Share of the normal distribution above z, by a logistic form good to about 0.0002."""
    c = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * c + 0.07056 * c * c * c))


def _encoding(t: Column) -> Column:
    """The smallest alphabet that holds a token; null for tokens of one case without digits, which are words."""
    digit, one_case = t.rlike("[0-9]"), t.rlike("^([a-z0-9]+|[A-Z0-9]+)$")
    return (
        F.when(digit & t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX))
        .when(digit & t.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), F.lit(B32))
        .when(digit & one_case & t.rlike("[A-Za-z]"), F.lit(B36))
        .when(t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("^[A-Za-z0-9]+$"), F.lit(B62))
        .when(t.rlike("[a-z]") & t.rlike("[A-Z]"), F.lit(B64))
    )


def _words(x: Column) -> Column:
    """A p-value for the hypothesis that token x.t is made of words.

    In mixed case, words have WORD of their neighbours both in lower case, or more; in one case, neighbours
    change between letter and digit with a rate of CHANGE, or less. Normal tails with continuity, so that longer tokens show more.
    """
    m = F.length(x["t"]) - 1.0
    chars = F.split(x["raw"], "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.struct(a.rlike("[a-z]").alias("a"), b.rlike("[a-z]").alias("b"), (a.rlike("[0-9]") != b.rlike("[0-9]")).alias("c")))
    low = F.size(F.filter(pairs, lambda v: v["a"] & v["b"])) + 0.5
    changes = F.size(F.filter(pairs, lambda v: v["c"])) - 0.5
    z = lambda got, rate: (got - m * rate) / F.sqrt(m * rate * (1 - rate))
    return F.when(x["a"].isin(B62, B64), _normal_tail(-z(low, WORD))).otherwise(_normal_tail(z(changes, CHANGE)))


def _battery(x: Column) -> Column:
    """Smallest of three p-values times three, for the hypothesis that x.t is uniform over x.a.

    Chi-squared over the alphabet (upper tail), runs about its middle and serial
    correlation at lag one (both tails).
    """
    n, size = F.size(x["i"]).cast("double"), F.length(x["a"]).cast("double")
    squares = F.aggregate(F.transform(F.split(x["a"], ""), lambda c: F.length(x["t"]) - F.length(F.replace(x["t"], c))), F.lit(0.0), lambda s, c: s + c * c)
    chi = squares * size / n - n
    chi_z = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    pairs = F.zip_with(F.slice(x["i"], F.lit(1), F.size(x["i"]) - 1), F.slice(x["i"], F.lit(2), F.size(x["i"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.size(F.filter(x["i"], lambda v: v * 2 >= size)).cast("double")
    turns = F.size(F.filter(pairs, lambda v: (v["a"] * 2 >= size) != (v["b"] * 2 >= size))) + 1.0
    m = 2 * high * (n - high) / n
    run_z = F.when(m > 0, F.abs(turns - 1 - m) / F.sqrt(F.greatest(m * (m - 1) / (n - 1), F.lit(1e-9)))).otherwise(F.lit(8.0))
    mid, var = (size - 1) / 2, (size * size - 1) / 12
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + (v["a"] - mid) * (v["b"] - mid))
    serial_z = F.abs(serial) / (var * F.sqrt(n - 1))
    return F.least(F.lit(1.0), 3 * F.least(_normal_tail(chi_z), 2 * _normal_tail(run_z), 2 * _normal_tail(serial_z)))


def random_spans(text: Column, level: float = 0.05, uniform: float = 0.001) -> list[tuple[str, Column]]:
    """Steps (column name, expression) that end in column `random`: the secrets among the tokens.

    Within a text, tokens are tested together: the false discoveries of "not words" are held at
    `level` (step-up procedure). Of those, tokens whose battery's p-value is below `uniform` are no secrets.
    """
    tok = F.filter(F.transform("_c", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("t"))), lambda x: _encoding(x["t"]).isNotNull())
    plain = lambda t, a: F.when(a == HEX, F.lower(t)).when(a.isin(B32, B36), F.upper(t)).otherwise(F.translate(t, "-_", "+/"))
    named = F.transform("_c", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("raw"), plain(x["t"], _encoding(x["t"])).alias("t"), _encoding(x["t"]).alias("a")))
    index = F.transform("_c", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["raw"].alias("raw"), x["t"].alias("t"), x["a"].alias("a"), F.transform(F.split(x["t"], ""), lambda ch: F.position(ch, x["a"]) - 1).alias("i")))
    tested = F.array_sort(F.transform("_c", lambda x: F.struct(_words(x).alias("q"), x["s"].alias("s"), x["e"].alias("e"), _battery(x).alias("p"))))
    found = F.coalesce(F.array_max(F.transform("_c", lambda x, i: F.when(x["q"] <= level * (i + 1) / F.size("_c"), i + 1).otherwise(0))), F.lit(0))
    kept = F.filter(F.slice("_c", F.lit(1), F.col("_k")), lambda x: x["p"] >= uniform)
    left = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), F.lit("random").alias("k"), x["e"].alias("e"), (x["e"] - x["s"]).alias("p")))
    return [("_c", spans(text, "_token")), ("_c", tok), ("_c", named), ("_c", index), ("_c", tested), ("_k", found), ("random", left)]


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns _t (text, empty for null), each kind, `_base` and `_all` (sorted spans)."""
    d = docs.withColumn("_t", F.coalesce(text_col, F.lit("")))
    for k in KINDS:
        d = d.withColumn(f"_{k}", spans(F.col("_t"), k))
    d = d.withColumn("_base", F.array_sort(F.concat(*(f"_{k}" for k in KINDS))))
    for name, step in random_spans(F.col("_t")):
        d = d.withColumn("_random" if name == "random" else name, step)
    new = F.filter("_random", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return d.withColumn("_all", F.array_sort(F.concat("_base", new)))


def _said(col: str) -> Column:
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    d = with_spans(docs.select("doc_id", "text"))
    return d.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_said("_base"), 256).alias("base_sha256"), _said("_all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by mark, touching or overlapping spans by one; n_chars follows."""
    d = with_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        lead = F.when(x["s"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(F.col("_t"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], lead).alias("out"))

    done = F.aggregate("_all", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    hit = F.size("_all") > 0
    new = F.when(hit, done).otherwise(F.col("text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return d.select(*(v.alias(c) for c, v in out.items()))
