"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 16 bits of each of its minima, WIDTH minima a chunk. With c chunks, two signatures
that differ in at most 2c - 1 values have a chunk that differs in at most one (pigeonhole). The
allowed chunk error is enumerated: each chunk gives WIDTH keys, one for each value left out. So all
pairs within that distance meet under a key. `chunks` picks c so that a pair at the threshold is
beyond the distance with a probability of at most MISS. Candidates are confirmed on whole sets.

Equal sets are one node before the join. Only signatures and keys travel: the sets are built again
from the texts of nodes that share a key, for candidates alone.

Under a key every class first meets only the key's leader; classes linked so far are joined, and
new leaders are drawn. What is still apart under a key after ROUNDS meets in full, in blocks, so no
link between signatures within the distance is lost. Each set also has a parity sketch of
PARITY * 64 bits, of which every member flips one. Bits that differ between two sketches are at
most the members that differ, so sketches rule out many pairs below the threshold and none above it.
"""
from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import Words, clear, components, cut, mix, shingles, slices, words_of

WIDTH = 4
MISS = 1e-5
PARITY = 8
ROUNDS = 2  # rounds of leaders before classes under a key meet in full
BLOCK = 1000  # nodes of a key in a block of the full meeting
GROUP = 400_000  # shingles that meet one leader in a task, about


def chunks(percent: int) -> int:
    """Chunks of a signature for a threshold."""
    p = 1 - percent / 100
    for c in range(4, 65):
        n = c * WIDTH
        if sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * c, n + 1)) <= MISS:
            return c
    raise ValueError("the threshold is too low for this join")


def signatures(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """A row for each set of values from one start to the next: low 16 bits of its minima under each seed."""
    seeds = np.random.default_rng(7).integers(1, 1 << 62, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), count), np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(seeds):
            x = values * seed
            x ^= x >> np.uint64(29)
            out[:, i] = np.minimum.reduceat(x, starts)
        return mix(out) & np.uint64(0xFFFF)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """A key of each row for each value: its chunk with that value left out."""
    out = np.empty(sig.shape, np.uint64)
    with np.errstate(over="ignore"):
        for slot in range(sig.shape[1]):
            h = np.full(len(sig), np.uint64(slot + 1))
            first = slot - slot % WIDTH
            for i in range(first, first + WIDTH):
                if i != slot:
                    h = mix((h << np.uint64(16)) ^ sig[:, i] ^ (h >> np.uint64(40)))
            out[:, slot] = h
    return out


def parity(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parity sketch of each set, in PARITY longs."""
    bit = np.uint64(1) << (values & np.uint64(63))
    lane = (values >> np.uint64(6)) % np.uint64(PARITY)
    return np.stack([np.bitwise_xor.reduceat(np.where(lane == np.uint64(i), bit, np.uint64(0)), starts) for i in range(PARITY)], 1)


def _digest(g: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(g.tobytes())


def _lists(x: np.ndarray, full: np.ndarray) -> pa.Array:
    """Rows of x as lists of longs, those of sets that are empty as nulls."""
    ends = np.concatenate([[0], np.cumsum(full)]).astype(np.int32) * x.shape[1]
    mask = pa.array(np.concatenate([~full, [False]]))
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.asarray(mask)), pa.array(x.reshape(-1).view(np.int64)))


def sketches(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, par, keys) of every row; a text without words has no par and keys."""
    count = chunks(percent) * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for b in batches:
            for part, texts in slices(b, 1):
                got = [np.unique(shingles(hashes(words_of(t)), words)) for t in texts]
                n = np.array([len(g) for g in got])
                full = n > 0
                values = np.concatenate(got)
                starts = (np.cumsum(n) - n)[full]
                sig = signatures(values, starts, count) if full.any() else np.empty((0, count), np.uint64)
                par = parity(values, starts) if full.any() else np.empty((0, PARITY), np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([_digest(g) for g in got], pa.binary()), _lists(par, full), _lists(keys_of(sig), full)], ["id", "n", "digest", "par", "keys"])

    d = docs.select(F.col(id_col), F.col(text_col))
    return d.mapInArrow(run, f"id {d.schema[0].dataType.simpleString()}, n long, digest binary, par array<long>, keys array<long>")


def _possible(na, nb, pa, pb, percent: int):
    """Whether sizes and parity sketches allow the similarity: common members are at most half of
    na + nb less the bits that differ."""
    differ = reduce(add, (F.bit_count(pa[i].bitwiseXOR(pb[i])) for i in range(PARITY)))
    return (F.least(na, nb) * 100 >= percent * F.greatest(na, nb)) & ((na + nb - differ) * (100 + percent) >= 2 * percent * (na + nb))


def _first_shared(slot, ka, kb):
    """Whether slot is the first in which the two lists of keys agree."""
    return F.array_position(F.zip_with(ka, kb, lambda a, b: a == b), True) == slot + 1


def _body(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of each of nodes (node, id, digest), from a row of docs with its id and set."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for b in batches:
            for part, texts in slices(b, 1):
                fits = [d == _digest(np.unique(shingles(hashes(words_of(t)), words))) for d, t in zip(part.column(2).to_pylist(), texts)]
                yield part.filter(pa.array(fits, pa.bool_())).select(["node", "text"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    twice = d.groupBy("id").count().where("count > 1")
    # rows that share their id with another have to show which set they hold, and one of equals stays
    j = d.join(nodes.join(twice, "id", "left_anti"), "id").select("node", "text")
    more = nodes.join(twice, "id", "left_semi")
    if not more.isEmpty():
        m = d.join(more, "id").select("node", "text", "digest").mapInArrow(same, "node long, text string")
        j = j.unionByName(m.dropDuplicates(["node"]))
    return j


def _linked(pairs: DataFrame, size: DataFrame, body: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough.

    The partners of one a are dealt to groups of about GROUP shingles, and a's text goes to each."""

    def meet(t: pa.Table) -> pa.Table:
        hashes = Words()
        node, first = t["node"].to_numpy(), t["first"].to_numpy(zero_copy_only=False)
        got = [np.unique(shingles(hashes(words_of(x)), words)) for x in t["text"].to_pylist()]
        a = int(np.flatnonzero(first)[0])
        out = []
        for k in np.flatnonzero(~first):
            both = len(np.intersect1d(got[a], got[k], assume_unique=True))
            if 100 * both >= percent * (len(got[a]) + len(got[k]) - both):
                out.append(node[k])
        return pa.table({"a": pa.array(np.full(len(out), node[a]), pa.int64()), "b": pa.array(out, pa.int64())})

    many = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("many"))
    p = pairs.join(many.toDF("a", "ma"), "a").join(many.toDF("b", "mb"), "b")
    lead = F.col("ma") >= F.col("mb")  # the side with more partners is sent once a group, the other once a pair
    p = p.select(F.when(lead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(lead, F.col("b")).otherwise(F.col("a")).alias("b"))
    p = p.join(size.toDF("b", "n"), "b")
    deal = p.groupBy("a").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("groups"))
    p = p.join(deal, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"))
    want = p.select("a", "g", F.col("b").alias("node"), F.lit(False).alias("first")).union(p.select("a", "g", "a", F.lit(True)).distinct())
    return want.join(body, "node").groupBy("a", "g").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept of every row.

    Links rows with 100 * intersection >= percent * union of their shingle sets. Null and empty
    texts have no shingles and link with nothing. Rows of one id but different texts link only as
    their texts do; a null id links with nothing and is its own, null, component. Other columns are
    not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held: list[str] = []  # tables of this call, deleted at its end
    fat: list[str] = []
    every = cut(sketches(docs, words, percent, id_col, text_col), fat)
    rows = cut(every.select("id", "n", "digest"))
    reps = every.where("keys is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("par").alias("par"), F.first("keys").alias("keys"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()), held)
    clear(spark, fat)
    keys = reps.select("node", F.posexplode("keys").alias("slot", "key"))
    keys = cut(keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"), held)
    met = keys.select("node").distinct()
    body = cut(_body(docs, reps.join(met, "node", "left_semi").select("node", "id", "digest"), words, id_col, text_col), held)
    size = reps.select("node", "n")
    sketch = reps.select("node", "n", "par")

    def allowed(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that sizes and sketches do not rule out."""
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(sketch.toDF("a", "na", "pa"), "a").join(sketch.toDF("b", "nb", "pb"), "b")
        return p.where(_possible(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), percent)).select("a", "b")

    seen: list[DataFrame] = []
    links = label = None
    for r in range(ROUNDS + 1):
        k = keys
        if label is not None:
            k = k.join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            apart = k.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
            k = cut(k.join(apart, "key", "left_semi"), held)
            if k.isEmpty():
                break
        else:
            k = k.withColumn("label", F.col("node"))
        if r < ROUNDS:
            # the middle of a group of copies meets the most others
            crowd = k.groupBy("key").agg(F.count("*").alias("crowd"))
            weight = k.join(crowd, "key").groupBy("node").agg(F.sum("crowd").alias("weight"))
            lead = k.join(weight, "node").groupBy("key").agg(F.max_by(F.struct("node", "label"), F.struct("weight", F.xxhash64(F.lit(r), "node"))).alias("l"))
            pairs = k.join(lead, "key").where("label <> l.label").select(F.col("l.node").alias("a"), F.col("node").alias("b"))
            pairs = allowed(pairs)
        else:
            # a pair counts under its first shared key only
            k = k.join(k.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "key")
            k = k.join(reps.select("node", "n", "par", "keys"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            k = k.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            x, y, c = k.alias("x"), k.alias("y"), F.col
            both = (c("x.key") == c("y.key")) & (c("x.own") == c("y.other")) & (c("x.other") == c("y.own")) & (c("x.node") < c("y.node")) & (c("x.label") != c("y.label"))
            both &= _possible(c("x.n"), c("y.n"), c("x.par"), c("y.par"), percent) & _first_shared(c("x.slot"), c("x.keys"), c("y.keys"))
            pairs = x.join(y, both).select(c("x.node").alias("a"), c("y.node").alias("b"))
        for old in seen:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = cut(pairs, held)
        seen.append(pairs)
        if r and pairs.isEmpty():
            continue
        found = cut(_linked(pairs, size, body, words, percent), held)
        links = found if links is None else links.union(found)
        label = components(links, held)
    member = reps.select("digest", "id", "node")
    if label is not None:
        member = member.join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        member = member.withColumn("label", F.col("node"))
    least = member.groupBy("label").agg(F.min("id").alias("component"))
    member = cut(member.join(least, "label").select("digest", "component"))
    clear(spark, held)
    full = rows.join(member, "digest", "left")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    full = full.withColumn("component", own)
    return full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group: its smallest doc_id, of repeated rows of
    that id one. Rows without words are no copies and all stay; so do rows of a null id. Where rows
    of one id have different texts, those of the id that stands for a group stay."""
    kept = near_duplicates(docs, words, percent).where("kept and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") | F.col("doc_id").isNull()
    live = docs.where(~bare).join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    twice = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    again = live["doc_id"] == twice["_twice"]
    return docs.where(bare).unionByName(live.join(twice, again, "left_anti")).unionByName(live.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))
