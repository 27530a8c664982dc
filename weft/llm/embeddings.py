"""Near-duplicate embeddings: int8 tile products with error bounds, exact where they may matter.

Equal vectors are one node of some weight. Nodes meet in buckets of random-hyperplane tables; the
number of bits follows log2 of the number of nodes, the number of tables follows from it, so that
a pair at the threshold is missed with a probability of at most MISS. Buckets are split into blocks
and every two blocks of a bucket form a tile. In a tile, vectors x = s*q + r (q int8) have
|x.y - s_x s_y q_x.q_y| <= |r_x| + |r_y| (1 + |r_x|) for unit x and y; only pairs that this bound
does not rule out are computed in double precision. A pair counts in its first shared table only.
"""
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import components, cut

MISS = 1e-4
BLOCK = 1500  # nodes of a bucket in a block


def plan(count: int, least: float) -> tuple[int, int]:
    """Bits and tables."""
    bits = min(60, max(8, math.ceil(math.log2(max(count, 2))) - 8))
    p = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-p))


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number of each row of x in each table."""
    planes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], bits * tables))
    b = (x @ planes > 0).reshape(len(x), tables, bits)
    return (b * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    # a little above the norm of the residual, for rounding here and in products
    return q, s, np.sqrt(((x - s[:, None] * q) ** 2).sum(1)) + 1e-6


def near_embeddings(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of a null id,
    link with nothing; neither do vectors of different lengths. Rows of one id are rows of their
    own: each counts the others it links with.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    good = F.exists("x", lambda c: c != 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    every = cut(v.withColumn("x", F.when(F.col("id").isNotNull() & good, F.transform("x", lambda c: c + 0.0))).withColumn("h", F.when(F.col("x").isNotNull(), F.sha2(F.concat_ws(",", F.transform("x", lambda c: c.cast("string"))), 256))))
    kind = every.schema["id"].dataType.simpleString()
    nodes = cut(every.where("h is not null").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.any_value("x").alias("x")).withColumn("node", F.monotonically_increasing_id()))
    bits, tables = plan(nodes.count(), least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            size = np.array([len(r) for r in rows])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                raw = [np.array(rows[i], np.float64).tobytes() for i in at]
                c = _codes(_unit(raw), bits, tables)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r for r in raw], pa.binary()), pa.array(c.tolist(), pa.list_(pa.int64()))], ["node", "m", "raw", "codes"])

    coded = cut(nodes.select("node", "x", "m").mapInArrow(hashed, "node long, m long, raw binary, codes array<long>"))
    seat = coded.select("node", F.length("raw").alias("n"), F.posexplode("codes").alias("t", "code"))
    big = seat.groupBy("n", "t", "code").count().where("count > 1")
    # rows of a bucket are dealt to blocks by node; a block meets itself and every other one
    seat = seat.join(big, ["n", "t", "code"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    seat = seat.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    seat = seat.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("n", "t", "code", F.least("own", "other"), F.greatest("own", "other"))
    seat = seat.select("node", tile.alias("tile"), "t", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    met = seat.join(coded, "node")

    def meet(table: pa.Table) -> pa.Table:
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        codes = np.array(table["codes"].to_pylist())
        m = table["m"].to_numpy()
        x = _unit(table["raw"].to_pylist())
        q, s, r = _quantised(x)
        q = q.astype(np.float32)  # sums of int8 products below 2**24 are exact for up to 1040 components; beyond, slack has their rounding
        t = int(table["t"][0].as_py())
        same = side[0] == 2
        left, right = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links = np.zeros(len(node), np.int64)
        up = np.arange(len(node))

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for k in range(0, len(left), 256):
            i = left[k : k + 256]
            about = (q[i] @ q[right].T).astype(np.float64) * s[i, None] * s[right]
            slack = r[i, None] + r[right] * (1 + r[i, None]) + 1.1 * q.shape[1] * 2.0**-24 * (q.shape[1] > 1040)
            a, b = np.nonzero(about + slack >= least)
            a, b = i[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            for z in range(0, len(a), 20000):
                c, d = a[z : z + 20000], b[z : z + 20000]
                hit = (x[c] * x[d]).sum(1) >= least
                c, d = c[hit], d[hit]
                if t:
                    new = ~(codes[c, :t] == codes[d, :t]).any(1)
                    c, d = c[new], d[new]
                np.add.at(links, c, m[d])
                np.add.at(links, d, m[c])
                for e, f in zip(c.tolist(), d.tolist()):
                    e, f = top(e), top(f)
                    if e != f:
                        up[f] = e
        on = np.flatnonzero(links)
        return pa.table({"node": node[on], "links": links[on], "root": node[[top(i) for i in on]] if len(on) else node[:0]})

    found = cut(met.groupBy("tile").applyInArrow(meet, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    n = nodes.select("node", "h", "id", "m").join(links, "node", "left").join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    n = n.join(n.groupBy("label").agg(F.min("id").alias("least")), "label").select("h", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = every.select("id", "h").join(n, "h", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").cast(kind).alias("component_id"), F.col("id").eqNullSafe(F.coalesce("least", "id")).alias("kept"))
