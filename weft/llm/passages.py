"""Repeated passages by compact windows of min-hashes.

Tokens are hashes of five-word runs. Under a hash, the Cartesian tree of a text's tokens gives for
each node its widest window: all subsequences of the window that hold the node, and start after the
last equal token before it, have the node's token as their minimum. Windows with room for a passage
are kept for each of HASHES hashes; two passages of similarity s meet under one hash with
probability s, and repeated ones under all.

Windows of one key (hash and token) are joined on their intervals: cut to the places they can share
about their nodes, and confirmed by similarity on the tokens themselves.

Of two passages of similarity s the shorter one shares 2s / (1 + s) of its distinct tokens. So each
window has a sketch, BITS bits set by the tokens fewer than `least` places from its node, and two
windows are compared only if their sketches have as many bits in common as a passage of `least`
tokens about the node leaves but for collisions (MISS).

Under a key every window first meets only the key's leader. Confirmed texts form classes, and
windows whose node lies in a confirmed passage are settled. Then windows under a key that are
unsettled, or of different classes, meet in full, in blocks of BLOCK windows: those of which others
have enough tokens are compared by a matrix product over the tokens that repeat in the block; where
`least` consecutive ones about a node are shared, the similarity is computed on the spot, once for
windows of the same tokens. Only pairs that hold, and settle a window or join classes that the block
has not joined yet, leave the block: none is lost, and no group of pairs is written out. Where keys
of many blocks would send the windows more than SENT times, their blocks meet in rounds of bounded
size, and what one round settles or joins is known to the next.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import clear, components, cut, mix

HASHES = 4
GAP = 12  # tokens without a partner that end a passage
BLOCK = 1000
SENT = 3  # windows sent to blocks in one job, for each window there is; beyond that they meet in rounds
GROUP = 400_000  # tokens that meet one text in a task, about
BITS = 512
MISS = 1e-5  # share of pairs at the bound that collisions of bits may hide
SEEDS = np.random.default_rng(11).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1_000_000  # bytes of the texts that are hashed at once; a longer text is alone
SMALL = "zstd"  # codec of the large tables
PART = 1 << 18  # longest word, in bytes, that is hashed by its letters
BASE, AFTER = 0x5851F42D4C957F2D, np.uint64(0xD1342543DE82EF95)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
LETTERS[65:91] = LETTERS[97:123]
LETTERS[WHITE] = 0
POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PART - 1, BASE, np.uint64)])
INVERSES = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PART - 1, pow(BASE, -1, 1 << 64), np.uint64)])


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word of raw, A-Z lowered; the words begin at starts.

    The sum of each letter's number times a power of BASE by its place in the word."""
    out = np.empty(len(starts), np.uint64)
    ends = np.r_[starts[1:], len(raw)]
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + PART, "right"))
        if j > i:
            part, at = raw[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
            out[i:j] = np.add.reduceat(LETTERS.take(part) * POWERS[: len(part)], at) * INVERSES.take(at)
        else:  # a very long word, or white space
            j, word = i + 1, raw[starts[i] : ends[i]].tobytes().split()[0].lower()
            if len(word) <= PART:
                out[i] = (LETTERS.take(np.frombuffer(word, np.uint8)) * POWERS[: len(word)]).sum(dtype=np.uint64)
            else:
                import xxhash

                out[i] = xxhash.xxh3_64_intdigest(word)
        i = j
    return out


def tokens_of(texts: pa.Array, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, tokens, starts) of slices of texts: the tokens of texts from to to (exclusive), end to end.

    A text's tokens begin at its place in starts (one more for the end), one a word; the last
    run - 1 of them reach into the next text and are none of it."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1) if run > 1 else a + 1
        raw, edge = data[off[a] : off[b]], off[a : b + 1] - off[a]
        inside = ~WHITE.take(raw)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        head = edge[:-1][edge[:-1] < len(raw)]
        first[head] = inside[head]
        at = np.flatnonzero(first)
        starts = np.searchsorted(at, edge)
        h = word_hashes(raw, at)
        s = np.r_[h, np.zeros(run - 1, np.uint64)] if run > 1 else h
        out = s[: len(h)]
        for i in range(1, run):
            out = out * AFTER + s[i : len(h) + i]
        yield a, b, mix(out), starts
        a = b


def sliding(v: np.ndarray, width: int, best: np.ufunc = np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each `width` consecutive places."""
    m, w = v, 1
    while 2 * w <= width:
        m, w = best(m[:-w], m[w:]), 2 * w
    return best(m[: len(v) - width + 1], m[width - w : width - w + len(v) - width + 1])


def windows(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, node, right) of the Cartesian tree's nodes whose windows have at least `least` places.

    Of equal tokens the first is the minimum. Such a node is a minimum of some `least` consecutive
    places, and so is the node that ends its window on either side.
    """
    none = np.empty(0, np.int64)
    if len(v) < least:
        return none, none, none
    # a place is a minimum of some places about it if the largest of their minima is its own
    edge = np.zeros(least - 1, v.dtype)
    c = np.flatnonzero(sliding(np.concatenate([edge, sliding(v, least), edge]), least, np.maximum) == v)
    vals, at = v[c].tolist(), c.tolist()
    lo, hi, stack = [0] * len(at), [len(v) - 1] * len(at), []
    for i, x in enumerate(vals):
        while stack and vals[stack[-1]] > x:
            hi[stack.pop()] = at[i] - 1
        lo[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
    wide = hi - lo + 1 >= least
    return lo[wide], c[wide], hi[wide]


def keyed(s: np.ndarray, least: int) -> np.ndarray:
    """Rows of key, left, node, right of a text's windows.

    Of windows of one key that overlap the widest stays."""
    return keyed_all(s, np.array([0, len(s)]), least, 1)[0][:, 1:]


def keyed_all(s: np.ndarray, starts: np.ndarray, least: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of text, key, left, node, right of the windows of the texts of `tokens_of`, by text; which texts have two of a key under the first hash.

    Places are the text's own. Between texts stand places smaller than any token."""
    gap = np.zeros(len(s), bool)
    for i in range(1, run):
        gap[np.maximum(starts[1:] - i, starts[:-1])[starts[1:] > starts[:-1]]] = True
    out, twice = [], np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            v = (s * SEEDS[i]) | np.uint64(1)
            v[gap] = 0
            lo, c, hi = windows(v, least)
            real = ~gap[c]
            lo, c, hi = lo[real], c[real], hi[real]
            text = np.searchsorted(starts, c, "right") - 1
            key = mix(s[c] ^ (SEEDS[i] >> np.uint64(1)))
            own = mix(key ^ (text.astype(np.uint64) * SEEDS[i]))  # the key within its text
            near = np.sort(own)
            again = near[1:][near[1:] == near[:-1]]
            if len(again):
                alone = ~np.isin(own, again)
                keep, last = np.flatnonzero(alone).tolist(), []
                rest = np.flatnonzero(~alone)
                if i == 0:
                    twice = np.unique(text[rest])
                for k in rest[np.lexsort((lo[rest], (lo - hi)[rest], own[rest]))].tolist():
                    if not last or own[last[-1]] != own[k]:
                        last = [k]
                    elif all(hi[j] < lo[k] or lo[j] > hi[k] for j in last):
                        last.append(k)
                    else:
                        continue
                    keep.append(k)
                keep = np.array(keep, np.int64)
                text, lo, c, hi, key = text[keep], lo[keep], c[keep], hi[keep], key[keep]
            at = starts[text]
            out.append(np.stack([text, key.view(np.int64), lo - at, c - at, hi - at], 1))
    out = np.concatenate(out)
    return out[np.argsort(out[:, 0], kind="stable")], twice


def slack(n: int) -> int:
    """Bits that collisions among n tokens take away, but with a probability of at most MISS (Poisson)."""
    mean = n * (n - 1) / (2 * BITS)
    k, term, rest = 0, np.exp(-mean), 1.0
    while rest - term > MISS:
        rest, k = rest - term, k + 1
        term *= mean / k
    return k


def sketches(s: np.ndarray, lo: np.ndarray, c: np.ndarray, hi: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(need, bits) of windows of tokens s: the distinct tokens that a passage about the node shares, at least, and the sketch."""
    need, bits = np.empty(len(c), np.int32), np.empty((len(c), BITS // 64), np.int64)
    for z in range(0, len(c), 4000):
        k = slice(z, z + 4000)
        left, right = np.maximum(lo[k], c[k] - least + 1), np.minimum(hi[k], c[k] + least - 1)
        at = left[:, None] + np.arange(2 * least - 1)
        pad = (at > right[:, None]).sum(1)
        tok = s[np.minimum(at, right[:, None])]
        on = np.zeros((len(tok), BITS), np.uint8)
        on[np.arange(len(tok))[:, None], (tok % np.uint64(BITS)).astype(np.int64)] = 1
        bits[k] = np.packbits(on, axis=1).view(np.int64)
        tok.sort(axis=1)
        again = (tok[:, 1:] == tok[:, :-1]).sum(1) - pad
        need[k] = np.ceil(np.maximum(least - again, 1) * 2 * percent / (100 + percent) - 1e-9)
    return need, bits


def own_repeats(s: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(from, to) of the runs of at least `least` tokens that occur again, word for word, further on, and of those occurrences."""
    order = np.argsort(s, kind="stable")
    same = np.flatnonzero(s[order][1:] == s[order][:-1])
    first, again = order[same], order[same + 1]
    k = np.argsort(first)
    first, far = first[k], (again - first)[k]
    out = []
    if len(first):
        ends = np.flatnonzero((np.diff(first) != 1) | (np.diff(far) != 0))
        for a, b in zip(np.r_[0, ends + 1], np.r_[ends, len(first) - 1]):
            if b - a + 1 >= least:
                f, t, d = int(first[a]), int(first[b]), int(far[a])
                out += [(f, t), (f + d, t + d)]
    return out


def pieces(at: np.ndarray, least: int, few: int) -> list[np.ndarray]:
    """The parts of at between gaps of more than GAP that span `least` places and hold at least few."""
    cuts = ((at[1:] - at[:-1]) > GAP).nonzero()[0]
    if not len(cuts):
        return [at] if len(at) >= few and at[-1] - at[0] + 1 >= least else []
    out, start = [], 0
    for end in (cuts + 1).tolist() + [len(at)]:
        if end - start >= few and at[end - 1] - at[start] + 1 >= least:
            out.append(at[start:end])
        start = end
    return out


def narrower(piece: np.ndarray, q: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """A piece and its partner, cut at the widest gap of the first that has one."""
    f, t, g, u = int(piece[0]), int(piece[-1]), int(q[0]), int(q[-1])
    gap = piece[1:] - piece[:-1]
    if len(gap) and gap.max() > 1:
        k = int(gap.argmax())
        return [(lo, hi, g, u + 1) for lo, hi in ((f, int(piece[k]) + 1), (int(piece[k + 1]), t + 1)) if hi - lo >= least]
    gap = q[1:] - q[:-1]
    if len(gap) and gap.max() > 1:
        k = int(gap.argmax())
        return [(f, t + 1, lo, hi) for lo, hi in ((g, int(q[k]) + 1), (int(q[k + 1]), u + 1)) if hi - lo >= least]
    return []


def aligned(partner: np.ndarray, a0: int, a1: int, b0: int, b1: int, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """`common` of the places a0 to a1 and b0 to b1 (exclusive) of texts where no token repeats; partner is the place in b of each place of a, or -1."""
    few = -(-least * percent // 100)  # tokens that a passage shares, at least
    out, todo = [], [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        there = partner[a0:a1]
        on = ((there >= b0) & (there < b1)).nonzero()[0] + a0
        if len(on) < few:
            continue
        for piece in pieces(on, least, few):
            for q in pieces(np.sort(partner[piece]), least, few):
                f, t, g, u = int(piece[0]), int(piece[-1]), int(q[0]), int(q[-1])
                if 100 * len(q) >= percent * (t - f + 1 + u - g + 1 - len(q)):
                    out.append((f, t, g, u))
                else:
                    todo += narrower(piece, q, least)
    return out


def common(a: np.ndarray, b: np.ndarray, least: int, percent: int, codes: int = 0) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of passages that a and b share, ends included.

    Places with a partner form pieces between gaps of more than GAP; a piece and its partner that
    are not similar enough are tried again without what lies beyond their widest gaps. Tokens may be
    given as numbers below codes."""
    if not codes:
        known, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, codes = number[: len(a)], number[len(a) :], len(known)
    place = np.empty(codes, np.int64)  # read only where it was written just before
    has = np.zeros(codes, bool)

    def lasts(x):
        """The places of x whose token does not occur further on."""
        r = np.arange(len(x))
        place[x] = r
        return place[x] == r

    def within(x, y):
        """The places of x whose token y has."""
        has[y] = True
        on = has[x].nonzero()[0]
        has[y] = False
        return on

    if lasts(a).all() and lasts(b).all():
        place[a] = -1
        place[b] = np.arange(len(b))
        return aligned(place[a], 0, len(a), 0, len(b), least, percent)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        on = within(a[a0:a1], b[b0:b1]) + a0
        for piece in pieces(on, least, 0) if len(on) else []:
            x = a[piece[0] : piece[-1] + 1]
            n = np.count_nonzero(lasts(x))
            for q in pieces(within(b[b0:b1], x) + b0, least, 0):
                y = b[q[0] : q[-1] + 1]
                uy = y[lasts(y)]
                both = len(within(uy, x))
                if 100 * both >= percent * (n + len(uy) - both):
                    out.append((int(piece[0]), int(piece[-1]), int(q[0]), int(q[-1])))
                else:
                    todo += narrower(piece, q, least)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) by start, touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def confirmed(pairs: DataFrame, body: DataFrame, least: int, run: int, percent: int) -> DataFrame:
    """(node, other, start, end): passages, as words, that pairs (a, b, la, ca, ha, lb, cb, hb) of windows share.

    The windows are cut to what lies about their nodes in both, with a quarter and 16 tokens more. A
    pair of windows without `least` consecutive tokens of which the other text has enough is not
    compared, unless tokens repeat there.
    The partners of one text are dealt to groups of about GROUP tokens; its tokens go to each."""
    enough = int(np.ceil(least * 2 * percent / (100 + percent) - 1e-9))
    more = lambda x: (x * 1.25 + 16).cast("int")
    near, far = F.least(F.col("ca") - F.col("la"), F.col("cb") - F.col("lb")), F.least(F.col("ha") - F.col("ca"), F.col("hb") - F.col("cb"))
    p = pairs.withColumn("near", more(near)).withColumn("far", more(far))
    for x in "ab":
        p = p.withColumn(f"l{x}", F.greatest(f"l{x}", F.col(f"c{x}") - F.col("near"))).withColumn(f"h{x}", F.least(f"h{x}", F.col(f"c{x}") + F.col("far")))
    quad = F.struct("la", "ca", "ha", "lb", "cb", "hb")
    p = p.groupBy("a", "b").agg(F.collect_set(quad).alias("w"), F.sum(F.col("hb") - F.col("lb") + 1).alias("n"))
    deal = p.groupBy("a").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("groups"))
    p = p.join(deal, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    kind = "array<struct<la:int,ca:int,ha:int,lb:int,cb:int,hb:int>>"
    side = p.select("a", "g", F.col("b").alias("node"), F.col("w").cast(kind).alias("w"))
    lead = p.select("a", "g", F.explode("w").alias("w")).groupBy("a", "g").agg(F.collect_set(F.struct("w.la", "w.ha")).alias("w"))
    zero = F.lit(0)
    lead = lead.select("a", "g", F.col("a").alias("node"), F.transform("w", lambda x: F.struct(x["la"].alias("la"), zero.alias("ca"), x["ha"].alias("ha"), zero.alias("lb"), zero.alias("cb"), zero.alias("hb"))).cast(kind).alias("w"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = 1 << 40  # more than any place
        for b in batches:
            for x0, x1, s, starts in tokens_of(b.column(4), run):
                part = b.slice(x0, x1 - x0)
                w = part.column(3)
                row = np.repeat(np.arange(len(part)), np.diff(w.offsets.to_numpy()))
                lead, w = (part.column(0).to_numpy() == part.column(2).to_numpy())[row], w.flatten()
                lo, hi = (np.where(lead, w.field(x).to_numpy(), w.field(y).to_numpy()) + row * apart for x, y in (("la", "lb"), ("ha", "hb")))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + 1)
                new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
                row, lo = np.divmod(lo[new], apart)
                size = end[np.r_[new[1:] - 1, len(end) - 1]] - row * apart - lo
                first = np.cumsum(size) - size
                tok = s.view(np.int64)[np.repeat(starts[row] + lo - first, size) + np.arange(size.sum())]
                spans = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                far = np.r_[first, size.sum()][spans].astype(np.int32)
                lists = [pa.ListArray.from_arrays(spans, pa.array(lo.astype(np.int32))), pa.ListArray.from_arrays(spans, pa.array(size.astype(np.int32))), pa.ListArray.from_arrays(far, pa.array(tok))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *lists], ["a", "g", "node", "w", "at", "size", "tok"])

    def meet(t: pa.Table) -> pa.Table:
        a, node = t["a"][0].as_py(), t["node"].to_numpy()
        at, size, w, tok = (t[x].combine_chunks() for x in ("at", "size", "w", "tok"))
        at, size, tok = ([x[i:j] for i, j in zip(v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:])] for v in (at, size, tok) for x in (v.values.to_numpy(),))
        ends = w.offsets.to_numpy()
        quads = np.stack([w.values.field(x).to_numpy() for x in ("la", "ca", "ha", "lb", "cb", "hb")], 1).astype(np.int64)

        def index(k, place):
            """Where places of the text lie in its tokens at hand."""
            i = np.searchsorted(at[k], place, "right") - 1
            return (np.cumsum(size[k]) - size[k])[i] + place - at[k][i]

        def dense(on, lo, n):
            """Whether `least` consecutive ones of the n places from lo hold enough that are on."""
            sums = np.cumsum(np.r_[0, on])
            held = np.cumsum(np.r_[0, sums[least:] - sums[:-least] >= enough])
            return (n >= least) & (held[np.clip(lo + n - least + 1, 0, len(held) - 1)] > held[np.minimum(lo, len(held) - 1)])

        first = int(np.flatnonzero(node == a)[0])
        ours = tok[first]
        order = np.argsort(ours)
        known = ours[order]
        single = not (known[1:] == known[:-1]).any()
        rows = []
        for k, b in enumerate(node.tolist()):
            if k == first:
                continue
            theirs, q = tok[k], quads[ends[k] : ends[k + 1]]
            q = q[np.lexsort((q[:, 4], q[:, 1], q[:, 0] - q[:, 2]))]
            f, g, m, n = index(first, q[:, 0]), index(k, q[:, 3]), q[:, 2] - q[:, 0] + 1, q[:, 5] - q[:, 3] + 1
            there = np.sort(theirs)
            plain = single and not (there[1:] == there[:-1]).any()  # no token repeats
            if plain:
                i = np.minimum(np.searchsorted(known, theirs), len(known) - 1)
                on = known[i] == theirs
                partner = np.full(len(ours), -1)
                partner[order[i[on]]] = np.flatnonzero(on)
                kept = dense(partner >= 0, f, m) & dense(on, g, n)
                q, f, g, m, n = q[kept], f[kept], g[kept], m[kept], n[kept]
            found: list[tuple[int, int, int, int]] = []
            for (la, ca, _, lb, cb, _), i, j, x, y in zip(q.tolist(), f.tolist(), g.tolist(), m.tolist(), n.tolist()):
                if any(r <= ca <= e and z <= cb <= u for r, e, z, u in found):
                    continue
                if plain:
                    found += [(r + la - i, e + la - i, z + lb - j, u + lb - j) for r, e, z, u in aligned(partner, i, i + x, j, j + y, least, percent)]
                else:
                    found += [(r + la, e + la, z + lb, u + lb) for r, e, z, u in common(ours[i : i + x], theirs[j : j + y], least, percent)]
            for f, e, g, u in set(found):
                rows += [(a, b, f, e + run), (b, a, g, u + run)]
        cols = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(x, pa.int64()) for x in cols], ["node", "other", "start", "end"])

    asked = side.union(lead).join(body, "node").select("a", "g", "node", "w", "text")
    cells = asked.mapInArrow(cut_out, f"a long, g int, node long, w {kind}, at array<int>, size array<int>, tok array<long>")
    return cells.groupBy("a", "g").applyInArrow(meet, "node long, other long, start long, end long")


def repeated_passages(docs: DataFrame, words: int = 50, run: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_passages, spans, component_id of every row.

    spans are the row's passages of at least `words` words found in another text too, or again, word
    for word, in the same text; as word numbers start:end (end exclusive, overlapping ones as one),
    comma-joined. component_id is the smallest id reachable over shared passages. Texts of different
    ids that are equal, and long enough, are a passage as a whole. Null, empty and shorter texts have
    none. Rows equal in id and text are one text, so they do not repeat each other; a null id takes
    part, and sorts last. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held: list[str] = []
    early: list[str] = []
    least = words - run + 1
    kind = "array<struct<start:bigint,end:bigint>>"

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, s, starts in tokens_of(b.column(1), run):
                n = np.diff(starts)
                cells, twice = keyed_all(s, starts, least, run)
                repeats = [[]] * (y - x)
                for k in twice.tolist():
                    own = own_repeats(s[starts[k] : starts[k + 1] - run + 1], least)
                    repeats[k] = [{"start": p, "end": q} for p, q in merged([(p, q + run) for p, q in own])]
                ends = pa.array(np.searchsorted(cells[:, 0], np.arange(y - x + 1)).astype(np.int32))
                cols = [pa.array(cells[:, 1]), *(pa.array(cells[:, i].astype(np.int32)) for i in (2, 3, 4))]
                wins = pa.StructArray.from_arrays(cols, ["key", "lo", "c", "hi"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(n, pa.int64()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.ListArray.from_arrays(ends, wins)], ["node", "n", "own", "wins"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("digest"))
    named = cut(d.select("id", "digest"))
    reps = named.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("ids"), F.count("*").alias("rows"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()), held)
    one = d.join(reps.select("digest", F.col("id").alias("rep"), "node", "rows", "ids"), "digest").where("id <=> rep")
    # of rows equal in id and text one is read; only those can repeat
    text = one.where("rows = ids").select("node", "text")
    if not reps.where("rows > ids").isEmpty():
        text = text.unionByName(one.where("rows > ids").select("node", "text").dropDuplicates(["node"]))
    text = cut(text, held, SMALL)
    every = cut(text.mapInArrow(marked, f"node long, n long, own {kind}, wins array<struct<key:bigint,lo:int,c:int,hi:int>>"), early, SMALL)
    # a key's leader has the largest rank
    rank = F.xxhash64(F.lit(0), "node").bitwiseAND(F.lit(~0xFFFFF)).bitwiseOR(F.col("c").cast("long").bitwiseAND(F.lit(0xFFFFF)))
    wins = every.select("node", F.inline("wins"))
    many = wins.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max(rank).alias("top")).where("x <> y").select("key", "top")
    many = cut(many, early)
    met: list[str] = []
    live = cut(wins.join(many.hint("shuffle_hash"), "key").select("key", "node", "lo", "c", "hi", (rank == F.col("top")).alias("lead")), met)
    whole = every.where(F.col("n") >= words).join(reps.where("ids > 1").select("node"), "node", "left_semi").select("node", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    spans = cut(whole.union(every.select("node", F.inline("own"))), held)
    size = cut(every.select("node", "n"), held)
    clear(spark, early)
    live = cut(_sketched(live, text, least, run, percent), early)
    clear(spark, met)
    lead = live.where("lead").select("key", F.struct("node", "lo", "c", "hi", "need", "bits").alias("l"))
    p = live.join(lead.hint("shuffle_hash"), "key").where(F.col("node") != F.col("l.node"))
    both = sum(F.bit_count(F.col("bits")[i].bitwiseAND(F.col("l.bits")[i])) for i in range(BITS // 64))
    p = p.where(both >= F.least("need", "l.need") - slack(least))
    p = cut(p.select(F.col("l.node").alias("a"), F.col("node").alias("b"), F.col("l.lo").alias("la"), F.col("l.c").alias("ca"), F.col("l.hi").alias("ha"), F.col("lo").alias("lb"), F.col("c").alias("cb"), F.col("hi").alias("hb")), met)
    links = cut(confirmed(p, text, least, run, percent).distinct(), held)
    clear(spark, met)
    label = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), held)
    facts = [spans, links.select("node", "start", "end")]
    # leaders have met all others of their key
    k = live.where("not lead").drop("lead", "bits").join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    seen = links.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("p"))
    # a token lies in a passage if its words do
    k = k.join(seen, "node", "left").withColumn("open", ~F.coalesce(F.exists("p", lambda x: (x["start"] <= F.col("c")) & (F.col("c") < x["end"])), F.lit(False))).drop("p")
    active = k.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("open").alias("z"), (F.min("node") != F.max("node")).alias("two")).where("two and (x <> y or z)").select("key")
    k = cut(k.join(active, "key", "left_semi"), held)
    clear(spark, early)
    if not k.isEmpty():
        p = _full(k, text, least, run, percent, held)
        found = cut(confirmed(p, text, least, run, percent).distinct(), held)
        facts.append(found.select("node", "start", "end"))
        label = components(links.union(found).select(F.col("node").alias("a"), F.col("other").alias("b")), held)
    all_spans = facts[0]
    for f in facts[1:]:
        all_spans = all_spans.union(f)
    p = all_spans.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("p"))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    join = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["end"] >= x["start"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
    p = p.withColumn("p", F.aggregate("p", F.array().cast(kind), join))
    said = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    group = reps.select("digest", "id", "node", "ids").join(size, "node").join(label.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    group = group.join(group.groupBy("label").agg(F.min("id").alias("least")), "label").join(p, "node", "left")
    # shorter texts have no passages, so equal ones stay apart
    linked = (F.col("n") >= words) & F.col("p").isNotNull()
    group = cut(group.select("digest", F.when(linked, F.col("least")).alias("least"), F.when(F.col("p").isNotNull(), F.size("p")).otherwise(0).cast("long").alias("n_passages"), F.coalesce(said, F.lit("")).alias("spans")))
    clear(spark, held)
    out = named.join(group, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("least", "id").alias("component_id"))


def _sketched(live: DataFrame, body: DataFrame, least: int, run: int, percent: int) -> DataFrame:
    """live with the columns need and bits of `sketches`."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, s, starts in tokens_of(b.column(2), run):
                w = b.column(1).slice(x, y - x)
                flat, size = w.flatten(), np.diff(w.offsets.to_numpy())
                at = np.repeat(starts[:-1], size)
                need, bits = sketches(s, *(flat.field(i).to_numpy() + at for i in ("lo", "c", "hi")), least, percent)
                bits = pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), BITS // 64).cast(pa.list_(pa.int64()))
                node = pa.array(np.repeat(b.column(0).slice(x, y - x).to_numpy(), size))
                yield pa.RecordBatch.from_arrays([flat.field("key"), node, *(flat.field(i) for i in ("lo", "c", "hi", "lead")), pa.array(need), bits], ["key", "node", "lo", "c", "hi", "lead", "need", "bits"])

    w = live.groupBy("node").agg(F.collect_list(F.struct("key", "lo", "c", "hi", "lead")).alias("w"))
    return w.join(body, "node").select("node", "w", "text").mapInArrow(draw, "key long, node long, lo int, c int, hi int, lead boolean, need int, bits array<long>")


def _blocks(k: DataFrame, low: int = 0, high: int = 1 << 30) -> DataFrame:
    """k with p, q, side: each two of a key's blocks that lie low to high (exclusive) apart in a ring, and which of them the window is of (2: p = q)."""
    k = k.withColumn("own", F.pmod(F.xxhash64("node", "c"), F.col("blocks")).cast("int"))
    far = lambda x: F.least(F.abs(x - F.col("own")), F.col("blocks") - F.abs(x - F.col("own")))
    k = k.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (far(x) >= low) & (far(x) < high))))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return k.withColumn("side", side).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))


def _unsettled(k: DataFrame, pairs: DataFrame, held: list[str]) -> DataFrame:
    """k after pairs of `tile`: their windows are no longer open, their classes are one; keys without work are left out."""
    ends = pairs.select("key", F.col("a").alias("node"), F.col("ca").alias("c")).union(pairs.select("key", "b", "cb")).distinct()
    now = components(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")), held).toDF("label", "now")
    k = k.join(now, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
    k = k.join(ends.withColumn("met", F.lit(True)), ["key", "node", "c"], "left").withColumn("open", F.col("open") & F.col("met").isNull()).drop("met")
    return k.join(k.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("open").alias("z")).where("x <> y or z").select("key"), "key", "left_semi")


def _full(k: DataFrame, body: DataFrame, least: int, run: int, percent: int, held: list[str]) -> DataFrame:
    """Pairs of windows of a key that share a passage about their nodes and join their classes, or settle one that is open.

    The pairs are written; held gets the tables' paths."""
    enough = int(np.ceil(least * 2 * percent / (100 + percent) - 1e-9))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x0, x1, s, starts in tokens_of(b.column(2), run):
                part = b.slice(x0, x1 - x0)
                w = part.column(1)
                n, w = np.diff(w.offsets.to_numpy()), w.flatten()
                lo, c, hi = (w.field(x).to_numpy().astype(np.int64) for x in ("lo", "c", "hi"))
                left, right = np.maximum(lo, c - least + 1), np.minimum(hi, c + least - 1)
                size = right - left + 1
                end = np.r_[0, np.cumsum(size)]
                near = s.view(np.int64)[np.repeat(np.repeat(starts[:-1], n) + left - end[:-1], size) + np.arange(end[-1])]
                node = np.repeat(part.column(0).to_numpy(), n)
                names = ["key", "label", "open", "lo", "c", "hi", "need", "blocks"]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *(w.field(x) for x in names), pa.ListArray.from_arrays(end.astype(np.int32), pa.array(near))], ["node", *names, "near"])

    def tile(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["key"].to_numpy(), kind="stable"))).combine_chunks()
        key, node, label, side, need = (t[c].to_numpy() for c in ("key", "node", "label", "side", "need"))
        label, free = label.copy(), t["open"].to_numpy(zero_copy_only=False).copy()
        near = t["near"].combine_chunks()
        ends, tokens = near.offsets.to_numpy().astype(np.int64), near.values.to_numpy()
        size = np.diff(ends)
        # windows of which others of the key have too few tokens are left out
        owner = np.repeat(np.arange(len(t)), size)
        with np.errstate(over="ignore"):
            here = mix(tokens.view(np.uint64) + mix(key.view(np.uint64))[owner])
        numbers, at, count = np.unique(here, return_inverse=True, return_counts=True)
        sums = np.r_[0, np.cumsum(count[at] > 1)]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least_need = np.repeat(np.minimum.reduceat(need, begin), np.diff(np.r_[begin, len(key)]))
        useful = sums[ends[1:]] - sums[ends[:-1]] >= least_need
        runs = np.zeros(len(tokens) + 1, np.int64)
        if len(tokens) >= least:
            runs[1 : len(tokens) - least + 2] = sums[least:] - sums[:-least] >= enough
        runs = np.cumsum(runs)
        ready = (size >= least) & (runs[np.maximum(ends[1:] - least + 1, ends[:-1])] > runs[ends[:-1]])
        out = []
        for z, y in zip(begin.tolist(), [*begin[1:].tolist(), len(key)]):
            if not ready[z:y].any():
                continue
            group = np.flatnonzero(useful[z:y]) + z
            left, right = (group, group) if side[z] == 2 else (group[side[group] == 0], group[side[group] == 1])
            if not len(left) or not len(right) or node[group].min() == node[group].max():
                continue
            flat = np.concatenate([at[ends[i] : ends[i + 1]] for i in group.tolist()])
            _, column, several = np.unique(flat, return_inverse=True, return_counts=True)
            total = int((several > 1).sum())
            column = np.where(several > 1, np.cumsum(several > 1) - 1, total)[column]  # the last column stays empty
            row = np.zeros(y - z, np.int64)
            row[group - z] = np.arange(len(group))
            has = np.zeros((len(group), total + 1), np.uint8)
            has[np.repeat(np.arange(len(group)), size[group]), column] = 1
            has[:, total] = 0
            spot = np.cumsum(size[group]) - size[group]
            shared = np.zeros((len(left), len(right)), np.float32)
            for k in range(0, total, 4096):
                m = has[:, k : k + 4096].astype(np.float32)
                shared += m[row[left - z]] @ m[row[right - z]].T
            fits = (shared >= np.minimum(need[left, None], need[None, right])) & (node[left, None] != node[None, right])
            tries = [(left[u], right, fits[u]) for u in np.flatnonzero(fits.any(1) & ready[left])]
            if side[z] != 2:
                tries += [(right[u], left, fits[:, u]) for u in np.flatnonzero(fits.any(0) & ready[right])]
            alike: dict[bytes, int] = {}  # windows of the same tokens are compared once
            same = {i: alike.setdefault(at[ends[i] : ends[i + 1]].tobytes(), i) for i in group.tolist()}
            apart = set()
            for i, v, fit in tries:
                v = v[fit]
                v = v[free[i] | free[v] | (label[v] != label[i])]
                first = spot[row[i - z]]
                held = np.zeros((len(v), size[i] + 1), np.int32)
                np.cumsum(has[row[v - z][:, None], column[first : first + size[i]]], axis=1, dtype=np.int32, out=held[:, 1:])
                for j in v[(held[:, least:] - held[:, :-least]).max(1) >= enough].tolist():
                    if not (free[i] or free[j] or label[i] != label[j]):
                        continue
                    if (same[i], same[j]) in apart:
                        continue
                    if common(at[ends[i] : ends[i + 1]], at[ends[j] : ends[j + 1]], least, percent, len(numbers)):
                        out.append((i, j))
                        free[i] = free[j] = False
                        mates = label[z:y]
                        mates[mates == label[j]] = label[i]
                    else:
                        apart.add((same[i], same[j]))
        pairs = np.array(out, np.int64).reshape(-1, 2).T
        cols = [t[c].to_numpy()[p] for p in pairs for c in ("node", "lo", "c", "hi", "label")]
        return pa.table([cols[0], cols[5], *cols[1:4], *cols[6:9], key[pairs[0]], cols[4], cols[9]], ["a", "b", "la", "ca", "ha", "lb", "cb", "hb", "key", "ka", "kb"])

    def near(k: DataFrame) -> DataFrame:
        w = k.groupBy("node").agg(F.collect_list(F.struct("key", "label", "open", "lo", "c", "hi", "need", "blocks")).alias("w"))
        return w.join(body, "node").select("node", "w", "text").mapInArrow(around, "node long, key long, label long, open boolean, lo int, c int, hi int, need int, blocks int, near array<long>")

    def met(k: DataFrame) -> DataFrame:
        # keys of one block are met many at a time, about BLOCK windows in a group
        k = k.withColumn("group", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
        k = k.select("group", "p", "q", "side", "key", "node", "label", "open", "lo", "c", "hi", "need", "near")
        return cut(k.groupBy("group", "p", "q").applyInArrow(tile, "a long, b long, la int, ca int, ha int, lb int, cb int, hb int, key long, ka long, kb long"), held)

    n = k.count()
    groups = max(1, n // BLOCK)
    many = cut(k.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), held)
    hot, sent, top = many.agg(F.sum("size"), F.sum(F.col("size") * F.col("blocks")), F.max("blocks")).first()
    k = k.join(many.select("key", "blocks"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    if not hot or n - hot + sent <= SENT * n:
        return met(_blocks(near(k)))
    pairs = met(_blocks(near(k.where("blocks = 1"))))
    mine: list[str] = []
    hottest, found = cut(near(k.where("blocks > 1")), mine, SMALL), None
    step = max(1, SENT * n // (2 * hot))
    for low in range(0, top // 2 + 1, step):
        old: list[str] = []
        new = met(_blocks(hottest if found is None else _unsettled(hottest, found, old), low, low + step))
        found = new if found is None else found.union(new)
        clear(body.sparkSession, old)
    clear(body.sparkSession, mine)
    return pairs.union(found)
