"""Token counts by rank-synchronous merging.

Pre-tokens of a batch are ragged numpy arrays of symbols; in each round every
sequence applies its lowest-rank pair, leftmost occurrences first. Null and empty
texts count 0; rows, repeated ids and null ids are kept one for one.
"""
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE = 500_000  # pre-tokens kept a task; beyond it the cache starts anew


def _bytes_to_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(keep)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        pairs = sorted(((vocab[a] << 32) | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(j["model"]["merges"]))
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        self.first = np.array([vocab[c] for c in _bytes_to_chars()], np.int64)
        self.split = regex.compile(pattern)
        special = [regex.escape(x["content"]) for x in j["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        none = len(self.keys)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        left = np.zeros(len(words), np.int64)
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self.ranks[at], none)
            best = np.full(len(words), none)
            np.minimum.at(best, owner[:-1], rank)
            live = best[owner] < none
            if not live.all():  # ended sequences leave the arrays
                left += np.bincount(owner[~live], minlength=len(words))
                keep = live[:-1]
                cut = keep & live[1:]
                sym, owner, rank, at = sym[live], owner[live], rank, at
                if not len(sym):
                    break
                key = (sym[:-1] << 32) | sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), none - 1)
                hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
                rank = np.where(hit, self.ranks[at], none)
            pick = np.flatnonzero((rank == best[owner[:-1]]) & (rank < none))
            # of a run of touching pairs the 1st, 3rd, ... merge
            new = np.r_[True, np.diff(pick) != 1]
            start = np.flatnonzero(new)
            pick = pick[(np.arange(len(pick)) - start[np.cumsum(new) - 1]) % 2 == 0]
            sym = sym.copy()
            sym[pick] = self.made[at[pick]]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, owner = sym[keep], owner[keep]
        return left

    def count(self, texts: list) -> list[int]:
        split, extra = [], []
        for t in texts:
            parts = self.special.split(t or "") if self.special else [t or ""]
            extra.append(len(parts) - 1)
            split.append([w for p in parts for w in self.split.findall(p)])
        new = list({w for ws in split for w in ws} - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list({w for ws in split for w in ws})
        self.known.update(zip(new, self.merge([w.encode() for w in new]).tolist()))
        return [n + sum(map(self.known.__getitem__, ws)) for n, ws in zip(extra, split)]


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merger(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                texts = part.column(1).to_pylist()
                n = m.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    d = docs.select(F.col(id_col), F.col(text_col))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
