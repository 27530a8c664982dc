"""License notices in documents: fingerprints, an inverted index, alignment.

Words are ASCII letters and digits, lowered. Fingerprints are pairs of neighbouring words of a line,
and of texts of LONG words or more runs of three, of which every WINDOW in a row keep the one of
smallest hash. A notice with 0.8 of a template's words in order shares a fingerprint: all pairs of
lines are kept, and of a long one four words in a row stay together somewhere. Lines are aligned in a
band about the hit's diagonal. For long texts the band is a quarter of the template, and the count
of words in order is a bit-parallel longest common subsequence, which has no band within the region.
Notices that cover enough of a template are reported; of several templates that claim the same words,
as kin of one license do, the one with the most words matched beyond those missed.
"""
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW, BAND, LONG = 2, 6, 24
WORD = re.compile(r"[A-Za-z0-9]+")
# Words that do not name a license: a line must show one of its others, numbers aside.
PLAIN = set("this work software program is are licensed released distributed dedicated under to into the a an of terms and license licence version v international unported universal free".split())
# Well-known license notices.
TEMPLATES = {
    "mit_line": "Released under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache_2_line": "Licensed under the Apache License, Version 2.0",
    "apache_2_notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl_3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl_2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc_by_4_line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_4_line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl_2_line": "Licensed under the Mozilla Public License, version 2.0.",
    "gpl_line": "This work is licensed under the GNU General Public License.",
    "gpl_2_line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl_line": "This work is licensed under the GNU Lesser General Public License.",
    "lgpl_2_1_line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl_3_line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl_3_line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl_notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gfdl_1_3_line": "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "bsd_line": "Released under the BSD License.",
    "bsd_2_line": "Released under the BSD 2-Clause License.",
    "bsd_3_line": "Released under the BSD 3-Clause License.",
    "isc_line": "Released under the ISC License.",
    "zlib_line": "Released under the zlib License.",
    "epl_2_line": "Licensed under the Eclipse Public License, version 2.0.",
    "boost_1_line": "Distributed under the Boost Software License, Version 1.0.",
    "artistic_2_line": "Licensed under the Artistic License, version 2.0.",
    "unlicense_line": "This is free and unencumbered software released into the public domain.",
    "cc0_1_line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "cc0_1_short": "Released under CC0 1.0.",
    "cc0_1_url": "creativecommons.org/publicdomain/zero/1.0",
}
_PARTS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
for _k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    _long = "-".join(_PARTS[x] for x in _k.split("-"))
    for _v, _where in (("4", "International"), ("3", "Unported")):
        _name = f"cc_{_k.replace('-', '_')}_{_v}"
        TEMPLATES[f"{_name}_line"] = f"This work is licensed under a Creative Commons {_long} {_v}.0 {_where} License."
        TEMPLATES[f"{_name}_short"] = f"Licensed under CC {_k.upper()} {_v}.0."
        TEMPLATES[f"{_name}_url"] = f"creativecommons.org/licenses/{_k}/{_v}.0"
for _k in ("MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", *(f"{a}-{b}" for a in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for b in ("only", "or-later"))):
    TEMPLATES[f"spdx_{_k.lower().replace('-', '_').replace('.', '_')}"] = f"SPDX-License-Identifier: {_k}"
# whole texts lie beside this module
for _k in ("apache_2", "artistic_1", "bsd_2", "bsd_3", "cc0_1", "gfdl_1_2", "gfdl_1_3", "gpl_1", "gpl_2", "gpl_3", "isc", "lgpl_2", "lgpl_2_1", "lgpl_3", "mit", "mpl_1_1", "mpl_2", "unlicense", "zlib"):
    TEMPLATES[f"{_k}_text"] = pkgutil.get_data("weft.llm", f"license_texts/{_k}.txt").decode()


def fingerprints(words: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """(position, run): every pair of a line, the winnowed runs of three of a long text."""
    import xxhash

    if len(words) < LONG:
        return list(enumerate(zip(words, words[1:])))
    runs = list(zip(words, words[1:], words[2:]))
    h = [xxhash.xxh3_64_intdigest(" ".join(p)) for p in runs]
    keep = {min(range(k, k + WINDOW), key=lambda i: (h[i], -i)) for k in range(len(h) - WINDOW + 1)}
    return [(i, runs[i]) for i in sorted(keep)]


def prefixes(t: list[str], d: list[str]) -> list[int]:
    """Most words of t in order in each prefix of d, bit-parallel."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(t):
        where[w] |= 1 << i
    full = (1 << len(t)) - 1
    v, out = full, []
    for w in d:
        m = where.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        out.append(len(t) - v.bit_count())
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.words = {k: [w.lower() for w in WORD.findall(t)] for k, t in templates.items()}
        self.bag = {k: Counter(w) for k, w in self.words.items()}
        self.names = {k: {x for x in w if not x.isdigit()} - PLAIN if len(w) < LONG else set() for k, w in self.words.items()}
        self.index, self.runs = defaultdict(list), defaultdict(list)
        for k, w in self.words.items():
            for i, p in fingerprints(w):
                (self.index if len(p) == 2 else self.runs)[p].append((k, i))
        self.first = {p[0] for p in self.index}
        self.pairs = {p[:2] for p in self.runs}

    def align(self, t: list[str], d: list[str], diagonal: int) -> tuple[int, int, int]:
        """Most words of t in order in d within BAND of the diagonal, first and last place in d."""
        none = (0, 0, 0)  # matched, start, -end: more first, then the later start and earlier end
        band = min(BAND, max(1, len(t) // 4))  # a repeated notice next to this one stays outside
        row: dict[int, tuple] = {}
        for i, w in enumerate(t):
            new: dict[int, tuple] = {}
            for j in range(max(0, i + diagonal - band), min(len(d), i + diagonal + band + 1)):
                best = max(row.get(j, none), new.get(j - 1, none))
                if d[j] == w:
                    n, s, _ = row.get(j - 1, none)
                    best = max(best, (n + 1, s if n else j, -(j + 1)))
                new[j] = best
            row = new
        n, s, e = max(row.values(), default=none)
        return n, s, -e

    def enough(self, k: str, d: list[str]) -> bool:
        """Whether words d hold enough of the template's, in any order."""
        t = self.bag[k]
        have = Counter(w for w in d if w in t)
        return sum(min(n, have[w]) for w, n in t.items()) >= self.least * len(self.words[k])

    def long(self, k: str, d: list[str], seeds: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(matched, start, end) of the places of a long template, from seeds (place in d, in the template)."""
        t = self.words[k]
        if not self.enough(k, d):
            return
        band = max(BAND, len(t) // 4)
        many = Counter((i - p) // band for i, p in seeds)
        taken: list[tuple[int, int]] = []
        for c in sorted(many, key=lambda c: (-many[c], c)):
            for i, p in sorted(x for x in seeds if (x[0] - x[1]) // band == c):
                if any(a <= i < b for a, b in taken):
                    continue
                lo = max([0, c * band - band] + [b for _, b in taken if b <= i])
                hi = min([len(d), (c + 2) * band + len(t)] + [a for a, _ in taken if a > i])
                part = d[lo:hi]
                if self.enough(k, part):
                    got = prefixes(t, part)
                    n = got[-1]
                    if n >= self.least * len(t):
                        end = got.index(n) + 1
                        back = prefixes(t[::-1], part[:end][::-1])
                        taken.append((lo + end - back.index(n) - 1, lo + end))
                        yield n, *taken[-1]
                        continue
                break

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        at = list(WORD.finditer(text))
        d = [m[0].lower() for m in at]
        hits = {(k, i - p) for i, w in enumerate(d[:-1]) if w in self.first for k, p in self.index.get((w, d[i + 1]), ())}
        found = defaultdict(list)
        for k, diagonal in sorted(hits):
            t = self.words[k]
            lo = max(0, diagonal - BAND)
            near = set(d[lo : max(0, diagonal + len(t) + BAND)])
            if sum(w in near for w in t) < self.least * len(t):
                continue
            n, s, e = self.align(t, d, diagonal)
            if n >= self.least * len(t) and (not self.names[k] or self.names[k] & set(d[s:e])):
                found[k].append((n / len(t), s, e))
        seeds = defaultdict(list)
        for i, p in enumerate(zip(d, d[1:], d[2:])):
            if p[:2] in self.pairs:
                for k, q in self.runs.get(p, ()):
                    seeds[k].append((i, q))
        for k, at_k in seeds.items():
            for n, s, e in self.long(k, d, at_k):
                found[k].append((n / len(self.words[k]), s, e))
        every = []
        for k, spans in found.items():
            last = []
            # better coverage first, then the earlier and shorter; overlapping ones are the same notice
            for c, s, e in sorted(set(spans), key=lambda x: (-x[0], x[1], x[2])):
                if all(e <= b or s >= f for _, b, f in last):
                    last.append((c, s, e))
            every += [(round((2 * c - 1) * len(self.words[k])), c, s, e, k) for c, s, e in last]
        # two templates claim the same notice if they share half the words of the longer span
        kept = []
        for x in sorted(every, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            if all(2 * (min(x[3], y[3]) - max(x[2], y[2])) < max(x[3] - x[2], y[3] - y[2]) for y in kept):
                kept.append(x)
        out = [{"license": k, "start": at[s].start(), "end": at[e - 1].end(), "coverage": c} for _, c, s, e, k in kept]
        return sorted(out, key=lambda x: (x["start"], x["end"], x["license"]))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_hits and spans (array of license, start, end, coverage) of every row.

    start and end are code points, end exclusive. Null and empty texts have none; rows of one
    id stay rows of their own.
    """
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, least)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                got = [s.scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array(got, kind)], ["id", "n_hits", "spans"])

    d = docs.select(F.col(id_col), F.col(text_col))
    out = d.mapInArrow(run, f"id {d.schema[0].dataType.simpleString()}, n_hits long, spans array<struct<license:string,start:long,end:long,coverage:double>>")
    return out.withColumnRenamed("id", id_col)
