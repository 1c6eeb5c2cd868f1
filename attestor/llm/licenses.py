"""License scans by patience alignment with templates.

An alignment pairs equal words of a template and of a stretch of at most ``SPAN`` times as many words, in order:
equal ends first, then the words that both sides have once, of which the longest increasing subsequence stands, then
the gaps between them in the same way (``aligned``). Coverage is the share of the template's words that found a partner.

An alignment with enough coverage leaves out at most u words of a template. Its *seeds* are the words at u + 1 of its
places, those that fewest templates share: any such alignment holds one, whichever words were cut or reworded. Around
the seeds' places, merged where they touch, every tight stretch (``stretches``) is aligned.
One narrow pass over whole texts; what a text without any seed costs is its words' hashes.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Defined cases: a null, empty or wordless text has no license; of overlapping matches, of one template or of several,
those with the most matched words in all count, then those with the greater coverage in all, then with the fewer
words; further ties go by place and template's name; repeated rows and repeated notices are each reported; templates
without words match nothing; further columns are ignored. A short notice whose name is missing or of a license without
a template is ``unnamed``: the template without a name covers it wholly, those with other names only in part.
"""
from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LEAST_COVERAGE = 0.8
SPAN = 4  # words of a stretch for each word of a template, at most

# Usual notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "bsd-line": "Released under the BSD License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "isc": "Released under the ISC License.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unnamed": "Released under the License.",
    "unnamed-line": "Licensed under the License.",
    "unnamed-2.0": "Licensed under the License, Version 2.0.",
}
MATCHES = "array<struct<license:string,start_word:int,end_word:int,coverage:double>>"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (sorted by the first) whose seconds increase: patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Paired positions of equal words, in order, by patience alignment.

    Equal ends are paired, then the words that either side has once are anchors, of which the longest increasing
    chain stands; the gaps are aligned in the same way. In a gap without anchors words repeat: there the longest
    common subsequence decides.
    """
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        where, seen = {}, {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        anchors = increasing(sorted((i, seen[x]) for x, i in where.items() if i >= 0 and seen.get(x, -1) >= 0))
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:]) if k > i + 1 and m > j + 1]
        elif where.keys() & seen.keys():
            out += repeats(a, a0, a1, b, b0, b1)
    return sorted(out)


def repeats(a: Sequence, a0: int, a1: int, b: Sequence, b0: int, b1: int) -> list[tuple[int, int]]:
    """Paired positions of a longest common subsequence of a gap: the text has at most ``SPAN`` times a template's words."""
    rows = [[0] * (b1 - b0 + 1)]
    for i in range(a1 - 1, a0 - 1, -1):
        after, row = rows[-1], [0] * (b1 - b0 + 1)
        for j in range(b1 - b0 - 1, -1, -1):
            row[j] = after[j + 1] + 1 if a[i] == b[b0 + j] else max(after[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < a1 - a0 and j < b1 - b0:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _templates(templates: dict[str, str], least: float) -> list[tuple[str, list[int], int, np.ndarray]]:
    """(name, word hashes, least number of pairs, hashes of the seeds) of every template that has words."""
    found = []
    for name in sorted(templates):
        (_, _, data, offsets), *_ = B.text_blocks(pa.array([templates[name]]))
        w = B.words(data, offsets, B.IS_ALNUM)
        if len(w.hash):
            found.append((name, w.hash.tolist(), (w.end - w.start).tolist()))
    owners = Counter(x for _, h, _ in found for x in set(h))
    out = []
    for name, h, size in found:
        need = max(1, math.ceil(least * len(h) - 1e-9))
        # any choice of places will do; words of few templates and long words are rare in texts
        rare = sorted(range(len(h)), key=lambda k: (owners[h[k]], -size[k], k))[: len(h) - need + 1]
        out.append((name, h, need, np.array(sorted({h[k] for k in rare}), np.uint64)))
    return out


def stretches(text: list[int], at: list[int], words: list[int], need: int) -> list[tuple[int, int, int]]:
    """(pairs, first word, end word) of the tight stretches whose patience alignment has ``need`` pairs or more.

    ``text`` are the template's words in a text and ``at`` their places. A stretch is tight when without its first or
    its last word fewer words could be paired. Their longest common subsequences, which no alignment exceeds, say
    which are: one bit-parallel pass from a start gives those of all its ends.
    """
    n, key = len(words), tuple(words)
    bits: dict[int, int] = {}
    for k, x in enumerate(words):
        bits[x] = bits.get(x, 0) | 1 << k
    heads, size, full = set(words[: n - need + 1]), Counter(words), (1 << n) - 1
    starts, have, common, b = [], Counter(), 0, 0
    for a, s in enumerate(at):
        while b < len(at) and at[b] < s + SPAN * n:
            have[text[b]] += 1
            common += have[text[b]] <= size[text[b]]
            b += 1
        if common >= need and text[a] in heads:  # words in common, whatever their order
            starts.append((a, b))
        common -= have[text[a]] <= size[text[a]]
        have[text[a]] -= 1
    out = []
    ends = [len(text)] * (n + 2)  # by number of words, the earliest end of the later starts
    for a, b in reversed(starts):
        most, v = 0, full
        for q in range(a, b):
            u = v & bits[text[q]]
            v = ((v + u) | (v - u)) & full
            if n - v.bit_count() > most:
                most = n - v.bit_count()
                if most >= need and q < ends[most]:
                    for k in range(most, 0, -1):
                        if ends[k] <= q:
                            break
                        ends[k] = q
                    pairs = coverage(tuple(text[a : q + 1]), key)
                    if pairs >= need:
                        out.append((pairs, at[a], at[q] + 1))
                if most == n:
                    break
    return out


@lru_cache(maxsize=20_000)
def coverage(stretch: tuple, words: tuple) -> int:
    """Words of a template that the patience alignment with a stretch pairs; notices repeat, so recent ones are kept."""
    return len(aligned(stretch, words))


def most_pairs(found: list[tuple]) -> list[tuple]:
    """Of (pairs, first, end, name, coverage) those that do not overlap and have the most pairs in all.

    Of equal choices the one of greater coverage in all, then of fewer words, then the earlier ends and names.
    """
    found = sorted(found, key=lambda m: (m[2], m[1], m[3]))
    ends = [m[2] for m in found]
    best, take = [(0, 0.0, 0)], []
    for k, (pairs, first, end, _, share) in enumerate(found):
        before = bisect_right(ends, first, 0, k)
        mine = (best[before][0] + pairs, round(best[before][1] + share, 9), best[before][2] - (end - first))
        take.append(before if mine > best[k] else -1)
        best.append(max(mine, best[k]))
    out, k = [], len(found)
    while k:
        if take[k - 1] >= 0:
            out.append(found[k - 1])
            k = take[k - 1]
        else:
            k -= 1
    return out[::-1]


def matches_in(h: np.ndarray, templates: list, held: set[int]) -> list[tuple[str, int, int, float]]:
    """(license, first word, end word, coverage) of one text, in order, best of each place; ``held``: the seeds in it."""
    out = []
    for name, words, need, seeds in templates:
        if held.isdisjoint(seeds.tolist()):
            continue
        places = np.flatnonzero(np.isin(h, seeds))
        reach, own = SPAN * len(words), np.array(sorted(set(words)), np.uint64)
        cuts = np.flatnonzero(np.diff(places) > 2 * reach) + 1
        for group in np.split(places, cuts):  # the windows of a group touch
            lo, hi = max(0, int(group[0]) - reach), min(len(h), int(group[-1]) + reach)
            at = lo + np.flatnonzero(np.isin(h[lo:hi], own))
            if len(at) >= need:
                found = stretches(h[at].tolist(), at.tolist(), words, need)
                out += [(pairs, first, end, name, pairs / len(words)) for pairs, first, end in found]
    return [(name, first, end, share) for _, first, end, name, share in most_pairs(out)]


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, matches) of every row of ``docs`` (doc_id, text)."""
    kind = pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("coverage", pa.float64())])

    def run(batches):
        known = _templates(templates, least)
        seeds = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for *_, x in known)]))
        for batch in batches:
            for a, b, data, offsets in B.text_blocks(batch.column("text")):
                w = B.words(data, offsets, B.IS_ALNUM)
                found: list[list] = [[] for _ in range(b - a)]
                held: dict[int, set[int]] = {}
                for k in np.flatnonzero(np.isin(w.hash, seeds)).tolist():
                    held.setdefault(int(w.row[k]), set()).add(int(w.hash[k]))
                for r, mine in held.items():
                    found[r] = [dict(zip(kind.names, m)) for m in matches_in(w.hash[w.first[r] : w.first[r + 1]], known, mine)]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(found, pa.list_(kind))], names=["doc_id", "matches"])

    base = B.small_batches(docs).select("doc_id", "text")
    return base.mapInArrow(run, base.select("doc_id", F.array().cast(MATCHES).alias("matches")).schema)
