"""License scans: patience alignment of whole texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents

COVERAGE = 0.75  # of a template's words that have to be aligned
GAP = 12  # words of the text between two aligned words of one notice, at most

# The wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

_WORD = re.compile(r"[^\W_]+")

Match = tuple[int, int]  # place in the template, place in the text


@lru_cache(maxsize=None)
def _template(text: str) -> tuple[list[str], list[str]]:
    words = _WORD.findall(text.lower())
    return words, sorted(set(words), key=lambda w: (-len(w), w))


def _increasing(pairs: list[Match]) -> list[Match]:
    """Longest subsequence of pairs, given by rising first place, whose second place rises too (patience sorting)."""
    tops: list[int] = []
    pile: list[int] = []
    before: list[int] = []
    for k, (_, place) in enumerate(pairs):
        at = bisect_left(tops, place)
        before.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(place), pile.append(k)
        else:
            tops[at], pile[at] = place, k
    out, k = [], pile[-1] if pile else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _longest_run(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[Match]:
    """The longest stretch of equal words, where no word is unique to both sides."""
    places: dict[str, list[int]] = {}
    for i in range(a0, a1):
        places.setdefault(a[i], []).append(i)
    best, last = (0, 0, 0), {}
    for j in range(b0, b1):
        now = {i: last.get(i - 1, 0) + 1 for i in places.get(b[j], ())}
        for i, n in now.items():
            if n > best[0]:
                best = (n, i - n + 1, j - n + 1)
        last = now
    return [(best[1] + k, best[2] + k) for k in range(best[0])]


def align(a: list[str], b: list[str]) -> list[Match]:
    """Matched places of template a and text b, rising on both sides.

    Words that occur once on each side are anchors; their longest increasing subsequence stays, and the gaps between are
    aligned in the same way. A gap without such a word is split at its longest common stretch, so a notice that a text
    repeats is found as well.
    """
    found: list[Match] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        left: dict[str, int] = {}
        for i in range(a0, a1):
            left[a[i]] = -1 if a[i] in left else i
        right: dict[str, int] = {}
        for j in range(b0, b1):
            w = b[j]
            if left.get(w, -1) >= 0:
                right[w] = -1 if w in right else j
        pairs = sorted((left[w], j) for w, j in right.items() if j >= 0)
        anchors = _increasing(pairs) or _longest_run(a, b, a0, a1, b0, b1)
        if not anchors:
            continue
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted(found)


def _notice(matches: list[Match], gap: int) -> list[Match]:
    """The largest part of the matches without a wider gap in the text."""
    cuts = [0, *(k for k in range(1, len(matches)) if matches[k][1] - matches[k - 1][1] > gap + 1), len(matches)]
    start, end = max(zip(cuts, cuts[1:]), key=lambda x: x[1] - x[0])
    return matches[start:end]


def _windows(a: list[str], b: list[str], allowed: int, gap: int) -> list[tuple[int, int]]:
    """Stretches of text b outside which no notice lies.

    A notice lacks `allowed` words of template a at most, so it holds one of the words that are rarest in the text, as
    many of them as make more than that. Around each of their places there is room for a notice on both sides.
    """
    need: dict[str, int] = {}
    for w in a:
        need[w] = need.get(w, 0) + 1
    places: dict[str, list[int]] = {w: [] for w in need}
    for j, w in enumerate(b):
        if w in places:
            places[w].append(j)
    seeds, total = [], 0
    for w in sorted(need, key=lambda w: (len(places[w]), w)):
        seeds += places[w]
        total += need[w]
        if total > allowed:
            break
    room, out = 2 * len(a) + gap, []
    for j in sorted(seeds):
        if out and j - room <= out[-1][1]:
            out[-1] = (out[-1][0], min(len(b), j + room + 1))
        else:
            out.append((max(0, j - room), min(len(b), j + room + 1)))
    return out


def notices(text: str | None, coverage: float = COVERAGE, gap: int = GAP) -> list[tuple[int, int, str, float]]:
    """(start, end, license, coverage) of every notice, in code points.

    After a notice was found, the text before and behind it is looked at again. Of notices that overlap, the one with
    more aligned words stays.
    """
    lower = (text or "").lower()
    if len(lower) != len(text or ""):  # a few characters grow in lower case; places must stay those of the text
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans: list[tuple[int, int]] | None = None
    words: list[str] = []
    found = []
    for name, template in TEMPLATES.items():
        a, rare = _template(template)
        allowed = int((1 - coverage) * len(a) + 1e-9)
        missing = 0
        for w in rare:  # each absent word leaves at least one place of the template without a partner
            missing += w not in lower
            if missing > allowed:
                break
        if missing > allowed:
            continue
        if spans is None:
            spans = [m.span() for m in _WORD.finditer(lower)]
            words = [lower[s:e] for s, e in spans]
        todo = _windows(a, words, allowed, gap)
        while todo:
            lo, hi = todo.pop()
            run = _notice(align(a, words[lo:hi]), gap)
            if run:  # a word far off may have been an anchor: look again at the close surroundings
                near = max(lo, lo + run[0][1] - len(a))
                again = _notice(align(a, words[near : min(hi, lo + run[-1][1] + len(a))]), gap)
                run = max(run, [(i, j + near - lo) for i, j in again], key=len)
            if len(run) < coverage * len(a):
                continue
            first, last = lo + run[0][1], lo + run[-1][1]
            found.append((len(run), spans[first][0], spans[last][1], name, len(run) / len(a)))
            todo += [(lo, first), (last + 1, hi)]
    kept: list[tuple[int, int, str, float]] = []
    for _, start, end, name, share in sorted(found, key=lambda x: (-x[0], x[1], x[3])):
        if all(end <= s or start >= e for s, e, _, _ in kept):
            kept.append((start, end, name, share))
    return sorted(kept)


def scan(docs: DataFrame, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """The rows of `docs` with n_notices, license (of the best notice), coverage (its share of the template), and notices (license:start:end, comma-joined).

    A null or empty text has no notice: license is null and coverage 0. Of equally good notices the first one counts.
    Repeated rows are each scanned; added columns replace input columns of the same name; no rows give no rows. No
    shuffle, whole texts.
    """

    @F.pandas_udf("n_notices long, license string, coverage double, notices string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            all_ = notices(text, coverage, gap)
            best = max(all_, key=lambda x: (x[3], -x[0]), default=(0, 0, None, 0.0))
            out.append((len(all_), best[2], best[3], ",".join(f"{n}:{s}:{e}" for s, e, n, _ in all_)))
        return pd.DataFrame(out, columns=["n_notices", "license", "coverage", "notices"])

    names = ["n_notices", "license", "coverage", "notices"]
    kept = [c for c in docs.columns if c not in (*names, "_scan")]
    return docs.select(*kept, scanned("text").alias("_scan")).select(*kept, "_scan.*")


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan(documents(spark, folder).select("doc_id", "text")).drop("text")
