"""License scans by patience alignment of texts with license templates.

A template is looked for around every place of the template word that is rarest in the text, so that a notice which
stands several times is aligned each time. Within such a region words that occur once on both sides are anchors; the
longest increasing run of anchors is fixed, equal neighbours of anchors are joined to it, and every gap is aligned the
same way until no anchor is left. Coverage is the share of the template's words that are aligned.

A notice that longer blocks interrupt does not fit such a region. Its parts are found by runs of at least ``RUN`` words
that stand in the template in a row. Runs that rise in text and template are joined into one region, however far they
lie apart, and the words between two of them are aligned in the same way beside the runs, as far as the template's gap
reaches. A part counts only if it has such a run, so long texts do not collect a template word by word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wording of public licenses.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
WORD = re.compile(r"\w+")
COVERAGE = 0.8
RUN = 3  # neighbouring words that a part lying apart has at least in a row
SLACK = 2  # words more than the template's gap that are looked at beside a run


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run: piles of patience, each card knowing the one before it."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[k] = ends[pile - 1] if pile else -1
        tops[pile:pile + 1], ends[pile:pile + 1] = [v], [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(k)
        k = before[k]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words ``(place in a, place in b)``, rising on both sides."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: k for k, w in enumerate(b[b0:b1], b0) if right[w] == 1 and left[w] == 1}
        both = [(k, once[w]) for k, w in enumerate(a[a0:a1], a0) if w in once]
        anchors = [both[k] for k in rising([y for _, y in both])]
        last = (a0, b0)
        for x, y in anchors:
            pairs.append((x, y))
            gaps.append((last[0], x, last[1], y))
            last = (x + 1, y + 1)
        if anchors:
            gaps.append((last[0], a1, last[1], b1))
    return sorted(pairs)


Part = tuple[int, int, int, int, int]  # begin and end in the text, begin and end in the template, words aligned


def covered(w: list[str], template: list[str], parts: list[Part], low: int, high: int) -> tuple[int, int, int]:
    """Words aligned, first and last place, of parts that rise, with what stands beside them between ``low`` and ``high``."""
    total, begin, end = 0, parts[0][0], parts[-1][1]
    k0, t0 = parts[0][0], parts[0][2]
    before = align(w[max(low, k0 - t0 - SLACK):k0], template[:t0])
    if before:
        total, begin = len(before), max(low, k0 - t0 - SLACK) + before[0][0]
    for (_, k1, _, t1, n), after in zip(parts, [*parts[1:], None]):
        total += n
        if after is None:
            rest = align(w[k1:min(high, k1 + len(template) - t1 + SLACK)], template[t1:])
            total, end = total + len(rest), k1 + rest[-1][0] + 1 if rest else end
            continue
        (k2, _, t2, _, _), near = after, after[2] - t1 + SLACK
        if k2 - k1 <= 2 * near:
            total += len(align(w[k1:k2], template[t1:t2]))
        else:
            head = align(w[k1:k1 + near], template[t1:t2])
            t1 += head[-1][1] + 1 if head else 0
            total += len(head) + len(align(w[k2 - near:k2], template[t1:t2]))
    return total, begin, end


class Scanner:
    """Templates as word lists, searched together."""

    def __init__(self, templates: dict[str, list[str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words(t)) for name, texts in templates.items() for t in texts if words(t)]
        self.distinct = [Counter(t) for _, t in self.templates]
        self.vocabulary = {w for t in self.distinct for w in t}
        self.grams: dict[tuple[str, ...], dict[tuple[str, ...], list[int]]] = {}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """``(license, coverage, start, end, places)`` in words: the best place of each license, and how many it has."""
        w = words(text)
        shared = self.vocabulary & set(w)
        if not shared:
            return []
        best: dict[str, list] = {}
        places = None
        for (name, template), held in zip(self.templates, self.distinct):
            # all but so many words of the template must stand in the text
            if sum(n for x, n in held.items() if x in shared) < self.coverage * len(template):
                continue
            if places is None:
                places = {}
                for k, x in enumerate(w):
                    if x in shared:
                        places.setdefault(x, []).append(k)
            taken, found = -1, []
            for begin, end in self._regions(template, held, places, len(w)):
                pairs = align(w[begin:end], template)
                share = len(pairs) / len(template)
                if share < self.coverage or begin + pairs[0][0] <= taken:
                    continue
                taken = begin + pairs[-1][0]
                found.append((share, begin + pairs[0][0], taken + 1))
            for share, begin, end in self._interrupted(w, template, held, places, found):
                here = best.setdefault(name, [(share, -begin, end), 0])
                here[0], here[1] = max(here[0], (share, -begin, end)), here[1] + 1
        return [(name, row[0], -row[1], row[2], n) for name, (row, n) in sorted(best.items())]

    def _runs(self, w: list[str], template: list[str], every: list[int]) -> list[Part]:
        """Stretches of at least ``RUN`` words that text and template share in a row, by their place in the text."""
        if template not in self.grams:
            self.grams[template] = at = {}
            for t in range(len(template) - RUN + 1):
                at.setdefault(template[t:t + RUN], []).append(t)
        grams, open_, runs = self.grams[template], {}, []
        for k in every:
            for t in grams.get(tuple(w[k:k + RUN]), ()):
                run = open_.get(k - t)
                if run is not None and runs[run][1] == k + RUN - 1:
                    k0, _, t0, _, _ = runs[run]
                    runs[run] = (k0, k + RUN, t0, t + RUN, k + RUN - k0)
                else:
                    open_[k - t] = len(runs)
                    runs.append((k, k + RUN, t, t + RUN, RUN))
        return runs

    def _interrupted(self, w: list[str], template: list[str], held: Counter, places: dict[str, list[int]],
                     found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """``(coverage, start, end)``: the places found, with parts that lie apart, and those in parts between them."""
        every = sorted(k for x in held if x in places for k in places[x])
        runs = self._runs(w, tuple(template), every)
        need = next(k for k in range(1, len(template) + 1) if k / len(template) >= self.coverage)
        whole = []
        for _, begin, end in found:
            pairs = align(w[begin:end], template)
            whole.append((begin, end, pairs[0][1], pairs[-1][1] + 1, len(pairs)))
        out, low = [], 0
        for k, part in enumerate([*whole, None]):
            high = part[0] if part else len(w)
            mine = runs[bisect_left(runs, (low,)):bisect_left(runs, (high,))]
            mine = [r for r in mine if r[1] <= high]
            apart, free = self._chains(w, template, mine, need, low, high)
            out += apart
            if part:
                # parts on both sides go on from the place found, until one goes back in the template
                chain = [part]
                for k0, k1, t0, t1, _ in reversed(runs[bisect_left(runs, (free,)):bisect_left(runs, (part[0],))]):
                    cut = max(0, k1 - chain[0][0])  # what the place found has of it already
                    if k1 - cut > k0 and t1 - cut <= chain[0][2]:
                        chain.insert(0, (k0, k1 - cut, t0, t1 - cut, k1 - cut - k0))
                    elif not cut:
                        break
                stop = whole[k + 1][0] if k + 1 < len(whole) else len(w)
                for k0, k1, t0, t1, _ in runs[bisect_left(runs, (part[0],)):bisect_left(runs, (stop,))]:
                    cut = max(0, chain[-1][1] - k0)
                    if k1 <= stop and k1 > k0 + cut and t0 + cut >= chain[-1][3]:
                        chain.append((k0 + cut, k1, t0 + cut, t1, k1 - k0 - cut))
                    elif not cut:
                        break
                begun, low = chain[0][0], chain[-1][1]
                if len(chain) > 1:
                    n, begin, end = covered(w, template, chain, begun, low)
                    out.append((n / len(template), begin, end))
                else:
                    out.append(found[k])
        return out

    @staticmethod
    def _chains(w: list[str], template: list[str], runs: list[Part], need: int, low: int,
                high: int) -> tuple[list[tuple[float, int, int]], int]:
        """Places of notices in parts: the first chain of rising runs that covers enough, then on behind it; the end."""
        out: list[tuple[float, int, int]] = []
        best: list = [None] * (len(template) + 1)  # by the template place that a chain has come to: words and chain
        tested, k = 0, 0
        while k < len(runs):
            k0, k1, t0, t1, n = run = runs[k]
            k += 1
            # of equal chains the one that was extended last, so that notices are as short as may be
            fits = [c for c in best[:t0 + 1] if c and c[2] <= k0]
            before = max(fits, key=lambda c: (c[0], c[2]), default=(0, None, 0))
            chain = (before[0] + n, (before[1], run), k1)
            if best[t1] is None or chain[0] >= best[t1][0]:
                best[t1] = chain
            if 2 * chain[0] < need or chain[0] <= tested:
                continue
            tested = chain[0]
            parts, link = [], chain[1]
            while link:
                link, part = link
                parts.insert(0, part)
            if covered(w, template, parts, low, high)[0] < need:
                continue
            while k < len(runs) and runs[k][2] >= parts[-1][3] and runs[k][0] >= parts[-1][1]:
                parts.append(runs[k])
                k += 1
            total, begin, end = covered(w, template, parts, low, runs[k][0] if k < len(runs) else high)
            out.append((total / len(template), begin, end))
            best, tested, low = [None] * (len(template) + 1), 0, end
        return out, low

    def _regions(self, template: list[str], held: Counter, places: dict[str, list[int]], n: int):
        """Where the template would lie around each place of its rarest words, more of which are tried than may be missing."""
        spare = len(template) - math.ceil(self.coverage * len(template))
        slack, starts, count = len(template) // 4 + 2, set(), 0
        for x in sorted((x for x in held if x in places), key=lambda x: (len(places[x]), x)):
            starts.update(k - at for at, w in enumerate(template) if w == x for k in places[x])
            count += held[x]
            if count > spare:
                break
        last = None
        for start in sorted(starts):
            if last is None or start - last > slack // 2:
                last = start
                yield max(start - slack, 0), min(start + len(template) + slack, n)


def license_scan(df: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text",
                 key: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """``(key, license, coverage, start, end, places)`` for each license found in each row.

    ``start`` and ``end`` count words of the best place. Null and empty texts hold none; repeated rows are reported
    each; ties go to the first place; an empty table gives no rows.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    kind = df.select(key).schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("license", T.StringType()),
                           T.StructField("coverage", T.DoubleType())]
                          + [T.StructField(c, T.LongType()) for c in ("start", "end", "places")])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in enumerate(batch.column(1).to_pylist()) for r in scanner.scan(t)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.float64()), *[pa.array(c, pa.int64()) for c in columns[3:]]],
                names=[f.name for f in schema])

    return df.select(F.col(key), F.col(text)).mapInArrow(fn, schema)
