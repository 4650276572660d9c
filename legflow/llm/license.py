"""License scans by patience alignment of texts with license templates.

A place of interest is where a text holds a three-word run of a template.
The run's place in the template tells where the template would begin; starts
near each other make one region of the text, taken as long as the template
and a little longer.  Region and template are aligned by patience: words that are unique
in both are anchors, the longest increasing run of anchors is kept, and the
gaps between kept anchors are aligned the same way.  Coverage is the share of
the template's words that are aligned; a license is found where it is at least
``LEAST``.  Templates are the whole texts in ``license_texts``, headers, and
short notices.  A notice (up to ``NOTICE`` words) differs from another
license's by a word or two, so all its words must stand in a row; its coverage
is its longest stretch of words in place.  Of places found that overlap by
more than half of the shorter, the one with most matched less missing words stays.

Templates over ``LONG`` words are looked for by runs that are unique in them,
and aligned only where the words that region and template share, counted with
repeats, reach ``LEAST`` (alignment cannot give more); below that they
don't count for ``best_license``.

Nulls and empty texts hold no license.  Very long texts are scanned whole;
regions stay as long as a template.  Of equal coverage, the license of more
words, then of lesser name, is best.  Repeated rows get a row each.  No
templates: nothing is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.llm import words as W
from legflow.llm.shared import Sent

GRAM = 3
LEAST = 0.8
NOTICE = 20
LONG = 300

# Short notices, headers and opening paragraphs of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                         "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                         'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
                         "See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
           "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
           "distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
                      "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                      "GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
                "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Names that a notice may call a license by; what follows ``#`` in a template's key is not reported.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    **{f"CC-{kind}-{version}": [f"CC {kind} {version}", f"a Creative Commons {name} {version} International License",
                                f"the Creative Commons {name} {version} International License"]
       for version in ("3.0", "4.0") for kind, name in (
           ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
           ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
TEMPLATES |= {f"{name}#{verb} {the}{i}": f"{verb} under {the}{called}" for name, all_called in NAMES.items()
              for i, called in enumerate(all_called) for verb in ("licensed", "released", "distributed", "available") for the in ("", "the ")}

GNU_HEADER = TEMPLATES["GPL-3.0 header"]
TEMPLATES |= {
    "AGPL-3.0 header": GNU_HEADER.replace("GNU General", "GNU Affero General"),
    "GPL-2.0 header": GNU_HEADER.replace("version 3", "version 2"),
    "LGPL-2.1 header": GNU_HEADER.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("program", "library"),
    "LGPL-3.0 header": GNU_HEADER.replace("GNU General", "GNU Lesser General"),
}

#: Section 13 of the AGPL, which otherwise has the GPL's terms under its own name.
AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License,
if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer
network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing
access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating
copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU
General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License,
you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a
single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the
covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.

  """


def whole_texts() -> dict[str, str]:
    """Whole licenses by name, up to the end of their terms; the GPL-3.0 and AGPL-3.0 without preamble."""
    out = {f"{f.stem} text": f.read_text().split("END OF TERMS AND CONDITIONS")[0]
           for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    gpl = out["GPL-3.0 text"]
    gpl = out["GPL-3.0 text"] = gpl[gpl.index("TERMS AND CONDITIONS"):]
    before, after = gpl[:gpl.index("13. Use with")], gpl[gpl.index("14. Revised"):]
    named = [re.sub(r"GNU\s+General\s+Public", "GNU Affero General Public", part) for part in (before, after)]
    return out | {"AGPL-3.0 text": named[0] + AGPL_13 + named[1]}


TEMPLATES |= whole_texts()


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    before = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def unique_places(words: list, low: int, high: int) -> dict:
    """Place of each word that occurs once in words[low:high]."""
    place: dict = {}
    for i in range(low, high):
        place[words[i]] = -1 if words[i] in place else i
    return {w: i for w, i in place.items() if i >= 0}


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of the patience alignment of two word lists, in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = unique_places(a, a0, a1), unique_places(b, b0, b1)
        both = [(i, in_b[w]) for w, i in in_a.items() if w in in_b]
        both.sort()
        keep = [both[i] for i in longest_rising([j for _, j in both])]
        pairs += keep
        edge = (a0 - 1, b0 - 1)
        for i, j in [*keep, (a1, b1)] if keep else []:
            todo.append((edge[0] + 1, i, edge[1] + 1, j))
            edge = (i, j)
    return sorted(pairs)


@dataclass
class Index:
    """Templates' names, word hashes and sorted distinct words with counts; sorted run hashes with (template, place) of each."""

    names: list
    words: list
    bags: list
    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray


def index_of(templates: dict[str, str]) -> Index:
    names, words, bags, key, template, place = [], [], [], [], [], []
    for name, text in sorted(templates.items()):
        for _, _, data, offsets in W.pieces(pa.array([text], pa.string())):
            w = W.split_words(data, offsets, W.plain_words()).hash
            runs = W.runs(w, GRAM)
            at = np.arange(len(runs))
            if len(w) > LONG:
                once, first, n = np.unique(runs, return_index=True, return_counts=True)
                at = np.sort(first[n == 1])
            key += runs[at].tolist()
            template += [len(names)] * len(at)
            place += at.tolist()
            names.append(name.partition("#")[0])
            words.append(w.tolist())
            bags.append(np.unique(w, return_counts=True))
    key = np.array(key, np.uint64)
    order = np.argsort(key, kind="stable")
    return Index(names, words, bags, key[order], np.array(template, np.int64)[order], np.array(place, np.int64)[order])


def unbroken(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """(first pair, pairs) of the longest stretch of an alignment without words left out on either side."""
    best, first = (0, 0), 0
    for i in range(1, len(pairs) + 1):
        if i == len(pairs) or pairs[i] != (pairs[i - 1][0] + 1, pairs[i - 1][1] + 1):
            best = max(best, (first, i - first), key=lambda x: x[1])
            first = i
    return best


def may_reach(words: np.ndarray, bag: tuple, least: float) -> bool:
    """Whether the words a region shares with a template, counted with repeats, are enough for ``least``."""
    known, count = bag
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    held = np.bincount(at[known[at] == words], minlength=len(known))
    return np.minimum(held, count).sum() >= least * count.sum()


def found_in(words: np.ndarray, hits: list[tuple[int, int]], index: Index, least: float) -> list[tuple[float, int, int, int, int]]:
    """(coverage, template, first word, word after the last, matched) of each region; hits: (template, where it would begin)."""
    out = []
    at = 0
    while at < len(hits):
        t, begin = hits[at]
        n = len(index.words[t])
        slack = 2 + n // 4 if n > NOTICE else 0
        end = at
        while end + 1 < len(hits) and hits[end + 1][0] == t and hits[end + 1][1] - begin <= slack:
            end += 1
        if n <= NOTICE:
            # a notice must stand whole: aligned where its runs put it, and counted as far as nothing is left out or put in
            low = max(0, begin)
            pairs = aligned(index.words[t], words[low:max(0, begin + n)].tolist())
            first, size = unbroken(pairs)
            if size:
                out.append((size / n, t, low + pairs[first][1], low + pairs[first][1] + size, size))
            at = end + 1
            continue
        # the place most runs point at, the range they point at, then with some room: a copy right beside it would hide the unique words
        begins, votes = np.unique([b for _, b in hits[at:end + 1]], return_counts=True)
        usual = int(begins[votes.argmax()])
        last = hits[end][1]
        best = None
        if n <= LONG or may_reach(words[max(0, begin - slack):max(0, last + n + slack)], index.bags[t], least):
            for low, high in ((usual, usual + n), (begin, last + n), (begin - slack, last + n + slack)):
                low = max(0, low)
                pairs = aligned(index.words[t], words[low:max(0, high)].tolist())
                if pairs and (best is None or len(pairs) > best[4]):
                    best = (len(pairs) / n, t, low + pairs[0][1], low + pairs[-1][1] + 1, len(pairs))
                if len(pairs) == n:
                    break
        if best:
            out.append(best)
        at = end + 1
    return out


def apart(found: list, index: Index) -> list:
    """The regions that stay where some overlap by more than half of the shorter."""
    kept: list = []
    for r in sorted(found, key=lambda r: (len(index.words[r[1]]) - 2 * r[4], -r[0], index.names[r[1]], r[2])):
        if all(2 * (min(r[3], k[3]) - max(r[2], k[2])) <= min(r[3] - r[2], k[3] - k[2]) for k in kept):
            kept.append(r)
    return kept


COLUMNS = ("n_words bigint, n_found bigint, licenses string, best_license string, best_coverage double, found string")


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_found, licenses, best_license, best_coverage, found) for every row of ``docs``.

    ``licenses``: names found, sorted; ``found``: name:start:end:matched of
    each place found, in word numbers, by start.
    """
    sent = Sent(docs.sparkSession, index_of(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        seen = np.zeros(1 << 16, bool)
        seen[(index.keys >> np.uint64(48)).astype(np.int64)] = True
        size = [len(w) for w in index.words]
        for batch in batches:
            rows = []
            for _, _, data, offsets in W.pieces(batch.column(1)):
                w = W.split_words(data, offsets, W.plain_words())
                runs = W.runs(w.hash, GRAM)
                at = np.flatnonzero(seen[(runs >> np.uint64(48)).astype(np.int64)])
                first, last = np.searchsorted(index.keys, runs[at], "left"), np.searchsorted(index.keys, runs[at], "right")
                text = np.searchsorted(w.at, at, "right") - 1
                hits: list[list] = [[] for _ in range(len(w.at) - 1)]
                for p, a, b, t in zip(at.tolist(), first.tolist(), last.tolist(), text.tolist()):
                    if p + GRAM <= w.at[t + 1]:
                        n = w.at[t + 1] - w.at[t]
                        hits[t] += [(int(index.template[k]), int(p - w.at[t] - index.place[k])) for k in range(a, b)
                                    if size[index.template[k]] <= max(LONG, n / least)]
                for t, h in enumerate(hits):
                    got = found_in(w.hash[w.at[t]:w.at[t + 1]], sorted(h), index, least) if h else []
                    full = [g for g in got if g[0] >= (least if size[g[1]] > NOTICE else 1)]
                    good = sorted((a, b, index.names[k], m) for _, k, a, b, m in apart(full, index))
                    best = min(got, key=lambda g: (-g[0], -len(index.words[g[1]]), index.names[g[1]]), default=None)
                    rows.append((int(w.at[t + 1] - w.at[t]), len(good), ",".join(sorted({g[2] for g in good})),
                                 best and index.names[best[1]], best[0] if best else 0.0,
                                 ",".join(f"{name}:{a}:{b}:{m}" for a, b, name, m in good)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))],
                                             ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id bigint, {COLUMNS}"))
