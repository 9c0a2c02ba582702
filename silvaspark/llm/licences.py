"""Licence scan: word-bigram Dice coefficient of normalised text windows against licence templates."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from silvaspark.llm.licence_templates import families, texts
from silvaspark.llm.parity_join import BASE, U, mix, word_hashes

LEAST = 0.9
WIDTHS = (1, 1.05, 1.1, 1.2)  # lengths of windows, in those of the template

# Licence notices and short licences as they stand in files, by SPDX identifier; licence_templates.py has more.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]

# Letters and digits (and every byte of non-ASCII characters) make words; all else separates them.
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PLAIN = bytes(32 if _SEPARATES[i] else i for i in range(256))


def bigrams(text: str) -> np.ndarray:
    """Hashes of the pairs of neighbouring words of the normalised (lower-case, no punctuation) text, in order."""
    w = word_hashes(text.encode().translate(_PLAIN))
    return mix((w[:-1] + U(1)) * BASE + w[1:]) if len(w) > 1 else np.zeros(0, U)


# Words and versions that tell members of a family apart; a text that differs in one of them is another licence's.
_CC_TELL = frozenset(["noncommercial", "sharealike", "noderivatives"])
_TELL = _CC_TELL | {"lesser", "affero", "later", "nc", "sa", "nd"}
_LEADS = frozenset(["version", "v", "license", "attribution", "by", *_CC_TELL, "nc", "sa", "nd"])
WHOLE = 500  # word pairs from which a template is a whole licence text, where versions and "later" stand in its prose


def _words(text: str) -> list[str]:
    out = text.encode().translate(_PLAIN).decode("utf-8", "replace").lower().split(" ")
    return ["noderivatives" if w == "noderivs" else w for w in out if w]


def _telling(words: list[str], stop: int, whole: bool) -> frozenset[str]:
    """What tells a licence from its siblings in the first ``stop`` words; a version may end beyond them."""
    head = words[:stop]
    if whole:
        return _CC_TELL.intersection(head)
    out = _TELL.intersection(head)
    for i in range(len(head) - 1):
        if head[i] == "library" and head[i + 1] == "general":
            out |= {"library"}
        elif head[i] in _LEADS and head[i + 1].isdigit():
            minor = words[i + 2] if i + 2 < len(words) and len(words[i + 2]) == 1 and words[i + 2].isdigit() else "0"
            out |= {f"{head[i + 1]}.{minor}"}
    return frozenset(out)


def _goes_on(name: str, words: list[str], short: bool) -> bool:
    """Whether the words after a notice make it a sibling's: a further clause, or a later version."""
    if name == "BSD-2-Clause" and short:
        return words[:1] == ["3"] or words[:3] == ["neither", "the", "name"]
    if name.startswith(("GPL", "LGPL", "AGPL")) and "later" not in name:
        return words[:1] == ["or"] and "later" in words[:7]
    return False


def _previous(places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the one before it that has the same id; -1 without."""
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    last = np.full(len(places), -1)
    last[order[1:][again]] = places[order[:-1][again]]
    return last


def _distinct(places: np.ndarray, last: np.ndarray, span: int, n: int) -> np.ndarray:
    """For each start below ``n``, how many different ids have a place in the window of ``span`` that begins there."""
    first = np.maximum(np.maximum(last, places - span) + 1, 0)
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(places + 1, minlength=n + 1))[:n]


class Scanner:
    """Templates' bigram sets with a table of their low bits, so that most words of a text cost one look-up."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.names, self.least = [n for n, _ in templates], least
        rows = [bigrams(t) for _, t in templates]
        self.sets, self.spans = list(map(np.unique, rows)), list(map(len, rows))
        self.known = np.unique(np.concatenate(self.sets))
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.known & U(0xFFFFF)).astype(np.int64)] = True
        self.owns = np.zeros((len(self.known), len(rows)), bool)
        for i, s in enumerate(self.sets):
            self.owns[np.searchsorted(self.known, s), i] = True
        # size bounds: Dice is at most 2 * min / (n + window), so fewer hits than this cannot reach the threshold
        self.need = np.array([least * len(s) / (2 - least) for s in self.sets])
        self.tells = [_telling(w, len(w), n >= WHOLE) for w, n in zip((_words(t) for _, t in templates), self.spans, strict=True)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """Licences found: ``(identifier, Dice, first word, words)``, the best of those that overlap, in order.

        A find inside one of a template so much longer that it cannot match on the shorter one alone is part of that.
        """
        b = bigrams(text)
        places = np.flatnonzero(self.low[(b & U(0xFFFFF)).astype(np.int64)])
        if not len(places):
            return []
        at = np.searchsorted(self.known, b[places])
        good = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == b[places])
        places, at = places[good], at[good]
        if len(places) < self.need.min():
            return []
        found, words, every, last_b = [], None, np.arange(len(b)), None
        for k in np.flatnonzero(np.count_nonzero(self.owns[at], axis=0) >= self.need):
            mine, n, span = self.owns[at, k], len(self.sets[k]), self.spans[k]
            p = places[mine]
            last, starts = _previous(p, at[mine]), np.unique(p)
            best, widths = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
            for width in sorted({math.ceil(span * x) for x in WIDTHS}):  # the template's length, and longer for words put in
                shared = _distinct(p, last, width, len(b))[starts]
                if not (enough := shared >= self.need[k]).any():
                    continue
                last_b = _previous(every, b) if last_b is None else last_b
                dice = np.where(enough, 2 * shared / (n + _distinct(every, last_b, width, len(b))[starts]), 0)
                better = dice > best
                best[better], widths[better] = dice[better], width
            if best.max() < self.least:
                continue
            words = _words(text) if words is None else words
            mine_taken: list[tuple[int, int]] = []
            for i in np.lexsort((starts, -best)):
                start, width = int(starts[i]), int(widths[i])
                if best[i] < self.least:
                    break
                if not _free(mine_taken, start, start + width + 1):
                    continue
                insort(mine_taken, (start, start + width + 1))
                stop = int(p[np.searchsorted(p, start + width) - 1]) + 2  # past the last word that the template has too
                if _telling(words[start : stop + 1], stop - start, span >= WHOLE) == self.tells[k] and not _goes_on(self.names[k], words[stop : stop + 7], span < 100):
                    found.append((-float(best[i]), -span, start, self.names[k], n, self.need[k], start + width))
        found = self._outermost(found)
        taken: list[tuple[int, int]] = []
        out = []
        for dice, _, start, name, _, _, end in sorted(found):
            if _free(taken, start, end + 1):
                insort(taken, (start, end + 1))
                out.append((name, -dice, start, end + 1 - start))
        return sorted(out, key=lambda x: x[2])

    @staticmethod
    def _outermost(found: list[tuple]) -> list[tuple]:
        """Without the finds that lie in one of a template too long to match on them alone; those of a template are apart."""
        by_need: dict[float, list[tuple[int, int]]] = {}
        for f in sorted(found, key=lambda f: f[2]):
            by_need.setdefault(f[5], []).append((f[2], f[6]))

        longest = {need: max(b - a for a, b in spans) for need, spans in by_need.items()}

        def inside(f: tuple) -> bool:
            for need, spans in by_need.items():
                if f[4] < need:
                    i = bisect_right(spans, f[2], key=lambda s: s[0]) - 1
                    while i >= 0 and spans[i][0] >= f[6] - longest[need]:
                        if f[6] <= spans[i][1]:
                            return True
                        i -= 1
            return False

        return [f for f in found if not inside(f)]


def _free(taken: list[tuple[int, int]], start: int, stop: int) -> bool:
    """Whether no span of ``taken``, sorted and apart, meets this one."""
    i = bisect_right(taken, (start, stop))
    return (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= stop)


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    """Kept by a worker from task to task: setting up costs more than a small task."""
    return Scanner(list(templates), least)


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: ``doc_id, licence`` (best match, null if none), ``dice, n_found, found``.

    ``found`` lists every licence in the text in order, as structs of ``licence, dice, first_word, n_words``. Whole
    texts are scanned, in windows as long as each template and up to a fifth longer. Ties go to the longer template, then to the earlier place.
    A window whose licence names or versions are not the template's (a sibling that has no template) is no find.
    Null, empty and one-word texts have none; repeated rows give repeated rows; other columns are not read. Templates
    (a fixed list) travel with the tasks; nothing is shuffled.
    """
    given = tuple(map(tuple, templates if templates is not None else TEMPLATES + families() + texts()))
    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(given, least)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            best = [min(f, key=lambda x: (-x[1], -x[3], x[2]), default=(None, None)) for f in found]
            listed = [[{"licence": a, "dice": d, "first_word": s, "n_words": n} for a, d, s, n in f] for f in found]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array(list(map(len, found)), pa.int64()), pa.array(listed, kind)], names=["doc_id", "licence", "dice", "n_found", "found"])

    schema = "doc_id long, licence string, dice double, n_found long, found array<struct<licence: string, dice: double, first_word: long, n_words: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
