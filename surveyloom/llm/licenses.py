"""License scans: winnowed fingerprints find template candidates, banded alignment reports spans.

Templates are cut into fingerprints (the smallest hash of every window of consecutive word
k-grams), which form an inverted index. A text that shares a stretch of WINDOW + GRAM - 1 words
with a template shares a fingerprint with it. Fingerprints that a template and a text share on
nearby diagonals open a region, which is aligned with the template in a band around them. Templates of
LONG words or more have an index of their own with longer grams, and windows of diagonals as regions.

A template of SHORT words or fewer must occur whole; a longer one must have its distinguishing phrases
(name, version) word for word. Of matches that overlap, one is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, WINDOW = 2, 2
BAND = 8
LEAST_COVERAGE = 0.8
#: Share of a template's fingerprints that a region must have. An edit breaks GRAM + WINDOW - 1 of them at
#: most, so a fifth of the words edited leaves two fifths.
LEAST_PRINTS = 0.25
#: Words up to which a template must occur whole, and from which it is a long one.
SHORT, LONG = 16, 400
LONG_GRAM, LONG_WINDOW = 3, 3
#: Of a long template, with a fifth of its words edited at even distances, a seventh of the fingerprints stays.
LONG_PRINTS = 0.1
MOST_FINGERPRINTS = 1_000_000
CACHE = 1 << 20
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
MATCH, MISMATCH, GAP = 2, -1, -1


class _Hashes(dict):
    """Hash of each lower-cased word met, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return value


_KNOWN = _Hashes()


def text_words(text: str) -> np.ndarray:
    """Hashes of the words, whatever their case; signs between words don't count."""
    found = _WORD.findall(text)
    return np.fromiter(map(_KNOWN.__getitem__, found), np.uint64, len(found))


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def grams(hashes: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window; all of a sequence shorter than a window."""
    if len(values) <= window:
        return np.arange(len(values))
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


class Index(NamedTuple):
    """Fingerprints in order, with the template and the word position of each entry."""

    prints: np.ndarray
    template: np.ndarray
    at: np.ndarray
    names: list[str]
    words: list[np.ndarray]
    needed: list[int]
    #: Of each template the phrases it must have, each as its length and the places where the template has it.
    phrases: list[list[tuple[int, list[int]]]]
    #: Fingerprints of templates too short for a window.
    tiny: np.ndarray
    long: Index | None


def _phrase(words: np.ndarray, phrase: str) -> tuple[int, list[int]]:
    wanted = text_words(phrase)
    n = len(wanted)
    places = [i for i in range(len(words) - n + 1) if (words[i : i + n] == wanted).all()]
    if not places:
        raise ValueError(f"a template does not have its phrase {phrase!r}")
    return n, places


def _index(rows: list[tuple[str, np.ndarray, list[str]]], gram: int, window: int, share: float, long: Index | None) -> Index:
    names, hashes, entries, needed, phrases, tiny = [], [], [], [], [], set()
    for name, h, wanted in rows:
        g = grams(h, gram)
        own = winnow(g, window)
        entries += [(int(g[i]), len(names), int(i)) for i in own]
        needed.append(max(1, int(share * len(own))))
        if len(g) < window:
            tiny.update(int(x) for x in g)
        names.append(name)
        hashes.append(h)
        phrases.append([_phrase(h, x) for x in wanted])
    entries.sort()
    prints = np.array([e[0] for e in entries], np.uint64)
    places = np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)
    return Index(prints, *places, names, hashes, needed, phrases, np.array(sorted(tiny), np.uint64), long)


def build_index(templates: DataFrame) -> Index:
    """The inverted index of (name, text) templates; a null or wordless template is left out, equal names keep one text.

    A third column ``needs`` may hold phrases of the text that a match must have word for word.
    """
    needs = F.col("needs") if "needs" in templates.columns else F.lit(None).cast("array<string>")
    rows = templates.where("name is not null and text is not null").groupBy("name").agg(F.min(F.struct("text", needs.alias("needs"))).alias("t"))
    distinct = rows.select("name", "t.*")
    size = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 16 * MOST_FINGERPRINTS:
        raise ValueError("the templates are too many to be sent to every task")
    found = [(r["name"], text_words(r["text"]), r["needs"] or []) for r in distinct.orderBy("name").collect()]
    long = [x for x in found if len(x[1]) >= LONG]
    second = _index(long, LONG_GRAM, LONG_WINDOW, LONG_PRINTS, None) if long else None
    return _index([x for x in found if 0 < len(x[1]) < LONG], GRAM, WINDOW, LEAST_PRINTS, second)


def _shared(index: Index, hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Template, diagonal and index entry of each fingerprint that a text shares, in this order."""
    g = grams(hashes, gram)
    own = winnow(g, window)
    if not len(own) or not len(index.prints):
        return None
    if len(index.tiny):
        own = np.union1d(own, np.flatnonzero(np.isin(g, index.tiny)))
    first = np.searchsorted(index.prints, g[own], "left")
    counts = np.searchsorted(index.prints, g[own], "right") - first
    hit = counts > 0
    if not hit.any():
        return None
    own, first, counts = own[hit], first[hit], counts[hit]
    entry = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    template, diagonal = index.template[entry], np.repeat(own, counts) - index.at[entry]
    order = np.lexsort((diagonal, template))
    return template[order], diagonal[order], entry[order]


def candidates(index: Index, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(template, first text word, last text word) of stretches whose shared fingerprints lie near one diagonal."""
    shared = _shared(index, hashes, GRAM, WINDOW)
    if shared is None:
        return []
    template, diagonal, entry = shared
    breaks = np.flatnonzero((np.diff(template) != 0) | (np.diff(diagonal) > BAND)) + 1
    out = []
    for group in np.split(np.arange(len(template)), breaks):
        t = int(template[group[0]])
        if len(group) < index.needed[t] or len(np.unique(entry[group])) < index.needed[t]:
            continue
        size = len(index.words[t])
        low, high = max(0, int(diagonal[group[0]]) - BAND), min(len(hashes), int(diagonal[group[-1]]) + size + BAND)
        # a long row of repeats is cut into stretches that overlap by more than a match can be long
        width = 2 * (size + 2 * BAND)
        out += [(t, a, min(high, a + 2 * width)) for a in range(low, max(low + 1, high - width), width)]
    return out


def long_candidates(index: Index, hashes: np.ndarray, least: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(template, [(lowest diagonal, highest)]) of long templates, the windows with more fingerprints first.

    Windows are half a template wide and overlap by half, so what drifts by less than a quarter lies in one.
    """
    if len(hashes) < least * min(len(w) for w in index.words):
        return
    shared = _shared(index, hashes, LONG_GRAM, LONG_WINDOW)
    if shared is None:
        return
    for t in np.unique(shared[0]):
        own = shared[0] == t
        diagonal, entry, step = shared[1][own], shared[2][own], len(index.words[t]) // 4
        windows = []
        for k in np.unique(np.concatenate((diagonal // step, diagonal // step - 1))):
            a, b = np.searchsorted(diagonal, (k * step, (k + 2) * step))
            n = len(np.unique(entry[a:b]))
            if n >= index.needed[t]:
                windows.append((-n, int(k * step), int((k + 2) * step)))
        yield int(t), [(a, b) for _, a, b in sorted(windows)]


def align_band(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, dict[int, int]] | None:
    """As ``align``, of diagonals from ``low`` to ``high`` only."""
    m, width = len(template), high - low + 1
    held = np.zeros(m + width, np.uint64)  # what lies outside the text equals no word
    a, b = max(0, low), min(len(text), low + len(held))
    if a >= b:
        return None
    held[a - low : b - low] = text[a:b]
    step = np.arange(width, dtype=np.int32)
    score = np.zeros((m + 1, width + 1), np.int32)  # the last column stays 0
    for i in range(1, m + 1):
        diagonal = score[i - 1, :-1] + np.where(held[i - 1 : i - 1 + width] == template[i - 1], MATCH, MISMATCH)
        best = np.maximum(0, np.maximum(score[i - 1, 1:] + GAP, diagonal))
        score[i, :-1] = np.maximum.accumulate(best - GAP * step) + GAP * step
    i, x = np.unravel_index(int(score.argmax()), score.shape)
    i, x = int(i), int(x)
    if not score[i, x]:
        return None
    end, first, pairs = i + x + low, i + x + low, {}
    while i and x >= 0 and score[i, x]:
        same = held[i - 1 + x] == template[i - 1]
        if score[i, x] == score[i - 1, x] + (MATCH if same else MISMATCH):
            i, first = i - 1, i - 1 + x + low
            if same:
                pairs[i] = first
        elif score[i, x] == score[i - 1, x + 1] + GAP:
            i, x = i - 1, x + 1
        else:
            x -= 1
    return len(pairs), first, end, pairs


def align(template: np.ndarray, text: np.ndarray) -> tuple[int, int, int, dict[int, int]] | None:
    """(matched words, first, end, text word of each matched word) of the best local alignment in a stretch of the text.

    The stretch was cut by the band, so each row is its width; a row is one vector step but for gaps
    in the text, which a running maximum carries.
    """
    m, n = len(template), len(text)
    if not m or not n:
        return None
    step = np.arange(n + 1)
    score = np.zeros((m + 1, n + 1), np.int32)
    for i in range(1, m + 1):
        diagonal = score[i - 1, :-1] + np.where(text == template[i - 1], MATCH, MISMATCH)
        best = np.maximum(0, np.maximum(score[i - 1] + GAP, np.concatenate(([0], diagonal))))
        score[i] = np.maximum.accumulate(best - GAP * step) + GAP * step
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    if not score[i, j]:
        return None
    end, matched, first, pairs = j, 0, j, {}
    while i and j and score[i, j]:
        same = text[j - 1] == template[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            matched, first = matched + bool(same), j
            if same:
                pairs[int(i)] = int(j)
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matched, int(first), int(end), pairs


def _says_so(index: Index, t: int, found: tuple[int, int, int, dict[int, int]]) -> bool:
    """Whether a match is whole, if the template is short, and has each phrase somewhere word for word."""
    matched, first, end, pairs = found
    size = len(index.words[t])
    if size <= SHORT:
        return matched == size == end - first
    runs = lambda n, p: all(pairs.get(p + i, -1) == pairs.get(p, -2) + i for i in range(n))
    return all(any(runs(n, p) for p in places) for n, places in index.phrases[t])


def scan_text(index: Index, text: str, least: float = LEAST_COVERAGE) -> list[tuple[str, int, int, int, int, int, float]]:
    """(template, start, end, first word, end word, matched words, coverage) of the matches, none of which overlap; spans in code points."""
    words = text_words(text)
    found: list[tuple[str, int, int, int, int]] = []  # name, size, first, end, matched
    for t, a, b in candidates(index, words):
        pending = [(a, b)]
        while pending:  # a stretch can hold a template more than once
            a, b = pending.pop()
            best = align(index.words[t], words[a:b])
            if best is None or best[0] / len(index.words[t]) < least:
                continue
            matched, first, end = best[0], best[1] + a, best[2] + a
            if _says_so(index, t, best):
                found.append((index.names[t], len(index.words[t]), first, end, matched))
            pending += [(a, first), (end, b)]
    for t, windows in long_candidates(index.long, words, least) if index.long else ():
        seen: list[int] = []
        for low, high in windows:
            size = len(index.long.words[t])
            if any(abs(low - x) <= size // 4 for x in seen):
                continue
            best = align_band(index.long.words[t], words, low, high)
            if best is not None and best[0] / size >= least and _says_so(index.long, t, best):
                found.append((index.long.names[t], size, best[1], best[2], best[0]))
                seen.append(low)
    places = word_places(text) if found else []
    # of matches that overlap, the one stays that matches most words, words missed taken off; of equal ones that of the smaller name
    kept: list[tuple] = []
    taken = np.zeros(len(words), bool)
    for name, size, first, end, matched in sorted(set(found), key=lambda m: (m[1] - 2 * m[4], m[0], m[2])):
        if not taken[first:end].any():
            taken[first:end] = True
            kept.append((name, places[first][0], places[end - 1][1], first, end, matched, round(matched / size, 6)))
    return sorted(kept, key=lambda m: (m[1], m[2], m[0]))


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, template, start, end, first_word, end_word, matched, coverage): a row per match of a template, the best one of each stretch.

    ``coverage`` is the share of the template's words that the alignment matches. Null, empty and
    wordless texts match nothing; repeated rows report alike; other columns are not read. No rows
    are shuffled: the index, of a checked size, goes to every task.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(templates))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, *m) for i, t in zip(b["doc_id"], b["text"]) for m in scan_text(index.value, t, least)]
            yield pd.DataFrame(found, columns=["doc_id", "template", "start", "end", "first_word", "end_word", "matched", "coverage"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id long, template string, start long, end long, first_word long, end_word long, matched long, coverage double")


# Well-known license notices.
TEMPLATES = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT-line", "Released under the MIT License."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("All-rights-reserved", "All rights reserved."),
    (
        "Apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
)


_IDS = """MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later
GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-2.1 LGPL-3.0
AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0
CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Unlicense Zlib BSL-1.0""".split()
_GNU = (("GPL", "", ("1", "2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("LGPL", "Library ", ("2",)), ("AGPL", "Affero ", ("3",)))
_CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ENDORSE = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
_ADVERTISE = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
)


def _gnu_notice(kind: str, version: str) -> str:
    program = "library" if kind in ("Lesser ", "Library ") and version != "3" else "program"
    terms = f"GNU {kind}General Public License"
    either = {"1": "either version 1, or (at your option) any later version"}.get(version, f"either version {version} of the License, or (at your option) any later version")
    return (
        f"This {program} is free software{':' if version == '3' else ';'} you can redistribute it and/or modify it under the terms of the {terms} as published by the Free "
        f"Software Foundation; {either}. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {terms} for more details."
    )


_BSD, _MIT = dict(TEMPLATES)["BSD-2-Clause"], dict(TEMPLATES)["MIT"]
_CONDITION = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
TEMPLATES += (
    ("MIT-0", _MIT.replace(_CONDITION, "")),
    ("BSD-2-Clause-text", f"{_BSD} {_DISCLAIMER}"),
    ("BSD-3-Clause", _BSD + _ENDORSE),
    ("BSD-3-Clause-text", f"{_BSD}{_ENDORSE} {_DISCLAIMER}"),
    ("BSD-4-Clause", _BSD + _ADVERTISE + _ENDORSE),
    ("BSD-4-Clause-text", f"{_BSD}{_ADVERTISE}{_ENDORSE} {_DISCLAIMER}"),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{short}-{v}{'' if '.' in v else '.0'}-notice", _gnu_notice(kind, v)) for short, kind, versions in _GNU for v in versions if (short, v) != ("GPL", "3")),
    *((f"{short}-{v}{'' if '.' in v else '.0'}-name{i}", text) for short, kind, versions in _GNU for v in versions
      for i, text in enumerate((f"GNU {kind}General Public License, version {v}", f"GNU {kind}General Public License v{v}", f"GNU {short} version {v}", f"GNU {short} v{v}"))),
    *((f"Apache-{v}-name{i}", text) for v in ("1.0", "1.1", "2.0") for i, text in enumerate((f"Apache License, Version {v}", f"Apache Software License, Version {v}", f"Apache License {v}"))),
    *((f"MPL-{v}-name{i}", text) for v in ("1.1", "2.0") for i, text in enumerate((f"Mozilla Public License, version {v}", f"Mozilla Public License {v}", f"Mozilla Public License, v. {v}"))),
    *((f"{x}-name", f"the {x} License") for x in ("MIT", "BSD", "ISC")),
    *((f"BSD-{n}-Clause-name{i}", text) for n in "234" for i, text in enumerate((f"BSD {n}-Clause License", f"BSD-{n}-Clause License", f"{n}-Clause BSD License"))),
    *((f"CC-{c}-{v}-name{i}", text) for c, words in _CC for v in ("2.0", "2.5", "3.0", "4.0")
      for i, text in enumerate((f"CC {c} {v}", f"CC-{c} {v}", f"Creative Commons {words} {v}", f"Creative Commons {words} License {v}"))),
    *((f"CC0-1.0-name{i}", text) for i, text in enumerate(("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero 1.0"))),
    *((f"SPDX-{x}", f"SPDX-License-Identifier: {x}") for x in _IDS),
)
#: Phrases by which a template is told from those of other names and versions.
NEEDS = {
    "Apache-2.0-notice": ["Apache License, Version 2.0"],
    "MPL-2.0-notice": ["Mozilla Public License, v. 2.0"],
    "BSD-3-Clause": ["may be used to endorse or promote products"],
    "BSD-3-Clause-text": ["may be used to endorse or promote products"],
    "BSD-4-Clause": ["All advertising materials"],
    "BSD-4-Clause-text": ["All advertising materials"],
    "ISC": ["and this permission notice appear in all copies"],
    **{f"{short}-{v}{'' if '.' in v else '.0'}-notice": [f"GNU {kind}General Public License", f"version {v}"] for short, kind, versions in _GNU for v in versions},
}
TEXTS = {
    "Apache-2.0": ["Apache License Version 2.0"], "GPL-1": ["GNU General Public License Version 1"], "GPL-2": ["GNU General Public License Version 2"],
    "GPL-3": ["GNU General Public License Version 3"], "LGPL-2": ["GNU Library General Public License Version 2"], "LGPL-2.1": ["GNU Lesser General Public License Version 2.1"],
    "LGPL-3": ["GNU Lesser General Public License Version 3"], "MPL-1.1": ["Mozilla Public License Version 1.1"], "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal"], "GFDL-1.2": ["GNU Free Documentation License Version 1.2"], "GFDL-1.3": ["GNU Free Documentation License Version 1.3"], "Artistic": [],
}


def known_templates(spark: SparkSession) -> DataFrame:
    """(name, text, needs): lines, notices, names and identifiers, and the full texts that are stored beside this file."""
    folder = Path(__file__).with_name("license_texts")
    rows = [(n, t, NEEDS.get(n, [])) for n, t in TEMPLATES]
    rows += [(f"{n}-full-text", (folder / f"{n}.txt").read_text("utf-8"), needs) for n, needs in TEXTS.items()]
    return spark.createDataFrame(rows, "name string, text string, needs array<string>")
