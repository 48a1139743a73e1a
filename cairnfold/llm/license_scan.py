"""License scans by conditional compression: a block that a license text explains compresses well with it as dictionary."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and licence texts in their public wording; <...> stands for what differs from case to case.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    (
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
_GAP = r"[^0-9A-Za-z,.:]"
#: What a text must hold for a place to become a candidate; line ends and comment signs may lie between the words.
CLUES = rf"(?i)licen[cs]|copyright|all{_GAP}+rights{_GAP}+reserved|public{_GAP}+domain|creative{_GAP}+commons|\bCC{_GAP}*(?:BY|0)|permission|redistribut|free{_GAP}+software|waived"
#: Characters around a clue in which its notice is sought on each side (the longest template has under 600); lines longer than this are looked at around each clue.
REACH = 1500
LEVEL = 9
#: Templates, best reductions first, of which the closest describes a block without a confirmed notice.
RANKED = 3
#: Words of a template that may differ, in hundredths.
SLACK = 10
#: Templates of fewer words must be there word for word; a notice may hold as many other words between its own as it has words, or this many.
SHORT = 12

#: Words, or parts of hyphened ones, that tell one licence from another: none may be missing from a notice, and none may come in. So may no number but a year.
TELLING = frozenset("mit apache bsd isc mozilla mpl gpl lgpl agpl lesser affero cc cc0 nc sa nd attribution noncommercial sharealike noderivatives noderivs clause only exception".split())
#: Notices of these names have a second one if these words follow.
LATER = {"GPL-2.0": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-or-later", "LGPL-3.0": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-or-later"}

_number = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
_year = re.compile(r"(?:19|20)[0-9]{2}")
_later = re.compile(r"(?i)[\s,#*/;(]*or[\s#*/;(]+(?:at\s+your\s+option[\s)]+)?(?:any\s+)?(?:later|newer|above)\b")
_clue = re.compile(CLUES)
#: A word may be broken behind a hyphen at the end of a line.
_broken = r"-[ \t\r]*\n[ \t#*/;%>|!]*"
_word = re.compile(rf"[0-9A-Za-z]+(?:(?:{_broken}|[.\-])[0-9A-Za-z]+)*")
_mend = re.compile(_broken)
_tail = re.compile(r"[^\s0-9A-Za-z]*")


def words(text: str) -> list[str]:
    return [_mend.sub("-", w).lower() for w in _word.findall(text)]


def telling(word: str) -> bool:
    """Whether a word says which licence, or which version of it, is meant."""
    return any(x in TELLING or (_number.fullmatch(x) and not _year.fullmatch(x)) for x in word.split("-"))


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks: runs of lines with clues (one line without may lie between), or surroundings of clues in long lines."""
    out: list[list[int]] = []
    at = quiet = 0
    spread = sorted(x for m in _clue.finditer(text) if "\n" in m[0] for x in (m.start(), m.end() - 1))  # clues over line ends count in their first and last lines
    for line in text.split("\n"):
        end = at + len(line)
        if len(line) > REACH:
            for m in _clue.finditer(line):
                lo, hi = at + max(0, m.start() - REACH // 2), at + min(len(line), m.end() + REACH // 2)
                if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * REACH:
                    out[-1][1] = max(hi, out[-1][1])
                else:
                    out.append([lo, hi])
            quiet = 9
        elif _clue.search(line) or bisect_left(spread, at) < bisect_left(spread, end):
            if out and quiet <= 1 and out[-1][1] < at and end - out[-1][0] <= 4 * REACH:
                out[-1][1] = end
            else:
                out.append([at, end])
            quiet = 0
        else:
            quiet += 1
        at = end + 1
    return [(a, b) for a, b in out]


def regions(text: str, cores: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The blocks with REACH characters on both sides, joined where they meet."""
    out: list[tuple[int, int]] = []
    for lo, hi in cores:
        lo, hi = max(0, lo - REACH), min(len(text), hi + REACH)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def windows(template: np.ndarray, own: np.ndarray, slack: int) -> list[tuple[int, int, int]]:
    """Shortest runs of own words that hold the template's in order, with 0 to slack of them missing: (first, last, missing).

    Exact. state[k][j] is the latest start of a run that ends before word j and lacks at most k of the template's words
    so far; n stands for a run not begun.
    """
    n = len(own)
    here = np.arange(n, dtype=np.int64)
    state = [np.full(n + 1, n, np.int64) for _ in range(slack + 1)]
    for i, word in enumerate(template):
        at = own == word
        new = []
        for k in range(slack + 1):
            begun = np.where(state[k][:-1] == n, here, state[k][:-1])
            ends = np.concatenate([[-1], np.maximum.accumulate(np.where(at, begun, -1))])
            new.append(np.maximum(ends, state[k - 1]) if k else ends)
        state = new
    out = []
    for k, s in enumerate(state):
        last = np.flatnonzero(s[1:] > s[:-1])
        out += [(int(s[j + 1]), int(j), k) for j in last if s[j + 1] < n]
    return out


@dataclass
class Verdict:
    license: str | None
    template: int
    plain: int
    given: int
    missing: int
    extra: int
    wording: list[str]
    lo: int = 0  # characters of the notice
    hi: int = 0

    @property
    def reduction(self) -> float:
        return (self.plain - self.given) / max(self.plain, 1)


class Scanner:
    """Compresses blocks with each template as a raw dictionary; buffers and tables are built once."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        import zstandard

        self.templates = templates
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False, level=LEVEL)
        self.plain = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, text in templates]
        self.words = [words(text) for _, text in templates]
        self.counts = [Counter(w) for w in self.words]
        self.codes = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}

    def sizes(self, block: bytes) -> tuple[int, list[int]]:
        return len(self.plain.compress(block)), [len(c.compress(block)) for c in self.given]

    def notices(self, text: str, lo: int = 0, hi: int | None = None) -> list[Verdict]:
        """Every template whose wording text[lo:hi] has, wherever it has it; not those whose words another's match holds."""
        hi = len(text) if hi is None else hi
        spans = [m.span() for m in _word.finditer(text, lo, hi)]
        if lo and spans and spans[0][0] == lo and _word.match(text[lo - 1]):  # words that the ends cut
            spans.pop(0)
        if spans and spans[-1][1] == hi and _word.match(text[hi : hi + 1]):
            spans.pop()
        own = [_mend.sub("-", text[a:b]).lower() for a, b in spans]
        there = Counter(own)
        coded = np.array([self.codes.get(w, -1) for w in own], np.int64)
        hits = []
        for t, template in enumerate(self.words):
            size = len(template)
            slack = size * SLACK // 100 if size >= SHORT else 0
            if sum((self.counts[t] - there).values()) > slack:  # more words are missing than may
                continue
            code = np.array([self.codes[w] for w in template], np.int64)
            runs = [(b - a + 1 - (size - k), k, a, b) for a, b, k in windows(code, coded, slack)]
            taken: list[tuple[int, int]] = []
            for extra, missing, a, b in sorted((x for x in runs if x[0] <= max(size, SHORT)), key=lambda x: (x[0] + x[1], *x[1:])):
                if all(b < c or d < a for c, d in taken):
                    taken.append((a, b))
                    if extra or missing:
                        at_t, at_o = (set(x) for x in aligned(template, own[a : b + 1]))
                        if any(telling(w) for i, w in enumerate(template) if i not in at_t) or any(telling(w) for i, w in enumerate(own[a : b + 1]) if i not in at_o):
                            continue  # the wording of another licence
                    hits.append((frozenset(a + x for x in aligned(template, own[a : b + 1])[1]), missing, extra, t, a, b))
        hits.sort(key=lambda x: (-len(x[0]), *x[1:]))
        kept: list[tuple] = []
        for hit in hits:
            name = self.templates[hit[3]][0]
            if not any(hit[0] <= k[0] or (self.templates[k[3]][0] == name and hit[0] & k[0]) for k in kept):
                kept.append(hit)
        # a wording with gaps that is made up of words of better ones is none of its own
        kept = [h for h in kept if not h[0] <= frozenset().union(*(k[0] for k in kept if k[1] + k[2] < h[1] + h[2]))]
        out = []
        for _, _, _, t, a, b in sorted(kept, key=lambda x: (x[4], x[5], x[3])):
            start, end = spans[a][0], _tail.match(text, spans[b][1], hi).end()
            at_t, at_o = (set(x) for x in aligned(self.words[t], own[a : b + 1]))
            missing = [w for i, w in enumerate(self.words[t]) if i not in at_t]
            extra = [w for i, w in enumerate(own[a : b + 1]) if i not in at_o]
            name = self.templates[t][0]
            if name in LATER and (m := _later.match(text, spans[b][1], hi)):
                name, end = LATER[name], m.end()
            notice = text[start:end].encode("utf-8", "surrogatepass")
            out.append(Verdict(name, t, len(self.plain.compress(notice)), len(self.given[t].compress(notice)), len(missing), len(extra), [*(f"-{w}" for w in missing), *(f"+{w}" for w in extra)], start, end))
        return out

    def judge(self, block: str) -> Verdict:
        """The confirmed notice with fewest words missing, then most words; else the closest template, unconfirmed."""
        found = self.notices(block)
        return min(found, key=lambda v: (v.missing, -len(self.words[v.template]))) if found else self.closest(block)

    def closest(self, block: str) -> Verdict:
        """Of the templates that shrink the block most, the one with fewest words missing. Nothing is confirmed here."""
        plain, given = self.sizes(block.encode("utf-8", "surrogatepass"))
        own = words(block)
        ranked = sorted(range(len(given)), key=lambda t: (given[t], len(self.words[t]), t))
        # equal reductions share a rank
        limit = given[ranked[min(RANKED, len(ranked)) - 1]]
        best: tuple | None = None
        for t in (t for t in ranked if given[t] <= limit):
            missing, extra, wording = differences(self.words[t], own)
            key = (missing, given[t], -len(self.words[t]), t)
            if best is None or key < best[0]:
                best = (key, Verdict(None, t, plain, given[t], missing, extra, wording))
        return best[1]


def aligned(template: list[str], own: list[str]) -> tuple[list[int], list[int]]:
    """Places in both of a longest common run of words in order."""
    if template == own:
        return list(range(len(own))), list(range(len(own)))
    table = [[0] * (len(own) + 1)]
    for w in reversed(template):
        row, below = [0] * (len(own) + 1), table[-1]
        for j in range(len(own) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if own[j] == w else max(below[j], row[j + 1])
        table.append(row)
    table.reverse()
    at_t, at_o, i, j = [], [], 0, 0
    while i < len(template) and j < len(own):
        if template[i] == own[j]:
            at_t.append(i)
            at_o.append(j)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return at_t, at_o


def differences(template: list[str], own: list[str]) -> tuple[int, int, list[str]]:
    """Words of the template that the block lacks, words that the block has among them, and these as -word and +word."""
    blocks_ = [m for m in difflib.SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
    if not blocks_:
        return len(template), 0, [f"-{w}" for w in template]
    missing, extra, at_t, at_o = [], [], 0, blocks_[0].b
    for m in blocks_:
        missing += template[at_t : m.a]
        extra += own[at_o : m.b]
        at_t, at_o = m.a + m.size, m.b + m.size
    missing += template[at_t:]
    return len(missing), len(extra), [*(f"-{w}" for w in missing), *(f"+{w}" for w in extra)]


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


_FOUND = "id long, block int, start long, length long, license string, confirmed boolean, plain_bytes int, given_bytes int, reduction double, missing int, extra int, wording array<string>, notice string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
    names = [x.split()[0] for x in _FOUND.split(", ")]
    memory: dict[str, Verdict] = {}
    for batch in batches:
        rows = []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cores = blocks(text)
            found = [v for lo, hi in regions(text, cores) for v in scanner.notices(text, lo, hi)]
            owned: dict[int, list[Verdict]] = {}
            touched = set()
            for v in found:
                at = [n for n, (lo, hi) in enumerate(cores) if v.lo < hi and lo < v.hi]
                touched.update(at)
                # a notice over several blocks belongs to the first
                owned.setdefault(at[0] if at else min(range(len(cores)), key=lambda n: max(cores[n][0] - v.hi, v.lo - cores[n][1])), []).append(v)
            for n, (lo, hi) in enumerate(cores):
                for v in owned.get(n, ()):
                    rows.append((id_, n, v.lo, v.hi - v.lo, v.license, True, v.plain, v.given, v.reduction, v.missing, v.extra, v.wording, text[v.lo : v.hi]))
                if n not in touched and n not in owned:
                    block = text[lo:hi]
                    v = memory.get(block) or scanner.closest(block)
                    if len(block) < 200 and len(memory) < 10_000:
                        memory[block] = v
                    rows.append((id_, n, lo, hi - lo, None, False, v.plain, v.given, v.reduction, v.missing, v.extra, v.wording, block))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per notice found and per candidate block without one: (id, block, start, length, license, confirmed, plain_bytes, given_bytes, reduction, missing, extra, wording, notice).

    A notice is a template's words in order, at most a tenth of them missing (none of short ones), with as many other words
    among them at most; words that name a licence, its family or version may neither be missing nor come in, so a
    relative's notice is no notice. Every template is sought in each block and its surroundings; block is the first block
    that the notice meets. start, length and notice are in characters of the whole text: the notice's own, or, where
    license is null, those of the block in which no wording is confirmed; the sizes and word differences are then those
    of the template that came closest (ties: fewest bytes, then the longer, then the earlier template). Documents without
    a clue, null and empty texts give no row; an empty table gives none. Texts of any length are read whole, long lines
    around each clue, as far as the longest template can reach. Null ids and repeated rows are scanned like others. One
    pass, no shuffle.
    """
    rows = docs.where(F.col(text).rlike(CLUES)).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scanned, _FOUND).withColumnRenamed("id", id)
