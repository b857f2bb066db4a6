"""License scans by conditional compression.

Candidate blocks are windows of words around the words that no confirmed
notice can lack (``anchors``), wide enough for the longest template on both
sides; line breaks and comment markers do not end them.  Every block is
compressed with zstandard, alone and with each template as a raw dictionary.
The templates are ranked by how many bytes they save; those that save too
little are not looked at.  The first of them whose wording is confirmed wins: a
passage of the block differs from it in few words, counted exactly as missing,
changed and added ones, has the words that decide between licenses, and is not
compressed better by a template of another license.  Its words are taken, and
the rest of the block is ranked again until nothing more is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from churnkit.llm.textkit import keyed_text

# Wording of common license notices and the identifier they stand for.
NOTICES = {
    "Apache-2.0 notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0 header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
                          "file except in compliance with the License. You may obtain a copy of the License at "
                          "http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT notice": ("MIT", "Released under the MIT License."),
    "MIT grant": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                  "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                  "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                  "following conditions:"),
    "GPL-3.0 notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "GPL-3.0 header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                       "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                       "License, or (at your option) any later version."),
    "GPL-2.0 notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "LGPL-3.0 notice": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0 notice": ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    "BSD sentence": ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met:"),
    "MPL-2.0 header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY-4.0 notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0 notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0 notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "CC0-1.0 notice": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights."),
    "MIT licensed": ("MIT", "Licensed under the MIT license."),
    "BSD-2-Clause notice": ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause notice": ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "BSD-2-Clause grant": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                           "permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
                           "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                           "binary form must reproduce the above copyright notice, this list of conditions and the following "
                           "disclaimer in the documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause grant": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                           "permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
                           "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                           "binary form must reproduce the above copyright notice, this list of conditions and the following "
                           "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the "
                           "name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                           "products derived from this software without specific prior written permission."),
    "ISC grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                  "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "BSL-1.0 notice": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    "EPL-2.0 notice": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
                       "Public License 2.0"),
    "GPL-2.0 header": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                       "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
                       "your option) any later version."),
    "LGPL-2.1 header": ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the "
                        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                        "License, or (at your option) any later version."),
    "LGPL-3.0 header": ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the "
                        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                        "License, or (at your option) any later version."),
    "AGPL-3.0 header": ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                        "License, or (at your option) any later version."),
    "Zlib disclaimer": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
                        "authors be held liable for any damages arising from the use of this software."),
    "WTFPL": ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
              "changing it is allowed as long as the name is changed."),
    "Artistic-2.0 notice": ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    "CDDL-1.0 header": ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution "
                        "License."),
    "OFL-1.1 notice": ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    "EUPL-1.2 notice": ("EUPL-1.2", "Licensed under the European Union Public Licence, Version 1.2."),
    "MS-PL notice": ("MS-PL", "This source code is licensed under the Microsoft Public License."),
    "PSF-2.0 notice": ("PSF-2.0", "Licensed under the Python Software Foundation License Version 2."),
    "PostgreSQL notice": ("PostgreSQL", "Released under the PostgreSQL License."),
    "CC-BY-ND-4.0 notice": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-SA-4.0 notice": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-NC-ND-4.0 notice": ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
}
SENTENCES = {
    "CC-BY-4.0 sentence": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0 sentence": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                              "International License."),
}
# every license has its identifier line as well
LINES = {f"{v} line": (v, f"SPDX-License-Identifier: {v}") for v in sorted({v for v, _ in NOTICES.values()}) if " " not in v}
TEMPLATES = NOTICES | LINES | SENTENCES
WORD = re.compile(r"[0-9A-Za-z]+(?:[.'/-][0-9A-Za-z]+)*")
LINE_MARKER = re.compile(r"^[ \t]*(dnl|rem)\b", re.IGNORECASE | re.MULTILINE)
CLOSING = re.compile(r"""[.,;:!?)\]"']*""")
MIN_GAIN = 0.25
LEVEL = 6
MAX_WRONG = 0.15


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def placed_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words with their starts and ends, without the comment markers that look like words."""
    markers = {m.start(1) for m in LINE_MARKER.finditer(text)}
    found = [m for m in WORD.finditer(text) if m.start() not in markers]
    return [m.group().lower() for m in found], [m.start() for m in found], [m.end() for m in found]


class Scanner:
    """Templates with their compressors; one per Python worker."""

    def __init__(self, templates: dict[str, tuple[str, str]]):
        self.names = list(templates)
        self.licenses = [templates[n][0] for n in self.names]
        self.words = [words(templates[n][1]) for n in self.names]
        self.allowed = [int(MAX_WRONG * len(w)) for w in self.words]
        self.counts = [Counter(w) for w in self.words]
        self.places = []
        for w in self.words:
            places: dict[str, int] = {}
            for i, v in enumerate(w):
                places[v] = places.get(v, 0) | 1 << i
            self.places.append(places)
        # any passage with at most ``allowed`` differences holds one of allowed + 1 different words
        self.anchors = [set(sorted(set(w), key=lambda v: (-len(v), v))[:n + 1]) for w, n in zip(self.words, self.allowed)]
        self.anchor_words = set().union(*self.anchors)
        self.finder = ahocorasick.Automaton()
        for v in self.anchor_words:
            self.finder.add_word(v, v)
        if self.anchor_words:
            self.finder.make_automaton()
        self.deciding = [self._deciding(i) for i in range(len(self.words))]
        self.reach = max((len(w) + n for w, n in zip(self.words, self.allowed)), default=0)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.primed = []
        for w in self.words:
            template = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            template.precompute_compress(level=LEVEL)
            self.primed.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=template))
        self.alone = lru_cache(20_000)(lambda passage: len(self.plain.compress(passage.encode())))
        self.saved = lru_cache(50_000)(self._saved)

    def _deciding(self, i: int) -> Counter:
        """Words that a notice of this template cannot lack: those with digits, and those that tell it from a much
        alike template of another license."""
        out = {w for w in self.words[i] if any(c.isdigit() for c in w)}
        for j, other in enumerate(self.counts):
            extra = self.counts[i] - other
            if self.licenses[j] != self.licenses[i] and extra.total() <= max(2, self.allowed[i]):
                out |= set(extra)
        return Counter({w: self.counts[i][w] for w in out})

    def _saved(self, i: int, passage: str) -> int:
        """Bytes that the template as dictionary saves on the passage."""
        return self.alone(passage) - len(self.primed[i].compress(passage.encode()))

    def gain(self, i: int, passage: str) -> float:
        """The bytes saved as a share of the template's own, or of the passage's where that is smaller."""
        return self.saved(i, passage) / max(1, min(self.alone(passage), len(" ".join(self.words[i]))))

    def ranking(self, said: list[str]) -> list[int]:
        """Templates that save enough on these words, those that save most first; of equal ones the longer."""
        block, here = " ".join(said), set(said)
        near = [i for i, a in enumerate(self.anchors) if a & here and self.gain(i, block) >= MIN_GAIN]
        return sorted(near, key=lambda i: (-self.saved(i, block), -len(self.words[i]), i))

    def distances(self, i: int, said: list[str]) -> list[int]:
        """Fewest differences between template ``i`` and a passage that ends with each word (bit-parallel edit distance)."""
        m, places = len(self.words[i]), self.places[i]
        full, top = (1 << m) - 1, 1 << m - 1
        up, down, score, out = full, 0, m, []
        for w in said:
            eq = places.get(w, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up) & full
            mh = up & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            up, down = mh | ~(xv | ph) & full, ph & xv
            out.append(score)
        return out

    @staticmethod
    def align(template: list[str], said: list[str]) -> tuple[int, int, int, int, int]:
        """(first, last, missing, changed, added) of the best passage that ends where ``said`` ends; first and
        last are the outermost words that agree."""
        rows = [[0] * (len(said) + 1)]
        for i, w in enumerate(template):
            above, row = rows[-1], [i + 1]
            for j, v in enumerate(said):
                row.append(min(above[j] + (w != v), above[j + 1] + 1, row[j] + 1))
            rows.append(row)
        i, j, agree, missing, changed, added = len(template), len(said), [], 0, 0, 0
        while i:
            here = rows[i][j]
            if j and here == rows[i - 1][j - 1] + (template[i - 1] != said[j - 1]):
                i, j = i - 1, j - 1
                if template[i] == said[j]:
                    agree.append(j)
                else:
                    changed += 1
            elif here == rows[i - 1][j] + 1:
                i, missing = i - 1, missing + 1
            else:
                j, added = j - 1, added + 1
        return (agree[-1], agree[0], missing, changed, added) if agree else (0, -1, missing, changed, added)

    def passages(self, i: int, said: list[str]) -> list[tuple[int, int, int, int, int]]:
        """Disjoint passages (as by ``align``) that template ``i`` explains, those with the fewest differences first."""
        if len(said) < len(self.words[i]) - self.allowed[i] or not self.words[i]:
            return []
        have = Counter(w for w in said if w in self.places[i])
        # a confirmed passage has all but the allowed number of the template's words
        if sum((have & self.counts[i]).values()) < len(self.words[i]) - self.allowed[i]:
            return []
        ends = sorted((d, j) for j, d in enumerate(self.distances(i, said)) if d <= self.allowed[i])
        span, out = len(self.words[i]) + self.allowed[i], []
        for _, j in ends:
            if any(a <= j <= b for a, b, *_ in out):
                continue
            low = max(0, j + 1 - span)
            a, b, *wording = self.align(self.words[i], said[low:j + 1])
            if a <= b and not any(a + low <= y and x <= b + low for x, y, *_ in out):
                out.append((a + low, b + low, *wording))
        return out

    def confirmed_by(self, i: int, said: list[str], rivals: list[int]) -> list[tuple[int, int, int, int, int]]:
        """The passages of ``said`` that template ``i`` explains: few differences, every deciding word, and no rival of
        another license that saves more on the passage."""
        out = []
        for x, y, *wording in self.passages(i, said):
            passage = said[x:y + 1]
            if self.deciding[i] - Counter(passage):
                continue
            text = " ".join(passage)
            mine = self.saved(i, text)
            if self.gain(i, text) >= MIN_GAIN and not any(
                    self.licenses[j] != self.licenses[i] and self.saved(j, text) > mine for j in rivals):
                out.append((x, y, *wording))
        return out

    def confirmed(self, said: list[str], free: list[bool], low: int, high: int, own: set[int]):
        """Every passage among the free words from ``low`` to ``high`` that a template explains and that has one of
        the places ``own``; takes its words.  Yields (first, last, license, template, gain, missing, changed, added)."""
        more = True
        while more:
            more, a = False, low
            while a < high:
                if not free[a]:
                    a += 1
                    continue
                b = a
                while b < high and free[b]:
                    b += 1
                ranked = self.ranking(said[a:b])
                for i in ranked:
                    hits = [(x + a, y + a, *w) for x, y, *w in self.confirmed_by(i, said[a:b], ranked)]
                    hits = [h for h in hits if any(p in own for p in range(h[0], h[1] + 1))]
                    for x, y, *wording in hits:
                        free[x:y + 1] = [False] * (y + 1 - x)
                        yield x, y, self.licenses[i], self.names[i], round(self.gain(i, " ".join(said[x:y + 1])), 4), *wording
                    if hits:  # what is left of the block is ranked anew
                        more = True
                        break
                a = b

    def scan(self, text: str | None):
        """(start, end, license, template, gain, missing, changed, added) of each passage that a template explains."""
        if not text or not self.anchor_words or next(self.finder.iter(text.lower()), None) is None:
            return
        said, starts, ends = placed_words(text)
        mentions = [i for i, w in enumerate(said) if w in self.anchor_words]
        free, found, done = [True] * len(said), [], 0
        while done < len(mentions):
            # the mentions of one block, which reaches far enough to both sides of each of them
            stop = bisect_left(mentions, mentions[done] + self.reach)
            low, high = max(0, mentions[done] - self.reach), min(len(said), mentions[stop - 1] + self.reach + 1)
            found += self.confirmed(said, free, low, high, set(mentions[done:stop]))
            done = stop
        for x, y, *rest in sorted(found):
            yield starts[x], CLOSING.match(text, ends[y]).end(), *rest


_scanners: dict[int, Scanner] = {}


def _scanner(templates: dict) -> Scanner:
    key = hash(tuple(sorted(templates.items())))
    if key not in _scanners:
        _scanners[key] = Scanner(templates)
    return _scanners[key]


FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.string()),
                   ("gain", pa.float64()), ("missing", pa.int64()), ("changed", pa.int64()), ("added", pa.int64())])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and ``found`` (start, end in code points, license, template, gain, words missing, changed
    and added) for every row; texts without a confirmed notice, null and empty ones have an empty array."""
    docs = keyed_text(df, id_col, text_col)
    templates = templates or TEMPLATES

    def run(batches):
        scanner = _scanner(templates)
        names = [f.name for f in FOUND]
        for b in batches:
            found = [[dict(zip(names, f)) for f in scanner.scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(FOUND))], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, found array<struct<start:bigint,end:bigint,license:string,template:string,"
                                "gain:double,missing:bigint,changed:bigint,added:bigint>>")
