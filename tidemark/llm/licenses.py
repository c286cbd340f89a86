"""Licence scans with a generalised suffix automaton of licence tokens.

All templates are read into one automaton over token ids. A file streams
through it: at each word the automaton holds the longest suffix read so far
that occurs in some template (the matching statistics). Matches of
``MIN_MATCH`` words or more that can't be extended are chained, in file and
template order, into spans. A span gives its template's label if it covers
``COVERED`` of the template, and with it every word that tells the template
from similar ones of other labels (those that have ``SIMILAR`` of its words:
"noncommercial", "affero", the number of a version). Where spans of several
labels overlap, the one that covers most words counts.

Words outside the templates end every match, so that only stretches of template
words go through the automaton. Defined results: a null or empty text has no
words and no labels, an empty table no rows; copies, and rows with the same or a
null id, are scanned each for itself and have equal results; only the id and the
text are read, so that further columns may have any name; texts are scanned
whole, however long.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

MIN_MATCH, COVERED, GAP, SIMILAR = 4, 0.6, 12, 0.5

# Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Texts of public licences and of the notices that refer to them, by label.
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [CONDITIONS, SOURCE, BINARY, "Licensed under the BSD License"],
    "bsd-3-clause": [f"{CONDITIONS}: 1. {SOURCE} 2. {BINARY} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-2-clause": [f"{CONDITIONS}: 1. {SOURCE} 2. {BINARY} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"],
    "isc": [ISC_GRANT, f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_WARRANTY}"],
    "0bsd": [f"{ISC_GRANT}. {ISC_WARRANTY}"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "GNU General Public License Version 2, June 1991",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "GNU Affero General Public License Version 3, 19 November 2007",
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "Eclipse Public License - v 2.0"],
    "epl-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "Eclipse Public License - v 1.0"],
    "cc0-1.0": [
        "has waived all copyright and related or neighboring rights to this work",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Creative Commons CC0 1.0 Universal",
    ],
    "boost-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    **{
        label: [f"Licensed under {short} 4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"licensed under the Creative Commons {name} 4.0 International License"]
        for label, short, name in [
            ("cc-by-4.0", "CC BY", "Attribution"),
            ("cc-by-nc", "CC BY-NC", "Attribution-NonCommercial"),
            ("cc-by-sa", "CC BY-SA", "Attribution-ShareAlike"),
            ("cc-by-nd", "CC BY-ND", "Attribution-NoDerivatives"),
            ("cc-by-nc-sa", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("cc-by-nc-nd", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        ]
    },
}
# Public identifiers behind "SPDX-License-Identifier:", by label.
IDENTIFIERS = {
    "apache-2.0": ["Apache-2.0"], "mit": ["MIT"], "bsd-2-clause": ["BSD-2-Clause"], "bsd-3-clause": ["BSD-3-Clause"], "isc": ["ISC"], "0bsd": ["0BSD"],
    "gpl-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"], "gpl-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"], "agpl-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "mpl-2.0": ["MPL-2.0"], "epl-1.0": ["EPL-1.0"], "epl-2.0": ["EPL-2.0"], "cc0-1.0": ["CC0-1.0"],
    "boost-1.0": ["BSL-1.0"], "zlib": ["Zlib"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"], "cc-by-4.0": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nd": ["CC-BY-ND-4.0"],
}
for _label, _ids in IDENTIFIERS.items():
    TEMPLATES[_label] = TEMPLATES[_label] + [f"SPDX-License-Identifier: {i}" for i in _ids]

#: A-Z to a-z; ASCII characters that aren't part of words to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Of several token sequences; states know where their strings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]

    def _state(self, length: int, link: int, next: dict[int, int]) -> int:
        self.next.append(next)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int], label: int) -> None:
        last = 0
        for i, t in enumerate(tokens):
            q = self.next[last].get(t)
            if q is not None:  # a prefix that another template has brought already
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
            else:
                p, new = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and t not in self.next[p]:
                    self.next[p][t] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][t]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
                last = new
            self.ends[last].append((label, i + 1))

    def close(self) -> None:
        """Hands the ends of every state up to the states whose strings are suffixes of its own."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]].extend(self.ends[s])
        self.ends[0] = []

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of every match that the next token doesn't extend."""
        s = n = 0
        for i, t in enumerate(tokens):
            if n and t not in self.next[s]:
                yield i, n, s
            while s and t not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if t in self.next[s]:
                s, n = self.next[s][t], n + 1
        if n:
            yield len(tokens), n, s


class Scanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self.vocab: dict[bytes, int] = {}
        self.sam, self.labels, self.sizes, self.tokens = SuffixAutomaton(), [], [], []
        self.base = [([self.token(w) for w in words_of(p.encode())], label) for p, label in base.items()]
        for label, texts in templates.items():
            for text in texts:
                ids = [self.token(w) for w in words_of(text.encode())]
                self.sam.add(ids, len(self.labels))
                self.labels.append(label)
                self.sizes.append(len(ids))
                self.tokens.append(ids)
        self.sam.close()
        #: Templates shorter than the shortest match are matched in full.
        self.least = min([MIN_MATCH, *self.sizes])
        self.needs = self._distinguishing()

    def _distinguishing(self) -> list[np.ndarray]:
        """Per template: how many words before each place are missing in a similar template of another label."""
        words = [frozenset(t) for t in self.tokens]
        needs = []
        for k, tokens in enumerate(self.tokens):
            rivals = [words[j] for j in range(len(words)) if self.labels[j] != self.labels[k] and len(words[j] & words[k]) >= SIMILAR * len(words[k])]
            telling = [any(t not in r for r in rivals) and self._tells(k, t, rivals) for t in tokens]
            needs.append(np.concatenate(([0], np.cumsum(telling))))
        return needs

    def _tells(self, k: int, token: int, rivals: list[frozenset]) -> bool:
        """Whether a word is one of few that a rival lacks; of long differences no single word is needed."""
        return any(token not in r and len(frozenset(self.tokens[k]) - r) <= MIN_MATCH for r in rivals)

    def token(self, word: bytes) -> int:
        return self.vocab.setdefault(word, len(self.vocab))

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of chained matches that no better one overlaps."""
        known = np.concatenate(([0], ids >= 0, [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
        open_chains: dict[int, list[int]] = {}  # template: file start, file end, template end, words covered, telling ones of these
        found: list[tuple[int, int, int, int]] = []

        def end_chain(k: int) -> None:
            start, end, _, covered, telling = open_chains.pop(k)
            if covered >= COVERED * self.sizes[k] and telling == self.needs[k][-1]:
                found.append((covered, start, end, k))

        for lo, hi in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
            for end, n, state in self.sam.statistics(ids[lo:hi].tolist()):
                for k, at in self.sam.ends[state]:
                    if n < min(MIN_MATCH, self.sizes[k]):
                        continue
                    needs = self.needs[k]
                    if chain := open_chains.get(k):
                        new = min(n, at - chain[2], lo + end - chain[1])
                        if new > 0 and lo + end - n - chain[1] <= GAP:
                            chain[1:] = [lo + end, at, chain[3] + new, chain[4] + int(needs[at] - needs[at - new])]
                            continue
                        if lo + end - n < chain[1] and chain[3] >= n:
                            continue  # another place of the template that says the same
                        end_chain(k)
                    open_chains[k] = [lo + end - n, lo + end, at, n, int(needs[at] - needs[at - n])]
        for k in list(open_chains):
            end_chain(k)
        return self._best(found)

    def _best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans that share no word with one of another label that covers more words, or as many and more of its template.

        Spans are decided from the best on; accepted ones of different labels don't
        overlap, so that a sorted list of them answers where a span stands.
        """
        rank = lambda f: (-f[0], -f[0] / self.sizes[f[3]], f[1], f[3])
        starts: list[int] = []
        taken: list[tuple[int, str]] = []  # ends and labels, in the order of ``starts``
        best = {}
        for covered, start, end, k in sorted(found, key=rank):
            label, i = self.labels[k], bisect_right(starts, start)
            near = [x for x in (taken[i - 1] if i else None,) if x and x[0] > start]
            j = i
            while j < len(starts) and starts[j] < end:
                near.append(taken[j])
                j += 1
            if any(x[1] != label for x in near):
                continue
            best[label, start, end] = max(best.get((label, start, end), 0.0), min(1.0, covered / self.sizes[k]))
            if not near:
                starts.insert(i, start)
                taken.insert(i, (end, label))
            else:  # one span for all of this label that touch
                lo = i - 1 if i and taken[i - 1][0] > start else i
                merged = (min(start, starts[lo]), max(end, max(x[0] for x in near)))
                starts[lo:j], taken[lo:j] = [merged[0]], [(merged[1], label)]
        return sorted(((label, s, e, share) for (label, s, e), share in best.items()), key=lambda x: (x[1], x[2], x[0]))

    def base_places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.base:
            ok = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
            for j, t in enumerate(phrase):
                ok &= ids[j : j + len(ok)] == t
            found += [(int(i), label) for i in np.flatnonzero(ok)]
        return sorted(found)

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        base, spans = self.base_places(ids), self.spans(ids)
        of_base = sorted({label for _, label in base})
        labels = sorted({*of_base, *(s[0] for s in spans)})
        best = max((s[3] for s in spans), default=0.0)
        return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(of_base), ",".join(labels), 1.0 if base else best, spans


@lru_cache(maxsize=4)
def _scanner(templates: tuple, base: tuple) -> Scanner:
    by_label = defaultdict(list)
    for label, text in templates:
        by_label[label].append(text)
    return Scanner(by_label, dict(base))


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the columns of ``SCANNED`` and ``spans``, an array of (label, start, end, covered) by word."""
    texts = tuple((label, t) for label, group in (templates or TEMPLATES).items() for t in group)
    phrases = tuple((base or BASE).items())
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(texts, phrases)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                *row, spans = scanner.scan(text)
                rows.append((doc_id, *row, [dict(zip(("label", "start", "end", "covered"), s)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCANNED.split(", ")] + ["spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(slim, run, SCANNED + ", spans array<struct<label:string,start:long,end:long,covered:double>>")


def op3_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
