"""License scan by MinHash of overlapping windows (operator 7).

For each template size, windows of as many words, a quarter of that apart, are reduced to
MinHash values of their word shingles. A window and a template that agree in all ``ROWS`` values
of one of ``BANDS`` bands are compared exactly: the template is reported if at least
``CONTAINED`` of its distinct shingles occur around the window.

A template that lies in the text at that containment overlaps some window by 7/8, so their
Jaccard similarity is at least 0.8 * 7/8 / (2 - 0.8 * 7/8) = 0.53, and the probability that no
band agrees is at most (1 - 0.53 ** 2) ** 24 = 0.0004. Windows without any shingle of a template
are skipped: no value of theirs could equal one of a template.

Null and empty texts match nothing, equal rows are reported each, of several places of a
template in one text the first of the best counts, and an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa

from newsloom.llm.tables import documents
from newsloom.llm.textwords import HashSet, char_spans, grams, mix, words

SHINGLE = 5
CONTAINED = 0.8
BANDS = 24
ROWS = 2

SCHEMA = "doc_id long, license string, template int, containment double, start_char int, end_char int"

# License notices and texts, as (name, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]


class Templates:
    """Templates grouped by (words, words per shingle), with their shingles and band keys."""

    def __init__(self, templates):
        self.names = [t[0] for t in templates]
        self.sizes, self.shingles = [], []
        self.groups = {}  # (size, shingle length) -> templates
        for k, (_, text) in enumerate(templates):
            own = words(text)[2]
            q = min(SHINGLE, len(own))
            self.sizes.append(len(own))
            self.shingles.append(np.unique(grams(own, q)) if q else np.zeros(0, np.uint64))
            if q:
                self.groups.setdefault((len(own), q), []).append(k)
        self.known = {
            q: HashSet(np.concatenate([self.shingles[k] for (_, g), ks in self.groups.items() if g == q for k in ks]))
            for q in {q for _, q in self.groups}
        }
        self.keys = [band_keys(s[None, :]) if len(s) else None for s in self.shingles]

    def scan(self, hashes):
        """``(template, containment, first word, end word)`` for each template found."""
        out = []
        runs = {q: grams(hashes, q) for q in self.known}
        hits = {q: self.known[q].positions(runs[q]) for q in runs}
        for (size, q), templates in self.groups.items():
            at, own = hits[q], runs[q]
            if not len(at):
                continue
            wide = size - q + 1
            stride = max(1, size // 4)
            # windows over a hit, on the grid of the stride and the last one of the text
            steps = at[:, None] // stride - np.arange(-(-wide // stride) + 1)
            starts = np.unique(np.clip(steps * stride, 0, max(0, len(own) - wide)))
            places = np.minimum(starts[:, None] + np.arange(wide), len(own) - 1)
            keys = band_keys(own[places])
            for k in templates:
                near = starts[(keys == self.keys[k]).any(axis=1)]
                best = None
                for start in near.tolist():
                    low = max(0, start - size // 2)
                    around = own[low : start + wide + size // 2]
                    inside = np.flatnonzero(np.isin(around, self.shingles[k]))
                    share = len(np.unique(around[inside])) / len(self.shingles[k])
                    if share >= CONTAINED and (best is None or share > best[1]):
                        best = (k, share, low + int(inside[0]), low + int(inside[-1]) + q)
                if best:
                    out.append(best)
        return out


def band_keys(shingles):
    """One key for each row of ``shingles`` and band."""
    keys = []
    for band in range(BANDS):
        key = np.zeros(len(shingles), np.uint64)
        for row in range(ROWS):
            salt = np.uint64(0x632BE59BD9B4E019 * (band * ROWS + row + 1) % (1 << 64))
            key = mix(key + mix(shingles ^ salt).min(axis=1))
        keys.append(key)
    return np.stack(keys, axis=1)


def scan(docs, templates=None):
    """One row per document and template found: its best place. Texts without words match nothing.

    ``templates`` are ``(name, text)`` pairs, by default ``TEMPLATES``; they travel with the tasks.
    """
    known = Templates(templates or TEMPLATES)

    def of_batches(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                starts, ends, hashes = words(text)
                for k, share, a, b in known.scan(hashes) if len(hashes) else ():
                    span = char_spans(text, [(int(starts[a]), int(ends[b - 1]))])[0]
                    rows.append((doc_id, known.names[k], k, share, *span))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return documents(docs).mapInArrow(of_batches, SCHEMA)
