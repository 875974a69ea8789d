"""Operator 8: licence scans. MinHash bands over overlapping windows retrieve templates, exact
shingle containment verifies them.

Signs count as spaces and A-Z as a-z. A template of m five-word shingles is looked for in windows of
2 m shingles that start every m, so a whole occurrence lies in one window and a window that holds 0.8
of it has a similarity of at least 0.8 m / (2 m + 0.2 m) > 0.36. With COORDS bands of one coordinate the
chance to miss it is 0.64 ** 40 < 2e-8. Windows with fewer than CONTAINED times m shingles of the
templates of their size can't match and aren't sketched. A licence is found where a window holds at least CONTAINED of a template, unless a better match in the
document holds the same shingles.

The templates are notices and the bodies of the licences in license_texts, in passages of up to 36 words,
so a part of a licence that holds one of them is found too. A family (GPL, GNU, CC, ...) is named only if
none of its versions is found.

A null or empty text, or one of fewer words than a shingle, has no licence. Each row is scanned by
itself, over its whole text; templates are a fixed list, so nothing grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS_OFF, blocks, byte_view, ranges, shingles, words
from .license_texts import PASSAGES
from .sketch import sketch

K, COORDS, CONTAINED = 5, 40, 0.8
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, text) for name, texts in PASSAGES.items() for text in texts),
]
# names without a version, and how the names that tell more begin
FAMILIES = {
    "GNU": ("GPL", "LGPL", "AGPL"), "GPL": ("GPL-",), "LGPL": ("LGPL-",), "MPL": ("MPL-",), "EPL": ("EPL-",), "BSD": ("BSD-",), "CC": ("CC-",),
}


def _shingled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingles; none of shorter texts."""
    w, woff = words(SIGNS_OFF[data], off)
    size = np.diff(woff)
    if ((size > 0) & (size < K)).any():
        keep = np.repeat(size >= K, size)
        w, woff = w[keep], np.concatenate([[0], np.cumsum(np.where(size >= K, size, 0))])
    return shingles(w, woff, K)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        data, off = byte_view(pa.array([t for _, t in templates]))
        h, at = _shingled(data, off)
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(templates))]
        self.size = np.array([len(s) for s in self.sets])
        if not self.size.all():
            raise ValueError(f"a template needs at least {K} words")
        self.all = np.unique(np.concatenate(self.sets))
        self.of_size = {m: np.unique(np.concatenate([s for s in self.sets if len(s) == m])) for m in np.unique(self.size)}
        cut = np.concatenate([[0], np.cumsum(self.size)])
        self.coords = sketch(np.concatenate(self.sets), cut, COORDS)

    def scan(self, data: np.ndarray, off: np.ndarray) -> dict[int, dict[str, float]]:
        """By document, the licences with the best containment of any of their templates."""
        h, at = _shingled(data, off)
        found: dict[int, dict[str, float]] = {}
        if not len(h):
            return found
        p = np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)
        hit = np.flatnonzero(self.all[p] == h)
        if not len(hit):
            return found
        matches: dict[int, dict[tuple[int, bytes], tuple[float, int, set[int]]]] = {}  # the same part of a template once
        for m, of_size in self.of_size.items():
            near = hit[np.isin(h[hit], of_size)]
            doc = np.searchsorted(at, near, "right") - 1
            place = (near - at[doc]) // m  # a place is in the windows that start at its step and at the one before
            key = np.unique(np.concatenate([doc * (1 << 40) + place, doc * (1 << 40) + np.maximum(place - 1, 0)]))
            d = key >> 40
            lo = at[d] + (key & ((1 << 40) - 1)) * m
            hi = np.minimum(lo + 2 * m, at[d + 1])
            enough = np.searchsorted(near, hi) - np.searchsorted(near, lo) >= CONTAINED * m - 1e-9
            d, lo, hi = d[enough], lo[enough], hi[enough]
            if not len(d):
                continue
            flat, size = h[ranges(lo, hi - lo)], hi - lo
            coords = sketch(flat, np.concatenate([[0], np.cumsum(size)]), COORDS)
            for t in np.flatnonzero(self.size == m):
                for i in np.flatnonzero((coords == self.coords[t]).any(1)):
                    there = np.isin(self.sets[t], h[lo[i] : hi[i]])
                    if there.mean() >= CONTAINED:
                        matches.setdefault(int(d[i]), {})[int(t), there.tobytes()] = (float(there.mean()), int(t), set(self.sets[t][there].tolist()))
        for doc_, parts in matches.items():
            all_ = list(parts.values())
            best = found.setdefault(doc_, {})
            for share, t, part in all_:
                # versions of one notice differ in a word: what a better match explains doesn't count again
                if not any(s > share and part <= p for s, _, p in all_):
                    best[self.names[t]] = max(best.get(self.names[t], 0.0), share)
            for family in [n for n in best if n in FAMILIES and any(o.startswith(FAMILIES[n]) for o in best if o != n)]:
                del best[family]
        return found


_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_licenses, licenses (sorted, comma-joined), containment (the best)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner(TEMPLATES))
        for b in batches:
            data, off = byte_view(b.column(1))
            found: dict[int, dict[str, float]] = {}
            for lo, hi in blocks(off):
                for d, x in _SCANNER[0].scan(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).items():
                    found[lo + d] = x
            got = [found.get(i, {}) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([",".join(sorted(g)) for g in got], pa.string()), pa.array([max(g.values(), default=0.0) for g in got], pa.float64())],
                ["doc_id", "n_licenses", "licenses", "containment"],
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, n_licenses long, licenses string, containment double")
