"""License scan: winnowed template fingerprints in an inverted index, then banded sequence alignment.

Templates and documents become lower-cased letter-and-digit words. Of each template's k-word fingerprints
the smallest of every window is kept (winnowing), so any run of ``K + WINDOW - 1`` words that a document
shares with a template contains a kept one. A document looks all of its fingerprints up in the index; hits
of one template that lie within a template's length of each other form a candidate region, which is
aligned with the whole template in a band around the hits' diagonals (match 2, mismatch and gap -1). What
covers at least ``COVERAGE`` of the template's words is reported with its span, if each of the template's
phrases (version and variant words, which the tolerance must not forgive) stands in the span word for word.
A region that lacks too many of the template's words in any order is not aligned.

Templates are a parameter of at most ``MAX_TEMPLATE_WORDS`` words in all, so the index is small and goes to
every task; the scan is a map over documents without a shuffle, linear in the text apart from the aligned
regions. Fingerprints never leave a task.

Edge cases: null and empty texts, and texts with fewer words than a fingerprint, give no rows; templates
shorter than a fingerprint are refused; a template that occurs twice gives two rows; of templates
that claim overlapping spans the one with most matched words is reported (ties: coverage, then place, then
order of templates); repeated rows give
their rows each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from . import words as W

K = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.7
MAX_TEMPLATE_WORDS = 100_000

#: Public license notices and texts by SPDX identifier, or by family where no version is named, with
#: the phrases that tell them from their relatives.
TEMPLATES: list[tuple] = [
    ("MIT", "Released under the MIT License.", ["mit"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache", "Licensed under the Apache License", ["apache"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache", "version 2.0"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache", "version 2.0"]),
    ("GPL", "licensed under the GNU General Public License", ["gnu general public"]),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public", "version 2"]),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public", "version 2"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public", "version 3"]),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public", "version 3"]),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ["gnu lesser general public"]),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["gnu lesser general public", "version 2.1"]),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", ["gnu lesser general public", "version 3"]),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu affero general public", "version 3"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla", "v. 2.0"]),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["neither the name", "endorse or promote"]),
    ("CC", "Licensed under CC BY", ["cc by"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ["cc by 4.0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ["cc by-sa 4.0"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["cc by-nc 4.0"]),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ["cc by-nd 4.0"]),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ["cc by-nc-sa 4.0"]),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", ["cc by-nc-nd 4.0"]),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

_BREAKS = bytes(32 if not (chr(i).isalnum() or i > 127) else i for i in range(256))


def located(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start of each word in them, its hash); punctuation parts words."""
    data = text.encode("utf-8", "replace").lower().translate(_BREAKS)
    starts, hashes = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + W.CHUNK)
        while end < len(data) and data[end] != 32:
            end += 1
        s, h = W._word_hashes(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return data, np.concatenate(starts) if starts else np.empty(0, np.int64), np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


def winnowed(fingerprints: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the kept fingerprints: of each window the smallest, the rightmost of equals."""
    if len(fingerprints) <= window:
        return np.array([len(fingerprints) - 1 - int(np.argmin(fingerprints[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(fingerprints, window)[:, ::-1]
    return np.unique(np.arange(len(windows)) + window - 1 - windows.argmin(axis=1))


class Index:
    """kept fingerprint -> (template, position) and the templates' words."""

    def __init__(self, templates: list[tuple], k: int = K, window: int = WINDOW):
        self.k = k
        self.names = [x[0] for x in templates]
        self.words = [located(x[1])[2] for x in templates]
        self.phrases = [[located(phrase)[2] for phrase in (x[2] if len(x) > 2 else [])] for x in templates]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"more than {MAX_TEMPLATE_WORDS} template words")
        if any(len(w) < k for w in self.words):
            raise ValueError(f"a template has fewer than {k} words")
        rows = [(int(f[p]), t, int(p)) for t, w in enumerate(self.words) for f in [W.ngrams(w, k)] for p in winnowed(f, window)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.templates = np.array([r[1] for r in rows], int)
        self.positions = np.array([r[2] for r in rows], int)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(template, [(place in the document, place in the template)]) of each candidate region."""
        f = W.ngrams(words, self.k)
        left, right = np.searchsorted(self.keys, f, "left"), np.searchsorted(self.keys, f, "right")
        found: dict[int, list[tuple[int, int]]] = {}
        for at in np.flatnonzero(right > left):
            for i in range(left[at], right[at]):
                found.setdefault(int(self.templates[i]), []).append((int(at), int(self.positions[i])))
        for t, places in found.items():
            region: list[tuple[int, int]] = []
            for at, p in places:
                if region and ((at - p) - (region[-1][0] - region[-1][1]) > BAND or p <= region[-1][1]):  # elsewhere, or the template begins again
                    yield t, region
                    region = []
                region.append((at, p))
            yield t, region


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last place) of the best local alignment with place - template place in low..high."""
    width = high - low + 1
    best = (0, 0, 0, -1)  # score, matched, first, last
    before: list[tuple[int, int, int, int]] = [(0, 0, -1, -1)] * (width + 1)
    for i, w in enumerate(template):
        row: list[tuple[int, int, int, int]] = []
        for d in range(width):
            at = i + low + d
            if not 0 <= at < len(words):
                row.append((0, 0, -1, -1))
                continue
            same = words[at] == w
            s, m, first, last = before[d]
            options = [(s + 2, m + 1, first if first >= 0 else at, at) if same else (s - 1, m, first, last), (0, 0, -1, -1)]
            s, m, first, last = before[d + 1] if d + 1 <= width - 1 else (0, 0, -1, -1)
            options.append((s - 1, m, first, last))
            if d:
                s, m, first, last = row[d - 1]
                options.append((s - 1, m, first, last))
            cell = max(options, key=lambda x: (x[0], x[1]))
            row.append(cell if cell[0] > 0 else (0, 0, -1, -1))
            if row[-1][:2] > best[:2]:
                best = row[-1]
        before = row + [(0, 0, -1, -1)]
    return best[1:]


def stands_in(phrase: np.ndarray, words: np.ndarray) -> bool:
    if len(words) < len(phrase):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(words, len(phrase)) == phrase).all(axis=1).any())


def scan_text(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """(license, matched words, coverage, start, end in characters) of each template found, in order."""
    data, starts, words = located(text or "")
    if len(words) < index.k:
        return []
    out = []
    taken: dict[int, int] = {}  # template -> diagonal that its region before ended on
    for t, region in index.hits(words):
        template = index.words[t]
        diagonals = [at - p for at, p in region]
        low = min(diagonals) - BAND
        if taken.get(t, min(diagonals)) < min(diagonals):  # the band must not reach back to the place before
            low = max(low, taken[t] + 1)
        taken[t] = max(diagonals)
        high = max(diagonals) + BAND
        if np.isin(template, words[max(0, low) : max(0, high + len(template))]).sum() < coverage * len(template):
            continue
        matched, first, last = align(template, words, low, high)
        if matched >= coverage * len(template) and all(stands_in(phrase, words[first : last + 1]) for phrase in index.phrases[t]):
            end = data.find(b" ", int(starts[last]))
            end = len(data) if end < 0 else end
            a = len(data[: starts[first]].decode("utf-8", "replace"))
            out.append((index.names[t], matched, matched / len(template), a, a + len(data[starts[first] : end].decode("utf-8", "replace")), t))
    kept: list[tuple] = []
    for x in sorted(set(out), key=lambda x: (-x[1], -x[2], x[3], x[5])):  # of templates on one span, the one that matches most
        if all(x[4] <= y[3] or x[3] >= y[4] for y in kept):
            kept.append(x)
    return [x[:5] for x in sorted(kept, key=lambda x: (x[3], x[5], x[4]))]


def scan(documents: DataFrame, templates: list[tuple] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, matched_words, coverage, span_start, span_end of every template found in every row.

    A template is (name, text) or (name, text, phrases that must stand in the span).
    """
    small_batches(documents.sparkSession)
    index = Index(templates or TEMPLATES)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                for x in scan_text(index, text.as_py(), coverage):
                    at.append(i)
                    found.append(x)
            names, matched, share, start, end = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(matched, pa.int64()), pa.array(share, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "license", "matched_words", "coverage", "span_start", "span_end"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, license string, matched_words long, coverage double, span_start long, span_end long")
