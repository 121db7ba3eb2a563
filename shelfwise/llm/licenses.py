"""License texts in documents: winnowed fingerprints pick candidates, banded alignment reports spans.

Method. Templates are token sequences (letters and digits, lower case). Each template keeps the
least hash of every window of ``WINDOW`` grams of ``GRAM`` tokens; those of fewer than ``SHORT`` tokens
keep all grams, and those of fewer than ``TINY`` grams of two tokens, so that some gram is left whatever
tokens an edit within the coverage changes. The fingerprints form an inverted index to (template,
position). All grams of a document are looked up,
so a template's fingerprint is found wherever it stands. Hits of one template on nearby diagonals
are one candidate; it is aligned with the template inside a band around those diagonals. Reported
are candidates whose matched tokens cover ``COVERAGE`` of the template.

Scale. Documents are read once and never shuffled. The templates are a parameter of at most
``MOST_TEMPLATE_BYTES`` (checked), sent to all tasks. Gram hashes are array operations; only candidates
run through the alignment, whose cost is a template's length times the band.

Rules for odd rows. Null and empty texts match nothing. Repeated rows give repeated results; rows
without doc_id are scanned and keep their null. Of overlapping spans of one template the one with
the best coverage stays, then the first. Different templates may overlap. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import ALPHANUMERIC, Slice, mix, slices, span_hashes

GRAM, WINDOW, COVERAGE = 3, 4, 0.8
SHORT, TINY, PAIR = 20, 7, 2
BAND_SHARE, LEAST_BAND = 0.2, 3
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 16
MOST_TEMPLATE_BYTES = 4 << 20
SCHEMA = "doc_id long, license string, start int, end int, matched int, template_tokens int, coverage double"

# Notices and texts of common public licenses.
TEMPLATES = (
    ("MIT notice", "Released under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "Apache-2.0 header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "GPL-3.0 header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
)


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of every token."""
    starts, ends, rows = part.word_spans(ALPHANUMERIC)
    return span_hashes(part.prefix_hashes(), starts, ends), starts, ends, rows


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` tokens that start at each position where so many are left."""
    n = max(0, len(words) - size + 1)
    out = words[:n].copy()
    for k in range(1, size):
        out = mix(out, k) + words[k : k + n]
    return mix(out, size - GRAM)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every window, the rightmost of equals."""
    if len(hashes) <= WINDOW:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    last = WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    return np.unique(np.arange(len(windows)) + last)


class TemplateIndex:
    """Inverted indexes of the templates' fingerprints, one for each size of grams."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        if sum(len(t.encode()) for _, t in templates) > MOST_TEMPLATE_BYTES:
            raise ValueError("the templates are too large to send to every task")
        self.names, self.words, entries = [], [], {}
        for name, text in templates:
            (part,) = slices(pa.array([text], pa.large_string()), lower=True, limit=max(1, len(text.encode())))
            words = tokens(part)[0]
            size = PAIR if len(words) < TINY else GRAM
            marks = grams(words, size)
            at = np.arange(len(marks)) if len(words) < SHORT else winnow(marks)
            entries.setdefault(size, []).append((marks[at], np.full(len(at), len(self.names)), at))
            self.names.append(name)
            self.words.append(words)
        self.sizes = {}
        for size, found in entries.items():
            keys, owner, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            known = np.zeros(1 << FILTER_BITS, dtype=bool)
            known[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = keys[order], owner[order], place[order], known

    def hits(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, template, diagonal) of every fingerprint in a slice; grams stay inside rows."""
        out = set()
        for size, (keys, owner, place, known) in self.sizes.items():
            marks = grams(words, size)
            hit = np.flatnonzero(known[(marks >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            hit = hit[rows[hit] == rows[hit + size - 1]]
            left = np.searchsorted(keys, marks[hit], "left")
            count = np.searchsorted(keys, marks[hit], "right") - left
            total = int(count.sum())
            if total:
                within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                entry = np.repeat(left, count) + within
                at = np.repeat(hit, count)
                out.update(zip(rows[at].tolist(), owner[entry].tolist(), (at - place[entry]).tolist()))
        return sorted(out)


def align(template: list[int], text: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched tokens and the span [first, last] of text in the best banded alignment.

    The whole template is aligned, the text's ends are free. Cell j of row i stands for the text
    position i + diagonal - band + j.
    """
    width = 2 * band + 1
    # score, matches, first and last matched text position
    none = (-(10**9), 0, -1, -1)
    row = [(0, 0, -1, -1)] * width
    for i, word in enumerate(template):
        new = []
        for j in range(width):
            at = i + diagonal - band + j
            best = none
            if 0 <= at < len(text):
                score, matched, first, last = row[j]
                if text[at] == word:
                    best = (score + MATCH, matched + 1, at if first < 0 else first, at)
                else:
                    best = (score + MISMATCH, matched, first, last)
            if j + 1 < width:  # the template's token has no partner
                score, *rest = row[j + 1]
                best = max(best, (score + GAP, *rest))
            if j and new[j - 1][0] > -(10**8) and new[j - 1][2] >= 0:  # the text's token has none
                score, *rest = new[j - 1]
                best = max(best, (score + GAP, *rest))
            new.append(best)
        row = new
    return max(row)[1:]


def _spans(index, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: TemplateIndex = index.value
        for batch in batches:
            out = []
            for part in slices(batch.column("text"), lower=True):
                words, starts, ends, rows = tokens(part)
                for row, name, first, last, matched, size in _found(templates, words, rows, coverage):
                    low = part.offsets[row]
                    points = lambda at: int((part.data[low:at] & 0xC0 != 0x80).sum())  # noqa: B023, E731
                    out.append(
                        (
                            batch.column("doc_id")[part.first + row].as_py(),
                            templates.names[name],
                            points(starts[first]),
                            points(ends[last]),
                            matched,
                            size,
                            matched / size,
                        )
                    )
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            names = ["doc_id", "license", "start", "end", "matched", "template_tokens", "coverage"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names
            )

    return run


def _found(templates: TemplateIndex, words: np.ndarray, rows: np.ndarray, coverage: float):
    """(row, template, first token, last token, matched, template size), overlaps resolved."""
    hits = templates.hits(words, rows)
    at = 0
    while at < len(hits):
        row, name, _ = hits[at]
        stop = at
        while stop < len(hits) and hits[stop][:2] == (row, name):
            stop += 1
        template = templates.words[name].tolist()
        band = max(LEAST_BAND, int(BAND_SHARE * len(template)))
        low, high = np.searchsorted(rows, [row, row + 1])
        spans, done = [], None
        for _, _, diagonal in hits[at:stop]:
            # The band around the last diagonal covers the near ones.
            if done is not None and diagonal - done <= band // 2:
                continue
            done = diagonal
            begin = max(low, diagonal - band)
            text = words[begin : min(high, diagonal + len(template) + band)].tolist()
            matched, first, last = align(template, text, diagonal - begin, band)
            if matched >= coverage * len(template):
                spans.append((-matched, begin + first, begin + last))
        kept: list[tuple[int, int]] = []
        for matched, first, last in sorted(spans):
            if all(last < a or first > b for a, b in kept):
                kept.append((first, last))
                yield row, name, int(first), int(last), -matched, len(template)
        at = stop


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """One row per license span of (doc_id, text): code points of the text, end exclusive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))
    return docs.where("text IS NOT NULL").mapInArrow(_spans(index, coverage), SCHEMA)
