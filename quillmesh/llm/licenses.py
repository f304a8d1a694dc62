"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

The templates' k-gram fingerprints are winnowed (the smallest hash of each window) into an inverted index
hash -> (template, position); gram and window of a template are so short that no match can be without a
fingerprint. A document is scanned
as a whole: each of its k-gram hashes is looked up, hits of a template on near diagonals form a region,
and each region is aligned with the template by banded local alignment of tokens. An alignment that
covers at least `min_coverage` of the template's tokens is a match; its span is given in
characters of the text.

The index depends on the templates alone (a parameter, not a table), so what is broadcast has a
size that no input changes. Nothing is shuffled.

Edge cases: null and empty texts match nothing; a text that repeats a template gives a span for
each copy; equal coverage of two templates is reported for both; repeated rows are scanned one by one, and so are rows without
an id, whose matches have none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import NOT_ALNUM, shingles, words_in

# Short notices and opening paragraphs of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

GRAM = 3
WINDOW = 4
BAND = 6
MIN_COVERAGE = 0.8


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return *words_in(np.frombuffer(raw, np.uint8), NOT_ALNUM), raw


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window (the last of equals)."""
    n = len(hashes)
    if n <= window:
        return np.arange(n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def guaranteed_run(n: int, min_coverage: float) -> int:
    """Tokens in a row that any match of so many of n tokens keeps: errors, at most n - matched, cut the matched ones into that many runs and one more."""
    matched = max(1, -int(-min_coverage * n // 1))
    return -(-matched // (n - matched + 1))


class Index:
    """The inverted index of the templates' winnowed fingerprints: by gram size, hash -> (template, position).

    A template's gram and window are such that a run of guaranteed_run tokens holds a fingerprint (gram + window - 1 tokens do), so no match is
    without one: short templates have all their grams, the shortest ones grams of fewer tokens.
    """

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> None:
        self.names = sorted(templates)
        self.words = [tokens(templates[name])[2] for name in self.names]
        self.lists: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            if not len(words):
                continue
            run = guaranteed_run(len(words), min_coverage)
            size = min(GRAM, run)
            grams = shingles(words, size)
            for p in winnow(grams, min(WINDOW, run - size + 1)):
                self.lists[size][int(grams[p])].append((t, int(p)))
        self.keys = {size: np.array(sorted(lists), np.uint64) for size, lists in self.lists.items()}

    def hits(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, shift) of each fingerprint in a text, in the order of the text."""
        out = []
        for size, keys in self.keys.items():
            if len(words) < size:
                continue
            grams = shingles(words, size)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            out += [(p, t, p - q) for p in np.flatnonzero(keys[at] == grams).tolist() for t, q in self.lists[size][int(grams[p])]]
        return [(t, shift) for _, t, shift in sorted(out)]


def align(template: np.ndarray, part: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded local alignment (match 2, mismatch and gap -1) around the diagonal part = template + shift: matched tokens, first and past-the-last token of the part."""
    width = 2 * band + 1
    best, ranked = (0, 0, 0), (0, -width)  # matched, from, to; score, nearness to the diagonal
    score, matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i, word in enumerate(template):
        new_score, new_matched, new_begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
        for k in range(width):
            j = i + shift + k - band
            if not 0 <= j < len(part):
                continue
            equal = part[j] == word
            options = [(0, 0, j + 1), (int(score[k]) + (2 if equal else -1), int(matched[k]) + int(equal), int(begin[k]) if score[k] > 0 else j)]
            if k + 1 < width and score[k + 1] > 0:
                options.append((int(score[k + 1]) - 1, int(matched[k + 1]), int(begin[k + 1])))
            if k and new_score[k - 1] > 0:
                options.append((int(new_score[k - 1]) - 1, int(new_matched[k - 1]), int(new_begin[k - 1])))
            new_score[k], new_matched[k], new_begin[k] = top = max(options, key=lambda x: (x[0], x[1], -x[2]))
            if (top[0], -abs(k - band)) > ranked and top[0]:
                best, ranked = (top[1], top[2], j + 1), (top[0], -abs(k - band))
        score, matched, begin = new_score, new_matched, new_begin
    return best


def scan(text: str | None, index: Index, min_coverage: float = MIN_COVERAGE) -> list[dict]:
    """Matches of a whole text: license, matched tokens, coverage, start and end in characters."""
    starts, ends, words, raw = tokens(text or "")
    if not len(words):
        return []
    regions: dict[int, list[int]] = defaultdict(list)
    for t, shift in index.hits(words):
        if not any(abs(shift - r) <= min(BAND, len(index.words[t])) // 2 for r in regions[t][-4:]):
            regions[t].append(shift)
    out = []
    for t, found in regions.items():
        template, kept = index.words[t], []
        for shift in found:
            lo = max(0, shift - BAND)
            part = words[lo : max(0, shift + len(template) + BAND)]
            n, a, b = align(template, part, shift - lo)
            if n >= min_coverage * len(template):
                kept.append((lo + a, lo + b, n))
        last = -1
        for a, b, n in sorted(set(kept), key=lambda x: (x[0], -x[2])):
            if a >= last:
                last = b
                chars = len(raw[: starts[a]].decode("utf-8", "surrogatepass")), len(raw[: ends[b - 1]].decode("utf-8", "surrogatepass"))
                out.append({"license": index.names[t], "matched": n, "coverage": n / len(template), "start": chars[0], "end": chars[1]})
    return sorted(out, key=lambda m: (m["license"], m["start"]))


MATCHES = "doc_id bigint, license string, matched bigint, coverage double, start bigint, `end` bigint"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, matched, coverage, start, end."""
    templates = dict(TEMPLATES if templates is None else templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, min_coverage)
        for batch in batches:
            rows = [{"doc_id": doc, **m} for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in scan(text.as_py(), index, min_coverage)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)
