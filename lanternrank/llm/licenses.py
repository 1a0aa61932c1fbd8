"""License scans: MinHash bands over windows of text find templates, then exact
shingle containment verifies them.

A template of m words is looked for in windows of 2 c words at every c words,
with c from m up, in few steps. Wherever a text of at most c words stands, one
window holds it whole. If it has k of the template's m' shingles, that window of
w shingles and the template have a Jaccard similarity of ``k / (m' + w - k)`` at
least, and with ``BANDS`` bands of one MinHash each they share a band with
probability ``1 - (1 - J) ** BANDS``: above 0.99 for each template below, down to
four fifths of its shingles.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import mixed, over_slices, window_hashes

WIDTH = 5
CONTAINED = 0.8
BANDS = 32
# Distinct words whose hashes a worker remembers.
REMEMBERED = 200_000

# Notices by which a text states its licence, by the public
# identifier of the licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License",
    "MIT-licensed": "This project is licensed under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "BSD": "Licensed under the BSD 3-Clause License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "LGPL": "under the terms of the GNU Lesser General Public License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "public-domain": "This work has been dedicated to the public domain",
    "all-rights-reserved": "All rights reserved",
}

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def size_class(n: int) -> int:
    """The least of 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, ... from n up."""
    step = max(1, 1 << max(0, (n - 1).bit_length() - 3))
    return max(3, -(-n // step) * step)


def least_probability(words: int, width: int = WIDTH, contained: float = CONTAINED, bands: int = BANDS) -> float:
    """With which a template of so many words and a window that holds a text with
    the least share of it have a band in common."""
    width = min(width, words)
    own, window = words - width + 1, 2 * size_class(words) - width + 1
    both = math.ceil(contained * own)
    jaccard = both / (own + window - both)
    return 1 - (1 - jaccard) ** bands


@dataclass(frozen=True)
class Template:
    name: str
    shingles: np.ndarray


class Scanner:
    """Templates by size class and shingle width, with their bands."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, contained: float = CONTAINED, bands: int = BANDS):
        self.contained = contained
        self.memory: dict[str, int] = {}
        # A product with an odd number permutes the hashes of shingles.
        self.turns = mixed(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.classes: dict[tuple[int, int], list[Template]] = {}
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if words:
                own = min(width, len(words))
                shingles = np.unique(window_hashes(self.codes(words), own))
                self.classes.setdefault((size_class(len(words)), own), []).append(Template(name, shingles))
        self.bands = {
            key: [np.unique([(t.shingles * turn).min() for t in some]) for turn in self.turns]
            for key, some in self.classes.items()
        }

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        for w in set(words):
            if w not in self.memory:
                self.memory[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int]]:
        """``place of the text, template, containment, first word, last word`` of
        every template found in each text, at its best window; ties go to the first."""
        cut = [words_of(t) if t else [] for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        begins = ends - [len(c) for c in cut]
        codes = self.codes(list(chain.from_iterable(cut)))
        found: dict[tuple[int, str], tuple[float, int, int]] = {}
        for width in sorted({w for _, w in self.classes}):
            hashes = window_hashes(codes, width)
            windows = {
                key: _windows(begins, ends - width + 1, 2 * key[0] - width + 1, key[0])
                for key in self.classes if key[1] == width
            }
            hits = {key: np.zeros(len(w[0]), bool) for key, w in windows.items()}
            for k, turn in enumerate(self.turns):
                turned = np.append(hashes * turn, np.uint64(0))
                for key, (starts, stops, _) in windows.items():
                    if len(starts):
                        low = np.minimum.reduceat(turned, np.stack([starts, stops], 1).ravel())[::2]
                        known = self.bands[key][k]
                        hits[key] |= known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
            for key, (starts, stops, texts_at) in windows.items():
                for at in np.flatnonzero(hits[key]):
                    window = hashes[starts[at] : stops[at]]
                    for t in self.classes[key]:
                        inside = np.isin(window, t.shingles)
                        share = len(np.unique(window[inside])) / len(t.shingles)
                        name = int(texts_at[at]), t.name
                        if share >= self.contained and share > found.get(name, (0.0,))[0]:
                            where = np.flatnonzero(inside) + starts[at] - begins[name[0]]
                            found[name] = share, int(where[0]), int(where[-1] + width - 1)
        return [(*name, *found[name]) for name in sorted(found)]


def _windows(begins: np.ndarray, ends: np.ndarray, span: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text of windows of ``span`` shingles at every ``step``; none
    runs over the last shingle of its text."""
    counts = np.maximum(0, -(-(ends - begins) // step))
    texts = np.repeat(np.arange(len(begins)), counts)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[texts] + turn * step
    return starts, np.minimum(starts + span, ends[texts]), texts


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, license, containment, first_word, last_word``: every document row and
    template of which at least four fifths of the shingles stand in one window.

    Shingles are five words of letters and digits, in lower case; a shorter
    template is one shingle. ``containment`` is exact for the window. NULL and
    empty texts have no row; repeated rows and NULL ids have their own; other
    columns are left out. Templates are a fixed, small parameter.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = TEMPLATES if templates is None else templates
    scanner = None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nonlocal scanner
        if scanner is None:
            scanner = Scanner(known)
        rows = scanner(batch.column(1).to_pylist())
        if not rows:
            return None
        at, names, share, first, last = (list(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(names), pa.array(share), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
            [id_col, "license", "containment", "first_word", "last_word"],
        )

    kind = kept.schema[id_col].dataType.simpleString()
    return over_slices(kept, "text", work, f"`{id_col}` {kind}, license string, containment double, first_word long, last_word long")
