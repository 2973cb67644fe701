"""License scans: MinHash bands over overlapping windows (operator 5).

The shingles of a text are cut into blocks of 2, 4, 8 ... and two neighbouring blocks
form a window, so windows overlap by half and every run of a block's length lies in one. A
template of n shingles is looked for in the windows of the smallest block that holds n. It is
retrieved if it shares one of ``BANDS`` min-hashes with a window. If the window holds three
quarters of a template, they have a similarity of at least 0.17, so a window is missed once in
10,000 cases at worst. Retrieved pairs are verified by exact containment of shingles.

Notices of related licenses share most of their words. Where verified places of two licenses
overlap, the one with the smaller share of its shingles, and no more of them, gives way.

Words are compared in lower case without punctuation at either end. Documents are independent:
one pass without a shuffle.

Edge cases: null, empty and short texts match nothing; a template found several times in a document
gives one row per place; a null id stays null; repeated ids give the rows of each of their texts; an
empty table gives none; long texts are scanned whole; other columns are ignored; a template of
fewer than five words is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import slices
from sentinela.llm.words import mix, shingle_hashes, word_hashes, words

SHINGLE = 5
BANDS = 48
LEAST_PERCENT = 75
SMALLEST_BLOCK = 2
EDGES = ".,;:!?()[]{}<>\"'*#/-_`|"

# Notices and grants of common public licenses.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "This software is provided by the copyright holders and contributors \"as is\" and any "
        "express or implied warranties, including, but not limited to, the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

SCHEMA = "doc_id long, license string, template int, start_word int, end_word int, shared int, shingles int"
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts, where each text's begin, and its number of words."""
    flat, offsets = words(texts)
    flat = pc.ascii_trim(flat, EDGES)
    # What was punctuation only is no word.
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    runs, starts = shingle_hashes(word_hashes(flat.filter(pa.array(full))), offsets, SHINGLE)
    return runs, starts, np.diff(offsets)


class Templates:
    """Shingles and min-hashes of the templates, by the block size they are looked for with."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = [(name, k) for name in texts for k in range(len(texts[name]))]
        flat = [t for name in texts for t in texts[name]]
        runs, starts, counts = text_shingles(pa.array(flat, pa.string()))
        if (counts < SHINGLE).any():
            raise ValueError("a template needs five words")
        self.shingles = [np.unique(runs[a:b]) for a, b in zip(starts, starts[1:])]
        self.blocks: dict[int, list[int]] = {}
        for t, own in enumerate(self.shingles):
            block = SMALLEST_BLOCK
            while block < len(own):
                block *= 2
            self.blocks.setdefault(block, []).append(t)
        with np.errstate(over="ignore"):
            self.minima = np.array([[(own * f + s).min() for f, s in zip(_FACTORS, _SHIFTS)]
                                    for own in self.shingles])


def retrieve(runs: np.ndarray, starts: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(template, start, end) of windows of the flat shingles that share a band with a template."""
    found: set[tuple[int, int, int]] = set()
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return found
    # Blocks of every size begin at multiples of it from their text's first shingle.
    cuts = {}
    block = SMALLEST_BLOCK
    while block <= max(templates.blocks):
        own = -(-np.diff(starts)[full] // block)
        first = np.cumsum(own) - own
        inside = np.arange(own.sum()) - np.repeat(first, own)
        cuts[block] = (np.repeat(starts[full], own) + block * inside,
                       np.repeat(starts[full + 1], own), inside == np.repeat(own, own) - 1, inside)
        block *= 2
    for band in range(BANDS):
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat(runs * _FACTORS[band] + _SHIFTS[band], cuts[SMALLEST_BLOCK][0])
        for block, (begin, end, last, inside) in cuts.items():
            if block > SMALLEST_BLOCK:
                # Two blocks of the size before; an odd one out stays alone.
                least = np.minimum.reduceat(least, np.flatnonzero(halves % 2 == 0))
            halves = inside
            if block in templates.blocks:
                window = least.copy()
                both = np.flatnonzero(~last)
                window[both] = np.minimum(least[both], least[both + 1])
                for t in templates.blocks[block]:
                    for w in np.flatnonzero(window == templates.minima[t, band]).tolist():
                        found.add((t, int(begin[w]), int(min(begin[w] + 2 * block, end[w]))))
    return found


def matches(texts: pa.Array, templates: Templates) -> list[tuple[int, int, int, int, int]]:
    """(text, template, first word, end word, shared shingles) of verified places."""
    runs, starts, _ = text_shingles(texts)
    places: dict[tuple[int, int], set[int]] = {}
    for t, a, b in retrieve(runs, starts, templates):
        own = templates.shingles[t]
        at = a + np.flatnonzero(np.isin(runs[a:b], own))
        if len(at) and 100 * len(np.unique(runs[at])) >= LEAST_PERCENT * len(own):
            text = int(np.searchsorted(starts, a, "right")) - 1
            places.setdefault((text, t), set()).update(at.tolist())
    found = []
    for (text, t), at in sorted(places.items()):
        at, least = sorted(at), LEAST_PERCENT * len(templates.shingles[t])
        width = 2 * next(b for b, own in templates.blocks.items() if t in own)
        k = 0
        while k < len(at):
            # From here on as far as a window reaches; a place ends where nothing new comes.
            seen, end = set(), k
            for other in range(k, len(at)):
                if at[other] >= at[k] + width:
                    break
                if int(runs[at[other]]) not in seen:
                    seen.add(int(runs[at[other]]))
                    end = other
            if 100 * len(seen) < least:
                k += 1
                continue
            first = int(starts[text])
            found.append((text, t, at[k] - first, at[end] - first + SHINGLE, len(seen)))
            k = end + 1
    return nearest_licenses(found, templates)


def nearest_licenses(found: list[tuple[int, int, int, int, int]], templates: Templates
                     ) -> list[tuple[int, int, int, int, int]]:
    """The places without those where another license's template fits better."""

    def worse(one: tuple, other: tuple) -> bool:
        sizes = [len(templates.shingles[p[1]]) for p in (one, other)]
        return one[4] * sizes[1] < other[4] * sizes[0] and one[4] <= other[4]

    ordered = sorted(found, key=lambda p: (p[0], p[2]))
    gone = set()
    for k, one in enumerate(ordered):
        for j in range(k + 1, len(ordered)):
            other = ordered[j]
            if other[0] != one[0] or other[2] >= one[3]:
                break
            if templates.names[one[1]][0] != templates.names[other[1]][0]:
                gone.update(a for a, b in ((one, other), (other, one)) if worse(a, b))
    return [p for p in found if p not in gone]


def scan_licenses(docs: DataFrame, texts: dict[str, list[str]] | None = None, *,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per template found at a place of a document, in words from its start."""
    known = TEMPLATES if texts is None else texts
    Templates(known)        # tell of wrong templates at once

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(known)
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            rows = [(ids[text], *templates.names[t], a, b, shared, len(templates.shingles[t]))
                    for text, t, a, b, shared in matches(part.column("text"), templates)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, schema)],
                schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string())] + [
        (n, pa.int32()) for n in ("template", "start_word", "end_word", "shared", "shingles")])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(scanned, SCHEMA)
