"""License notices in texts.

Each text is cut into overlapping windows a quarter of a template's shingles longer than it and apart, so that any
occurrence lies whole within one; templates of less than four shingles have windows of their own length at every place.
Windows and templates with an equal band of MinHash values meet; the window is then searched for the template's shingles,
and a match is a template of which the window has at least a given share.

A window that has all of a template without repeated shingles has a similarity of at least 0.8 to it, one that has four
fifths of it of 0.55: with BANDS bands of ROWS values, the first is met with a probability beyond 1 - 1e-10 (certainly where
the window fits exactly), the second of 0.999. A band can only agree where the window has a shingle that gives the template
one of its values, so only windows around those are hashed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from placebook.llm.shingles import SIZE, mix

BANDS = 24
ROWS = 2
LEAST_SHARE = 0.8
# Templates are sent to every task; more bytes than these are refused.
TEMPLATE_BYTES = 16 << 20

# Notices by the identifiers in common use, and the openings of the licenses' own texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MATCHES = "array<struct<license:string,share:double,first:int,last:int>>"


def words_of(text: str | None) -> list[str]:
    """Runs of ASCII digits and letters, A-Z lower-cased, and of all characters beyond ASCII."""
    return WORD.findall(re.sub("[A-Z]+", lambda found: found[0].lower(), text or ""))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` words, in order, from the hashes of the words."""
    found = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size if len(found) else 0):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(found)])
    return found


SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(found: np.ndarray) -> np.ndarray:
    """For each seed the smallest of the shingles' hashes."""
    return mix(found[None, :] ^ SEEDS[:, None]).min(axis=1)


class Matcher:
    """Finds templates in texts."""

    def __init__(self, templates: Iterable[tuple[str, str]], least: float = LEAST_SHARE):
        self.least = least
        self.templates = []  # (license, shingle size, words, sorted distinct shingles)
        self.bands: dict[tuple, list[int]] = {}
        # By shingle size, the shingles that give a template one of its values, each with the lengths of those templates.
        self.marks: dict[int, dict[int, set[int]]] = {}
        for license, text in templates:
            words = words_of(text)
            if not words:
                continue
            size = min(SIZE, len(words))
            own = np.unique(shingles(word_hashes(words), size))
            number = len(self.templates)
            self.templates.append((license, size, len(words), own))
            values = signature(own)
            for band in range(BANDS):
                self.bands.setdefault((len(words), band, *values[band * ROWS : band * ROWS + ROWS].tolist()), []).append(number)
            marks = self.marks.setdefault(size, {})
            for place in {int(np.argmin(mix(own ^ seed))) for seed in SEEDS}:
                marks.setdefault(int(own[place]), set()).add(len(words))
        self.sorted_marks = {size: np.array(sorted(found), np.uint64) for size, found in self.marks.items()}

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Matches as (license, share of its shingles, first and last word from 1), by place; of matches of one license
        that overlap the one with the largest share is given, the longest of equals, the first of those.
        """
        hashes = word_hashes(words_of(text))
        found: list[tuple[str, float, int, int]] = []
        for size, marks in self.sorted_marks.items():
            own = shingles(hashes, size)
            marked = np.flatnonzero(np.isin(own, marks)).tolist() if len(own) else []
            places: dict[int, list[int]] = {}
            for i in marked:
                for length in self.marks[size][int(own[i])]:
                    places.setdefault(length, []).append(i)
            for length, near in sorted(places.items()):
                found += self._windows(own, near, size, length)
        kept: list[tuple[str, float, int, int]] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # by license the places of kept matches, in order; none overlap
        for match in sorted(set(found), key=lambda m: (-m[1], m[2] - m[3], m[2], m[0])):
            places = taken.setdefault(match[0], [])
            at = bisect_left(places, match[2:])
            if (at == 0 or places[at - 1][1] < match[2]) and (at == len(places) or match[3] < places[at][0]):
                places.insert(at, match[2:])
                kept.append(match)
        return sorted(kept, key=lambda m: (m[2], m[0], m[3]))

    def _windows(self, own: np.ndarray, marked: list[int], size: int, length: int) -> list[tuple[str, float, int, int]]:
        """Matches of the templates of a length in the windows around the shingles that give one of them a value."""
        count = length - size + 1
        step = max(1, count // 4)
        reach = count + count // 4 - 1  # a window's shingles less one; below four shingles it fits exactly
        starts = {k * step for i in marked for k in range(max(0, -(-(i - reach) // step)), i // step + 1)}
        found = []
        for start in sorted(starts):
            window = own[start : start + reach + 1]
            values = signature(window).tolist()
            met = {t for band in range(BANDS) for t in self.bands.get((length, band, *values[band * ROWS : band * ROWS + ROWS]), ())}
            for number in met:
                license, _, _, template = self.templates[number]
                inside = np.flatnonzero(np.isin(window, template))
                share = len(np.unique(window[inside])) / len(template)
                if share >= self.least:
                    found.append((license, share, start + int(inside[0]) + 1, start + int(inside[-1]) + size))
        return found


def matches(text: Column, templates: list[tuple[str, str]] | None = None, least: float = LEAST_SHARE) -> Column:
    templates = TEMPLATES if templates is None else templates
    if sum(len(body.encode()) for _, body in templates) > TEMPLATE_BYTES:
        raise ValueError(f"the templates have more than {TEMPLATE_BYTES} bytes")

    made: list[Matcher] = []

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(templates, least))
        kind = pa.list_(pa.struct([("license", pa.string()), ("share", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        names = ("license", "share", "first", "last")
        return pa.array([[dict(zip(names, match)) for match in made[0].find(item.as_py())] for item in texts], kind)

    return found(text)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """`docs` with a column `licenses`, replacing one of that name: the matches in `text`. Null and empty texts have none,
    templates without words are in no text, every row stays, repeated rows included.
    """
    return docs.withColumn("licenses", matches(F.col("text"), templates, least))
