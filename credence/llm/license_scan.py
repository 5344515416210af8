"""License scan by conditional compression.

A window of words can hold a statement of a license, exact or modified, only
if enough of its words are the statement's. The lines of such windows, lines
with a cue word, and such lines at most `REACH` lines apart together with what
lies between, are candidate blocks. A block is compressed by zstandard alone
and with the wording of each license as raw dictionary; the share of its size
that a dictionary saves ranks the licenses.

All licenses are then confirmed in that order, without a cap, by the words in
which the block differs from their statements: a statement counts as exact
without differences, as modified while no more than `MOST_CHANGED` of its words
differ and none of its telling words (names, numbers) does. Only texts that
lack more of a statement's words than may differ are passed over before they
are split into words.

Defined results for unusual input: a null or empty text has no licenses; a very
long text is scanned whole, in chunks of windows; licenses that save the same
share are ordered by name, and of equally modified wordings that overlap the
shorter, then the first, counts; an empty table gives an empty result; repeated
rows give repeated rows; null ids are kept; other columns are ignored whatever
their names. Lines are counted from 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 2
MOST_CHANGED = 0.2
CUES = re.compile(r"licen[sc]|copyright|all rights reserved|permission is hereby|permission to use|redistribution and use|warrant|public domain|creative commons|\bcc[ -]by|\bcc0\b|\bspdx", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Statements of each license, the telling words in braces.
LICENSES = {
    "MIT": (
        "Released under the {MIT} License", "Licensed under the {MIT} License", "{MIT} License", "Licensed under {MIT}", "Licensed under the {MIT}", "SPDX-License-Identifier: {MIT}", "{Apache-2.0} OR {MIT}",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the {Apache} License, Version {2.0}", "{Apache} License, Version {2.0}", "{Apache-2.0}",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.{apache}.org/licenses/LICENSE-{2.0}",
    ),
    "GPL-3.0": (
        "This work is licensed under the {GNU} {General} Public License, version {3}", "{GNU} {General} Public License version {3}", "{GPL-3.0}", "{GPL-3.0-only}", "{GPL-3.0-or-later}", "{GPLv3}",
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the {GNU} {General} Public License, version {2}", "{GNU} {General} Public License version {2}", "{GPL-2.0}", "{GPL-2.0-only}", "{GPL-2.0-or-later}", "{GPLv2}",
        "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version",
    ),
    "GPL": ("Licensed under the {GPL}", "Licensed under {GPL}", "Released under the {GPL}", "Distributed under the {GPL}", "Licensed under the {GNU} {GPL}"),
    "LGPL-3.0": ("{GNU} {Lesser} General Public License, version {3}", "{LGPL-3.0}", "{LGPL-3.0-only}", "{LGPL-3.0-or-later}", "{LGPLv3}"),
    "LGPL-2.1": ("{GNU} {Lesser} General Public License, version {2.1}", "{LGPL-2.1}", "{LGPL-2.1-only}", "{LGPL-2.1-or-later}", "{LGPLv2.1}"),
    "AGPL-3.0": ("{GNU} {Affero} General Public License, version {3}", "{AGPL-3.0}", "{AGPL-3.0-only}", "{AGPL-3.0-or-later}", "{AGPLv3}"),
    "BSD-3-Clause": (
        "Licensed under the {BSD} {3-Clause} License", "{BSD-3-Clause}",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "BSD-2-Clause": (
        "Licensed under the {BSD} {2-Clause} License", "{BSD-2-Clause}", "Licensed under the {BSD} License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ISC": ("Licensed under the {ISC} License", "{ISC} License", "SPDX-License-Identifier: {ISC}", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}", "{Mozilla} Public License Version {2.0}", "{MPL-2.0}"),
    "EPL-2.0": ("{Eclipse} Public License, Version {2.0}", "{Eclipse} Public License - v {2.0}", "{EPL-2.0}"),
    "EPL-1.0": ("{Eclipse} Public License, Version {1.0}", "{Eclipse} Public License - v {1.0}", "{EPL-1.0}"),
    "BSL-1.0": ("Distributed under the {Boost} Software License, Version {1.0}", "{Boost} Software License, Version {1.0}", "{BSL-1.0}"),
    "CC-BY-4.0": ("Licensed under {CC} {BY} {4.0}", "This work is licensed under a Creative Commons {Attribution} {4.0} International License", "{CC-BY-4.0}"),
    "CC-BY-SA-4.0": ("Licensed under {CC} {BY-SA} {4.0}", "This work is licensed under a Creative Commons {Attribution-ShareAlike} {4.0} International License", "{CC-BY-SA-4.0}"),
    "CC-BY-NC-4.0": ("Licensed under {CC} {BY-NC} {4.0}", "This work is licensed under a Creative Commons {Attribution-NonCommercial} {4.0} International License", "{CC-BY-NC-4.0}"),
    "CC-BY-ND-4.0": ("Licensed under {CC} {BY-ND} {4.0}", "This work is licensed under a Creative Commons {Attribution-NoDerivatives} {4.0} International License", "{CC-BY-ND-4.0}"),
    "CC0-1.0": ("{CC0} {1.0} Universal", "Dedicated to the public domain under {CC0}", "{CC0-1.0}"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Licensed under the {Unlicense}", "SPDX-License-Identifier: {Unlicense}"),
    "Zlib": ("Licensed under the {zlib} License", "SPDX-License-Identifier: {Zlib}", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    "All-rights-reserved": ("All rights {reserved}",),
}


@cache
def _compressors():
    """The plain compressor and one for each license, built once in a worker."""
    text = lambda s: " ".join(s).replace("{", "").replace("}", "").encode()
    made = {k: zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text(s) + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, s in LICENSES.items()}
    return zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False), made


@cache
def _statements(name: str) -> tuple[tuple[tuple[str, ...], frozenset[int]], ...]:
    """Each statement as words, and the places of its telling words."""
    out = []
    for s in LICENSES[name]:
        # Braces fall away before words are split, as a telling word can be a part of one (www.{apache}.org).
        parts = re.split(r"[{}]", s)
        ends = np.cumsum([len(p) for p in parts])
        marked = [(int(e) - len(p), int(e)) for p, e in zip(parts[1::2], ends[1::2])]
        found = list(_WORD.finditer("".join(parts)))
        told = frozenset(k for k, w in enumerate(found) if any(w.start() < e and b < w.end() for b, e in marked))
        out.append((tuple(w.group().lower() for w in found), told))
    return tuple(out)


@cache
def _vocabulary() -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for k in LICENSES for words, _ in _statements(k) for w in words}))}


def _exact(words: tuple[str, ...], text: str) -> list[int]:
    """Where words stand in the text, a string of words with a blank around each; without overlaps."""
    sought, out, at, passed = f" {' '.join(words)} ", [], 0, 0
    while (found := text.find(sought, at)) >= 0:
        passed += text.count(" ", at, found)
        out.append(passed)
        at = found + len(sought) - 1
        passed += len(words)
    return out


def _own(words: tuple[str, ...], ids: np.ndarray) -> np.ndarray:
    vocabulary = _vocabulary()
    return np.isin(ids, np.array([vocabulary[w] for w in words]))


def _starts(words: tuple[str, ...], ids: np.ndarray) -> np.ndarray:
    """Where a wording of a statement may begin: at a word of its own, with enough of them in the window that follows. A wording has at most as many words more or less as may differ."""
    n, of = len(words), _own(words, ids)
    allowed = int(n * MOST_CHANGED)
    held = np.concatenate([[0], np.cumsum(of), np.full(n + allowed, of.sum())])
    return np.flatnonzero(of & (held[n + allowed : n + allowed + len(ids)] - held[: len(ids)] >= n - allowed))


def _modified(words: tuple[str, ...], told: frozenset[int], ids: np.ndarray, taken: list[int]) -> list[tuple[int, int, int]]:
    """(differing words, first word, end) of every modified wording of a statement but where it stands word by word (taken), without overlaps, the least modified first.

    In each window that may hold one its longest common subsequence with the statement is found.
    """
    n, vocabulary = len(words), _vocabulary()
    allowed = int(n * MOST_CHANGED)
    own, width = np.array([vocabulary[w] for w in words]), n + allowed
    free = np.ones(len(ids), bool)
    for at in taken:
        free[at : at + n] = False
    starts = _starts(words, ids)
    starts = starts[free[starts]]
    padded = np.concatenate([ids, np.full(width, -1)])
    # A telling word counts so much that no number of others makes up for it.
    weight = np.array([1 + (1 << 16) * (k in told) for k in range(n)])
    found = []
    for part in range(0, len(starts), 4096):
        begin = starts[part : part + 4096]
        row = np.zeros((len(begin), n + 1), np.int64)
        fewest, end = np.full(len(begin), n + 1), np.zeros(len(begin), np.int64)
        for j in range(width):
            same = padded[begin + j][:, None] == own
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], np.where(same, row[:, :-1] + weight, 0)), axis=1)
            changed = np.where(row[:, -1] >> 16 == len(told), max(n, j + 1) - (row[:, -1] & 0xFFFF), n + 1)
            end = np.where(changed < fewest, j + 1, end)
            fewest = np.minimum(fewest, changed)
        good = fewest <= allowed
        found += zip(fewest[good].tolist(), begin[good].tolist(), (begin + end)[good].tolist())
    out, covered = [], np.zeros(len(padded), bool)
    for at in taken:
        covered[at : at + n] = True
    for d, a, b in sorted(found, key=lambda f: (f[0], f[2] - f[1], f[1])):
        if not covered[a:b].any():
            covered[a:b] = True
            out.append((d, a, b))
    return out


@cache
def _needed(name: str) -> tuple[tuple[tuple[str, ...], tuple[str, ...], int], ...]:
    """For each statement its telling words, its other words (long ones first, as they are rare) and how many of those a text may lack."""
    by_length = lambda w: (-len(w), w)
    of = [(words, {words[k] for k in told}) for words, told in _statements(name)]
    return tuple((tuple(sorted(told, key=by_length)), tuple(sorted(set(words) - told, key=by_length)), int(len(words) * MOST_CHANGED)) for words, told in of)


def _may_hold(name: str, held: str | set[str]) -> list[bool]:
    """Which of the license's statements a text, in lower case, or a set of words may hold, as it has their words."""
    return [all(w in held for w in told) and next(islice((w for w in rest if w not in held), lacks, None), None) is None for told, rest, lacks in _needed(name)]


class Words:
    """The words of a text, with what the search needs of them."""

    def __init__(self, words: list[str]) -> None:
        self.text, self.set = f" {' '.join(words)} ", set(words)
        self.ids = np.fromiter((_vocabulary().get(w, -1) for w in words), np.int64, len(words))

    def _held(self, name: str) -> list[tuple[tuple[str, ...], frozenset[int]]]:
        return [s for s, may in zip(_statements(name), _may_hold(name, self.set)) if may]

    def windows(self, name: str) -> list[tuple[int, int]]:
        """(first word, end) of the windows that may hold a statement of the license, joined where they touch; they end with a word of it."""
        out: list[tuple[int, int]] = []
        for words, _ in self._held(name):
            width, at = len(words) + int(len(words) * MOST_CHANGED), _starts(words, self.ids)
            if len(at):
                of, breaks = np.flatnonzero(_own(words, self.ids)), np.flatnonzero(np.diff(at) > width)
                ends = of[np.searchsorted(of, at + width) - 1] + 1
                out += [(int(at[a]), int(ends[b])) for a, b in zip([0, *(breaks + 1)], [*breaks, len(at) - 1])]
        return out

    def wordings(self, name: str) -> Iterator[int]:
        """The differing words of each wording of the license's statements."""
        for words, told in self._held(name):
            exact = _exact(words, self.text)
            yield from [0] * len(exact)
            if int(len(words) * MOST_CHANGED):
                yield from (d for d, _, _ in _modified(words, told, self.ids, exact))


def differences(name: str, block: list[str] | Words) -> int | None:
    """The fewest words in which a statement of the license differs from the block; None if none comes close."""
    return min((block if isinstance(block, Words) else Words(block)).wordings(name), default=None)


def blocks(lines: list[str], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the blocks of cue lines and of the found (first line, line after the last)."""
    out = []
    for first, end in sorted([*found, *((i, i + 1) for i, line in enumerate(lines) if CUES.search(line))]):
        if out and first - out[-1][1] <= REACH:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def found_in(text: str | None) -> list[tuple[int, int, str, float, int]]:
    """(first line, end, license, share saved, differing words) for each confirmed license of each block."""
    low = (text or "").lower()
    names = [k for k in LICENSES if any(_may_hold(k, low))]
    if not names:
        return []
    lines = text.split("\n")
    split = [[w.lower() for w in _WORD.findall(line)] for line in lines]
    line_of = [i for i, line in enumerate(split) for _ in line]
    words = Words([w for line in split for w in line])
    windows = [(line_of[a], line_of[b - 1] + 1) for k in names for a, b in words.windows(k)]
    out = []
    for first, end in blocks(lines, windows) if windows else []:
        own = Words([w for line in split[first:end] for w in line])
        held = [k for k in names if any(_may_hold(k, own.set))]
        out += [(first, end, k, share, d) for k, share in (_ranked(lines[first:end]) if held else []) if k in held and (d := differences(k, own)) is not None]
    return out


def _ranked(block: list[str]) -> list[tuple[str, float]]:
    """(license, share of the block's compressed size that its dictionary saves), the most first."""
    plain, by_license = _compressors()
    saved = dict.fromkeys(LICENSES, -math.inf)
    # A long block hides what a short notice saves, so each of its cue lines is ranked too.
    for part in ["\n".join(block), *(line for line in block if len(block) > 1 and CUES.search(line))]:
        raw = part.encode()
        alone = len(plain.compress(raw))
        for k in saved:
            saved[k] = max(saved[k], 1 - len(by_license[k].compress(raw)) / alone)
    return sorted(((k, round(x, 4)) for k, x in saved.items()), key=lambda r: (-saved[r[0]], r[0]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, an array of structs (first_line, end_line, license, saved, differing), for every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(fields, f)) for f in found_in(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    fields = ("first_line", "end_line", "license", "saved", "differing")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())))))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, found array<struct<first_line:int,end_line:int,license:string,saved:double,differing:int>>")
