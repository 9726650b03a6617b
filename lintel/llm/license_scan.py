"""Operator 3: license scan by conditional compression.

Passages around license words are candidate blocks. A block compresses better with
a text like it at hand: each template whose names it holds is given to zstandard
as a raw dictionary, and templates are ranked by the bytes they save on the block. In that
order they are confirmed or dropped by their exact wording differences: the
share of the template's words that a passage has in order, the words that must be
there (names, versions), and words that tell a license from its relatives
(``TELLING``: Lesser, Affero, ShareAlike, ...), none of which may stand in the passage
unless the template has it. What a confirmed template covers is used; the words left
over are compressed and ranked again until none is confirmed.

Texts without a license word are left out by a pattern before Python sees them.
Rows are independent: no shuffle; a task holds one slice of texts and remembers a
bounded number of blocks already judged.

Defined results: null, empty and other texts without license words give no rows, and
neither do licenses that no template is for; each confirmed notice of a text is a
row, so repeated rows of a document give repeated rows; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version"
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution")
_BSD_3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_CC = "Licensed under a Creative Commons Attribution{} 4.0 International License"
# License, words that must be there, wording of the notice or grant (public license texts).
TEMPLATES = [
    ("Apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "mit", "Released under the MIT License"),
    ("MIT", "mit", "This software is licensed under the MIT License"),
    ("MIT", "permission without restriction merge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "permission use copy fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "isc", "Licensed under the ISC License"),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "boost 1 0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "eclipse public 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("GPL-3.0", "general public 3", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "general public 2", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "lesser general public 3", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-2.1", "lesser general public 2 1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "affero general public 3", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("GPL-3.0", "general public 3", _GPL.format(":", "General Public License", ",", "3")),
    ("GPL-2.0", "general public 2", _GPL.format(";", "General Public License", ";", "2")),
    ("LGPL-3.0", "lesser general public 3", _GPL.format(":", "Lesser General Public License", ",", "3")),
    ("LGPL-2.1", "lesser general public 2 1", _GPL.format(";", "Lesser General Public License", ";", "2.1")),
    ("AGPL-3.0", "affero general public 3", _GPL.format(":", "Affero General Public License", ",", "3")),
    ("GPL-3.0", "gpl v3", "License: GPL v3"), ("GPL-2.0", "gpl v2", "License: GPL v2"), ("GPL-3.0", "gplv3", "Licensed under GPLv3"), ("GPL-2.0", "gplv2", "Licensed under GPLv2"),
    ("CC-BY-4.0", "cc by 4 0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4 0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "cc by nc nd 4 0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "creative commons attribution 4 0", _CC.format("")),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0", _CC.format("-ShareAlike")),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0", _CC.format("-NonCommercial")),
    ("CC-BY-ND-4.0", "creative commons attribution noderivatives 4 0", _CC.format("-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "creative commons attribution noncommercial sharealike 4 0", _CC.format("-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", "creative commons attribution noncommercial noderivatives 4 0", _CC.format("-NonCommercial-NoDerivatives")),
    ("BSD-3-Clause", "bsd 3", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "bsd 2", "Licensed under the BSD 2-Clause License"),
    ("BSD", "bsd license", "BSD License"),
    ("BSD-3-Clause", "redistribution source binary neither endorse promote", _BSD + _BSD_3),
    ("BSD-2-Clause", "redistribution source binary reproduce", _BSD),
    ("BSD", "redistribution source binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
_SPDX = ("Apache-2.0", "MIT", "ISC", "Unlicense", "BSL-1.0", "EPL-2.0", "MPL-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSD-3-Clause", "BSD-2-Clause")
TEMPLATES += [(name, "spdx identifier " + name.lower().replace("-", " ").replace(".", " "), f"SPDX-License-Identifier: {name}") for name in _SPDX]
#: Words that tell a license from its relatives: a template doesn't fit words that hold one it hasn't.
TELLING = frozenset("lesser affero library sharealike noncommercial noderivatives noderivs sa nc nd endorse".split())
CUE = r"(?i)licen[sc]|copyright|public domain|permission (?:is hereby granted|to use)|redistribut|\bGPL"
#: Words kept on either side of a license word; least share of a template's words; blocks remembered, and characters up to which one is.
AROUND, LEAST, REMEMBERED, LONG = 60, 0.8, 20_000, 4_000
_CUE, _WORD = re.compile(CUE), re.compile(r"[^\W_]+")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of up to ``AROUND`` words either side of license words, across line ends; overlapping ones are one."""
    cues = [(m.start(), m.end()) for m in _CUE.finditer(text)]
    begins, ends = zip(*[m.span() for m in _WORD.finditer(text)]) if cues else ((), ())
    spans: list[list[int]] = []
    for start, end in cues:
        first, last = bisect_right(begins, start) - 1, bisect_left(ends, end)  # the words that the cue begins and ends in
        lo, hi = begins[max(first - AROUND, 0)], ends[min(last + AROUND, len(ends) - 1)]
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    yield from (tuple(s) for s in spans)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@cache
def _templates() -> list[tuple[str, set[str], list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, needed, text in TEMPLATES:
        own = words(text)
        held = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, set(needed.split()), own, zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False)))
    return out


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def _saving(passage: list[str], i: int) -> tuple[int, float]:
    """Bytes of a passage's compressed size that a template saves, and their share."""
    data = " ".join(passage).encode()
    alone = len(_plain().compress(data))
    saved = alone - len(_templates()[i][3].compress(data))
    return saved, saved / alone


def _wording(i: int, own: list[str]) -> tuple[int, int, int] | None:
    """``(lo, hi, missing)`` of the words that hold a template's wording, if they do; None otherwise."""
    _, needed, wording, _ = _templates()[i]
    runs = [m for m in SequenceMatcher(None, wording, own, autojunk=False).get_matching_blocks() if m.size]
    least, matched = LEAST * len(wording), sum(m.size for m in runs)
    held = lambda some: {w for m in some for w in own[m.b:m.b + m.size]}
    while matched >= least and len(runs) > 1:  # words far from the others at an end are of another sentence
        gaps = [(runs[1].b - runs[0].b - runs[0].size, runs[0], runs[1:]), (runs[-1].b - runs[-2].b - runs[-2].size, runs[-1], runs[:-1])]
        gap, end, rest = max(gaps, key=lambda g: g[0] - g[1].size)
        if gap <= end.size or matched - end.size < least or not needed <= held(rest):
            break
        runs, matched = rest, matched - end.size
    if matched < least or not needed <= held(runs):
        return None
    lo, hi = runs[0].b, runs[-1].b + runs[-1].size
    if hi - lo - matched > len(wording) or TELLING.intersection(own[lo:hi]) - set(wording) - _shared(i):
        return None
    return lo, hi, len(wording) - matched


@cache
def _shared(i: int) -> frozenset[str]:
    """Telling words that mean nothing to a template: those of families it isn't of."""
    name = TEMPLATES[i][0]
    own = {"GPL": "lesser affero library", "LGP": "affero", "AGP": "lesser library", "CC-": "sharealike noncommercial noderivatives noderivs sa nc nd", "BSD": "endorse"}.get(name[:3], "")
    return TELLING - set(own.split())


def _notices(i: int, own: list[str], begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Places between two words that hold a template's wording, one after the other.

    A notice has at most twice its template's words; the passages compared have
    four times as many, and begin at every multiple of its number. A passage may
    end within a notice, so a place found is looked at again with the words around it.
    """
    _, needed, wording, _ = _templates()[i]
    size, distinct, at, free = len(wording), set(wording), begin, begin
    while end - at >= LEAST * size:
        passage = own[at:min(at + 4 * size, end)]
        here = distinct.intersection(passage)
        found = _wording(i, passage) if needed <= here and len(distinct) - len(here) <= (1 - LEAST) * size + 1e-9 else None
        if found:
            lo, hi, missing = at + found[0], at + found[1], found[2]
            around = max(lo - size, free)
            again = _wording(i, own[around:min(lo + 3 * size, end)])
            if again and again[2] < missing:
                lo, hi, missing = around + again[0], around + again[1], again[2]
            yield lo, hi, missing
            at = free = max(hi, at + 1)
        else:
            at += size


def judge(block: str) -> list[tuple[str, float, int, int]]:
    """``(license, saved, missing, added)`` of the confirmed licenses of a block, in the order of their place.

    saved: share of the passage's compressed size that the template saves; missing: words of
    the template that the passage lacks; added: words of the passage between those it has.
    """
    return [hit[2:] for hit in places(block)]


def places(block: str) -> list[tuple[int, int, str, float, int, int]]:
    """The place (start, end) of each confirmed license of a block, and what ``judge`` gives."""
    return (_judged if len(block) <= LONG else _judged.__wrapped__)(block)


@lru_cache(maxsize=REMEMBERED)
def _judged(block: str) -> list[tuple[int, int, str, float, int, int]]:
    spans = [m.span() for m in _WORD.finditer(block)]
    own = words(block)
    present, out, left = set(own), [], [(0, len(own))]
    candidates = [i for i, t in enumerate(_templates()) if t[1] <= present]
    while left:  # until the words left over confirm no template
        begin, end = left.pop()
        ranked = sorted((-_saving(own[begin:end], i)[0], i) for i in candidates)
        used: list[tuple[int, int]] = []
        for _, i in ranked:  # the template that saves most first
            for lo, hi, missing in _notices(i, own, begin, end):
                at = bisect_left(used, (lo, hi))
                if (at == 0 or used[at - 1][1] <= lo) and (at == len(used) or hi <= used[at][0]):
                    used.insert(at, (lo, hi))
                    off = hi - lo - len(_templates()[i][2]) + 2 * missing
                    out.append((spans[lo][0], spans[hi - 1][1], _templates()[i][0], round(_saving(own[lo:hi], i)[1], 4), missing, off - missing))
        if used:
            left += [(a, b) for a, b in zip([begin, *[hi for _, hi in used]], [*[lo for lo, _ in used], end]) if b > a]
    return sorted(out)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, end, license, saved, missing, added)`` for each confirmed notice (code points)."""
    kept = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(CUE))
    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, end long, license string, saved double, missing long, added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [(i, lo + start, lo + end, *hit) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for lo, hi in blocks(t) for start, end, *hit in places(t[lo:hi])]
                if rows:
                    types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)],
                                                     names=["doc_id", "start", "end", "license", "saved", "missing", "added"])

    return kept.mapInArrow(run, schema)
