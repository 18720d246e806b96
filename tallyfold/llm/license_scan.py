"""License notices in texts, by conditional compression.

Lines that speak of licences are candidate blocks, alone and with the lines between them.  A block is
widened by the length of the longest wording.  Windows of a wording's length run over it; those that
hold enough of its words are compressed with nothing and with the wording as a zstandard raw dictionary.
Wordings that save enough are confirmed, or not, by the fewest missing and extra words that any stretch
of the window has; the best ones' words are taken out, and windows that lost words are searched again.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, prepare, text_or_empty

# Wordings of well-known licences and notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: A line with one of these is a candidate.
CUES = ("licen", "copyright", "rights reserved", "public domain", "hereby granted", "redistribution", "permission", "cc by", "free software")
#: Lines without a cue that a block may have between two with one.
GAP = 3
#: The least saving with which a wording is compared word by word, and the least share of its words that
#: the block must have, in order.
LEAST_SAVING, LEAST_SHARE = 0.3, 0.9
#: Characters by which a block is widened on either side: the longest wording, with room for marks of comments.
WIDER = 2 * max(len(w) for wordings in TEMPLATES.values() for w in wordings)
MEMO_BLOCKS = 50_000

_TOKEN = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")
_PLACED = re.compile(_TOKEN.pattern, re.I | re.A)
_open: list[Scanner] = []


def _words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def nearest(want: list[str], have: list[str | None]) -> tuple[int, int, int]:
    """The stretch of ``have`` with the fewest missing and extra words: their number, its first word and the one after it."""
    code = {w: i for i, w in enumerate(set(want))}
    b = np.array([code.get(w, -1) for w in have], np.int64)
    at = np.arange(len(b) + 1)
    cost, start = np.zeros(len(b) + 1, np.int64), at.copy()
    for w in want:
        # a missing word, or one that is there
        step, since = cost + 1, start
        same = np.flatnonzero(b == code[w])
        there = same[cost[same] <= step[same + 1]]
        step[there + 1] = cost[there]
        since = since.copy()
        since[there + 1] = start[there]
        # extra words after it
        low = step - at
        run = np.minimum.accumulate(low)
        place = np.maximum.accumulate(np.where(low == run, at, 0))
        cost, start = run + at, since[place]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Scanner:
    def __init__(self):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.known = []
        for name, wordings in TEMPLATES.items():
            for wording in wordings:
                held = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False)
                self.known.append((name, _words(wording), packer, len(self.plain.compress(wording.encode()))))
        self.count = [Counter(want) for _, want, _, _ in self.known]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for c in self.count for w in c}))}
        self.ids = [np.array(sorted(self.vocabulary[w] for w in c), np.int64) for c in self.count]
        self.memo: dict[tuple, list] = {}

    def windows(self, ids: np.ndarray, i: int, near: np.ndarray | None) -> list[int]:
        """Starts of the windows that hold enough words of wording ``i`` (near one of the places ``near``, if given)."""
        want = self.known[i][1]
        step, wide = self.span(i)
        starts = np.arange(0, max(1, len(ids) - wide + step), step)
        held = np.concatenate([[0], np.cumsum(np.isin(ids, self.ids[i]))])
        starts = starts[held[np.minimum(starts + wide, len(ids))] - held[starts] >= LEAST_SHARE * len(want)]
        if near is not None:
            starts = starts[np.searchsorted(near, starts) < np.searchsorted(near, starts + wide)]
        return starts.tolist()

    def span(self, i: int) -> tuple[int, int]:
        """Step and width of a wording's windows: each stretch of twice its words lies whole in one of them."""
        n = len(self.known[i][1])
        step = max(1, n // 2)
        return step, 2 * n + step

    def judge(self, i: int, have: list[str | None], text: str) -> tuple | None:
        """(order, licence, saving, share, missing, extra words), first and last word, of a wording in a window."""
        name, want, packer, own = self.known[i]
        count = Counter(have)
        if sum(min(n, count[w]) for w, n in self.count[i].items()) < LEAST_SHARE * len(want):
            return None
        data = text.encode()
        saving = (len(self.plain.compress(data)) - len(packer.compress(data))) / own
        if saving < LEAST_SAVING:
            return None
        cost, first, last = nearest(want, have)
        hit = (len(want) + last - first - cost) // 2
        missing, extra = len(want) - hit, last - first - hit
        if hit < LEAST_SHARE * len(want):
            return None
        # a version or a name is a word like others, and has to be there
        if any(w not in have[first:last] for w in want if any(c.isdigit() for c in w)):
            return None
        return (missing + extra, -len(want), -saving), (name, saving, hit / len(want), missing, extra), first, last

    def confirm(self, block: str) -> tuple | None:
        """(licence, saving, share of its words, missing words, extra words) of the best wording that holds."""
        found = self.confirm_all(block, ((0, len(block)),))
        return min(((f[4] + f[5], i, f[1:]) for i, f in enumerate(found)), default=(0, 0, None))[2]

    def confirm_all(self, block: str, cores: tuple[tuple[int, int], ...]) -> list[tuple]:
        """(first character, licence, ...) of each notice in the block, the best ones first.

        Every wording is held against windows of its own length, so what stands around a notice, or how
        often it is repeated, makes no difference.  Beyond the cores (the lines with cues), the extra words
        within a notice may be as many as its own at most."""
        key = block, cores
        if key not in self.memo:
            placed = list(_PLACED.finditer(block))
            have: list[str | None] = [m[0].lower() for m in placed]
            ids = np.array([self.vocabulary.get(w, -1) for w in have], np.int64)
            found: list[tuple] = []
            near = None
            while len(have):
                hits = []
                for i in range(len(self.known)):
                    for s in self.windows(ids, i, near):
                        e = min(s + self.span(i)[1], len(have))
                        if hit := self.judge(i, have[s:e], block[placed[s].start() : placed[e - 1].end()]):
                            order, what, first, last = hit
                            start, end = placed[s + first].start(), placed[s + last - 1].end()
                            if what[4] <= len(self.known[i][1]) or any(a <= start and end <= b for a, b in cores):
                                hits.append((order, s + first, s + last, what))
                gone = []
                for _, first, last, what in sorted(hits, key=lambda h: h[:3]):
                    if all(have[k] is not None for k in range(first, last)):
                        found.append((placed[first].start(), *what))
                        have[first:last] = [None] * (last - first)
                        gone += range(first, last)
                if not gone:
                    break
                ids[gone] = -1
                near = np.array(sorted(gone))  # only windows that have lost words can show something new
            if len(self.memo) >= MEMO_BLOCKS:
                self.memo.clear()
            self.memo[key] = found
        return self.memo[key]

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of candidate blocks, and the notices that were confirmed: (first character, licence, ...)."""
        low = text.lower()
        if not any(c in low for c in CUES):
            return 0, []
        at, marked, runs = 0, 0, []
        for i, line in enumerate(text.split("\n")):
            low = line.lower()
            if any(c in low for c in CUES):
                marked += 1
                if runs and i - runs[-1][1] <= GAP + 1:
                    runs[-1][1], runs[-1][3] = i, at + len(line)
                else:
                    runs.append([i, i, at, at + len(line)])
            at += len(line) + 1
        # widened blocks that overlap are one
        wide: list[list] = []
        for _, _, start, end in runs:
            if wide and start - WIDER <= wide[-1][1]:
                wide[-1][1] = end + WIDER
                wide[-1][2].append((start, end))
            else:
                wide.append([max(0, start - WIDER), end + WIDER, [(start, end)]])
        found = []
        for start, end, cores in wide:
            for hit in self.confirm_all(text[start:end], tuple((a - start, b - start) for a, b in cores)):
                found.append((start + hit[0], *hit[1:]))
        return marked + sum(a != b for a, b, _, _ in runs), found


def scanner() -> Scanner:
    if not _open:
        _open.append(Scanner())
    return _open[0]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns ignored): ``doc_id``,
    ``n_blocks`` (candidates), ``n_found`` (confirmed notices), ``license`` (of the notice with the fewest
    differences, then the largest saving; null if none), ``licenses`` (all, ascending, by comma),
    ``differences`` (missing and extra words of the best one), ``saving`` (bytes saved, as a share of the wording's compressed size).

    A null or empty text has no block, no rows give no rows.  Rows are judged one by one, so repeats and
    ties are alike.  Of a very long text all candidate blocks are searched; each notice is found however
    often it is repeated and whatever stands around it.
    """
    prepare(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("n_found", pa.int64()), ("license", pa.string()), ("licenses", pa.string()), ("differences", pa.int64()), ("saving", pa.float64())]
    )

    def kernel(part: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema}
        for text in part.column("text").to_pylist():
            n, found = scanner().scan(text)
            best = min(found, key=lambda f: (f[4] + f[5], -f[2], f[0]), default=None)
            out["n_blocks"].append(n)
            out["n_found"].append(len(found))
            out["license"].append(best and best[1])
            out["licenses"].append(",".join(sorted({f[1] for f in found})))
            out["differences"].append(best and best[4] + best[5])
            out["saving"].append(best and best[2])
        out["doc_id"] = part.column("doc_id")
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(
        by_slices("text", schema, kernel), "doc_id long, n_blocks long, n_found long, license string, licenses string, differences long, saving double"
    )
