"""License scans by conditional compression.

Each template has keys: pairs of neighbouring words, so many that any wording within the allowed edits still holds one.
All templates' keys are looked up in a text's words at once. Where some are, the block is compressed alone and with each of
their templates as a zstandard raw dictionary, and the templates are ranked by the size that their dictionary saves. In that
order all are confirmed by exact wording: the words to insert, delete or replace between the template and the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Notice wordings of common public licenses, one entry a wording.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
MAX_DIFF = 0.2
#: Words that say little; keys of other words are preferred.
COMMON = set("a all an and any are as at be by for in is it of on or that the this to with you".split())
_WORD = re.compile(r"[A-Za-z0-9.+-]*[A-Za-z0-9]")


def _words(text: str) -> list[str]:
    return " ".join(_WORD.findall(text)).lower().split(" ")


def key_places(words: list[str], edits: int) -> list[tuple[int, int]]:
    """(place, length) of a template's keys: within ``edits`` word edits of it, a text holds at least one of them.

    An edit breaks two pairs of neighbours at most, so one pair more than twice the edits is enough; or one word more than the edits.
    """

    def plain(at: int, n: int) -> int:
        return sum(w in COMMON for w in words[at : at + n])

    if len(words) - 1 >= 2 * edits + 1:
        return [(k, 2) for k in sorted(range(len(words) - 1), key=lambda k: (plain(k, 2), k))[: 2 * edits + 1]]
    return [(k, 1) for k in sorted(range(len(words)), key=lambda k: (plain(k, 1), k))[: edits + 1]]


def wordings(want: np.ndarray, window: np.ndarray, edits: int) -> list[tuple[int, int, int]]:
    """(word edits, first, end) of the places in a window of word numbers that differ from ``want`` by at most ``edits``."""
    n = len(window)
    cols = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), cols.copy()
    for k, word in enumerate(want):
        best, at = cost + 1, start.copy()  # the template's word is left out
        swap = cost[:-1] + (window != word)
        better = swap <= best[1:]
        best[1:], at[1:] = np.where(better, swap, best[1:]), np.where(better, start[:-1], at[1:])
        low = best - cols  # words of the window that the template lacks
        run = np.minimum.accumulate(low)
        source = np.maximum.accumulate(np.where(low == run, cols, 0))
        cost, start = run + cols, at[source]
    return [(int(cost[j]), int(start[j]), int(j)) for j in np.flatnonzero(cost <= edits) if start[j] < j]


class Scanner:
    """Compressors with each template as dictionary, the keys of all templates, and the confirmation by wording."""

    def __init__(self, templates: dict[str, list[str]], max_diff: float):
        self.entries, self.plain, self.numbers = [], zstandard.ZstdCompressor(level=3), {}
        keys: dict[str, list[tuple[int, int]]] = {}
        for name, texts in templates.items():
            for t in texts:
                words = _words(t)
                edits = int(max_diff * len(words) + 1e-9)
                d = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_dict_id=False)
                for k, n in key_places(words, edits):
                    keys.setdefault(f" {' '.join(words[k : k + n])} ", []).append((len(self.entries), k))
                want = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
                self.entries.append((name, want, edits, c))
        self.keys = ahocorasick.Automaton()
        for key, places in keys.items():
            self.keys.add_word(key, (len(key), places))
        self.keys.make_automaton()

    def _regions(self, line: str) -> dict[int, list[list[int]]]:
        """For each template the runs [lowest, highest] of places where it would begin, by the keys found; places closer than its edits are one run."""
        found: dict[int, set[int]] = {}
        at, word = 0, 0
        for end, (size, places) in self.keys.iter(line):
            start = end - size + 1
            word += line.count(" ", at, start)
            at = start
            for entry, k in places:
                found.setdefault(entry, set()).add(word - k)
        out = {}
        for entry, begins in found.items():
            runs: list[list[int]] = []
            for x in sorted(begins):
                if runs and x - runs[-1][1] <= 2 * self.entries[entry][2] + 1:
                    runs[-1][1] = x
                else:
                    runs.append([x, x])
            out[entry] = runs
        return out

    def saving(self, raw: bytes, entry: int) -> float:
        """Share of a block's compressed size that a template's dictionary saves."""
        alone = len(self.plain.compress(raw))
        return (alone - len(self.entries[entry][3].compress(raw))) / alone

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int]]:
        """(license, start, end, saving, word edits) found in a whole text, in order.

        Of overlapping places the one with the smallest share of edits stays, then the longest, then the one that saves most.
        """
        line = f" {' '.join(_WORD.findall(text))} ".lower() if text else ""
        regions = self._regions(line) if line.strip() else {}
        if not regions:
            return []
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        ids = np.array([self.numbers.get(w, 0) for w in line.split()])
        blocks = []
        for entry, runs in regions.items():
            n, edits = len(self.entries[entry][1]), self.entries[entry][2]
            for lo, hi in runs:
                a, b = max(0, lo - edits), min(len(ids), hi + n + edits)
                if b > a:
                    blocks.append((self.saving(text[places[a][0] : places[b - 1][1]].lower().encode(), entry), entry, a, b))
        found = []
        for saved, entry, a, b in sorted(blocks, key=lambda x: (-x[0], x[1], x[2])):
            _, want, edits, _ = self.entries[entry]
            found += [(d / len(want), -len(want), -saved, entry, a + s, a + e, d) for d, s, e in wordings(want, ids[a:b], edits)]
        out: list[tuple[str, int, int, float, int]] = []
        for _, _, saved, entry, s, e, d in sorted(found):
            x, y = places[s][0], places[e - 1][1]
            if not any(x < f[2] and f[1] < y for f in out):
                out.append((self.entries[entry][0], x, y, -saved, d))
        return sorted(out, key=lambda f: (f[1], f[2]))


def scan(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, max_diff: float = MAX_DIFF, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, license, start, end, saving, n_edits)`` for each license notice in each row's whole text.

    Places are in code points. One pass, no shuffle; null and empty texts hold none, null ids keep their rows, and
    repeated rows are reported each. Ties between licenses go to the first one of ``templates``. Only the id and text columns are read,
    so others can't clash; a text of any length is looked through as a whole.
    """
    table = templates or TEMPLATES
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(table, max_diff)
        for pdf in frames:
            rows = [(None if pd.isna(i) else int(i), *hit) for i, t in zip(pdf["doc_id"].tolist(), pdf["t"].tolist()) for hit in s.scan(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start", "end", "saving", "n_edits"])
            yield out.astype({"doc_id": "Int64", "start": "int64", "end": "int64", "saving": "float64", "n_edits": "int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return picked.mapInPandas(run, "doc_id long, license string, start long, end long, saving double, n_edits long")
