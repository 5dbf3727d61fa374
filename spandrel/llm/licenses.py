"""License scans by conditional compression.

A candidate block is the words around mentions of licensing. It is compressed by itself and with each template as a raw
Zstandard dictionary. Templates are ranked by the bytes that they save; those that save a share `WINS` of what they save on their own
wording are winners, and only winners are confirmed: by their exact wording, at every place, best first. Words that are missing, added or
replaced are counted by an alignment with the block, and no more than one in `ONE_IN` of the template's words may differ (one word at least in
templates of `LEAST_LOOSE` words or more); words that name a license or its version may not differ at all. Confirmed words are taken
out, so each mention is found once, and the rest is compressed again, as one notice can hide another from the compression.

Defined results: a null or empty text has no match and no row; a null doc_id stays null; repeated rows give repeated matches;
other columns, whatever their names, are ignored; an empty table gives an empty result. Texts are read whole; the words of one
text at a time are in memory, and what up to `_KEPT` blocks gave, by a digest of their words.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of licenses and notices, as published.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "Public domain": "This work is released into the public domain.",
    "GPL-2.0 (terms)": "Distributed under the terms of the GNU General Public License version 2.",
    "GPL-3.0 (terms)": "Distributed under the terms of the GNU General Public License version 3.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0+": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0+": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1+": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0+": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MIT (title)": "MIT License Copyright (c)",
    "BSD-3-Clause (notice)": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause (notice)": "Licensed under the BSD 2-Clause License.",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 2",
    "GPL-3.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 3",
    "LGPL-3.0 (title)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    "AGPL-3.0 (title)": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3",
    "MIT (disclaimer)": "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "BSD (disclaimer)": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}
#: Identifiers of SPDX; each gives a template.
IDENTIFIERS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {f"{name} (SPDX)": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
#: Words that name a license, its variant or its version.
NAMES = frozenset((
    "mit apache bsd isc gnu gpl lgpl agpl mpl general lesser affero mozilla cc creative commons attribution sharealike attribution-sharealike noncommercial international by nc sa nd "
    "by-nc by-sa by-nd by-nc-sa by-nc-nd 1 1.0 2 2.0 2.1 3 3.0 4.0 v2 v3 2-clause 3-clause domain reserved unencumbered"
).split()) | {name.lower() for name in IDENTIFIERS}
#: What makes the words around it a candidate. Written so that engines that know fewer letters and spaces find more, not less.
MENTIONS = r"licen[cs]|copyright|copyleft|rights\W+reserved|public\W+domain|creative\W+commons|permission|redistribut|free\W+software|warrant|general\W+public"
#: Level of the compression: with lower ones the matches of a short block do not pay, and its savings tell less.
LEVEL = 15
#: What a template must save of what it saves on its own wording, to be confirmed. Of 342 notices each, in 94 words of prose, whole ones saved 0.36 at least, and 99 in 100
#: with their tolerance used up 0.32; in a few words beside another notice 0.36 at least; of prose without a notice 1 in 100 saved 0.12 (0.31 at most).
WINS = 0.25
#: Words around a mention that a block takes in, at least; more if a template reaches further from its mentions.
AROUND = 24
#: One word in so many of a template may differ, and one at least in a template of so many words.
ONE_IN, LEAST_LOOSE = 10, 4

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_KEPT = 50_000


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def tolerance(template: list[str]) -> int:
    return max(len(template) // ONE_IN, int(len(template) >= LEAST_LOOSE))


def distances(template: list[str], words: list[str]) -> np.ndarray:
    """For each place (0 to len(words)): words that differ between the template and the best part of words that ends there.

    A word that is missing, added or replaced counts one; one that names a license counts more than any tolerance.
    """
    weigh = lambda w: len(template) + 1 if w in NAMES else 1
    drop = np.array([0, *np.cumsum([weigh(w) for w in template]).tolist()])  # of the first words of the template
    costs = np.array([weigh(w) for w in template])
    held, out = drop.copy(), [int(drop[-1])]
    index = {w: np.array([t != w for t in template]) for w in set(words)}
    for w in words:
        added = weigh(w)
        fresh = np.empty_like(held)
        fresh[0] = 0
        fresh[1:] = np.minimum(held[1:] + added, held[:-1] + np.where(index[w], np.maximum(costs, added), 0))
        held = np.minimum.accumulate(fresh - drop) + drop  # words of the template that are missing at the end
        out.append(int(held[-1]))
    return np.array(out)


def _reach(template: str) -> int:
    """Words from a template's beginning or end to the nearest mention in it, at most, and those that may be added."""
    ends = [m.end() for m in _WORD.finditer(template)]
    hits = [bisect_right(ends, m.start()) for m in re.finditer(MENTIONS, template, re.I)]
    return max(hits[0], len(ends) - hits[-1]) + tolerance(_words(template)) + 1 if hits else 0


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = []
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for name, text in templates.items():
            words = _words(text)
            data = " ".join(words).encode()
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False)
            known.precompute_compress(level=LEVEL)
            most = len(plain.compress(data)) - len(given.compress(data))
            self.templates.append((name, words, given, max(1, most)))
        self.plain = plain
        self.longest = max((len(t[1]) for t in self.templates), default=0)
        self.around = max([AROUND, *(_reach(t) for t in templates.values())])
        self.kept: dict[bytes, list[tuple]] = {}

    def winners(self, words: list[str]) -> list[tuple[int, int]]:
        """(bytes saved, template) of the templates that save enough of what they can here, those that save most first."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = [(alone - len(given.compress(data)), i) for i, (_, _, given, _) in enumerate(self.templates)]
        return sorted(((n, i) for n, i in saved if n >= WINS * self.templates[i][3]), key=lambda x: (-x[0], x[1]))

    @staticmethod
    def places(template: list[str], words: list[str]) -> list[tuple[int, int, int, str]]:
        """(first word, last + 1, words that differ, how) of the places where words say the template, apart, the closest first."""
        most = tolerance(template)
        ends = distances(template, words)
        found: list[tuple[int, int, int, str]] = []
        for end in sorted(np.flatnonzero(ends <= most).tolist(), key=lambda e: (ends[e], e)):
            low = max(0, end - len(template) - most)
            back = distances(template[::-1], words[low:end][::-1])
            start = end - int(np.flatnonzero(back <= ends[end])[0])
            if any(start < b and a < end for a, b, _, _ in found):
                continue
            how = []
            for op, a, b, c, d in SequenceMatcher(None, template, words[start:end], autojunk=False).get_opcodes():
                if op != "equal":
                    how.append(f"-{' '.join(template[a:b])}" * (b > a) + f"+{' '.join(words[start + c : start + d])}" * (d > c))
            found.append((start, end, int(ends[end]), "; ".join(how)))
        return found

    def block(self, words: list[str]) -> list[tuple[int, int, int, int, int, str]]:
        """(first word, last + 1, template, bytes saved, words that differ, how) of each confirmed mention."""
        key = hashlib.blake2b("\0".join(words).encode(), digest_size=16).digest()
        if (got := self.kept.get(key)) is not None:
            return got
        found, rest, before = [], list(words), -1
        while len(found) > before:  # what is confirmed is taken out, and templates that it hid can win then
            before = len(found)
            for saved, i in self.winners([w for w in rest if w[0] != "\0"]):
                for a, b, differ, how in self.places(self.templates[i][1], rest):
                    found.append((a, b, i, saved, differ, how))
                    rest[a:b] = [f"\0{a}"] * (b - a)  # words that nothing matches
        if len(self.kept) >= _KEPT:
            self.kept.clear()
        self.kept[key] = found
        return found

    def text(self, text: str, mention: re.Pattern) -> list[tuple]:
        """(start, end, license, saved bytes, differing words, differences) in characters of the text."""
        hits = [m.start() for m in mention.finditer(text)]
        if not hits:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        starts = [a for a, _ in spans]
        blocks: list[list[int]] = []
        for h in hits:
            i = max(0, bisect_right(starts, h) - 1)
            low, high = max(0, i - self.around), min(len(spans), i + self.around)
            if blocks and low <= blocks[-1][1]:
                blocks[-1][1] = high
            else:
                blocks.append([low, high])
        out = []
        for low, high in blocks:
            words = [text[a:b].lower() for a, b in spans[low:high]]
            for a, b, i, saved, differ, how in self._parts(words):
                out.append((spans[low + a][0], spans[low + b - 1][1], self.templates[i][0], saved, differ, how))
        return out

    def _parts(self, words: list[str]) -> list[tuple]:
        """A block of any length, in parts that overlap by the longest template."""
        step = 4 * self.longest
        if len(words) <= step + 2 * self.longest:
            return sorted(self.block(words))
        found: dict[tuple[int, int], tuple] = {}
        for low in range(0, len(words), step):
            for a, b, *more in self.block(words[low : low + step + 2 * self.longest]):
                if low + a < low + step or low + step >= len(words):  # what begins later is the next part's
                    found.setdefault((low + b, more[0]), (low + a, low + b, *more))
        return sorted(found.values())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed mention: doc_id, start, end (characters), license, saved_bytes, differing_words, differences, exact."""
    templates = dict(TEMPLATES if templates is None else templates)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved_bytes", pa.int64()), ("differing_words", pa.int64()), ("differences", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, mention = Scanner(templates), re.compile(MENTIONS, re.I)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(doc_id, *m, m[4] == 0) for m in scanner.text(text.as_py() or "", mention)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.types)], schema=kinds)

    likely = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(f"(?iu){MENTIONS}"))
    return likely.mapInArrow(run, "doc_id long, start long, end long, license string, saved_bytes long, differing_words long, differences string, exact boolean")
