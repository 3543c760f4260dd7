"""License scans by conditional compression.

Texts with a cue word are cut into candidate blocks: the words around a cue, as many as a template has, if enough of the template's words are
there. Each block is compressed by itself and with each template as a zstandard raw dictionary, and the templates are ranked by how much smaller
that makes it. The FEW best ones, and others within MARGIN of the best, are the winners, and only they are confirmed.

A winner is confirmed by exact wording: a window of the block's words that lacks, or adds, no more words than the template allows. That is
``share`` of its words, and one word in any case of four words or more; words that tell licenses apart (all but the fixed FILLERS) may not
be missing from a template of fewer than SHORT words. Windows run over line ends. Of windows of one template that overlap, the one with the fewest
differences is the finding; a finding that lies within another template's is dropped if that one has fewer differences, or as many in more
words. All others are reported, so equal notices are findings each, and a window that two templates fit equally well has both. A finding's
reduction and rank are those of its window.

Texts are compared in lower case, words without punctuation around them. Null and empty texts have no findings. Repeated
rows give equal results. Texts of any length are scanned as wholes. Empty tables give empty tables; columns other than
those named are carried along. Templates are a parameter: some dozens of notices, sent with the tasks; each must have a
word.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .html_text import shared

#: Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-notice": "Licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "Licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0-SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "GPL-2.0-or-later-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will
        be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "LGPL-2.1-or-later-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Words that notices of one license have or lack.
FILLERS = {"a", "all", "and", "are", "at", "be", "by", "distributed", "for", "in", "is", "it", "licensed", "made", "of", "or", "project", "provided", "published", "released", "software", "terms", "the", "this", "to", "under", "version", "with", "work"}
#: Templates with fewer words than this keep all words that tell.
SHORT = 20
#: How many templates are confirmed for a block at least, and how much larger than the best one's the block may be with others.
FEW, MARGIN = 3, 0.1
_WORD = re.compile(r"\w(?:[\w.\-]*\w)?")
FINDING = StructType([StructField("license", StringType()), StructField("line", IntegerType()), StructField("reduction", DoubleType()), StructField("missing", ArrayType(StringType())), StructField("extra", ArrayType(StringType())), StructField("rank", IntegerType())])


def _allowed(words: list[str], share: float) -> int:
    """So many words may be missing or extra; one of the template has to be there."""
    return min(max(int(share * len(words)), int(len(words) >= 4)), len(words) - 1)


def telling(words: list[str]) -> list[str]:
    """The words that a short template can't do without."""
    return [w for w in words if w not in FILLERS] if len(words) < SHORT else []


def _cues(templates: dict[str, str], share: float) -> dict[str, list[str]]:
    """For each template its longest telling word, or one word more than may be missing, the longest ones."""
    words = {k: _WORD.findall(t.lower()) for k, t in templates.items()}
    if bare := sorted(k for k, w in words.items() if not w):
        raise ValueError(f"Templates without words: {', '.join(bare)}")
    return {k: sorted(t, key=len)[-1:] if (t := telling(w)) else sorted(w, key=len, reverse=True)[: _allowed(w, share) + 1] for k, w in words.items()}


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words of the block between the first and the last that agree."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(w, len(number)) for w in x] for x in (template, block))
    mine, theirs = set(shared(a, b)), shared(b, a)
    extra = [block[i] for i in range(theirs[0], theirs[-1]) if i not in set(theirs)] if theirs else []
    return [w for i, w in enumerate(template) if i not in mine], extra


def windows(template: Sequence, text: Sequence, allowed: int, first: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(differences, start, end) of the windows of the text's words that differ from the template in at most ``allowed``
    missing and extra words; of windows that overlap, the one with the fewest differences, then the shortest."""
    n = len(template)
    costs, starts = list(range(n + 1)), [first] * (n + 1)  # of the template's beginnings against windows that end here
    ends: list[tuple[int, int, int]] = []
    for j in range(first, len(text) if end is None else end):
        word, old, from_ = text[j], costs[0], starts[0]
        starts[0] = j + 1
        for i in range(1, n + 1):
            best = min((costs[i] + 1, -starts[i]), (costs[i - 1] + 1, -starts[i - 1]))
            if template[i - 1] == word:
                best = min(best, (old, -from_))
            old, from_ = costs[i], starts[i]
            costs[i], starts[i] = best[0], -best[1]
        if costs[n] <= allowed and starts[n] <= j:
            ends.append((costs[n], starts[n], j + 1))
    taken: list[tuple[int, int, int]] = []  # by start
    for off, s, e in sorted(ends, key=lambda w: (w[0], w[2] - w[1], w[1])):
        at = bisect.bisect_left(taken, s, key=lambda w: w[1])
        if (at == 0 or taken[at - 1][2] <= s) and (at == len(taken) or taken[at][1] >= e):
            taken.insert(at, (off, s, e))
    return taken


class Scanner:
    def __init__(self, templates: dict[str, str], share: float) -> None:
        import zstandard

        self.words = {k: _WORD.findall(t.lower()) for k, t in templates.items()}
        self.allowed = {k: _allowed(w, share) for k, w in self.words.items()}
        cues = _cues(templates, share)
        self.number = {w: i for i, w in enumerate(sorted({w for x in self.words.values() for w in x}))}
        self.ids = {k: [self.number[w] for w in x] for k, x in self.words.items()}
        self.must = {k: {self.number[w] for w in telling(x)} for k, x in self.words.items()}
        self.cued: dict[int, list[str]] = {}  # templates by cue
        for k, x in cues.items():
            for w in set(x):
                self.cued.setdefault(self.number[w], []).append(k)
        self.cues = re.compile("|".join(sorted({re.escape(w) for x in cues.values() for w in x})) or r"(?!)")
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        raw = {k: zstandard.ZstdCompressionDict(t.lower().encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, t in templates.items()}
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False) for k, d in raw.items()}

    def _ranges(self, ids: array) -> dict[str, list[list[int]]]:
        """For each template, where in the text it can be: around cues with enough of its words."""
        out: dict[str, list[list[int]]] = {}
        for at, x in enumerate(ids):
            for k in self.cued.get(x, ()):
                reach, mine = len(self.ids[k]) + self.allowed[k], set(self.ids[k])
                s, e = max(0, at + 1 - reach), min(len(ids), at + reach)
                if len(mine.intersection(ids[s:e])) < len(mine) - self.allowed[k]:
                    continue
                found = out.setdefault(k, [])
                if found and s <= found[-1][1]:
                    found[-1][1] = e
                else:
                    found.append([s, e])
        return out

    def _packed(self, low: str, places: array, s: int, e: int) -> tuple[dict[str, int], bytes]:
        """The size of some words of a text when they are compressed with each template, and the words themselves."""
        raw = low[places[s] : _WORD.match(low, places[e - 1]).end()].encode("utf-8", "surrogatepass")
        return {t: len(c.compress(raw)) for t, c in self.given.items()}, raw

    def _wins(self, k: str, low: str, places: array, s: int, e: int) -> bool:
        """Whether a template is among the best of a candidate block: cut into pieces of its own length, if several cues made the block longer."""
        step = len(self.ids[k]) + self.allowed[k]
        for at in range(s, e, step):
            packed, _ = self._packed(low, places, at, min(e, at + 2 * step))
            if packed[k] <= max(sorted(packed.values())[: FEW][-1], (1 + MARGIN) * min(packed.values())):
                return True
        return False

    def text(self, text: str) -> list[tuple]:
        """license, line of the first word, reduction, missing and extra words, and rank of each finding, by place."""
        low = text.lower()
        if not self.cues.search(low):
            return []
        ids, places = array("i"), array("q")
        for m in _WORD.finditer(low):
            ids.append(self.number.get(m[0], -1))
            places.append(m.start())
        near = {k: [w for s, e in r if self._wins(k, low, places, s, e) for w in windows(self.ids[k], ids, self.allowed[k], s, e) if self.must[k] <= set(ids[w[1] : w[2]])] for k, r in self._ranges(ids).items()}
        kept = []
        for k, found in near.items():
            for off, s, e in found:
                within = (x[bisect.bisect_right(x, s, key=lambda w: w[1]) - 1] for x in near.values() if x and x[0][1] <= s)
                if not any(e <= w[2] and (w[0], w[1] - w[2]) < (off, s - e) for w in within):
                    kept.append((s, e, k))
        out, line, before = [], 0, 0
        for s, e, k in sorted(kept):
            line, before = line + low.count("\n", before, places[s]), places[s]
            packed, raw = self._packed(low, places, s, e)
            rank = 1 + sum(n < packed[k] for n in packed.values())
            reduction = 1 - packed[k] / len(self.alone.compress(raw))
            out.append((k, line, reduction, *differences(self.words[k], _WORD.findall(raw.decode("utf-8", "surrogatepass"))), rank))
        return out


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str] = TEMPLATES, share: float = 0.1) -> DataFrame:
    """Every row with ``findings``: license, line, reduction, and the words that are missing and extra."""
    every = {w for x in _cues(templates, share).values() for w in x}
    cues = sorted(w for w in every if not any(v != w and v in w for v in every))  # a word that holds another cue is found with it

    @F.pandas_udf(ArrayType(FINDING))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, share)
        names = FINDING.fieldNames()
        for batch in texts:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in scanner.text(t)] if t else [] for t in batch])

    # Texts without a cue are told apart before anything is sent to Python.
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cue = reduce(or_, [low.contains(c) for c in cues], F.lit(False))
    return docs.drop("findings").withColumn("findings", found(F.when(cue, F.col(text))))
