"""Licence statements by conditional compression.

A candidate block is a run of lines without an empty line between them that
holds a trigger word, and each such line by itself. The words round its triggers
are compressed alone and with each template as zstandard raw dictionary; templates
rank by how much smaller that makes them. In this order each is compared exactly:
a notice is confirmed where some run of the block's words can be turned into the
template's by changing, adding or leaving out a small share of them (word edit
distance, by one pass of bit vectors over the block). The pass over the templates
ends where the words that they need show that no lower one can be there. Where
several are confirmed over the same words, the one under which these words alone
compress best holds. Short names and identifiers must stand there word for word,
without a denial in front. The differing words are part of the result.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public wordings of licence notices. Names must match word for word.
TEMPLATES = {
    "MIT": ["the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "BSD": ["the BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "ALL-RIGHTS": ["All rights reserved"],
}
#: Further paragraphs of public licence texts.
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'],
    "BSD": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
}
#: SPDX identifiers by licence, and the usual short names, which stand with the word licence.
IDENTIFIERS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD-3-Clause": ["BSD-3-Clause"], "BSD-2-Clause": ["BSD-2-Clause"], "MPL-2.0": ["MPL-2.0"], "BSL-1.0": ["BSL-1.0"],
    "Unlicense": ["Unlicense"], "Zlib": ["Zlib"], "ISC": ["ISC"], "EPL-2.0": ["EPL-2.0"], "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-ND-4.0": ["CC-BY-ND-4.0"],
}
SHORT = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache 2.0", "Apache 2"], "GPL-3.0": ["GPLv3", "GPL v3", "GPL 3", "GPL version 3", "GNU GPLv3", "GNU GPL v3", "GNU General Public License v3"], "GPL-2.0": ["GPLv2", "GPL v2", "GPL 2", "GPL version 2", "GNU GPLv2", "GNU GPL v2", "GNU General Public License v2"],
    "LGPL-3.0": ["LGPLv3", "LGPL v3", "GNU LGPL v3"], "LGPL-2.1": ["LGPLv2.1", "LGPL v2.1"], "AGPL-3.0": ["AGPLv3", "AGPL v3", "GNU AGPL v3"], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Revised BSD"], "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
    "BSD": ["BSD"], "MPL-2.0": ["MPL 2.0", "Mozilla Public"], "BSL-1.0": ["Boost Software"], "ISC": ["ISC"], "Zlib": ["zlib"], "EPL-2.0": ["Eclipse Public"], "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"], "CC0-1.0": ["CC0", "CC0 1.0"],
}


def known_wordings() -> dict[str, list[str]]:
    """All wordings by licence: notices, paragraphs of texts, and names made from identifiers and short names.

    An identifier with a version stands alone; any stands behind an SPDX tag or the
    word licence, or before it, and a short name before or behind that word. GPL v2
    and the like need none.
    """
    out = {name: [*ws] for name, ws in TEMPLATES.items()}
    for name, ws in TEXTS.items():
        out.setdefault(name, []).extend(ws)
    for name, ids in IDENTIFIERS.items():
        forms = [f"SPDX-License-Identifier {i}" for i in ids] + [i for i in ids if any(c.isdigit() for c in i)]
        for short in [*ids, *SHORT.get(name, [])]:
            forms += [f"{short} {w}" for w in ("License", "Licence")] + [f"{w} {short}" for w in ("License", "Licence", "licensed under", "licenced under", "licensed under the", "released under the")]
        forms += [x for short in SHORT.get(name, []) if any(c.isdigit() for c in short) and "GPL" in short for x in (short, f"{short} or later")]
        out.setdefault(name, []).extend(forms)
    out["BSD"] += [f"{x} BSD License" for x in ("the", "a")] + ["BSD License", "BSD Licence", "BSD-style license"]
    out["Apache-2.0"] += ["Apache License 2.0", "Apache License, Version 2.0", "Apache Licence 2.0"]
    out["MPL-2.0"] += ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"]
    return {name: [*dict.fromkeys(ws)] for name, ws in out.items()}


#: Words that deny a name within the few before it.
DENIALS = frozenset("not no never nor without isn doesn don didn aren wasn cannot non neither".split())
DENIED = 4
#: Words on either side of a trigger that are compressed.
ROUND = 60
TRIGGER = r"(?i)licen[cs]|\bspdx\b|\bl?a?gpl|cc-by|copyright|permission|redistribut|rights reserved|creative commons|\bcc0\b|\bcc[ -]by\b|warrant|public domain"
TRIGGERS = re.compile(TRIGGER)
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Share of a longer notice's words that may differ; names of up to NAME words must be whole.
DIFFER, NAME = 0.1, 10
#: Characters of judged blocks that a worker remembers, and of the longest of them.
MEMO, LONGEST = 4_000_000, 4_000
#: zstandard's, slow enough to find short matches in small texts.
LEVEL = 6


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places of the blocks with a trigger word: paragraphs, and their lines if there are several."""
    seen = set()
    for pattern in (r"[^\n]+", r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*"):
        for m in re.finditer(pattern, text):
            if m.span() not in seen and TRIGGERS.search(m[0]):
                seen.add(m.span())
                yield m.span()


def distances(wording: list[str], own: list[str]) -> Iterator[int]:
    """For each word of `own`, the least edits that turn `wording` into some run of words that ends there (bit-parallel, after Myers)."""
    n = len(wording)
    at: dict[str, int] = {}
    for k, w in enumerate(wording):
        at[w] = at.get(w, 0) | 1 << k
    full, top, plus, minus, score = (1 << n) - 1, 1 << n - 1, (1 << n) - 1, 0, n
    for w in own:
        eq = at.get(w, 0)
        zero = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full  # a run may begin at any word: row 0 stays 0
        plus, minus = (down | ~(zero | up)) & full, up & zero & full
        yield score


def places(wording: list[str], own: list[str], allowed: int) -> list[tuple[int, int, int]]:
    """(edits, first word, end) of the closest run in each stretch of the block that is close enough."""
    n, out = len(wording), []
    best: tuple[int, int] | None = None  # (edits, end) of the stretch at hand
    for k, score in enumerate([*distances(wording, own), n + 1]):
        if score <= allowed:
            if best is None or score < best[0]:
                best = score, k + 1
        elif best:
            edits, end = best
            back = [*distances(wording[::-1], own[max(0, end - n - allowed) : end][::-1])]
            out.append((edits, end - 1 - min(range(len(back)), key=lambda i: (back[i], -i)), end))
            best = None
    return out


class Template:
    """Wordings of a licence that rank as one: a notice, or all its names."""

    def __init__(self, name: str, wordings: list[str]) -> None:
        import zstandard

        self.name, self.rows = name, [words(t) for t in wordings]
        self.needs = [(ws, set(ws), int(DIFFER * len(ws)) if len(ws) > NAME else 0) for ws in self.rows]
        self.given = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict("\n".join(" ".join(ws) for ws in self.rows).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def possible(self, has: set[str]) -> list[tuple[list[str], int]]:
        """Wordings of which no more different words are missing than may differ: no other can be in the block."""
        return [(ws, allowed) for ws, kinds, allowed in self.needs if len(kinds - has) <= allowed]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]) -> None:
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for name, ts in templates.items():
            names = [t for t in ts if len(words(t)) <= NAME]
            self.templates += [Template(name, [t]) for t in ts if len(words(t)) > NAME] + ([Template(name, names)] if names else [])
        self.memo: OrderedDict[str, list[tuple]] = OrderedDict()
        self.held = 0

    def judge(self, block: str) -> list[tuple]:
        if (known := self.memo.get(block)) is not None:
            return known
        found = self._judge(block)
        if len(block) <= LONGEST:
            self.memo[block] = found
            self.held += len(block)
            while self.held > MEMO:
                self.held -= len(self.memo.popitem(last=False)[0])
        return found

    def saved(self, template: Template, text: bytes, alone: int) -> int:
        """Bytes by which the template makes the text smaller."""
        return alone - len(template.given.compress(text))

    def ranked(self, block: str, spans: list[tuple[int, int]], own: list[str]) -> list[tuple[float, Template]]:
        """Templates by the share that they take off the words round the triggers, the best window of each."""
        best = [-1.0] * len(self.templates)
        starts = [a for a, _ in spans]
        last = -1
        for m in TRIGGERS.finditer(block):
            k = bisect_right(starts, m.start()) - 1
            if last >= 0 and k - last < ROUND // 2:
                continue  # lies well inside the last window
            last = k
            text = " ".join(own[max(0, k - ROUND) : k + ROUND + 1]).encode("utf-8", "replace")
            alone = len(self.alone.compress(text))
            best = [max(b, self.saved(t, text, alone) / alone) for b, t in zip(best, self.templates, strict=True)]
        return sorted(zip(best, self.templates, strict=True), key=lambda x: (-x[0], x[1].name, x[1].rows))

    def _judge(self, block: str) -> list[tuple]:
        """(licence, size reduction, words missing, words added, place and length in the block, the missing words, the added ones, number of places) of each confirmed licence.

        A block without any gives its leading template's name-less row. Of notices
        over the same words the one that compresses them best holds (ties: the
        closer, the longer, then the first in order of names); of names the longest,
        unless it is a part of a notice.
        """
        spans = [m.span() for m in WORD.finditer(block)]
        own = [block[a:b].lower() for a, b in spans]
        has, at = set(own), {}
        for k, w in enumerate(own):
            at.setdefault(w, []).append(k)
        order = self.ranked(block, spans, own)
        open_ = [t.possible(has) for _, t in order]
        left = sum(map(bool, open_))
        found = []  # (is a name, -bytes saved on its own words, edits, -words, licence, first, end, gain, wording)
        for (gain, template), possible in zip(order, open_, strict=True):
            if not left:
                break
            left -= bool(possible)
            for ws, allowed in possible:
                n = len(ws)
                if n <= NAME:
                    found += [(True, 0, 0, -n, template.name, i, i + n, gain, ws) for i in at[ws[0]] if own[i : i + n] == ws and DENIALS.isdisjoint(own[max(0, i - DENIED) : i])]
                    continue
                for edits, a, b in places(ws, own, allowed):
                    text = " ".join(own[a:b]).encode("utf-8", "replace")
                    found.append((False, -self.saved(template, text, len(self.alone.compress(text))), edits, -n, template.name, a, b, gain, ws))
        kept: dict[str, list] = {}
        taken: list[tuple[int, int]] = []
        for is_name, _, _, _, name, a, b, gain, ws in sorted(found, key=lambda x: x[:7]):
            within = (x <= a and b <= y for x, y in taken) if is_name else (2 * (min(b, y) - max(a, x)) > b - a for x, y in taken)
            if any(within):
                continue
            taken.append((a, b))
            if name in kept:
                kept[name][-1] += 1
                continue
            steps = difflib.SequenceMatcher(None, ws, own[a:b], autojunk=False).get_opcodes()
            gone = [w for op, i, j, _, _ in steps if op in ("delete", "replace") for w in ws[i:j]]
            more = [w for op, _, _, i, j in steps if op in ("insert", "replace") for w in own[a + i : a + j]]
            kept[name] = [name, gain, len(gone), len(own) - len(ws) + len(gone), spans[a][0], spans[b - 1][1] - spans[a][0], " ".join(gone), " ".join(more), 1]
        if kept:
            return [tuple(x) for x in kept.values()]
        return [(None, order[0][0], len(order[0][1].rows[0]), len(own), 0, 0, "", "", 0)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per confirmed licence of each candidate block: id, start, length (the block, in code points), license, reduction, n_missing, n_extra, at, at_length (its first and closest wording, from the text's start), missing, extra (the differing words), n_places, confirmed.

    Only texts with a trigger word leave the scan. A block without a confirmed
    licence has one row with a null `license` and n_places 0. n_extra counts the
    block's words besides the wording. A paragraph of several lines is judged as one
    and line by line. Null and empty texts give no rows; repeated rows repeat; no
    rows in, none out; only the two named columns are read.
    """
    wanted = templates or known_wordings()
    names = ["id", "start", "length", "license", "reduction", "n_missing", "n_extra", "at", "at_length", "missing", "extra", "n_places"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(wanted)
        for frame in frames:
            rows = [(i, a, b - a, *x[:4], a + x[4], *x[5:]) for i, text in zip(frame["id"].tolist(), frame["text"].tolist(), strict=True) for a, b in candidates(text) for x in scanner.judge(text[a:b])]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(confirmed=out["license"].notna())

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(TRIGGER))
    kinds = f"id {dict(base.dtypes)['id']}, start long, length long, license string, reduction double, n_missing long, n_extra long, at long, at_length long, missing string, extra string, n_places long, confirmed boolean"
    return base.mapInPandas(run, kinds).withColumnRenamed("id", id_col)
