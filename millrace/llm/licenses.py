"""License scans by conditional compression.

Around each word that speaks of rights, as many words as a template may take are compressed twice: alone, and with each license
template as a raw zstandard dictionary. Templates are ranked by how much they save of their own size; the best are compared with the
words word by word, and one is reported only if the words that differ are few and none of them tells licenses apart. The scan goes on behind a notice.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: License identifiers and the names that notices give them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2", "GNU GPL v2", "GPL version 2", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3", "GNU GPL v3", "GPL version 3", "GNU GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "BSD": ["BSD License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
#: How short notices speak of a license.
FORMS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This file is licensed under the {}."]
#: How notices speak of a license by its identifier, and what identifiers of the GNU licenses end in.
IDENTIFIER_FORMS = ["SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {} license.", "Released under the {} license."]
IDENTIFIER_ENDS = ["", "-only", "-or-later"]
#: Notices that are no form of a name.
NOTICES = {
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "All-rights-reserved": ["All rights reserved.", "Copyright (c) All rights reserved."],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
}
#: A notice has one of these at least; every template does.
_TRIGGER = re.compile(r"licen[cs]e|(?:released|distributed)\s+under|copyright|©|rights?\s+reserved|hereby\s+granted|redistribut|public\s+domain|creative\s+commons|\bcc0\b|\bcc\s+by", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
#: Words of notices in general; all others of a template tell licenses apart.
_COMMON = frozenset(w for form in FORMS + IDENTIFIER_FORMS for w in form.replace("{}", "").lower().replace(".", "").replace(":", "").split()) | {"license", "licence", "version", "international", "universal", "software"}


#: Words from which on a template is a long one, of whose words most tell nothing.
_LONG = 20
#: Words of the names of licenses that tell one from another wherever they stand.
_NAMED = frozenset(w for titles in NAMES.values() for title in titles for w in _WORD.findall(title.lower()) if len(w) > 2 and not re.search(r"\d", w)) - _COMMON
#: Words of conditions that some licenses add to those of others, and how such conditions go on behind them.
_CLAUSES = {"endorse": "endorse or promote", "advertising": "advertising materials", "subject": "subject to the limitations"}
#: Words behind a notice within which a further condition begins.
_FURTHER = 32
_VERSION = re.compile(r"\d+(?:\.\d+)+|(?<=^v)\d+|(?<=gplv)\d+")


class Templates:
    """Templates (identifier, words) with their dictionaries."""

    def __init__(self, texts: list[tuple[str, list[str]]]) -> None:
        self.texts = texts
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(template).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, template in texts]
        self.sizes = [len(self.plain.compress(" ".join(template).encode())) for _, template in texts]
        self.longest = max(len(template) for _, template in texts)
        #: Words that a stretch must have, whatever else may differ: those of a short template that tell licenses apart.
        self.needed = [frozenset(template) - _COMMON if len(template) < _LONG else frozenset() for _, template in texts]
        self.holders: dict[str, list[tuple[int, int]]] = {}
        for k, (_, template) in enumerate(texts):
            for word, times in Counter(template).items():
                self.holders.setdefault(word, []).append((k, times))

    def able(self, block: list[str], most_different: float) -> list[int]:
        """Templates of whose words ``block`` has so many, in any order, that one could be confirmed; for all others too many are missing."""
        same: Counter = Counter()
        for word, n in Counter(block).items():
            for k, times in self.holders.get(word, ()):
                same[k] += min(n, times)
        held = set(block)
        return [k for k, n in same.items() if len(self.texts[k][1]) - n <= most_different * len(self.texts[k][1]) and self.needed[k] <= held]

    def ranked(self, block: list[str], most_different: float) -> list[int]:
        """Templates that could be confirmed, by how many of the bytes that each takes alone it saves in ``block``, so that other words of the block count for nothing."""
        able = self.able(block, most_different)
        if not able:
            return able
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        saved = {k: (alone - len(self.given[k].compress(data))) / self.sizes[k] for k in able}
        return sorted(able, key=lambda k: (-saved[k], -len(self.texts[k][1]), self.texts[k]))

    def reduction(self, block: list[str], k: int) -> float:
        """How much smaller template ``k`` makes ``block``."""
        data = " ".join(block).encode()
        return 1 - len(self.given[k].compress(data)) / len(self.plain.compress(data))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def differences(template: list[str], block: list[str], at: int, most: float) -> tuple[list[str], int, int, int] | None:
    """The stretch of ``block`` over word ``at`` that is nearest to the template: words of the template that it lacks or has others for, the number of its other words, its first word and its end. None if there are more than ``most`` in all."""
    low, high = 0, len(block)
    while sum((Counter(template) & Counter(block[low:high])).values()) >= len(template) - most:
        match = [(m.a, low + m.b, m.size) for m in difflib.SequenceMatcher(None, template, block[low:high], autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i, (_, first, _) in enumerate(match):
            same = 0
            for j, (_, b, size) in enumerate(match[i:], i):
                same += size
                rank = len(template) + b + size - first - 2 * same, -same
                if first <= at < b + size and rank[0] <= most and (best is None or rank < best[0]):
                    best = rank, i, j, same
        if best:
            _, i, j, same = best
            held = {k for a, _, size in match[i : j + 1] for k in range(a, a + size)}
            first, end = match[i][1], match[j][1] + match[j][2]
            return [w for k, w in enumerate(template) if k not in held], end - first - same, first, end
        # What is most alike may be another notice near by: look again on this side of it.
        _, b, size = max(match, key=lambda m: m[2])
        if b <= at < b + size:
            return None
        low, high = (low, b) if b > at else (b + size, high)
    return None


def telling(block: list[str]) -> tuple[set[str], set[str]]:
    """What tells licenses apart: names and versions, and words of conditions."""
    named, clauses = set(), set()
    for before, word in zip(["", *block], block):
        if word in _NAMED or (word == "library" and before == "gnu") or (word.isdigit() and before == "version"):
            named.add(word)
        elif word in _CLAUSES:
            clauses.add(word)
        else:
            named.update(_VERSION.findall(word))
    return named, clauses


def told_apart(template: list[str], stretch: list[str], after: list[str]) -> bool:
    """Whether ``stretch``, with the words ``after`` it, is of another license than the template: by a name or version that is missing or added, or a condition. In a template that names no license, names are those of holders."""
    (named, clauses), (own, conditions) = telling(template), telling(stretch)
    further = " ".join(after[:_FURTHER]) if len(template) >= _LONG else ""
    return (bool(named) and named != own) or clauses != conditions or any(phrase in further for word, phrase in _CLAUSES.items() if word not in clauses)


@lru_cache(maxsize=1)
def _templates() -> tuple[Templates, Templates]:
    """Long and short templates."""
    texts = [(name, words(form.format(title))) for name, titles in NAMES.items() for title in titles for form in FORMS]
    texts += [(name, words(form.format(name + end))) for name in NAMES if name != "BSD" for end in (IDENTIFIER_ENDS if "GPL" in name else [""]) for form in IDENTIFIER_FORMS]
    texts += [(name, words(text)) for name, notices in NOTICES.items() for text in notices]
    texts = [(name, list(said)) for name, said in sorted({(name, tuple(said)) for name, said in texts})]
    return Templates([x for x in texts if len(x[1]) >= _LONG]), Templates([x for x in texts if len(x[1]) < _LONG])


def confirmed(templates: Templates, block: list[str], at: int, least_reduction: float, most_different: float) -> tuple[str, float, int, int, int, int] | None:
    """License, size reduction, missing and other words, first word and end of the stretch of ``block`` over word ``at`` that has the fewest differences from a template, of all that save at least ``least_reduction`` of it; of equals the longest template."""
    best = None
    for k in templates.ranked(block, most_different):
        name, template = templates.texts[k]
        near = differences(template, block, at, most_different * len(template))
        if not near:
            continue
        missing, other, first, end = near
        apart = (len(template) < _LONG and any(w not in _COMMON for w in missing)) or told_apart(template, block[first:end], block[end:])
        reduction = templates.reduction(block[first:end], k)
        if not apart and reduction >= least_reduction:
            rank = ((len(missing) + other) / len(template), -len(template), -reduction, name)
            if best is None or rank < best[0]:
                best = rank, (name, reduction, len(missing), other, first, end)
    return best and best[1]


def notices(text: str, least_reduction: float, most_different: float) -> list[tuple[int, int, str, float, int, int, str]]:
    """Per notice of ``text``: first line, lines, license, size reduction, missing words, other words, block."""
    spans = [m.span() for m in _WORD.finditer(text)]
    own = [text[a:b].lower() for a, b in spans]
    ends = [b for _, b in spans]
    breaks = [m.start() for m in re.finditer("\n", text)]
    out, free = [], 0
    for trigger in _TRIGGER.finditer(text):
        at = bisect_right(ends, trigger.start())
        if at < free or at == len(own):
            continue
        for templates in _templates():
            # A stretch over the trigger has at most so many words before and after it, on its line or on those around.
            most = math.ceil(templates.longest * (1 + most_different))
            low = max(free, at - most)
            found = confirmed(templates, own[low : at + most + 1 + _FURTHER], at - low, least_reduction, most_different)
            if not found:
                continue
            name, reduction, missing, other, first, end = found
            first, end = low + first, low + end
            # Where the lines at both ends hold no other words, the block is whole lines.
            line, last = bisect_right(breaks, spans[first][0]), bisect_right(breaks, ends[end - 1] - 1)
            begin, stop = (breaks[line - 1] + 1 if line else 0), (breaks[last] if last < len(breaks) else len(text))
            begin = spans[first][0] if first and spans[first - 1][1] > begin else begin
            stop = ends[end - 1] if end < len(own) and spans[end][0] < stop else stop
            out.append((line, last - line + 1, name, round(reduction, 6), missing, other, text[begin:stop]))
            free = end
            break
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_reduction: float = 0.2, most_different: float = 0.34) -> DataFrame:
    """Notices in whole texts: (id, line, n_lines, license, reduction, n_missing, n_other, block).

    A block is the stretch over a word of rights that is nearest to a template, within a line, a line or several; other words around it change nothing,
    and a line may have several. All templates of whose words it holds enough are ranked by size reduction
    and compared word by word; one is confirmed if it makes the block smaller by ``least_reduction``, missing and other words are at most ``most_different`` of its
    words and none of them tells licenses apart: names, versions, further conditions, in a short notice all words but those of notices in general. Documents without a notice have no row; null
    and empty texts have none. Null and repeated ids keep their rows, other columns are ignored. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "line", "n_lines", "license", "reduction", "n_missing", "n_other", "block"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids, found = [], []
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text and _TRIGGER.search(text):
                    for notice in notices(text, least_reduction, most_different):
                        ids.append(name.as_py())
                        found.append(notice)
            columns = list(zip(*found)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, line long, n_lines long, license string, reduction double, n_missing long, n_other long, block string")
