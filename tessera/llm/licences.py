"""Licence scans by sentence rules.

A text is cut into fragments at sentence ends and line ends. Fragments are normalised to their words; a fragment, or as
many as follow each other where lines are wrapped, that equals a known licence sentence gets that sentence's
identifier. The sequence of identifiers is then matched against ordered rules, the more specific first: a rule fits
where its identifiers follow each other, with at most ``GAP`` unknown fragments in between, and uses them up.

Defined results: a null or empty text has no licences; sentences that no rule uses count in ``n_sentences`` alone;
repeated rows get equal results; an empty table gives an empty result; positions are code points, ends exclusive; whole
texts are read; further columns are neither read nor touched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import tidy

GAP = 2

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-named": "Released under the MIT License.",
    "mit-under": "Licensed under the MIT License.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "reserved": "All rights reserved.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-named": "Distributed under the Boost Software License, Version 1.0.",
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0": "This work is marked with CC0 1.0 Universal.",
    "cc0-named": "Licensed under CC0 1.0.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-no-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-no-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Names by which short notices call a licence.
_NAMES = {
    "MIT": ("MIT license", "MIT License (MIT)"), "Apache-2.0": ("Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-clause BSD license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"), "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2"), "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1", "LGPLv2.1"), "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", "LGPLv3"), "AGPL-3.0-only": ("GNU Affero General Public License v3.0", "AGPLv3"),
    "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software License 1.0",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",), "OFL-1.1": ("SIL Open Font License 1.1",),
}
_NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This work is licensed under the {}.")

#: Creative Commons licences by the name of their clauses; version 4.0 is International, 3.0 is Unported.
_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Licences whose SPDX tag is a sentence.
_TAGS = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "Unlicense", "Zlib", "OFL-1.1",
    *(f"CC-{clauses}-{version}" for version in ("3.0", "4.0") for clauses in _COMMONS),
)

_known = set(SENTENCES.values())
for _clauses, _name in _COMMONS.items():
    for _version, _kind in (("3.0", "Unported"), ("4.0", "International")):
        for _form, _text in (("work", f"This work is licensed under a Creative Commons {_name} {_version} {_kind} License."), ("short", f"Licensed under CC {_clauses} {_version}.")):
            if _text not in _known:
                SENTENCES[f"cc-{_clauses}-{_version}-{_form}".lower()] = _text
_taken = {" ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())) for text in SENTENCES.values()}
_NAMED: dict[str, str] = {}
for _licence, _titles in _NAMES.items():
    for _n, _title in enumerate(_titles):
        for _m, _notice in enumerate(_NOTICES):
            _words = " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (_text := _notice.format(_title)).lower()))
            if _words not in _taken:
                _taken.add(_words)
                SENTENCES[_key := f"named-{_licence}-{_n}-{_m}".lower()] = _text
                _NAMED[_key] = _licence
SENTENCES |= {f"spdx-{tag}".lower(): f"SPDX-License-Identifier: {tag}" for tag in _TAGS}

#: In order: licence, and the identifiers that make it.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-under",)),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-compliance")),
    ("Apache-2.0", ("apache-named",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-no-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-no-liability", "zlib-grant")),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("MPL-2.0", ("mpl", "mpl-obtain")),
    ("MPL-2.0", ("mpl",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Unlicense", ("unlicense", "unlicense-grant")),
    ("Unlicense", ("unlicense",)),
    ("OFL-1.1", ("ofl",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-named",)),
    ("EPL-1.0", ("epl1",)),
    ("EPL-2.0", ("epl2",)),
    ("CC0-1.0", ("cc0",)),
    ("CC0-1.0", ("cc0-named",)),
    *((f"CC-{c}-{v}", (key,)) for c in _COMMONS for v in ("3.0", "4.0") for form in ("work", "short") if (key := f"cc-{c}-{v}-{form}".lower()) in SENTENCES),
    *((licence, (key,)) for key, licence in _NAMED.items()),
    *((tag, (f"spdx-{tag}".lower(),)) for tag in _TAGS),
    ("LicenseRef-All-Rights-Reserved", ("reserved",)),
)

_FRAGMENT = re.compile(r"[^\n]*?(?:[.!?;:](?=[\s])|\n|\Z)")
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
def normalised(sentence: str) -> str:
    return " ".join(_WORDS.findall(sentence.lower()))


class Rules:
    """Sentences by identifier, and the ordered rules over them."""

    def __init__(self, sentences: dict[str, str], rules: Sequence[tuple[str, tuple[str, ...]]]):
        if missing := {x for _, rule in rules for x in rule} - set(sentences):
            raise ValueError(f"rules name unknown sentences: {sorted(missing)}")
        self.rules = tuple((licence, tuple(rule)) for licence, rule in rules)
        self.known = {normalised(s): k for k, s in sentences.items()}
        if len(self.known) < len(sentences) or "" in self.known:
            raise ValueError("sentences must have words and differ in them")
        self.sorted = sorted(self.known)
        # each sentence's longest word; a text with none of them needs no cutting
        self.stems = tuple(sorted({max(re.findall(r"[a-z0-9]+", s), key=len) for s in self.known}))
        self.stem = re.compile("|".join(self.stems))

    def leads_on(self, words: str) -> bool:
        """Whether a known sentence starts with these words."""
        at = bisect_left(self.sorted, words)
        return at < len(self.sorted) and self.sorted[at].startswith(words)


PUBLIC = Rules(SENTENCES, RULES)


def identifiers(text: str, rules: Rules = PUBLIC) -> list[tuple[str, int, int, int, int]]:
    """(identifier, start, end, number of its first and of its last fragment) of each known sentence."""
    lowered = text.lower()
    if not rules.stem.search(lowered):
        return []
    cut = [(m.start(), m.end(), normalised(m[0])) for m in _FRAGMENT.finditer(text) if m[0]]
    cut = [c for c in cut if c[2]]
    found, k = [], 0
    while k < len(cut):
        words, best = "", None
        for j in range(k, len(cut)):
            words = f"{words} {cut[j][2]}" if words else cut[j][2]
            if words in rules.known:
                best = j
            if not rules.leads_on(words + " "):
                break
        if best is None:
            k += 1
            continue
        words = " ".join(c[2] for c in cut[k : best + 1])
        start, end = cut[k][0], cut[best][1]
        part = text[start:end]
        found.append((rules.known[words], start + len(part) - len(part.lstrip()), start + len(part.rstrip()), k, best))
        k = best + 1
    return found


def licences(text: str, rules: Rules = PUBLIC) -> tuple[int, list[tuple[str, int, int]]]:
    """The number of known sentences, and (licence, start, end) of each rule that fits, by start."""
    sequence = identifiers(text, rules)
    free, matched = [True] * len(sequence), []
    for licence, rule in rules.rules:
        for k in range(len(sequence) - len(rule) + 1):
            run = sequence[k : k + len(rule)]
            if all(free[k : k + len(rule)]) and tuple(x[0] for x in run) == rule and all(b[3] - a[4] - 1 <= GAP for a, b in zip(run, run[1:], strict=False)):
                free[k : k + len(rule)] = [False] * len(rule)
                matched.append((licence, run[0][1], run[-1][2]))
    return len(sequence), sorted(matched, key=lambda m: m[1:])


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """doc_id, n_sentences, licences (distinct, in order of appearance), spans (licence, start, end) for each row."""
    chosen = Rules(sentences, rules)

    @tidy
    def convert(batches):
        span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            done = [licences(t or "", chosen) for t in batch.column(1).to_pylist()]
            spans = [[{"licence": x, "start": a, "end": b} for x, a, b in found] for _, found in done]
            names = [list(dict.fromkeys(x for x, _, _ in found)) for _, found in done]
            columns = [batch.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "licences", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        convert, "doc_id long, n_sentences long, licences array<string>, spans array<struct<licence:string,start:int,end:int>>"
    )
