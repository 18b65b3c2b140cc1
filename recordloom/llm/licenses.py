"""License wording by template automata, and fixed phrases, in whole texts.

A template is wording with optional and replaceable regions in the markup that public license lists use. It is compiled to
an automaton over words: optional regions may be passed over, replaceable ones take words that fit their pattern, and every
other word must stand exactly. Texts are searched inside the scan, without a shuffle; automata start only at words that can
begin a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licenses and notices, with the regions that their texts leave open.
#: label -> template. A replaceable region gives a pattern for each of its words and how many there may be.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>(the \"License\")<<endOptional>> <<beginOptional>>you may not use this file except in compliance with the License<<endOptional>>",
    "mit": "<<beginOptional>>Released under the<<endOptional>> <<beginOptional>>Licensed under the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;name=work;match=.+;words=1-4>> and associated documentation files",
    "gpl-versioned": "GNU <<beginOptional>><<var;name=kind;match=lesser|affero;words=1-1>><<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;name=version;match=[1-3];words=1-1>> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>",
    "cc-by-versioned": "CC BY <<beginOptional>><<var;name=terms;match=nc|sa|nd;words=1-2>><<endOptional>> <<var;name=major;match=[1-4];words=1-1>> <<var;name=minor;match=[05];words=1-1>>",
    "copyright-notice": "Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=years;match=[0-9]{4};words=1-3>> <<var;name=holder;match=.+;words=1-8>> All rights reserved",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "spdx-tag": "SPDX License Identifier <<var;name=id;match=.+;words=1-4>>",
    "mit-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;name=work;match=.+;words=1-4>> and associated documentation files
        <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name=holders;match=.+;words=1-10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;name=holders;match=.+;words=1-10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;match=.+;words=1-10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder;match=.+;words=1-10>> nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;name=holders;match=.+;words=1-10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;match=.+;words=1-10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holders;match=.+;words=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<var;name=scheme;match=https?;words=0-1>> <<beginOptional>>www.apache.org/licenses/LICENSE-2.0<<endOptional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
        <<beginOptional>><<var;name=kind;match=lesser|affero|library;words=1-1>><<endOptional>> General Public License as published by the Free Software Foundation;
        <<beginOptional>>either<<endOptional>> version <<var;name=version;match=[1-3];words=1-2>> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.""",
    "zlib-text": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "unlicense-text": """free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "boost-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        <<beginOptional>>(the "Software")<<endOptional>> to use, reproduce, display, distribute, execute, and transmit the Software""",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holders;match=.+;words=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=liable;match=.+;words=1-6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        <<var;name=spelling;match=acknowledge?ment;words=1-1>> in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source
        distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        <<beginOptional>>(the "Software")<<endOptional>> to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,
        this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
        THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
}
#: The opening or short form of a license, and the whole wordings that hold it: it isn't told where one of these is.
PART_OF = {
    "mit-text": ("mit-license",), "bsd-text": ("bsd-2-clause", "bsd-3-clause"), "apache-2.0": ("apache-2.0-notice",), "gpl-versioned": ("gpl-notice",), "isc-text": ("isc",), "zlib-text": ("zlib",),
    "unlicense-text": ("unlicense",), "boost-text": ("boost",),
}
#: So many mandatory words make a match certain; fewer score in proportion.
CERTAIN = 5

_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def split_words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode().translate(_TABLE).split()


def parse(template: str) -> list:
    """A list of words (bytes), optional parts (lists) and replaceable parts (pattern, least, most)."""
    stack, at = [[]], 0
    for m in _MARK.finditer(template):
        stack[-1] += split_words(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that didn't begin")
            part = stack.pop()
            stack[-1].append(part)
        else:
            attrs = dict(x.split("=", 1) for x in m[1].split(";")[1:])
            least, most = map(int, attrs.get("words", "1-8").split("-"))
            stack[-1].append((attrs.get("match", ".+"), least, most))
    if len(stack) != 1:
        raise ValueError("an optional region doesn't end")
    return stack[0] + split_words(template[at:])


@dataclass
class Automaton:
    """States are numbers; a state has steps on a word, steps on a pattern, and free steps. The last state accepts."""

    words: list[dict[bytes, int]] = field(default_factory=list)
    patterns: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory: int = 0
    final: int = 0

    def state(self) -> int:
        self.words.append({})
        self.patterns.append([])
        self.free.append([])
        return len(self.words) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        out = {t for s in states if (t := self.words[s].get(word)) is not None}
        out |= {t for s in states for p, t in self.patterns[s] if p.fullmatch(word)}
        return self.closed(out) if out else frozenset()

    def match_end(self, words: list[bytes], at: int) -> int:
        """End of the longest match that begins at a word; -1 where there is none."""
        states, end = self.closed({0}), -1
        for i in range(at, len(words)):
            if not (states := self.step(states, words[i])):
                break
            if self.final in states:
                end = i + 1
        return end

    def firsts(self) -> set[bytes] | None:
        """Words that can begin a match; None where a pattern can."""
        start = self.closed({0})
        return None if any(self.patterns[s] for s in start) else {w for s in start for w in self.words[s]}


def compile_template(template: str) -> Automaton:
    a = Automaton()

    def add(parts: list, at: int, needed: bool) -> int:
        for p in parts:
            if isinstance(p, bytes):
                new = a.state()
                # a fresh state for each word keeps one target for each word of a state
                if p in a.words[at]:
                    a.free[at].append(via := a.state())
                    a.words[via][p] = new
                else:
                    a.words[at][p] = new
                a.mandatory += needed
                at = new
            elif isinstance(p, list):
                inside = a.state()
                a.free[at].append(inside)
                end = add(p, inside, False)
                new = a.state()
                a.free[end].append(new)
                a.free[at].append(new)
                at = new
            else:
                pattern, new = re.compile(p[0].encode()), a.state()
                for i in range(p[2]):
                    if i >= p[1]:
                        a.free[at].append(new)
                    a.patterns[at].append((pattern, nxt := a.state()))
                    at = nxt
                a.free[at].append(new)
                at = new
        return at

    a.final = add(parse(template), a.state(), True)
    if a.final in a.closed({0}):
        raise ValueError("a template needs mandatory wording")
    return a


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            fixed.setdefault((w := split_words(phrase))[0], []).append((w, label))
        automata = {label: compile_template(t) for label, t in templates.items()}
        starts: dict[bytes, list[str]] = {}
        for label, a in automata.items():
            if (first := a.firsts()) is None:
                raise ValueError(f"template {label} begins with a replaceable region")
            for w in first:
                starts.setdefault(w, []).append(label)
        begins = frozenset(fixed) | frozenset(starts)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = split_words(text.as_py() or "")
                places, base, more, best = [], set(), set(), 0
                for i in [i for i, w in enumerate(words) if w in begins]:
                    for phrase, label in fixed.get(words[i], ()):
                        if words[i : i + len(phrase)] == phrase:
                            places.append(i)
                            base.add(label)
                            best = max(best, len(phrase))
                    for label in starts.get(words[i], ()):
                        if label not in more and automata[label].match_end(words, i) >= 0:
                            more.add(label)
                            best = max(best, automata[label].mandatory)
                more -= {part for part, wholes in PART_OF.items() if more.intersection(wholes)}
                out.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), min(1.0, best / CERTAIN)))
            if out:
                kinds = [batch.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs`` (doc_id, text).

    n_base counts all places where a phrase's words stand consecutively; first_word and last_word are the smallest and largest
    of these, null where there is none. labels adds the templates that match anywhere, but the openings of licenses that match whole. score is the longest mandatory wording
    found, in words, over CERTAIN, 1 at most. A null text is empty: no words, empty labels, score 0. Repeated rows and null
    doc_ids get their result each time; more columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(phrases, templates), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def as_regex(parts: list) -> str:
    """The same language as a pattern over words that each follow a space."""
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += " " + re.escape(p.decode())
        elif isinstance(p, list):
            out += f"(?:{as_regex(p)})?"
        else:
            each = "[^ ]+" if p[0] == ".+" else f"(?:{p[0]})"
            out += f"(?: {each}){{{p[1]},{p[2]}}}"
    return out


def oracle() -> str:
    """The same in DuckDB: phrases by list slices, templates as patterns over the joined words."""
    places = " || ".join(f"list_filter(range(0, len(w)), lambda i: w[i+1:i+{len(p.split())}] = {p.split()!r})" for p in PHRASES)
    has = {label: f"contains(j, ' {p} ')" for p, label in PHRASES.items()}
    hit = {label: f"regexp_matches(j, '{as_regex(parse(t))} ')" for label, t in TEMPLATES.items()}
    joined = lambda d: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' ELSE '' END" for k, c in d.items()) + "], lambda x: x <> '')), ',')"
    told = hit | {k: f"{hit[k]} AND NOT ({' OR '.join(hit[w] for w in wholes)})" for k, wholes in PART_OF.items()}
    best = ", ".join([f"CASE WHEN {c} THEN {len(p.split())} ELSE 0 END" for (p, _), c in zip(PHRASES.items(), has.values(), strict=True)] + [f"CASE WHEN {hit[k]} THEN {compile_template(t).mandatory} ELSE 0 END" for k, t in TEMPLATES.items()])
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, w, {places} AS p, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, {joined(has)} AS base_labels, {joined(has | told)} AS labels, least(1.0, greatest({best}) / {CERTAIN})::DOUBLE AS score FROM e"""
