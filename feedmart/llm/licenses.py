"""License scans by template-markup matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled

#: Phrases whose words, standing consecutively, give a base label. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label -> template. ``[[ ]]`` holds an optional region, ``{{n}}`` stands for
#: up to n words of any wording, ``{{a|b}}`` for one of the wordings; all other
#: words are mandatory.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license [[,]] version 2.0",
    "gpl-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[{{|either}} version {{2|3}} [[of the license]]]]",
    "gpl-or-later": "under the terms of the gnu general public license as published by the free software foundation [[;]] either version {{2|3}} of the license or [[(]] at your option [[)]] any later version",
    "cc-by-4.0": "licensed under {{|a|the}} {{cc by|creative commons attribution}} 4.0 [[international]] [[license]]",
    "cc-by-nc-4.0": "licensed under [[a]] {{cc by nc|creative commons attribution noncommercial}} 4.0 [[international]] [[license]]",
    "mit-notice": "{{released|licensed|distributed}} under the [[terms of the]] mit license",
    "apache-2.0-header": (
        "licensed under the apache license [[,]] version 2.0 [[(the license)]] you may not use {{this file|these files|this software}} except in compliance with the license you may obtain a copy of the license at "
        "{{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v [[.]] 2.0 if a copy of the mpl was not distributed with this file you can obtain one at {{|http|https}} {{|www}} mozilla org mpl 2.0"
    ),
    "lgpl-or-later": (
        "under the terms of the gnu {{lesser|library}} general public license as published by the free software foundation either version {{2|2.1|3}} of the license or at your option any later version"
    ),
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[(]] the software [[)]] "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software "
        "[[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software]]"
    ),
    "isc-text": (
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies [[the software is provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence "
        "or other tortious action arising out of or in connection with the use or performance of this software]]"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution "
        "[[[[3]] neither the name of {{12}} may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "[[this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage]]"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means"
    ),
    "boost-1.0": "distributed under the boost software license version 1.0 [[see accompanying file {{4}} or copy at {{8}}]]",
    "spdx": "spdx license identifier {{mit|isc|apache 2.0|bsd 2 clause|bsd 3 clause|gpl 2.0 only|gpl 2.0 or later|gpl 3.0 only|gpl 3.0 or later|cc by 4.0}}",
}

#: Bytes that end a word: ASCII that is neither a digit nor a letter.
_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\{(.*?)\}\}|(?:(?!\[\[|\]\]|\{\{).)+", re.S)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of digits, letters a-z and non-ASCII."""
    return text.lower().translate(_SPLIT).split()


@dataclass
class Automaton:
    """Token automaton. State k has edges ``word -> next state`` (``None``: any word) and free moves."""

    edges: list[dict[bytes | None, set[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    final: int = 0

    def state(self) -> int:
        self.edges.append({})
        self.free.append(set())
        return len(self.edges) - 1

    def words(self, at: int, words: list[bytes | None]) -> int:
        for w in words:
            to = self.state()
            self.edges[at].setdefault(w, set()).add(to)
            at = to
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = [*states], set(states)
        while todo:
            for k in self.free[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        return seen

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from ``start``, or None."""
        states, end = self.closure({0}), None
        for k in range(start, len(words) + 1):
            if self.final in states:
                end = k
            if k == len(words):
                break
            states = self.closure({t for s in states for w in (words[k], None) for t in self.edges[s].get(w, ())})
            if not states:
                break
        return end


def compile_template(template: str) -> Automaton:
    """Optional regions get a free move around them, replaceable ones a branch per wording or a run of any words."""
    auto, at, opened = Automaton(), 0, []
    for m in _MARK.finditer(template):
        part, inner = m.group(0), m.group(1)
        if part == "[[":
            opened.append(at)
        elif part == "]]":
            auto.free[opened.pop()].add(at)
        elif inner is None:
            at = auto.words(at, words_of(part.encode()))
        elif inner.isdigit():
            end = auto.state()
            for _ in range(int(inner)):
                auto.free[at].add(end)
                at = auto.words(at, [None])
            auto.free[at].add(end)
            at = end
        else:
            end = auto.state()
            for wording in inner.split("|"):
                auto.free[auto.words(at, words_of(wording.encode()))].add(end)
            at = end
    auto.final = at
    return auto


class Scanner:
    """Finds phrases and template matches in the words of one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.templates = [(label, compile_template(t)) for label, t in templates.items()]
        self.by_label = dict(self.templates)
        self.anchors = sorted({(a, label) for label, auto in self.templates for a in self.begins(auto)})

    @staticmethod
    def begins(auto: Automaton) -> set[bytes]:
        """A template is tried only where one or two words with which it can begin stand; one that can begin with any word is tried at every word (a blank)."""
        first = auto.closure({0})
        if auto.final in first:
            raise ValueError("a template must hold a mandatory word")
        out = set()
        for a, to in ((a, to) for s in first for a, to in auto.edges[s].items()):
            then = auto.closure(to)
            nexts = {b for t in then for b in auto.edges[t]}
            if a is None:
                return {b" "}
            out |= {b" " + a + b" "} if auto.final in then or None in nexts else {b" " + a + b" " + b + b" " for b in nexts}
        return out

    @staticmethod
    def places(line: bytes, phrase: bytes) -> Iterator[int]:
        """Indexes of the words with which the phrase begins."""
        at, seen, index = line.find(phrase), 0, 0
        while at >= 0:
            index, seen = index + line.count(b" ", seen, at), at
            yield index
            at = line.find(phrase, at + 1)

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        base = [(start, label) for phrase, label in self.phrases for start in self.places(line, phrase)]
        matches = set()
        for anchor, label in self.anchors:
            for start in self.places(line, anchor) if anchor != b" " else range(len(words)):
                if (end := self.by_label[label].longest(words, start)) is not None:
                    matches.add((label, start, end))
        found = sorted({label for _, label in base})
        every = sorted({*found, *(label for label, _, _ in matches)})
        inside, at = 0, 0
        for _, first, end in sorted(matches, key=lambda m: m[1:]):
            inside, at = inside + max(0, end - max(first, at)), max(at, end)
        score = 0.75 + 0.25 * inside / len(words) if matches else 0.5 if base else 0.0
        starts = [k for k, _ in base]
        spans = sorted(matches, key=lambda m: (m[1], m[0]))
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(found), ",".join(every), score, [{"label": a, "first": b, "end": c} for a, b, c in spans]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, first long, end long>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), _MATCH]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None
) -> DataFrame:
    """One row per input row with its license phrases and template matches.

    A template matches where its mandatory words stand exactly and in order,
    optional regions may be missing and replaceable ones hold a wording that
    they allow. ``score`` is 0.75 with a template match and rises to 1 with the
    share of the text's words inside matches; 0.5 with a phrase only, else 0. ``matches`` has each template match as label, first word and the
    word after its end. Narrow: no shuffle, whole texts, one at a time.

    Null and empty texts have no words, no labels (empty strings) and score 0;
    repeated rows give a row each; an empty table gives no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    names = [f.split()[0] for f in re.sub(r"array<.*", "x", SCHEMA).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), *([r[k] for r in rows] for k in range(8))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
