"""Operator 7: license scans by template markup.

A template is license wording with regions marked optional, [[ ... ]], and replaceable, {name:n}, which stands for up
to n words of any kind. It is compiled into a token automaton; a place of a text is accepted if the automaton runs
from there to its end, so all mandatory words stand there exactly, in order. Phrases are found beside that.

A null text is an empty one. Rows are independent: repeated rows give a row each, an empty table none, and no other
column of docs is read. Whole texts are matched, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import prepare

#: Phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = "including but not limited to the [[implied]] warranties of merchantability [[and]] fitness for a particular purpose"
_BSD_OPEN = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[{n:1}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{n:1}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "neither the name of {owner:12} nor the names of [[its]] {contributors:4} may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_CLOSE = f"this software is provided by {{holder:10}} as is and any express or implied warranties {_WARRANTY} are disclaimed in no event shall {{holder:12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_GPL_OPEN = "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {number:2} of the license"

#: Public license wording, as templates: whole licences and whole file headers.
WHOLE = {
    "mit": f"{_MIT_GRANT} and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied {_WARRANTY} and noninfringement in no event shall the {{holders:8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause": f"{_BSD_OPEN} {_BSD_CLOSE}",
    "bsd-3-clause": f"{_BSD_OPEN} [[{{n:1}}]] {_BSD_NAMES} {_BSD_CLOSE}",
    "isc": f"{_ISC_GRANT} the software is provided as is and {{author:6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{author:8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at {url:12} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": f"{_GPL_OPEN} or [[at your option]] any later version {{work:4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details [[you should have received a copy of the gnu general public license along with {{work:4}} if not see {{url:8}}]]",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {url:10}",
}
#: Sentences and notices out of them. The label in front is what an accepted text is given.
TEMPLATES = WHOLE | {
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit-grant": _MIT_GRANT,
    "apache-2.0-notice": "licensed under the apache license [[version]] 2 0 [[the license]]",
    "apache-2.0-header": "you may not use this file except in compliance with the license [[you may obtain a copy of the license at {url:12}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl-3.0-notice": "[[this {work:4} is]] licensed under the gnu general public license [[as published by the free software foundation]] version 3",
    "gpl-header": _GPL_OPEN,
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-no-endorsement": _BSD_NAMES,
    "isc-grant": _ISC_GRANT,
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] creative commons attribution 4 0 international [[public]] license",
    "spdx-tag": "spdx license identifier {id:6}",
}

#: Bytes that separate words, and A-Z: the words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Automaton:
    """States 0..n over template tokens: a word, a gap of up to n words, or a jump over an optional region."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int]] = []  # (word, 0) or (None, n): up to n words of any kind
        self.jumps: dict[int, int] = {}
        opened: list[int] = []
        for t in re.findall(r"\[\[|\]\]|\{\w+:\d+\}|[^\s\[\]]+", template):
            if t == "[[":
                opened.append(len(self.steps))
            elif t == "]]":
                at = opened.pop()
                self.jumps[at] = max(self.jumps.get(at, 0), len(self.steps))
            elif t[0] == "{":
                self.steps.append((None, int(t[1:-1].split(":")[1])))
            else:
                self.steps.append((t.encode(), 0))
        optional = {i for a, b in self.jumps.items() for i in range(a, b)}
        self.mandatory = [w for i, (w, _) in enumerate(self.steps) if w and i not in optional]
        #: The longest mandatory word is looked for first; no text without it is accepted.
        self.anchor = max(self.mandatory, key=len)
        self.first = {w for i in self._open({(0, 0)}) if (w := self.steps[i[0]][0])}

    def _open(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """states, and those reached from them without a word; a state is (step, words used by its gap)."""
        todo = list(states)
        while todo:
            at, _ = todo.pop()
            reach = [(self.jumps[at], 0)] if at in self.jumps else []
            if at < len(self.steps) and self.steps[at][0] is None:
                reach.append((at + 1, 0))
            for s in reach:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from start, or -1."""
        states, at, end = self._open({(0, 0)}), start, -1
        while states:
            if any(s == len(self.steps) for s, _ in states):
                end = at
            if at == len(words):
                break
            new = set()
            for s, used in states:
                if s < len(self.steps):
                    word, gap = self.steps[s]
                    if word is None:
                        if used < gap:
                            new.add((s, used + 1))
                    elif word == words[at]:
                        new.add((s + 1, 0))
            states, at = self._open(new), at + 1
        return end


def scan(text: bytes | None, phrases: dict[bytes, str], automata: dict[str, Automaton]) -> tuple:
    """(n_words, places of phrases [(start, label)], accepted templates [(start, end, label)])."""
    words = words_of(text)
    flat = b" ".join(words)
    places: list[tuple[int, str]] = []
    for phrase, label in phrases.items():
        if phrase in flat:
            p = phrase.split(b" ")
            at = -1
            while (at := _index(words, p[0], at + 1)) >= 0:
                if words[at : at + len(p)] == p:
                    places.append((at, label))
    found: list[tuple[int, int, str]] = []
    for label, a in automata.items():
        if a.anchor in flat and all(w in flat for w in a.mandatory):
            for first in a.first:
                at = -1
                while (at := _index(words, first, at + 1)) >= 0:
                    if (end := a.accepts(words, at)) >= 0:
                        found.append((at, end, label))
    return len(words), sorted(places), sorted(set(found))


def _index(words: list[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automata = {p.encode(): label for p, label in phrases.items()}, {k: Automaton(t) for k, t in templates.items()}
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        match = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for b in batches:
            rows = [scan(t.as_py(), known, automata) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": s, "label": x} for s, x in r[1]] for r in rows], place),
                    pa.array([[{"start": s, "end": e, "label": x} for s, e, x in r[2]] for r in rows], match),
                ],
                names=["doc_id", "n_words", "places", "matches"],
            )

    return run


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, matches, score): phrases as (start, label), accepted templates as (start, end, label),
    words counted from 0. score is 1 if a whole licence or header (WHOLE) was accepted, .75 if another template was, .5 if
    only a phrase stands there, else 0."""
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = d.mapInArrow(_scan(phrases, templates), "doc_id long, n_words long, places array<struct<start: long, label: string>>, matches array<struct<start: long, end: long, label: string>>")
    return out.withColumn("score", F.when(F.exists("matches", lambda m: m["label"].isin(list(WHOLE))), 1.0).when(F.size("matches") > 0, 0.75).when(F.size("places") > 0, 0.5).otherwise(0.0))
