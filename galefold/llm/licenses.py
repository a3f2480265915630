"""Operator 7: license scans by template markup compiled to token automata.

A template is plain wording with marks: <<beginOptional>> ... <<endOptional>> encloses
wording that may be missing, and <<var;name="...";most="N">> stands for up to N words of
any kind. It compiles to an automaton over words; a stretch of text is accepted if its
mandatory wording matches word by word. Some templates are the line that names a license,
others (-text, -clause, -notice and the like) the whole of a license or of its notice,
so that a text with altered or missing wording isn't accepted as one. Words are runs of letters and digits (A-Z lower-
cased) and of characters beyond ASCII.

Besides the templates there are base phrases, which count wherever their words stand in
a row. Each text is scanned on its own, whole; nothing is shuffled.

Defined results: a null text counts as empty and has no words and no labels; repeated
rows give equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, whole_texts

# Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = '<<beginOptional>><<var;name="what";most="6">> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>distributed<<endOptional>> <<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the terms of<<endOptional>> the '
#: label -> wording that names the license.
_NAMED = {
    "mit": [_GRANT + 'mit license'],
    "apache-2.0": [_GRANT + 'apache license <<beginOptional>>version<<endOptional>> 2 0'],
    "gpl-2.0": [_GRANT + 'gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2'],
    "gpl-3.0": [_GRANT + 'gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3'],
    "lgpl": [_GRANT + 'gnu lesser general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>2 1<<endOptional>> <<beginOptional>>3<<endOptional>>'],
    "mpl-2.0": [_GRANT + 'mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 0'],
    "bsd": [_GRANT + '<<beginOptional>>new<<endOptional>> <<beginOptional>>simplified<<endOptional>> bsd <<var;name="clauses";most="2">> license'],
    "cc-by-4.0": ['<<beginOptional>>licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0', 'creative commons attribution 4 0 <<beginOptional>>international<<endOptional>>'],
    "cc-by-nc-4.0": ['<<beginOptional>>licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0', 'creative commons attribution noncommercial 4 0 <<beginOptional>>international<<endOptional>>'],
    "cc-by-sa-4.0": ['<<beginOptional>>licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4 0', 'creative commons attribution sharealike 4 0 <<beginOptional>>international<<endOptional>>'],
    "cc0-1.0": ['<<beginOptional>>dedicated to the public domain under<<endOptional>> cc0 1 0 <<beginOptional>>universal<<endOptional>>'],
    "all-rights-reserved": ['<<beginOptional>>copyright <<var;name="owner";most="8">><<endOptional>> all rights reserved'],
}

_OPEN, _END = '<<beginOptional>>', '<<endOptional>>'
_HOLDER = '<<var;name="holder";most="12">>'
_AS_IS = 'this software is provided by ' + _HOLDER + ' as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall ' + _HOLDER + ' be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage'
_BSD = 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {_2} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution '.replace('{_1}', f'{_OPEN}1{_END}').replace('{_2}', f'{_OPEN}2{_END}')
_NO_ENDORSEMENT = f'{_OPEN}3{_END} neither the name of ' + _HOLDER + ' nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission '
_ISC_WARRANTY = 'the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software'
_GNU = '<<var;name="program";most="6">> is free software you can redistribute it and or modify it under the terms of the gnu {kind} as published by the free software foundation either version {version} of the license or at your option any later version <<var;name="this program";most="6">> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} for more details'

#: label -> whole license texts, or the notice that a license tells to put in files. The public wording of each.
_WHOLE = {
    "mit-text": [
        'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation '
        'the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions '
        f'the above copyright notice and this permission notice {_OPEN}including the next paragraph{_END} shall be included in all copies or substantial portions of the software '
        'the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement '
        'in no event shall ' + _HOLDER + ' be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'
    ],
    "bsd-2-clause": [_BSD + _AS_IS],
    "bsd-3-clause": [_BSD + _NO_ENDORSEMENT + _AS_IS],
    "isc": [f'permission to use copy modify and {_OPEN}or{_END} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies ' + _ISC_WARRANTY],
    "0bsd": [f'permission to use copy modify and {_OPEN}or{_END} distribute this software for any purpose with or without fee is hereby granted ' + _ISC_WARRANTY],
    "zlib": [
        f'this software is provided as is without any express or implied warranty in no event will the {_OPEN}author{_END} {_OPEN}authors{_END} be held liable for any damages arising from the use of this software '
        'permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions '
        f'{_OPEN}1{_END} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required '
        f'{_OPEN}2{_END} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {_OPEN}3{_END} this notice may not be removed or altered from any source distribution'
    ],
    "bsl-1.0": [
        'permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software '
        'and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following '
        'the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software '
        'unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor '
        'the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement '
        'in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'
    ],
    "unlicense": [
        'this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means '
        'in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors '
        'we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law '
        'the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement '
        'in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'
    ],
    "apache-2.0-notice": [
        'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 '
        'unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied '
        'see the license for the specific language governing permissions and limitations under the license'
    ],
    "gpl-2.0-notice": [_GNU.format(kind='general public license', version='2')],
    "gpl-3.0-notice": [_GNU.format(kind='general public license', version='3')],
    "lgpl-2.1-notice": [_GNU.format(kind='lesser general public license', version='2 1')],
    "lgpl-3.0-notice": [_GNU.format(kind='lesser general public license', version='3')],
    "agpl-3.0-notice": [_GNU.format(kind='affero general public license', version='3')],
    "mpl-2.0-notice": ['this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0', 'this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0'],
    "epl-2.0-notice": [f'this program and the accompanying materials are made available under the terms of the eclipse public license {_OPEN}v{_END} 2 0 which is {_OPEN}also{_END} available at https www eclipse org legal epl 2 0'],
    "wtfpl": ['do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to'],
    "cc0-1.0-notice": [_OPEN + 'to the extent possible under law' + _END + ' ' + _HOLDER + ' has waived all copyright and related or neighboring rights to <<var;name="work";most="12">>'],
}
TEMPLATES = _NAMED | _WHOLE

_APART = bytes.maketrans(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), b" " * (0x30 + 0x27 + 5))
_MARK = re.compile(r'<<(beginOptional|endOptional|var;[^>]*)>>')


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_APART).split()


@dataclass
class Automaton:
    """States are numbers; `steps` has (word, next) pairs, word None for any; `free` has moves without a word."""

    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0
    mandatory: list[bytes] = field(default_factory=list)

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.steps[at].append((word, to))
        return to

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def first_words(self) -> set[bytes | None]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s]}

    def match(self, text: list[bytes], start: int) -> int | None:
        """The end of the longest accepted stretch from start."""
        states, end = self.closure({0}), None
        for at in range(start, len(text)):
            word = text[at]
            states = self.closure({to for s in states for w, to in self.steps[s] if w is None or w == word})
            if not states:
                break
            if self.final in states:
                end = at + 1
        return end


def compile_template(markup: str) -> Automaton:
    a, at, opened = Automaton(), 0, []
    for k, part in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            for w in words(part):
                at = a._word(at, w)
                if not opened:
                    a.mandatory.append(w)
        elif part == "beginOptional":
            opened.append(at)
        elif part == "endOptional":
            begin = opened.pop()
            end = a._state()
            a.free[at].append(end)
            a.free[begin].append(end)
            at = end
        else:
            end = a._state()
            for _ in range(int(dict(re.findall(r'(\w+)="([^"]*)"', part)).get("most", "1"))):
                a.free[at].append(end)
                at = a._word(at, None)
            a.free[at].append(end)
            at = end
    if opened or not a.mandatory:
        raise ValueError(f"template without an end mark or without mandatory wording: {markup[:60]}")
    a.final = at
    return a


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES):
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.automata = [(label, compile_template(t)) for label, own in templates.items() for t in own]
        #: A wildcard may come first; then a match is looked for from its least mandatory wording on.
        self.rare = [max(a.mandatory, key=len) for _, a in self.automata]

    def scan(self, text: str) -> tuple[int, list[tuple[str, str, int, int]]]:
        """Number of words, and (kind, label, start, end) of all finds in order."""
        own = words(text)
        line, found = b" " + b" ".join(own) + b" ", []
        for phrase, label in self.phrases:
            if b" " + b" ".join(phrase) + b" " in line:
                n = len(phrase)
                found += [("base", label, k, k + n) for k in range(len(own) - n + 1) if own[k] == phrase[0] and tuple(own[k : k + n]) == phrase]
        for (label, a), rare in zip(self.automata, self.rare, strict=True):
            if rare in line and all(b" " + w + b" " in line for w in a.mandatory):
                first, last = a.first_words(), -1
                for k, w in enumerate(own):
                    if k >= last and (w in first or None in first) and (end := a.match(own, k)):
                        found.append(("template", label, k, end))
                        last = end
        return len(own), sorted(found, key=lambda f: (f[2], f[3], f[0], f[1]))


_SPAN = "array<struct<kind:string,label:string,start:long,end:long>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (kind base or template, label, start and end in words)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches(rows):
            out = [scanner.scan(t) for t in batch["text"].to_pylist()]
            spans = [[dict(zip(("kind", "label", "start", "end"), s, strict=True)) for s in own] for _, own in out]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in out], pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_words", "spans"])

    return whole_texts(docs).mapInArrow(run, f"doc_id long, n_words long, spans {_SPAN}")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] == "base")
    labels = lambda s: F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(s, lambda x: x["label"]))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(spans).alias("labels"), (1 - 1 / (1 + covered)).alias("score"),
    )
