"""License scans by template automata.

A license is described by a template: its wording with ``<<beginOptional>> ... <<endOptional>>`` around what may be
left out and ``<<var;name="...";words="a-b">>`` where a to b words of the user's choice stand. All templates are
compiled into one token automaton, determinised as texts call for it, which accepts exactly the word sequences whose
mandatory wording is unchanged. Each document is scanned once, wherever in it a license stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the UTF-8 text with A-Z lower-cased; bytes above 7F belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


@dataclass(frozen=True)
class Template:
    """``base`` marks a plain phrase, whose places are counted."""

    label: str
    markup: str
    base: bool = False


#: The phrases of the base scan.
PHRASES = (
    Template("mit", "under the MIT License", base=True),
    Template("apache-2", "Apache License, Version 2", base=True),
    Template("cc-by-nc", "CC BY-NC", base=True),
)

_VERSION = '<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version {0}'
_LATER = " <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>"
#: The FSF's notice as it stands at the head of files; its paragraphs on warranty and on the copy of the license may be left out.
_FSF = (
    'This <<var;name="what";words="1-4">> is free software; you can redistribute it and/or modify it under the terms of {0} ' + _VERSION.replace("{0}", "{1}") + _LATER
    + ' <<beginOptional>>This <<var;name="what";words="1-4">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See {0} for more details<<endOptional>>'
    + ' <<beginOptional>>You should have received a copy of {0} along with this <<var;name="what";words="1-4">> If not, <<var;name="where";words="2-30">><<endOptional>>'
)

#: What may stand before a whole wording: its name and a line of copyright.
_HEAD = '<<beginOptional>>{0}<<endOptional>> <<beginOptional>>Copyright <<var;name="holder";words="1-20">><<endOptional>> <<beginOptional>>All rights reserved<<endOptional>> '
#: Parts of the long wordings.
_MIT = _HEAD.format("MIT License <<beginOptional>>(MIT)<<endOptional>>") + 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE'
_APACHE_TAIL = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License'
_ISC = _HEAD.format("ISC License") + 'Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>><<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";words="1-12">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";words="1-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE'
_BSD = _HEAD.format('BSD <<var;name="clauses";words="0-2">> License') + 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3<<endOptional>> Neither the name of <<var;name="holder";words="1-12">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words="1-14">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";words="1-14">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://mozilla.org/MPL/2.0"
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"

#: Notices in their usual wording.
NOTICES = (
    Template("mit", "<<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under the MIT <<beginOptional>>(Expat)<<endOptional>> License"),
    Template("mit", _MIT),
    Template("apache-2", 'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License <<beginOptional>>You may obtain a copy of the License at <<var;name="where";words="1-12">> ' + _APACHE_TAIL + "<<endOptional>><<endOptional>>"),
    Template("cc-by-nc", 'Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>>'),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var;name=\"version\";words=\"0-2\">> International"),
    Template("cc-by-sa", "Licensed under CC BY-SA <<beginOptional>>4.0<<endOptional>>"),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike <<var;name=\"version\";words=\"0-2\">> International"),
    Template("cc-by", "Creative Commons Attribution <<var;name=\"version\";words=\"0-2\">> International"),
    Template("cc0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    Template("gpl-3", "This <<var;name=\"what\";words=\"1-4\">> is <<beginOptional>>free software and<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>either<<endOptional>> version 3"),
    Template("gpl-2", "This <<var;name=\"what\";words=\"1-4\">> is <<beginOptional>>free software and<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>either<<endOptional>> version 2"),
    Template("gpl-3", _FSF.format("the GNU General Public License", "3")),
    Template("gpl-2", _FSF.format("the GNU General Public License", "2")),
    Template("lgpl", _FSF.format("the GNU Lesser General Public License", "3")),
    Template("lgpl", _FSF.format("the GNU Lesser General Public License", "2.1")),
    Template("agpl-3", _FSF.format("the GNU Affero General Public License", "3")),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl-3", "GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    Template("mpl-2", _MPL),
    Template("isc", _ISC),
    Template("bsd", _BSD),
    Template("unlicense", _UNLICENSE),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("gpl-3", "SPDX-License-Identifier: GPL-3.0 <<beginOptional>>only<<endOptional>>"),
)


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return WORD.findall(data.lower())


class Automaton:
    """The union of all templates' token automata, determinised on demand.

    ``match(words, at)`` gives, for each template that accepts words from ``at`` on, where its longest match ends.
    """

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self.mandatory = []
        self._edges: list[dict[bytes, list[int]]] = [{}]
        self._any: list[list[int]] = [[]]
        self._free: list[list[int]] = [[]]
        self._accept: dict[int, int] = {}
        for k, template in enumerate(self.templates):
            end, fixed = self._compile(template.markup)
            if not fixed:
                raise ValueError(f"no mandatory wording in {template.markup!r}")
            self._accept[end] = k
            self.mandatory.append(fixed)
        self._ids: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._moves: list[tuple[dict[bytes, int], int, tuple[int, ...]] | None] = []
        self.start = self._state(frozenset([0]))
        self.first = frozenset(self._open(self.start)[0])
        if self._open(self.start)[1] >= 0:
            raise ValueError("a template may not begin with a replaceable region")

    def _new(self) -> int:
        self._edges.append({})
        self._any.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _compile(self, markup: str) -> tuple[int, int]:
        at, fixed, open_at = 0, 0, []
        parts = _MARK.split(markup)
        for k, part in enumerate(parts):
            if k % 2 == 0:
                for word in words_of(part):
                    to = self._new()
                    self._edges[at].setdefault(word, []).append(to)
                    at, fixed = to, fixed + (not open_at)
            elif part == "beginOptional":
                enter = self._new()
                self._free[at].append(enter)
                open_at.append(at)
                at = enter
            elif part == "endOptional":
                leave = self._new()
                self._free[at].append(leave)
                self._free[open_at.pop()].append(leave)
                at = leave
            else:
                least, most = map(int, re.search(r'words="(\d+)-(\d+)"', part).groups())
                stops = []
                for step in range(most):
                    if step >= least:
                        stops.append(at)
                    to = self._new()
                    self._any[at].append(to)
                    at = to
                for stop in stops:
                    self._free[stop].append(at)
        if open_at:
            raise ValueError(f"optional region without end in {markup!r}")
        return at, fixed

    def _state(self, states: frozenset[int]) -> int:
        seen, todo = set(states), list(states)
        while todo:
            for to in self._free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        key = frozenset(seen)
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append(None)
        return self._ids[key]

    def _open(self, state: int) -> tuple[dict[bytes, int], int, tuple[int, ...]]:
        """Moves by word, the move by any other word (-1: none) and the templates accepted here."""
        if self._moves[state] is None:
            inside = self._sets[state]
            other = frozenset(t for s in inside for t in self._any[s])
            words = {w for s in inside for w in self._edges[s]}
            moves = {w: self._state(other | {t for s in inside for t in self._edges[s].get(w, ())}) for w in words}
            accepted = tuple(sorted(self._accept[s] for s in inside if s in self._accept))
            self._moves[state] = (moves, self._state(other) if other else -1, accepted)
        return self._moves[state]

    def match(self, words: Sequence[bytes], at: int) -> dict[int, int]:
        found: dict[int, int] = {}
        state, n = self.start, len(words)
        while True:
            moves, other, accepted = self._open(state)
            for k in accepted:
                found[k] = at
            if at >= n:
                return found
            state = moves.get(words[at], other)
            if state < 0:
                return found
            at += 1

    def scan(self, words: Sequence[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of all matches, in order of their starts."""
        first = self.first
        return [(k, i, end) for i, w in enumerate(words) if w in first for k, end in sorted(self.match(words, i).items())]


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("mandatory", pa.int32())]))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All template matches in the whole text of each row: ``id_col``, n_words, matches (label, base, start, end, mandatory).

    start and end count words from 0, end is exclusive, mandatory is the template's number of mandatory words. A null
    text counts as empty and has no matches; repeated rows are scanned each for itself; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        kinds = [(t.label, t.base, m) for t, m in zip(automaton.templates, automaton.mandatory, strict=True)]
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                counts.append(len(words))
                found.append([
                    {"label": kinds[k][0], "base": kinds[k][1], "start": i, "end": j, "mandatory": kinds[k][2]}
                    for k, i, j in automaton.scan(words)
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _MATCH)], names=["_id", "n_words", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
        .mapInArrow(run, f"_id {kind}, n_words bigint, matches array<struct<label:string,base:boolean,start:bigint,end:bigint,mandatory:int>>")
        .withColumnRenamed("_id", id_col)
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: m / (m + 2) for the m mandatory words of the longest wording found, 0 without any."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.transform(labels, lambda m: m["label"]))), ",")
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["mandatory"])), F.lit(0)).cast("double")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        (most / (most + 2)).alias("score"),
    )
