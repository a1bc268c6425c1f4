"""Operator 11: licences in whole texts, by templates compiled to automata over words.

A template is the wording of a licence or a notice with markup: ``[...]`` may be left out, ``{a|b c}`` is one of these wordings, ``{1-12}`` stands for any words,
so many of them; regions may be nested. All templates together are one automaton without empty moves. It accepts a stretch of words whose mandatory wording is a
template's word for word; what punctuation, case and line breaks do between words doesn't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, table
from .words import blocks

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: of texts whose A-Z are lower-cased

# The phrases that count by themselves, and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_GRANT = "{licensed|released|distributed|available|published|provided} under [the terms of] {the|a|an|} "
_DAMAGES = """(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [{1|a}] Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [{2|b}] Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """[{3|c}] Neither the name of {1-12} nor the names of {its|their|other} contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {1-12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {1-12} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES """
_GPL = """free software[:;] you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation[,] {{either version {}
of the License, or (at your option) any later version|version {} of the License|version {}}}"""

# The wordings of licences and of notices that name them.
TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
    Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [(including the next paragraph)] shall
    be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {1-12} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("MIT", _GRANT + "MIT License"),
    ("ISC", """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
    permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {1-12} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {1-12} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
    PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""),
    ("BSD-2-Clause", _BSD + _BSD_END + _DAMAGES),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END + _DAMAGES),
    ("BSD-2-Clause", _GRANT + "{bsd 2 clause|2 clause bsd|simplified bsd} License"),
    ("BSD-3-Clause", _GRANT + "{bsd 3 clause|3 clause bsd|new bsd|modified bsd} License"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 [(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    {1-12} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
    either express or implied. See the License for the specific language governing permissions and limitations under the License]"""),
    ("Apache-2.0", _GRANT + "Apache {License 2.0|2.0 license|software license version 2.0}"),
    *((f"GPL-{v}.0", _GPL.format("", v, v, v)) for v in (2, 3)),
    *((f"GPL-{v}.0", _GRANT + f"{{GNU General Public License|GNU GPL|GPL}} {{version {v}|v{v}|{v}}} [.0] [or {{any|}} later [version]]") for v in (2, 3)),
    *((f"LGPL-{v}", _GPL.format("{lesser|library}", v, v, v)) for v in ("2.1", "3")),
    *((f"AGPL-{v}.0", _GPL.format("affero", v, v, v)) for v in (3,)),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {1-12}"""),
    ("MPL-2.0", _GRANT + "Mozilla Public License [{version|v}] 2.0"),
    *((f"CC-BY{'-' + k.upper() if k else ''}-{v}", _GRANT + f"{{creative commons|cc}} {{by {' '.join(k.split('-'))}|attribution {long}}} [{{license|version}}] {v} [{{international|unported}}] [license]")
      for k, long in (("", ""), ("nc", "{noncommercial|non commercial}"), ("sa", "{sharealike|share alike}"), ("nd", "{noderivatives|no derivatives|noderivs}"), ("nc-sa", "{noncommercial|non commercial} {sharealike|share alike}"))
      for v in ("3.0", "4.0")),
    ("CC0-1.0", "To the extent possible under law, {1-12} {has|have} waived all copyright and related or neighboring rights to"),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
    source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the author[s] be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
)


def words_of(text: str) -> list[str]:
    """Words of a text, A-Z in lower case."""
    return re.findall(WORD, text.encode().lower().decode())


@dataclass(frozen=True)
class Part:
    """A piece of a template: a ``word``; any words, from ``least`` to ``most``; or one of several ``ways``, each a list of pieces."""

    word: str = ""
    least: int = 0
    most: int = 0
    ways: tuple[tuple[Part, ...], ...] = ()


_MARKUP = re.compile(r"\{(\d+)-(\d+)\}|([\[\]{}|])|([^\[\]{}|]+)")


def parse(markup: str) -> tuple[Part, ...]:
    """The pieces of a template; brackets that don't close, or close what isn't open, are a ValueError."""
    stack: list[tuple[str, list[list[Part]]]] = [("", [[]])]
    at = 0
    while at < len(markup):
        m = _MARKUP.match(markup, at)
        if m is None or m.end() == at:
            raise ValueError(f"the template can't be read at {markup[at : at + 20]!r}")
        if not (markup[at] == "{" and m[1]) and m[3] is None:
            stack[-1][1][-1] += [Part(w) for w in words_of(m[4])]
        elif m[1]:
            if int(m[1]) > int(m[2]):
                raise ValueError(f"a region of {m[1]} to {m[2]} words")
            stack[-1][1][-1].append(Part(least=int(m[1]), most=int(m[2])))
        elif m[3] in "[{":
            stack.append((m[3], [[]]))
        elif m[3] == "|":
            if stack[-1][0] != "{":
                raise ValueError("a | outside of { }")
            stack[-1][1].append([])
        else:
            opened, ways = stack.pop()
            if opened + m[3] not in ("[]", "{}"):
                raise ValueError(f"a {m[3]} that closes nothing")
            made = [tuple(w) for w in ways] + ([()] if opened == "[" else [])
            stack[-1][1][-1].append(Part(ways=tuple(made)))
        at = m.end()
    if len(stack) > 1:
        raise ValueError(f"a {stack[-1][0]} that isn't closed")
    return tuple(stack[0][1][0])


def mandatory(parts: Sequence[Part]) -> list[str]:
    """Words that every text of a template holds, as far as they stand outside of regions."""
    return [p.word for p in parts if p.word]


@dataclass
class Automaton:
    """``moves``: for each state, the states after a word; ``free``: those after any word; ``ends``: the template that a state completes; ``first``: the states after
    a template's first word. States are those of all templates; none is left without a word."""

    labels: list[str]
    base: list[bool]
    moves: list[dict[str, tuple[int, ...]]] = field(default_factory=list)
    free: list[tuple[int, ...]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)
    first: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @staticmethod
    def of(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> Automaton:
        """The automaton of templates and phrases (label, wording). One that may begin with any word, or be empty, is a ValueError."""
        every = [(label, parse(text), False) for label, text in templates] + [(label, tuple(Part(w) for w in words_of(text)), True) for label, text in phrases]
        out = Automaton([e[0] for e in every], [e[2] for e in every])
        words: list[dict[str, list[int]]] = []
        anything: list[list[int]] = []
        empty: list[list[int]] = []

        def state() -> int:
            words.append({}), anything.append([]), empty.append([])
            return len(words) - 1

        def build(parts: Sequence[Part], at: int) -> int:
            for p in parts:
                after = state()
                if p.word:
                    words[at].setdefault(p.word, []).append(after)
                elif p.ways:
                    for way in p.ways:
                        begin = state()
                        empty[at].append(begin)
                        empty[build(way, begin)].append(after)
                else:
                    for k in range(p.most):
                        if k >= p.least:
                            empty[at].append(after)
                        then = state()
                        anything[at].append(then)
                        at = then
                    empty[at].append(after)
                at = after
            return at

        begins, last = [], {}
        for i, (label, parts, _) in enumerate(every):
            begin = state()
            end = build(parts, begin)
            begins.append(begin)
            last[end] = i

        def reach(start: int) -> list[int]:
            seen, todo = {start}, [start]
            while todo:
                for s in empty[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return sorted(seen)

        closed = [reach(s) for s in range(len(words))]
        useful = lambda s: words[s] or anything[s] or s in last  # noqa: E731 - others only pass on
        after = lambda targets: tuple(sorted({s for t in targets for s in closed[t] if useful(s)}))
        out.moves = [{w: after(ts) for w, ts in own.items()} for own in words]
        out.free = [after(ts) for ts in anything]
        out.ends = last
        for i, begin in enumerate(begins):
            if any(anything[s] or s in last for s in closed[begin]):
                raise ValueError(f"a template of {every[i][0]} begins with any word, or is empty")
            for s in closed[begin]:
                for w, targets in out.moves[s].items():
                    out.first[w] = tuple(sorted({*out.first.get(w, ()), *targets}))
        return out

    def accepted(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, template) of the stretches of ``words`` that templates accept: of a template's ones that overlap the earliest, as long as it can be."""
        begin = self.first.keys()
        places = [i for i, w in enumerate(words) if w in begin]
        found: dict[tuple[int, int], int] = {}
        at = 0
        for place in places:
            if place < at:
                continue
            active: dict[int, int] = {}
            at = place
            while at < len(words):
                word, then = words[at], {}
                for s, start in active.items():
                    for t in (*self.moves[s].get(word, ()), *self.free[s]):
                        if then.get(t, start) >= start:
                            then[t] = start
                for t in self.first.get(word, ()):
                    then.setdefault(t, at)
                at += 1
                active = then
                for t, start in then.items():
                    if t in self.ends:
                        found[self.ends[t], start] = at
                if not then:
                    break
        out, free = [], {}
        for (i, start), end in sorted(found.items()):
            if start >= free.get(i, 0):
                out.append((start, end, i))
                free[i] = end
        return sorted(out)


def _may(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]) -> str:
    """An expression that every text with a template or phrase matches: the longest word of each that is mandatory."""
    needed = {max(mandatory(parse(t)), key=len, default="") for _, t in templates} | {max(words_of(t), key=len, default="") for _, t in phrases}
    shortest = [w for w in needed if not any(v in w for v in needed - {w})]
    return "(?i)" + "|".join(map(re.escape, sorted(shortest)))


def _numbers(texts: pa.Array) -> Iterator[int]:
    """Number of words of each text."""
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    for _, _, data, bounds in blocks(texts):
        word = inside[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = bounds[:-1][bounds[:-1] < len(data)]
        begins[cuts] = word[cuts]
        total = np.concatenate([[0], np.cumsum(begins)])
        yield from (total[bounds[1:]] - total[bounds[:-1]]).tolist()


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``docs`` with n_words and places: array of (label, base, start, end) in words of the whole text, end exclusive, by start, end, label.

    ``base`` places are those of phrases, the others those of templates. Only texts with a word that some template or phrase can't do without are cut into words. A null or
    empty text has none. Each row is judged alone, repeated rows too; columns of these two names are replaced, others stay. An empty table gives no rows."""
    lean(docs.sparkSession)
    automaton, may = Automaton.of(templates, phrases), _may(templates, phrases)
    name = free_name(docs, "_licenses")

    @F.arrow_udf("struct<n_words: bigint, places: array<struct<label: string, base: boolean, start: bigint, end: bigint>>>")
    def scan(texts: pa.Array) -> pa.Array:
        n = list(_numbers(texts))
        out = []
        for i, hit in enumerate(pc.match_substring_regex(texts, may).to_pylist()):
            found = automaton.accepted(words_of(texts[i].as_py())) if hit else []
            rows = sorted((start, end, automaton.labels[k], automaton.base[k]) for start, end, k in found)
            out.append([{"label": label, "base": base, "start": start, "end": end} for start, end, label, base in rows])
        places = pa.array(out, pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), places], ["n_words", "places"])

    out = docs.withColumn(name, scan(F.coalesce("text", F.lit(""))))
    return out.withColumns({"n_words": F.col(f"{name}.n_words"), "places": F.col(f"{name}.places")}).drop(name)


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 where a template is accepted, a half where only a phrase stands, else 0."""
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    size = F.size("places")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.when(size > F.size(base), 1.0).when(size > 0, 0.5).otherwise(0.0).alias("score"),
    )
