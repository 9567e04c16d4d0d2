"""License scans: template markup compiled to token automata that accept exact mandatory wording."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import sub_batches, text_bytes

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MARKUP = re.compile(r"<<(beginOptional|endOptional|var)(?:;([^>]*))?>>")

# The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices as templates.  Text in <<beginOptional>>..<<endOptional>> may be absent; a <<var>> stands for
# any wording its `match` allows: alternatives parted by |, or .{low,high} for so many words.
VERB = '<<var;name="verb";match="released|licensed|distributed|available|provided">>'
TERMS = '<<beginOptional>>the terms of <<endOptional>>'

# Whole licence texts and standard headers; numbers and names that may differ are regions.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";match=".{1,6}">>
and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the Software.
<<var;name="start";match="The Software is|This software is">> provided "as is", without warranty of any kind, express or implied,
including but not limited to the warranties of merchantability, fitness for a particular purpose and
<<var;name="last";match="noninfringement|non infringement">>. In no event shall
<<var;name="holders";match="the authors or copyright holders|.{1,12}">> be liable for any claim, damages or other liability, whether
in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in
the Software."""
ISC_TEXT = """Permission to use, copy, modify, <<var;name="and";match="and distribute|and or distribute">> this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
The software is provided "as is" and <<var;name="author";match=".{1,8}">> disclaims all warranties with regard to this software
including all implied warranties of merchantability and fitness. In no event shall <<var;name="holder";match=".{1,8}">> be liable for
any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits,
whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of
this software."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. """
BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";match=".{1,12}">> nor the names of
<<var;name="whose";match="its|their|specific">> contributors may be used to endorse or promote products derived from this software
without specific prior written permission. """
BSD_END = """This software is provided by <<var;name="provider";match="the copyright holders and contributors|.{1,12}">> "as is" and any
express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular
purpose are disclaimed. In no event shall <<var;name="holder";match="the copyright holder or contributors|.{1,12}">> be liable for
any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of
substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of
liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of
this software, even if advised of the possibility of such damage."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
<<var;name="place";match="http www apache org licenses LICENSE 2.0|https www apache org licenses LICENSE 2.0">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GNU_HEADER = """<<var;name="work";match="This program|This library|This software|This file">> is free software
<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, <<beginOptional>>either <<endOptional>>version {version} of the License{later}.
<<var;name="it";match="This program|This library|This software|This file|It">> is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for
more details."""
GNU_LATER = ', or (at your option) any later version'
# Labels, names and versions of the headers above.
GNU_LICENSES = [("gpl", "GNU General Public License", "2"), ("gpl", "GNU General Public License", "3"),
                ("lgpl", "GNU Lesser General Public License", "2.1"), ("lgpl", "GNU Lesser General Public License", "3"),
                ("agpl", "GNU Affero General Public License", "3")]
# Labels and wordings of the Creative Commons licences.
COMMONS = {"cc-by-4.0": "by|attribution", "cc-by-sa-4.0": "by sa|attribution sharealike", "cc-by-nd-4.0": "by nd|attribution noderivatives",
           "cc-by-nc-4.0": "by nc|attribution noncommercial", "cc-by-nc-sa-4.0": "by nc sa|attribution noncommercial sharealike",
           "cc-by-nc-nd-4.0": "by nc nd|attribution noncommercial noderivatives"}

TEMPLATES = {
    "mit-notice": f"{VERB} under {TERMS}the MIT License",
    "apache-2.0": f"{VERB} under {TERMS}the Apache License<<beginOptional>>,<<endOptional>> Version 2.0",
    "gpl-2.0": f"licensed under {TERMS}the GNU General Public License, version 2",
    "gpl-3.0": f"licensed under {TERMS}the GNU General Public License, version 3",
    "mit-text": MIT_TEXT,
    "isc-text": ISC_TEXT,
    "bsd-2-clause": BSD_START + BSD_END,
    "bsd-3-clause": BSD_START + BSD_NAMES + BSD_END,
    "apache-2.0-header": APACHE_HEADER,
    **{f"{label}-{version if '.' in version else version + '.0'}-{kind}": GNU_HEADER.format(name=name, version=version, later=later)
       for label, name, version in GNU_LICENSES for kind, later in (("only", ""), ("or-later", GNU_LATER))},
    **{label: f'{VERB} under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<var;name="owner";'
              f'match="cc|creative commons">> <<var;name="kind";match="{kinds}">> 4.0' for label, kinds in COMMONS.items()},
}

ANY = b""


def words_of(text: bytes) -> list[bytes]:
    """Words of a text after A-Z were lower-cased."""
    return WORD.findall(text.lower())


@dataclass
class Automaton:
    """All templates in one nondeterministic automaton over words, and its subsets as they are met."""

    steps: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)
    roots: set[int] = field(default_factory=set)

    def state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def chain(self, at: int, words: list[bytes]) -> int:
        for word in words:
            after = self.state()
            self.steps[at].setdefault(word, set()).add(after)
            at = after
        return at

    def replaceable(self, at: int, match: str) -> int:
        """A region of any allowed wording: .{low,high} words, or one of the alternatives."""
        start, end = at, self.state()
        for wording in match.split("|"):
            span = re.fullmatch(r"\.\{(\d+),(\d+)\}", wording)
            if not span:
                self.free[self.chain(start, words_of(wording.encode()))].add(end)
                continue
            low, high = map(int, span.groups())
            at = start
            for k in range(high + 1):
                if k >= low:
                    self.free[at].add(end)
                if k < high:
                    at = self.chain(at, [ANY])
        return end

    def add(self, label: str, template: str) -> None:
        root = at = self.state()
        opened, place = [], 0
        for tag in MARKUP.finditer(template):
            at = self.chain(at, words_of(template[place:tag.start()].encode()))
            place = tag.end()
            if tag[1] == "beginOptional":
                opened.append(at)
            elif tag[1] == "endOptional":
                end = self.state()
                self.free[at].add(end)
                self.free[opened.pop()].add(end)
                at = end
            else:
                at = self.replaceable(at, re.search(r'match="([^"]*)"', tag[2])[1])
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        at = self.chain(at, words_of(template[place:].encode()))
        self.accepts[at] = label
        self.roots.add(root)

    def close(self, states) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in out:
                    out.add(after)
                    todo.append(after)
        return frozenset(out)


class Scanner:
    """Deterministic view of an automaton: subsets of states are numbered when first met.

    The subsets are those of fixed templates, so their number has nothing to do with the texts.
    """

    def __init__(self, templates: dict[str, str]):
        nfa = self.nfa = Automaton()
        for label, template in templates.items():
            nfa.add(label, template)
        self.vocabulary = {w for step in nfa.steps for w in step if w != ANY}
        start = nfa.close(nfa.roots)
        if any(ANY in nfa.steps[s] for s in start) or any(s in nfa.accepts for s in start):
            raise ValueError("a template must begin with given wording")
        self.first = {w for s in start for w in nfa.steps[s]}
        self.numbers = {start: 0}
        self.sets = [start]
        self.moves: list[dict[bytes, int]] = [{}]
        self.labels: list[list[str]] = [[]]

    def move(self, number: int, word: bytes) -> int:
        """The subset after a word; -1 once no template can go on.  Unknown words count as one."""
        word = word if word in self.vocabulary else ANY
        known = self.moves[number].get(word)
        if known is None:
            steps = self.nfa.steps
            after = self.nfa.close({t for s in self.sets[number] for w in {word, ANY} for t in steps[s].get(w, ())})
            known = self.numbers.get(after, -1) if after else -1
            if after and known < 0:
                known = self.numbers[after] = len(self.sets)
                self.sets.append(after)
                self.moves.append({})
                self.labels.append([self.nfa.accepts[s] for s in after if s in self.nfa.accepts])
            self.moves[number][word] = known
        return known

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, end) of every place where a template's wording stands; the longest of each place."""
        first, found = self.first, []
        for begin in [k for k, w in enumerate(words) if w in first]:
            state, ends = 0, {}
            for k in range(begin, len(words)):
                state = self.move(state, words[k])
                if state < 0:
                    break
                for label in self.labels[state]:
                    ends[label] = k + 1
            found += [(label, begin, end) for label, end in ends.items()]
        return found


@functools.cache
def scanners() -> tuple[Scanner, Scanner]:
    return Scanner({phrase: phrase for phrase in BASE_PHRASES}), Scanner(TEMPLATES)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: number of words, places of base phrases, labels of phrases and templates, and their spans.

    `score` is 1 where a whole notice template matches, 0.5 where only a base phrase stands, else 0.  A null text
    counts as empty: no words, no places, empty labels, score 0.  Rows are independent; whole texts are scanned;
    other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
              "labels string, score double, spans array<struct<label string, begin_word bigint, end_word bigint>>")
    span = pa.struct([("label", pa.string()), ("begin_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, notices = scanners()
        for batch in sub_batches(batches, "text"):
            rows = []
            for text in text_bytes(batch, "text"):
                words = words_of(text)
                places = base.scan(words)
                whole = notices.scan(words)
                starts = [begin for _, begin, _ in places]
                plain = {BASE_PHRASES[label] for label, _, _ in places}
                own = {label for label, _, _ in whole}
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(plain)), ",".join(sorted(plain | own)), 1.0 if own else 0.5 if plain else 0.0,
                    [{"label": label, "begin_word": a, "end_word": b} for label, a, b in whole]))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _pattern(template: str) -> str:
    """A template as a regular expression over words that are each followed by one blank."""
    def plain(text: str) -> str:
        return "".join(w.decode() + " " for w in words_of(text.encode()))

    out, place = "", 0
    for tag in MARKUP.finditer(template):
        out += plain(template[place:tag.start()])
        place = tag.end()
        if tag[1] == "beginOptional":
            out += "(?:"
        elif tag[1] == "endOptional":
            out += ")?"
        else:
            kinds = [f"(?:[^ ]+ ){m}" if (m := x.removeprefix(".")) != x else plain(x)
                     for x in re.search(r'match="([^"]*)"', tag[2])[1].split("|")]
            out += f"(?:{'|'.join(kinds)})"
    return out + plain(template[place:])


_OWN_SQL = ",\n    ".join(f"case when regexp_matches(t, ' {_pattern(t)}') then '{label}' end" for label, t in TEMPLATES.items())

OP1_SQL = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as t,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' and w[i + 2] = 'license') as mit,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' and w[i + 2] = 'license') as apache,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as gpl from w),
m as (select doc_id, len(w) as n_words, list_concat(mit, list_concat(apache, gpl)) as places,
  list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end,
    case when len(mit) > 0 then 'mit' end], lambda x: x is not null) as base,
  list_filter([
    {_OWN_SQL}], lambda x: x is not null) as own from p)
select doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') as labels,
  case when len(own) > 0 then 1.0 when len(base) > 0 then 0.5 else 0.0 end::double as score
from m
"""
