"""License scans by template markup compiled to token automata.

A template is wording with two kinds of regions: ``[[ ... ]]`` may be left out
and ``{{name:n}}`` stands for up to ``n`` words of any kind (``{{name:m-n}}``:
at least ``m``). Everything else is mandatory and must match word for word.
Each template becomes a deterministic automaton over words; a label is given
where the automaton reaches its end from some word of the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fields

#: Phrases that are labels by themselves (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of whole licences and of the notices that name one (fixed wording), words in lower case without punctuation.
TEMPLATES = {
    "mit": [
        "released under [[the terms of]] the mit license",
        "licensed under [[the terms of]] the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {{name:1-3}} "
        "to deal in the {{name:1-3}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{name:1-3}} "
        "and to permit persons to whom the {{name:1-3}} is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{name:1-3}} "
        "the {{name:1-3}} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{holder:2-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the {{name:1-3}} or the use or other dealings in the {{name:1-3}}",
    ],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{holder:1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{holder:1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 [[the license]]",
        "spdx license identifier apache 2 0",
    ],
    "gpl-2.0": ["gnu general public license [[as published by the free software foundation either]] version 2"],
    "gpl-3.0": ["gnu general public license [[as published by the free software foundation either]] version 3"],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[{{mark:0-1}} neither the name of {{holder:1-12}} nor the names of {{whose:1-3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "this software is provided by {{holder:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{holder:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will {{holder:1-8}} be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "cc-by-nc": ["licensed under [[a]] [[creative commons]] cc by nc"],
    "cc-by-sa": ["licensed under [[a]] [[creative commons]] cc by sa"],
    "cc-by-nd": ["licensed under [[a]] [[creative commons]] cc by nd"],
    "cc0": ["cc0 1 0 universal", "no copyright [[cc0]] public domain dedication"],
    "copyright-notice": ["copyright [[c]] {{owner:1-8}} all rights reserved"],
}

SCORE_TEMPLATE, SCORE_PHRASE = 1.0, 0.5

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:(?:(\d+)-)?(\d+)\}\}|[^\s\[\]{}]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII digits and letters, lower-cased, and bytes beyond ASCII."""
    return text.translate(_KEEP).split()


class TokenAutomaton:
    """The automaton of one template: a nondeterministic one, determinised as words arrive."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]  # word, or None for any word
        self.free: list[list[int]] = [[]]  # moves that need no word
        opened, at, runs = [], 0, [[]]
        for mark in _MARK.finditer(template):
            what = mark[0]
            if what == "[[":
                opened.append(at)
                runs.append([])
            elif what == "]]":
                self.free[opened.pop()].append(at)
                runs.append([])
            elif mark[2] is not None:
                least, most = int(mark[1] or 0), int(mark[2])
                starts = []
                for k in range(most):
                    if k >= least:
                        starts.append(at)
                    at = self._step(at, None)
                for s in starts:
                    self.free[s].append(at)
                runs.append([])
            else:
                at = self._step(at, what.encode())
                if not opened:
                    runs[-1].append(what.encode())
        self.end = at
        #: The longest run of mandatory words: a text without it can't match.
        self.core = b" " + b" ".join(max(runs, key=len)) + b" "
        self._known = frozenset(w for e in self.edges for w, _ in e if w)
        self._start = self._closed({0})
        #: Words a match can begin with; None among them stands for any.
        self.first = {w for s in self._start for w, _ in self.edges[s]}
        self._moves: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def _step(self, at: int, word: bytes | None) -> int:
        self.edges.append([])
        self.free.append([])
        self.edges[at].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def move(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self._known else None)
        if key not in self._moves:
            self._moves[key] = self._closed({t for s in state for w, t in self.edges[s] if w is None or w == key[1]})
        return self._moves[key]

    def ends(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that starts at a word, or None."""
        state, end = self._start, None
        for i in range(start, len(words)):
            state = self.move(state, words[i])
            if not state:
                break
            if self.end in state:
                end = i + 1
        return end

    def found(self, words: list[bytes], text: bytes) -> tuple[int, int] | None:
        """First match in a text; ``text`` is the words joined by single spaces, one more at each end."""
        if self.core not in text:
            return None
        for i, w in enumerate(words):
            if (None in self.first or w in self.first) and (end := self.ends(words, i)):
                return i, end
        return None


@lru_cache(maxsize=1)
def compiled() -> list[tuple[str, TokenAutomaton]]:
    return [(label, TokenAutomaton(t)) for label, templates in TEMPLATES.items() for t in templates]


def scan(text: bytes) -> dict:
    """Phrases and template labels of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base, labels, places = set(), set(), []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(sought, at + 1)
    for label, automaton in compiled():
        if label not in labels and automaton.found(words, joined):
            labels.add(label)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": joined.count(b" ", 0, min(places)) if places else None,
        "last_word": joined.count(b" ", 0, max(places)) if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": SCORE_TEMPLATE if labels else SCORE_PHRASE if base else 0.0,
    }


_SPARK, _ARROW = fields("n_words:long n_base:long first_word:long last_word:long base_labels:string labels:string score:double")


@F.arrow_udf(_SPARK)
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan(t) for block in blocks(texts) for t in block], pa.struct(_ARROW))


def license_scan(docs: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """``docs`` with a struct column of what the scan found in each whole text.

    A null or empty text has no words, no labels and score 0. Score: 1 with a
    matching template, 0.5 with a phrase alone. All columns and rows stay, in
    any multiplicity; an existing column ``into`` is replaced.
    """
    return docs.withColumn(into, _scan(F.col(text)))


def _pattern(template: str) -> str:
    """A template as a regular expression over words with a space before each."""
    out = ""
    for mark in _MARK.finditer(template):
        if mark[0] == "[[":
            out += "(?:"
        elif mark[0] == "]]":
            out += ")?"
        elif mark[2] is not None:
            out += f"(?: [^ ]+){{{int(mark[1] or 0)},{int(mark[2])}}}"
        else:
            out += f" {mark[0]}"
    return f"{out} "


def oracle_sql() -> str:
    """The same scan in SQL: phrases by position, templates by regular expressions."""
    at = lambda phrase: "(" + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + ")"
    labels = ", ".join(f"case when {' or '.join(f"regexp_matches(j, '{_pattern(t)}')" for t in templates)} then '{label}' end" for label, templates in TEMPLATES.items())
    base = ", ".join(f"case when list_bool_or(list_transform(p, lambda i: {at(phrase)})) then '{label}' end" for phrase, label in PHRASES.items())
    return f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
p as (
  select *, ' ' || array_to_string(w, ' ') || ' ' j, list_filter(range(0, len(w)), lambda i: coalesce({' or '.join(map(at, PHRASES))}, false)) p from d),
l as (select *, list_filter([{base}], lambda x: x is not null) b, list_filter([{labels}], lambda x: x is not null) m from p)
select doc_id, cast(len(w) as bigint) n_words, cast(len(p) as bigint) n_base, cast(list_min(p) as bigint) first_word, cast(list_max(p) as bigint) last_word,
  array_to_string(list_sort(list_distinct(b)), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') labels,
  case when len(m) > 0 then {SCORE_TEMPLATE}::double when len(b) > 0 then {SCORE_PHRASE}::double else 0::double end score
from l
"""
