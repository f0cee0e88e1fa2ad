"""License scans: templates with optional and replaceable regions, matched by token automata."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: The phrases of the base scan, and license wordings in template markup. <<optional>> to
#: <<end>> may be left out as a whole; <<words 1-9>> stands for that many words of any kind.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "under <<optional>>the terms of<<end>> the MIT <<optional>>(X11)<<end>> license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in
        all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<words 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, <<optional>>and/or<<end>> <<optional>>and<<end>> distribute this software for
        any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<words 1-12>> DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<words 1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<words 0-1>> Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. <<words 0-1>> Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<words 1-12>> "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<words 0-1>> Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. <<words 0-1>> Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution. <<words 0-1>> Neither the name of <<words 1-12>> nor the names of
        <<words 1-12>> may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY <<words 1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED.""",
    ),
    ("bsd-2-clause", "under <<optional>>the terms of<<end>> the <<optional>>simplified<<end>> BSD 2-clause license"),
    ("bsd-3-clause", "under <<optional>>the terms of<<end>> the <<optional>>new<<end>> BSD 3-clause license"),
    ("apache-2", "Apache License <<optional>>Version<<end>> 2"),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<words 1-4>> except in compliance
        with the License. You may obtain a copy of the License at <<words 1-9>> Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    ("gpl-2", "GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2"),
    ("gpl-3", "GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("lgpl-3", "GNU Lesser General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("cc-by-nc", "Creative Commons Attribution <<optional>>Non<<end>> Commercial <<optional>>Share Alike<<end>> <<words 0-2>> <<optional>>International<<end>> license"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial <<optional>>ShareAlike<<end>> <<words 0-2>> <<optional>>International<<end>> license"),
)
#: Words of a mandatory stretch from which it counts as evidence without a whole match, and its weight.
STRETCH, PARTLY = 4, (9, 10)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * (128 - 62)).translate(bytes.maketrans(_UPPER, _LOWER))


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased; runs of a-z, 0-9 and anything beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split()


def parse(markup: str) -> list:
    """A template as a list: words (bytes), (least, most) words of any kind, and lists that may be left out."""
    root: list = []
    stack = [root]
    for part in re.split(r"(<<.*?>>)", markup):
        tag = part[2:-2].split() if part.startswith("<<") else None
        if tag is None:
            stack[-1].extend(words_of(part))
        elif tag == ["optional"]:
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif tag == ["end"] and len(stack) > 1:
            stack.pop()
        elif tag[0] == "words" and re.fullmatch(r"\d+-\d+", tag[1]):
            low, high = map(int, tag[1].split("-"))
            stack[-1].append((low, high))
        else:
            raise ValueError(f"markup <<{' '.join(tag)}>> is not known or closes nothing")
    if len(stack) > 1:
        raise ValueError("an optional region is not closed")
    if not root or not isinstance(root[0], bytes):
        raise ValueError("a template begins with a word that it requires")
    return root


def stretches(tree: list) -> list[list[bytes]]:
    """Runs of words that every accepted text holds, in order."""
    out: list = [[]]
    for item in tree:
        if isinstance(item, bytes):
            out[-1].append(item)
        elif out[-1]:
            out.append([])
    return [run for run in out if run]


class Automaton:
    """The texts of a template, word by word: positions of its words, deterministic as far as texts lead.

    A position is a word of the template, or one of the words that a replaceable region may hold; `after`
    has the positions that may follow it. Sets of positions become numbered states when a text first
    reaches them; all words that the template does not name act alike, so there are few.
    """

    def __init__(self, tree: list):
        self.words: list[bytes | None] = []
        self.after: list[set[int]] = []
        start, ends, empty = self._add(tree)
        self.finals = ends
        self.named = {w for w in self.words if w is not None}
        self.states, self.numbers, self.moves = [frozenset(start)], {frozenset(start): 0}, [{}]
        self.accepts = [empty]

    def _position(self, word: bytes | None) -> int:
        self.words.append(word)
        self.after.append(set())
        return len(self.words) - 1

    def _add(self, tree: list) -> tuple[set[int], set[int], bool]:
        """First positions, last positions and whether nothing will do, of the items of tree in turn."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for item in tree:
            if isinstance(item, bytes):
                p = self._position(item)
                f, e, skip = {p}, {p}, False
            elif isinstance(item, tuple):
                f, e, skip = self._any(*item)
            else:
                f, e, _ = self._add(item)
                skip = True
            for p in last:
                self.after[p] |= f
            first |= f if empty else set()
            last = last | e if skip else e
            empty = empty and skip
        return first, last, empty

    def _any(self, low: int, high: int) -> tuple[set[int], set[int], bool]:
        row = [self._position(None) for _ in range(high)]
        for a, b in zip(row, row[1:], strict=False):
            self.after[a].add(b)
        return set(row[:1]), set(row[max(low - 1, 0) :]), low == 0

    def step(self, state: int, word: bytes) -> int:
        """The state after a word, -1 if there is none. A state is the set of positions that may come next."""
        word = word if word in self.named else b""
        to = self.moves[state].get(word)
        if to is None:
            hit = [p for p in self.states[state] if self.words[p] is None or self.words[p] == word]
            after = frozenset().union(*(self.after[p] for p in hit)) if hit else frozenset()
            key = (after, bool(self.finals.intersection(hit)))
            to = -1 if not hit else self.numbers.get(key, len(self.states))
            if to == len(self.states):
                self.numbers[key] = to
                self.states.append(after)
                self.moves.append({})
                self.accepts.append(key[1])
            self.moves[state][word] = to
        return to

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from `at`, or -1."""
        state, found = 0, -1
        for i in range(at, len(words)):
            state = self.step(state, words[i])
            if state < 0:
                break
            found = i + 1 if self.accepts[state] else found
        return found


class Scanner:
    """Phrases and templates, found in texts: the first mandatory stretch leads to where an automaton starts."""

    def __init__(self, phrases: dict[str, str], templates: tuple):
        self.phrases = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]
        self.templates = []
        for label, markup in templates:
            tree = parse(markup)
            runs = stretches(tree)
            long = [(b" " + b" ".join(r) + b" ", len(r)) for r in runs if len(r) >= STRETCH]
            self.templates.append((b" " + b" ".join(runs[0]) + b" ", Automaton(tree), label, long, sum(n for _, n in long)))

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, bool]], float]:
        """Number of words, spans (label, first word, word after the last, of the base scan), and score."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        spans, partly = [], 0.0
        for phrase, n, label in self.phrases:
            spans += [(label, i, i + n, True) for i in _places(line, phrase)]
        for anchor, automaton, label, long, total in self.templates:
            found = [(label, i, end, False) for i in _places(line, anchor) if (end := automaton.longest(words, i)) >= 0]
            spans += found
            if not spans and long:
                partly = max(partly, PARTLY[0] * sum(n for run, n in long if run in line) / (PARTLY[1] * total))
        return len(words), spans, 1.0 if spans else partly


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase, with blanks around it, stands in a line of words."""
    out, at, word = [], 0, 0
    while (found := line.find(phrase, at)) >= 0:
        word += line.count(b" ", at, found)
        out.append(word)
        at = found + 1
        word += 1
    return out


@cache
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), templates)


def license_spans(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, spans, score of every document: where phrases and templates stand in its whole text.

    A span is (label, start, end, base) in words from 0; of a template that accepts several ends the
    longest counts. score is 1 with a span; else nine tenths of the largest share, over the templates, of the
    words in mandatory stretches of four words or more that the text holds somewhere. Null text is
    empty, an empty text has no span; repeated rows are scanned one by one; other columns are
    ignored. Rows are scanned where they lie, nothing is shuffled, and automata have a fixed size.
    """
    key = (tuple(phrases.items()), tuple(templates))
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def rows(batches):
        scanner = _scanner(*key)
        for batch in shared.in_slices(batches):
            found = [scanner.scan(t or "") for t in batch["text"].to_pylist()]
            spans = pa.array([[dict(zip(("label", "start", "end", "base"), s, strict=True)) for s in sorted(f[1])] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.int64()), spans, pa.array([f[2] for f in found], pa.float64())], ["doc_id", "n_words", "spans", "score"])

    source = documents.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(rows, "doc_id long, n_words long, spans array<struct<label:string,start:long,end:long,base:boolean>>, score double")


def digest(spans: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of the spans of each document, labels sorted and comma-joined."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")

    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )


def _pattern(tree: list) -> str:
    """A regular expression for a template, over words that each follow a blank."""
    out = ""
    for item in tree:
        if isinstance(item, bytes):
            out += " " + item.decode()
        elif isinstance(item, tuple):
            out += "( [^ ]+){%d,%d}" % item
        else:
            out += f"({_pattern(item)})?"
    return out


def oracle_sql() -> str:
    """The digest in SQL, templates as regular expressions."""
    n, first, last = [], [], []
    for i, p in enumerate(PHRASES):
        # the text between the places of a phrase; its words are counted by the two blanks around each
        pieces, blanks = f"p{i}", "CAST((len({0}) - len(replace({0}, ' ', ''))) / 2 AS BIGINT)"
        n.append(f"len({pieces}) - 1")
        first.append(f"CASE WHEN len({pieces}) > 1 THEN {blanks.format(f'{pieces}[1]')} END")
        last.append(f"CASE WHEN len({pieces}) > 1 THEN len(w) - {len(p.split())} - {blanks.format(f'{pieces}[-1]')} END")
    split = ", ".join(f"string_split(' ' || array_to_string(w, '  ') || ' ', ' {'  '.join(p.split())} ') AS p{i}" for i, p in enumerate(PHRASES))
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    trees = [(label, parse(m)) for label, m in TEMPLATES]
    more = ", ".join(f"CASE WHEN regexp_matches(t, '{_pattern(tree)} ') THEN '{label}' END" for label, tree in trees)
    shares = []
    for _, tree in trees:
        long = [r for r in stretches(tree) if len(r) >= STRETCH]
        if long:
            held = " + ".join(f"CASE WHEN contains(t, ' {b' '.join(r).decode()} ') THEN {len(r)} ELSE 0 END" for r in long)
            shares.append(f"CAST({PARTLY[0]} * ({held}) AS DOUBLE) / {PARTLY[1] * sum(map(len, long))}")
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
        b AS (SELECT *, {split} FROM t)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({" + ".join(n)} AS BIGINT) AS n_base, least({", ".join(first)}) AS first_word, greatest({", ".join(last)}) AS last_word,
            {joined.format(base)} AS base_labels, {joined.format(base + ", " + more)} AS labels,
            CASE WHEN {joined.format(base + ", " + more)} <> '' THEN 1.0::DOUBLE ELSE greatest({", ".join(shares)}) END AS score FROM b"""
