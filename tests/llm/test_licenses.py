"""License spans against backtracking over templates, and the query against its SQL."""

import random
import re

import duckdb
import pytest

from trialframe.llm import licenses
from trialframe.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
FULL_MIT = re.sub(r"<<words 1-12>>", "John Q. Public and friends", re.sub(r"<<optional>>.*?<<end>>", "", licenses.TEMPLATES[1][1]))


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ends(tree, w, at):
    """All ends of matches of a parsed template, by trying everything."""
    found = {at}
    for item in tree:
        if isinstance(item, bytes):
            found = {i + 1 for i in found if i < len(w) and w[i] == item.decode()}
        elif isinstance(item, tuple):
            found = {i + n for i in found for n in range(item[0], item[1] + 1) if i + n <= len(w)}
        else:
            found = found | {e for i in found for e in ends(item, w, i)}
    return found


def slow(text):
    w, spans = words(text), []
    for p, label in licenses.PHRASES.items():
        p = p.split()
        spans += [(label, i, i + len(p), True) for i in range(len(w)) if w[i : i + len(p)] == p]
    for label, markup in licenses.TEMPLATES:
        tree = licenses.parse(markup)
        spans += [(label, i, max(e), False) for i in range(len(w)) if w[i] == tree[0].decode() and (e := ends(tree, w, i))]
    return len(w), sorted(spans)


TEXTS = [
    None, "", " \n", "MIT", "Released under the MIT License.", "Under the MIT license under the mit license", "xunder the mit license", "under the mit licenses",
    "Licensed under the terms of the MIT (X11) License!", "Apache License, Version 2.0", "apache license 2", "CC-BY-NC 4.0 and cc by nc", "CC BY ND", FULL_MIT,
    FULL_MIT.replace("free of charge", "at a charge"), FULL_MIT.replace("John Q. Public and friends", " ".join("x" * 13)), FULL_MIT.replace("John Q. Public and friends", ""),
    FULL_MIT.upper() + FULL_MIT, "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 2",
    "GNU General Public License either as published by version 3", "under the terms of the new BSD 3-clause license", "the é under the mit license",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution Non-Commercial license", "word " * 100_000 + "under the mit license",
]


def test_texts(make_docs):
    got = {r.doc_id: r for r in licenses.license_spans(make_docs(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        n, spans = slow(text)
        assert (got[i].n_words, [tuple(s) for s in got[i].spans]) == (n, spans), text
        assert (got[i].score == 1.0) == bool(spans) and 0 <= got[i].score <= 1
    assert got[13].score == 1 and got[14].spans == [] and 0.4 < got[14].score < 0.9 and got[16].spans == []


def test_automata_on_random_words():
    rng = random.Random(4)
    markup = "a b <<optional>>c <<optional>>d<<end>> <<words 0-2>><<end>> <<words 1-3>> a <<optional>>b<<end>> <<optional>>c<<end>>"
    tree, automaton = licenses.parse(markup), licenses.Automaton(licenses.parse(markup))
    for _ in range(3000):
        w = [rng.choice("abcdx") for _ in range(rng.randrange(14))]
        for i in range(len(w)):
            assert automaton.longest([x.encode() for x in w], i) == max(ends(tree, w, i), default=-1)
    assert licenses.stretches(tree) == [[b"a", b"b"], [b"a"]]


@pytest.mark.parametrize("markup", ["a <<optional>> b", "a <<end>>", "a <<words many>>", "<<optional>>a<<end>> b", "", "a <<what>>"])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        licenses.parse(markup)


def test_odd_rows(make_docs, odd_rows):
    got = licenses.digest(licenses.license_spans(make_docs(odd_rows))).collect()
    assert len(got) == len(odd_rows)
    assert all(r.n_base == 0 and r.first_word is None and r.last_word is None and r.base_labels == r.labels == "" and r.score == 0 for r in got)
    assert licenses.digest(licenses.license_spans(make_docs([]))).collect() == []


def test_whole_table_and_sql(spark, make_docs):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")

    def by_sql(columns):
        cur = duck.execute(ORACLE_SQL["op13_template_licenses"])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(columns)
        return sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=str)

    got = QUERIES["op13_template_licenses"](spark, SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_sql(got.columns)
    assert {"apache-2", "mit", "cc-by-nc"} & {r.base_labels for r in got.collect()}
    duck.execute("DROP VIEW documents")
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    got = licenses.digest(licenses.license_spans(make_docs(list(enumerate(TEXTS)))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_sql(got.columns)
