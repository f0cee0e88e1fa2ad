import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trialframe.llm import mixing


def targets_by_rounds(sizes):
    """The contract read literally: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, got):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, taken, longest = targets_by_rounds(size), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1


def test_odd_rows(make_docs, odd_rows):
    got = mixing.mix(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    check(odd_rows, got)


def test_whole_table(spark, small):
    got = mixing.mix(small).collect()
    check([(r.doc_id, r.text, r.lang, r.source) for r in small.collect()], got)
    again = mixing.mix(small.repartition(7, F.rand(3))).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_skewed_and_unweighted_sources(make_docs):
    rows = [(i, "w " * (1 + i % 9), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    check(rows, mixing.mix(make_docs(rows)).collect())


def test_empty_and_wordless(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.copies for r in mixing.mix(make_docs([(1, None, None, "a"), (2, "", None, None)])).collect()] == [0, 0]


def test_apply_keeps_columns_and_repeats(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumnsRenamed({"size": "_copy", "shard": "_rid", "n_chars": "copies"})
    out = mixing.apply_mix(docs)
    assert all(r._copy == "x" and r._rid == 7 for r in out.collect())
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_registered_query_against_its_sql(spark):
    import duckdb

    from trialframe.llm.queries import ORACLE_SQL, op7_systematic_mix

    out = op7_systematic_mix(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(duck.execute("SELECT doc_id, size, source_size, target, taken FROM (" + ORACLE_SQL["op7_systematic_mix"] + ")").fetchall())
    assert sorted(tuple(r) for r in out.collect()) == want
