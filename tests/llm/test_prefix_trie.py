"""The trie against one built turn by turn, and the query against its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from trialframe.llm import prefix_trie
from trialframe.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("length", T.StringType()), T.StructField("depth", T.StringType()),
    ]
)


def slow(rows, splice=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = convs
    if splice:
        built = {}
        for c, own in convs.items():
            h, base = zlib.crc32(str(c).encode()) % 4, convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
            built[c] = base[:h] + own[h:]
    members, ends = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie(spark, rows):
    turns, convs = prefix_trie.spliced(prefix_trie.turns(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)))
    return rows_of(prefix_trie.prefix_trie(turns, convs))


def test_whole_table_and_sql(spark):
    got = QUERIES["op12_conversation_trie"](spark, SMALL)
    want = slow([tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(got) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    cur = duck.execute(ORACLE_SQL["op12_conversation_trie"])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(-1 if (v := dict(zip(names, r, strict=True))[c]) is None else v for c in got.columns) for r in cur.fetchall()) == want


def test_deep_conversations(spark):
    rng, rows = random.Random(2), []
    lengths = [*range(1, 36), 47, 48, 49, 63, 64, 65, 95, 96, 97, 128, 130, 200]
    common = [("user", f"turn number {i}") for i in range(200)]
    for c, n in enumerate(lengths):
        change = rng.randrange(n + 30)
        rows += [(c, i, r, t if i < change else f"{t} of {c % 5}") for i, (r, t) in enumerate(common[:n])]
    rows += [(100 + c, i, *common[i]) for c in range(40) for i in range(33)]
    rng.shuffle(rows)
    assert trie(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (2, 0, "user", "x y z"), (2, 0, "user", "x y z"), (2, None, None, "a b"),
        (None, 0, "user", "no conversation"), (3, 5, "user", "w " * 200_000), (-3, 1, "a", "b"), (-20, 1, "a", "c"), (-7, 1, "a", "d"), (17, 2, "", "alone"),
        (40, 0, "user", "x"), (40, 1, "bot", "y"), (41, 0, "user", "z"), (44, 0, "q", "1"), (44, 1, "q", "2"), (59, 9, "user", "\x0b\x1c é"),
    ]
    assert trie(spark, rows) == slow(rows)


def test_equal_turn_numbers_are_settled_by_content(spark):
    rows = [(c, 0, "user", t) for c in (1, 2) for t in ("b", "a", "c")]
    turns = prefix_trie.turns(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    orders = {c: [r.turn_name for r in sorted(turns.collect(), key=lambda r: r.pos) if r.conv_id == c] for c in (1, 2)}
    assert orders[1] == orders[2]


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_nothing(spark, rows):
    assert trie(spark, rows) == []


def test_only_empty_sequences(spark):
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "x") for c in alone]
    assert trie(spark, rows) == slow(rows) and slow(rows)[0][4:6] == (0, 1)
    copies = [(c, 0, "user", "x") for c in range(0, 2400, 20)]
    assert trie(spark, copies) == slow(copies)
