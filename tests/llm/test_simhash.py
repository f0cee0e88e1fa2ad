import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from test_components import brute
from trialframe.llm import simhash


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, distance=4):
    prints = sorted({p for _, p in rows})
    edges = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= distance]
    root = brute(edges + [(p, p) for p in prints])
    best = {}
    for d, p in rows:
        if d is not None:
            best[root[p]] = min(best.get(root[p], d), d)
    return sorted(((d, p, best.get(root[p])) for d, p in rows), key=str)


def test_fingerprints(odd_rows, small):
    for text in [r[1] for r in odd_rows[:10]] + [r.text for r in small.limit(40).collect()] + ["a b c", "a b c d", "A b C d e"]:
        assert simhash.fingerprints(text or "")[0] == slow_fingerprint(text)


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_classes(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(bucket_rows)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains of near fingerprints
        prints.append(prints[rng.randrange(len(prints))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    rows = [(None if i % 50 == 7 else i, p) for i, p in enumerate(prints)]
    signed = [(d, int(np.uint64(p).astype(np.int64))) for d, p in rows]
    df = spark.createDataFrame(signed, "doc_id long, _fp long").withColumn("_rid", F.monotonically_increasing_id())
    got = sorted(((r.doc_id, r._fp % (1 << 64), r.component_id) for r in simhash.class_ids(df, ["_fp"]).collect()), key=str)
    assert got == slow_classes(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 500])
def test_index_alone(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.unique(base[rng.integers(0, 12, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, n).astype(np.uint64)))
    buckets = (prints >> np.uint64(60)).astype(np.int64)
    index = simhash.GrayIndex(buckets, prints, 4)
    label = index.classes()
    got = {int(p): int(index.prints[x]) for p, x in zip(index.prints, label, strict=True)}
    p = [int(x) for x in prints]
    want = brute([(a, b) for i, a in enumerate(p) for b in p[:i] if (a ^ b).bit_count() <= 4 and a >> 60 == b >> 60] + [(a, a) for a in p])
    assert sorted(sorted(k for k in got if got[k] == v) for v in set(got.values())) == sorted(sorted(k for k in want if want[k] == v) for v in set(want.values()))


def test_documents(spark, make_docs, odd_rows, small):
    texts = [(500 + r.doc_id, r.text) for r in small.limit(60).collect()]
    rows = odd_rows + texts + [(900 + d, t + " x") for d, t in texts[:20]]
    got = simhash.near_duplicate_classes(make_docs(rows))
    got = sorted(((r.doc_id, r._fp % (1 << 64), r.component_id) for r in got.collect()), key=str)
    assert got == slow_classes([(d, slow_fingerprint(t)) for d, t, *_ in rows])


def plain_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_keep_one(spark, make_docs, odd_rows):
    rng = random.Random(5)
    rows, copies = list(odd_rows), set()
    for i in range(40):
        words = plain_words(rng, 150)
        rows.append((1000 + i, " ".join(words)))
        for k in (1, 2):  # one changed word: similarity above 0.93
            changed = list(words)
            changed[rng.randrange(150)] = "other"
            rows.append((2000 + 10 * i + k, " ".join(changed)))
            copies.add(2000 + 10 * i + k)
        for k in range(75):  # half of the words changed: similarity far below 0.8
            words[2 * k] = f"x{k}"
        rows.append((3000 + i, " ".join(words)))
    docs = make_docs(rows)
    clashing = {"size": "_print0", "shard": "_rid", "lang": "_bucket", "source": "_node"}
    docs = docs.withColumnsRenamed(clashing)
    kept = simhash.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1000 + i for i in range(40)} | {3000 + i for i in range(40)} <= set(ids)
    assert len(copies & set(ids)) <= 0.05 * len(copies)
    assert {None, 1, 3, 5, 7, 8} <= set(ids) and not {2, 4, 6} & set(ids)
    assert all(r._print0 == "x" and r._rid == 7 for r in kept.collect())
    assert simhash.keep_one_of_each_class(make_docs([])).count() == 0


def test_links_of_several_fingerprints(spark):
    """Every pair that differs little in one family, and in the checks of it, and no other."""
    rng = random.Random(9)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    rows = [[rng.getrandbits(64) for _ in range(3)] for _ in range(30)]
    rows += [[flip(p, rng.randint(0, 12)) for p in rows[rng.randrange(30)]] for _ in range(200)]
    rows = [tuple(r) for r in {tuple(r) for r in rows}]
    near = lambda a, b: any((a[j] ^ b[j]).bit_count() <= 5 and sum((a[(j + k) % 3] ^ b[(j + k) % 3]).bit_count() for k in (1, 2)) <= 12 for j in range(3))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if near(rows[i], rows[j])]
    assert edges
    signed = [(i, *(int(np.uint64(p).astype(np.int64)) for p in r)) for i, r in enumerate(rows)]
    got = simhash.linked_classes(spark.createDataFrame(signed, "_node long, a long, b long, c long"), ["a", "b", "c"], 5, 2, 12)
    root = brute(edges)
    assert {r.node: r.component for r in got.collect()} == root


def test_registered_query(spark, small):
    from trialframe.llm.queries import op9_gray_simhash

    out = op9_gray_simhash(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    want = slow_classes([(r.doc_id, slow_fingerprint(r.text)) for r in small.collect()])
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out.collect()), key=str) == want
    assert all(len(r.fingerprint) == 16 for r in out.collect())
