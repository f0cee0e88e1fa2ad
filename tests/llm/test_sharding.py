import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from trialframe.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n, 3)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 10 or got != sorted(got)


def test_documents(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i}", "en", "a") for i in range(60)]
    got = sharding.document_shards(make_docs(rows), 24).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], size(r[1]) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.get(k, 0) for k in range(24)) <= 1
    for k in shards:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(shards[k]))


def test_reruns_and_partitioning_agree(spark, small):
    one = sharding.document_shards(small, 24).orderBy("doc_id").collect()
    two = sharding.document_shards(small.repartition(5, F.rand(1)), 24).orderBy("doc_id").collect()
    assert one == two


def test_empty(make_docs):
    assert sharding.document_shards(make_docs([]), 24).count() == 0


def test_write(spark, small, tmp_path):
    sharding.write_shards(small, sharding.document_shards(small, 4), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == small.count()


def slow_place(x, n, seed=42):
    """The permutation in plain integers: a Feistel network over a mixed-radix pair, walked until it falls inside."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def h(value, key):
        one = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
        two = xxhash.xxh64_intdigest(struct.pack("<q", key), one)
        return two - (1 << 64) if two >> 63 else two

    def network(v):
        for key in range(seed * 1000003, seed * 1000003 + sharding.HALF_ROUNDS):
            left, right = divmod(v, b)
            if key % 2 == 0:
                left = (left + h(right, key) % a) % a
            else:
                right = (right + h(left, key) % b) % b
            v = left * b + right
        return v

    x = network(x)
    while x >= n:
        x = network(x)
    return x


def test_registered_query_against_a_plain_version(spark, small):
    from trialframe.llm.queries import op3_feistel_shards

    out = op3_feistel_shards(spark, "/root/testdata/sf0.001")
    kinds = ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    assert out.dtypes == list(zip(("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"), kinds, strict=True))
    texts = [(r.doc_id, (r.text or "").encode()) for r in small.collect()]
    rows = sorted((d, zlib.crc32(t), len(t) + 8) for d, t in texts)
    want = {}
    for i, (d, crc, size) in enumerate(rows):
        place = slow_place(i, len(rows))
        want[d] = (size, crc, "rows", place % 24, place // 24, None)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
