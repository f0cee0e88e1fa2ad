import base64
import hashlib

import pytest
import zstandard

from trialframe.llm import shared, warc
from trialframe.llm.shared import fresh_path, read_files

SCHEMA = "page_id long, url string, html string, payload string, key int"
ROWS = [
    (5, "http://a/x y\n", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://a/3", "<p>same</p>"),
    (1, "http://a/é", None), (2, "http://b", ""), (7, "http://c", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "http://d", "größe " * 300_000),
    (10, "u", "twice"), (10, "u", "twice"), (None, "u", "lonely"), (None, "u", "lonely"),
]


def expected(rows, least=0):
    out, seen = [], set()
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and (first != page or data in seen)
        if first == page:
            seen.add(data)  # of repeated rows one is the response
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def digest_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    path = fresh_path(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    warc.write_archives(pages, path, least)
    back = warc.read_archives(spark, path)
    assert digest_rows(back) == expected(ROWS, least)
    for r in back.collect():
        if r.record_type == "response":
            assert any(r.page_id == p and bytes(r.payload) == (h or "").encode() for p, _, h in ROWS)


def test_whole_table_and_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = fresh_path(spark, "test-warc")
    warc.write_archives(pages.union(pages.limit(9)), path)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(r.page_id, r.url, r.html) for r in pages.limit(9).collect()]
    assert digest_rows(warc.read_archives(spark, path, with_payload=False)) == expected(rows)
    content = bytes(read_files(spark, path).first().content)
    assert content[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    known = zstandard.ZstdCompressionDict(content[8 : 8 + int.from_bytes(content[4:8], "little")])
    start = 8 + int.from_bytes(content[4:8], "little")
    first = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(content[start:])
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and first.count(b"WARC-Type") == 1


@pytest.mark.parametrize("rows", [[(i, "u", f"<p>{i}</p>" + "long page " * 7000 + str(i)) for i in range(40)], [(1, "u", "x")], [(1, None, None)]])
def test_dictionary_of_long_few_and_empty_pages(spark, rows):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), path)
    back = warc.read_archives(spark, path)
    assert digest_rows(back) == expected(rows)
    content = bytes(read_files(spark, path).first().content)
    size = int.from_bytes(content[4:8], "little")
    assert content[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and content[8:12] == bytes.fromhex("37a430ec") and size > 100


def test_registered_query(spark):
    from trialframe.llm.queries import op1_warc_dictionary

    out = op1_warc_dictionary(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert digest_rows(out) == expected(rows)


def test_empty(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("copies", [1, 10_000])
def test_repeated_rows_leave_a_dictionary(spark, tmp_path, copies):
    one = "<html><body>" + " ".join(f"word{i}" for i in range(300)) + "</body></html>"
    pages = spark.createDataFrame([(1, "u", one)], "page_id long, url string, html string").selectExpr("*", f"explode(sequence(1, {copies})) x").drop("x")
    assert len(warc.sample_records(pages)) == 1
    path = f"file://{tmp_path}/out"
    warc.write_archives(pages, path)
    archives = [bytes(r.content) for r in shared.read_files(spark, path).collect()]
    assert archives and all(a[:4] == b"\x5d\x2a\x4d\x18" or (a[0] & 0xF0 == 0x50 and a[1:4] == b"\x2a\x4d\x18") for a in archives)
    assert warc.read_archives(spark, path, with_payload=False).count() == copies
