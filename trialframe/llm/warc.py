"""WARC archives compressed with Zstandard and a shared dictionary."""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Compressed bytes of one archive, and of the text handed to Spark's writer at once.
ARCHIVE_BYTES, ROW_BYTES = 24_000_000, 1_000_000
#: The dictionary: bytes, records it is trained on (about so many, by a hash, never over twice), and bytes
#: of each of them (of a longer payload a slice from a place that the hash gives).
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_RECORD_BYTES = 65_536, 400, 65_536
#: Fixed values of the formats: magic numbers of the dictionary frame and of a frame to skip, headers.
DICTIONARY_MAGIC, SKIP_MAGIC = 0x184D2A5D, 0x184D2A50
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
_DATE = b"2024-01-01T00:00:00Z"
#: A one-byte frame whose byte is the line feed that the sink adds.
_ROW_END = struct.pack("<II", SKIP_MAGIC, len(shared.FILE_END))


def _urn(page) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page is None else b"%d" % page)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def format_record(page, url, size: int, digest: str, payload: bytes | None, refers_to=None) -> bytes:
    """A WARC record: a response, or, without payload, a revisit that keeps only the HTTP header."""
    revisit = payload is None
    block = _HTTP % size + (payload or b"")
    head = [b"WARC/1.1\r\nWARC-Type: ", b"revisit" if revisit else b"response", b"\r\nWARC-Record-ID: ", _urn(page), b"\r\nWARC-Date: ", _DATE, b"\r\n"]
    if url is not None:
        head += [b"WARC-Target-URI: ", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()), b"\r\n"]
    if revisit:
        head += [b"WARC-Refers-To: ", _urn(refers_to), b"\r\n", _PROFILE]
    head += [b"WARC-Payload-Digest: sha1:", digest.encode(), b"\r\n"]
    head += [b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"]
    return b"".join(head)


def _number(urn: bytes):
    name = urn[len(b"<urn:page:") : -1]
    return None if name == b"null" else int(name)


def parse_records(read):
    """Records of a decompressed archive: (page, url, payload or None, bytes, digest, type, refers_to).

    read(n) gives up to n bytes. A response's length and digest are computed from its payload and
    checked; a revisit's come from its headers.
    """
    held = b""
    while True:
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not (more := read(1 << 18)):
                if held:
                    raise ValueError("an archive ends inside a record")
                return
            held += more
        head = dict(line.split(b": ", 1) for line in held[:stop].split(b"\r\n")[1:])
        end = stop + 4 + int(head[b"Content-Length"]) + 4
        parts, have = [held], len(held)
        while have < end:
            if not (more := read(max(1 << 18, end - have))):
                raise ValueError("an archive ends inside a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        block, held = held[stop + 4 : end - 4], held[end:]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError("a payload does not match its header")
        url = head.get(b"WARC-Target-URI")
        refers = head.get(b"WARC-Refers-To")
        yield (_number(head[b"WARC-Record-ID"]), None if url is None else url.decode(), payload if kind == "response" else None, size, digest, kind, None if refers is None else _number(refers))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the sample records; of few records, a small one from their pieces."""
    import zstandard

    pieces = [s[i : i + 256] for s in samples for i in range(0, len(s), 256)]
    pieces *= -(-1024 // max(1, len(pieces)))
    for most, data in ((size, samples), (size // 4, pieces), (2048, pieces), (512, pieces)):
        try:
            return zstandard.train_dictionary(most, data, k=512 if most == size else 64, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


def sample_records(pages: DataFrame) -> list[bytes]:
    """Records of about SAMPLE_RECORDS pages, distinct in page and payload, in a fixed order; at least one of a table with rows."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    spare = F.greatest(F.octet_length("payload") - SAMPLE_RECORD_BYTES, F.lit(0))
    place = (F.pmod(F.col("_draw"), (spare + 1).cast("long")) + 1).cast("int")
    cut = F.substring(F.col("payload"), place, F.lit(SAMPLE_RECORD_BYTES)).alias("payload")
    rows = shared.distinct_sample(rows, ["page_id", "url", "payload"], SAMPLE_RECORDS, keep=["page_id", "url", cut])
    found = sorted(rows.collect(), key=lambda r: (r._draw, bytes(r.payload)))
    return [format_record(r.page_id, r.url, len(r.payload), payload_digest(bytes(r.payload)), bytes(r.payload)) for r in found]


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page (page_id, url, html) to .warc.zst archives below path.

    Payloads are html in UTF-8 (null: empty). Of records with equal payloads of least_bytes or more,
    one with the smallest page_id becomes the response, the others revisits of it; a null page_id
    counts as larger than all, and records whose copies all lack an id are responses. Each page is
    first compressed where it is read, as a response; only these small frames are written, numbered
    and moved. Equal payloads are found on narrow rows of digest, page_id and number; the smallest
    one is combined before the shuffle, the join with it may split a hot payload, and the frames are
    then dealt by their numbers, so no archive holds a whole group of copies. Each archive starts
    with the dictionary in a skippable frame; each record is a frame of its own. An empty table
    writes no records; other columns are not read.
    """
    import zstandard

    dictionary = train_dictionary(sample_records(pages))

    def compressor():
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(level=3, dict_data=known).compress

    def responses(batches):
        compress = compressor()
        for batch in shared.in_slices(batches, 200):
            payloads = [x.as_py() for x in batch["payload"]]
            digests, frames = [payload_digest(x) for x in payloads], []
            for page, url, digest, payload in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), digests, payloads, strict=True):
                frames.append(compress(format_record(page, url, len(payload), digest, payload)))
            sizes = pa.array([len(x) for x in payloads], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], sizes, pa.array(digests), pa.array(frames, pa.binary())], ["page_id", "url", "size", "digest", "frame"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    framed = rows.mapInArrow(responses, "page_id long, url string, size long, digest string, frame binary")
    framed = shared.materialize(framed.withColumn("number", F.monotonically_increasing_id()), "warc-frames")
    total = framed.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).first()[0]
    archives = max(1, -(-total // ARCHIVE_BYTES))
    alike = framed.where(F.col("size") >= least_bytes).select("digest", "page_id", "number")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "number"))
    copies = alike.groupBy("digest").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and not least.none")
    revisits = alike.join(copies, "digest").where("number <> least.number").select("number", F.col("least.page_id").alias("refers_to"))

    def archive(batches):
        compress = compressor()
        held, size = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary] if dictionary else [], 0
        for batch in batches:
            for page, url, n, digest, frame, refers_to in zip(*(batch[k].to_pylist() for k in ("page_id", "url", "size", "digest", "frame", "refers_to")), strict=True):
                held.append(frame if refers_to is None else compress(format_record(page, url, n, digest, None, refers_to)))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_pydict({"bytes": pa.array([b"".join([*held, _ROW_END])], pa.binary())})
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b"".join([*held, _ROW_END])], pa.binary())})

    dealt = framed.repartition(archives, "number").join(revisits.repartition(archives, "number"), "number", "left")
    shared.write_files(dealt.select("page_id", "url", "size", "digest", "frame", "refers_to").mapInArrow(archive, "bytes binary"), path)
    shared.discard(framed)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives below path: page_id, url, payload (null for revisits or if not asked
    for), payload_bytes, payload_digest, record_type, refers_to. Archives are decompressed as streams."""

    def records(batches):
        import zstandard

        for batch in batches:
            for content in batch["content"]:
                data = memoryview(content.as_buffer())
                magic, size = struct.unpack_from("<II", data)
                known = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])) if magic == DICTIONARY_MAGIC else None
                reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True)
                rows: list = []
                held = 0
                for row in parse_records(reader.read):
                    rows.append(row if with_payload else (*row[:2], None, *row[3:]))
                    held += 200 + len(rows[-1][2] or b"")
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return shared.read_files(spark, path).select("content").mapInArrow(records, schema)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])
