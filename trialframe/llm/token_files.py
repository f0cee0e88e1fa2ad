"""Token-id shards compressed by Re-Pair grammars, with random access to each document."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, small_batches, vocabulary_size

#: Ids in a shard before it is closed, and UTF-8 bytes of text for one file of shards.
SHARD_IDS, FILE_TEXT_BYTES = 400_000, 12_000_000
#: The least count of a replaced pair: a rule takes 12 bytes of a shard and each use of it saves 3.
LEAST = 5
_MAGIC = b"RPG1"
#: partition, ids before the shard in its partition, documents, ids, symbols, rules, first nonterminal
_HEADER = struct.Struct("<4sqqqqqqq")
_BUCKET_BITS = 18
#: Shards in a file at most, so that a file stays readable however texts are dealt out.
FILE_SHARDS = 64


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of symbols."""
    return (left * np.uint32(2654435761) + right * np.uint32(2246822519)) >> np.uint32(32 - _BUCKET_BITS)


def _uses(at: np.ndarray, key: np.ndarray, bucket: np.ndarray, kinds: np.ndarray, least: int):
    """Places to replace, the kind at each, and the kinds: of kinds in one bucket one, of overlapping
    places in a run every second one, from the left; kinds that then have fewer than `least` places
    are left out (a later round comes back to them)."""
    table = np.full(1 << _BUCKET_BITS, -1, np.int32)
    table[_bucket((kinds >> np.uint64(32)).astype(np.uint32), kinds.astype(np.uint32))] = np.arange(len(kinds), dtype=np.int32)
    rank = table.take(bucket)
    some = np.flatnonzero(rank >= 0)
    some = some[kinds.take(rank[some]) == key[some]]
    at, rank = at[some], rank[some]
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    keep = (np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0
    at, rank = at[keep], rank[keep]
    used = np.bincount(rank, minlength=len(kinds)) >= least
    keep = used[rank]
    return at[keep], (np.cumsum(used) - 1)[rank[keep]], kinds[used]


def _frequent(key: np.ndarray, bucket: np.ndarray, bar: int) -> np.ndarray:
    """Pairs whose count reaches the bar: where there are many, the last pair of each bucket is counted
    first, and all pairs only if none of those reaches it."""
    if len(key) > 1 << 14:
        last = np.zeros(1 << _BUCKET_BITS, np.uint64)
        last[bucket] = key
        n = np.bincount(bucket[last.take(bucket) == key], minlength=1 << _BUCKET_BITS)
        if len(slots := np.flatnonzero(n >= bar)):
            return last[slots]
    kinds, n = np.unique(key, return_counts=True)
    return kinds[n >= bar]


def _apart(kinds: np.ndarray) -> np.ndarray:
    """Some of the kinds, none of which begins with a symbol that one ends with, so that none overlap."""
    left, right = kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)
    for bit in range(64):
        side = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63 - bit)) & np.uint64(1)  # noqa: E731, B023
        some = kinds[(side(left) == 0) & (side(right) == 1)]
        if len(some):
            return some
    return kinds[left != right][:1]


def build_grammar(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST):
    """Re-Pair: (symbols, positions of document ends, rules as left and right).

    Pairs inside documents are replaced by new nonterminals, frequent ones first: a round replaces
    all pairs whose count reaches a bar, the bar falls to a third from round to round, and rounds go on
    until no pair is left that can be replaced `least` times. Where overlaps keep every pair of a
    round below that, pairs that cannot overlap go first. ids >= first must not occur.
    """
    seq, end = ids.astype(np.uint32), np.zeros(len(ids), bool)
    end[ends] = True
    rules: list = []
    made, bar, new = 0, len(ids), 0
    while len(seq) > 1:
        if new:  # pairs that the last round made, all of which show one of its nonterminals
            fresh = seq >= new
            at = np.flatnonzero((fresh[:-1] | fresh[1:]) & ~end[:-1])
            bucket = _bucket(seq[at], seq[at + 1])
        else:
            bucket = _bucket(seq[:-1], seq[1:])
            bucket[end[:-1]] = 1 << _BUCKET_BITS  # no pair goes across the end of a document
            count = np.bincount(bucket, minlength=(1 << _BUCKET_BITS) + 1)
            count[-1] = 0
            bar = max(least, min(bar, int(count.max()) // 2) // 3)
            at = np.flatnonzero((count >= bar).take(bucket))
            bucket = bucket[at]
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        every = kinds = _frequent(key, bucket, bar)
        if len(every):
            spots, rank, kinds = _uses(at, key, bucket, every, least)
            if not len(kinds) and len(some := _apart(every)):
                spots, rank, kinds = _uses(at, key, bucket, some, least)
        if not len(kinds):
            if bar == least and not new:
                break
            new = 0
            continue
        new = first + made if bar == least else 0
        seq[spots] = first + made + rank
        rules.append(kinds)
        made += len(kinds)
        end[spots] = end[spots + 1]
        stay = np.ones(len(seq), bool)
        stay[spots + 1] = False
        seq, end = seq[stay], end[stay]
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return seq, np.flatnonzero(end), np.array([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], np.uint32).reshape(2, -1)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    sizes: list = []
    for a, b in rules.T.tolist():
        sizes.append((sizes[a - first] if a >= first else 1) + (sizes[b - first] if b >= first else 1))
    return np.array(sizes, np.uint32)


def expansions(rules: np.ndarray, first: int):
    """Expansion lengths of the rules, and all expansions in one array."""
    texts: list = []
    for a, b in rules.T.tolist():
        texts.append((texts[a - first] if a >= first else [a]) + (texts[b - first] if b >= first else [b]))
    return np.array([len(t) for t in texts], np.uint32), np.array([x for t in texts for x in t], np.uint32)


def decode(symbols: np.ndarray, lengths: np.ndarray, expanded: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    size[rule] = lengths[symbols[rule] - first]
    source = np.cumsum(lengths, dtype=np.int64) - lengths
    place = np.cumsum(size) - size
    out = np.repeat(symbols, size)
    wide = np.flatnonzero(rule)
    if len(wide):
        n = size[wide]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(place[wide], n) + inner] = expanded[np.repeat(source[symbols[wide] - first], n) + inner]
    return out


def pack_shard(doc_ids: list, id_bytes: list[bytes], partition: int, before: int, first: int) -> bytes:
    """One shard: header, documents (id, symbols, ids), rules, expansion lengths, symbols of 24 bits."""
    counts = np.array([len(x) // 4 for x in id_bytes], np.int64)
    ids = np.frombuffer(b"".join(id_bytes), "<u4")
    symbols, ends, rules = build_grammar(ids, np.cumsum(counts) - 1, first)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    lengths = expansion_lengths(rules, first)
    parts = [
        _HEADER.pack(_MAGIC, partition, before, len(doc_ids), len(ids), len(symbols), rules.shape[1], first),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), known.tobytes(),
        (ends + 1).astype("<i8").tobytes(), counts.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        symbols.astype("<u2").tobytes(), (symbols >> 16).astype(np.uint8).tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """A shard in a buffer; documents can be decoded one by one."""

    def __init__(self, data: memoryview, at: int):
        magic, self.partition, self.before, docs, self.n_ids, symbols, rules, self.first = _HEADER.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError(f"no shard at byte {at}")
        at += _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.ends, self.counts = take("<i8", docs), take("<i8", docs)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(2, -1), take("<u4", rules)
        low, high = take("<u2", symbols), take("u1", symbols)
        self.symbols = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
        self.expanded = expansions(self.rules, self.first)[1]
        self.stop = at

    def document(self, k: int) -> np.ndarray:
        """Ids of document k, from its own symbols alone."""
        return decode(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]], self.lengths, self.expanded, self.first)

    def documents(self):
        """Ids of all documents in order."""
        return np.split(decode(self.symbols, self.lengths, self.expanded, self.first), np.cumsum(self.counts)[:-1])


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode all texts, append end_id to each, and write shard files in ascending doc_id order.

    Documents are range-sorted by doc_id (nulls first), rows of one doc_id by a hash of their text, so
    that they too spread over ranges; a task encodes its range and closes a shard every SHARD_IDS ids,
    so memory does not depend on the table. Nonterminals begin above the ids of the tokenizer file. A
    null text counts as empty and becomes the end id alone; an empty table writes no shards; other
    columns are not read.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // FILE_TEXT_BYTES))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "hash", "tie"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    tail, vocabulary = np.array([end_id], "<u4").tobytes(), vocabulary_size(tokenizer, end_id)

    def shards(batches):
        encode, partition = encoder(tokenizer).encode, TaskContext.get().partitionId()
        docs: list = []
        ids: list = []
        held = before = 0
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for i, j in small_batches(texts):
                for name, x in zip(names[i:j], encode(texts[i:j]), strict=True):
                    docs.append(name)
                    ids.append(x + tail)
                    held += len(x) // 4 + 1
                    if held >= SHARD_IDS:
                        yield pa.RecordBatch.from_pydict({"bytes": pa.array([pack_shard(docs, ids, partition, before, vocabulary)], pa.binary())})
                        before, held, docs, ids = before + held, 0, [], []
        if docs:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([pack_shard(docs, ids, partition, before, vocabulary)], pa.binary())})

    shared.write_files(rows.mapInArrow(shards, "bytes binary"), path, FILE_SHARDS)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (start: ids of all before it)."""

    def documents(batches):
        for batch in batches:
            for content in batch["content"]:
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    shard = Shard(data, at)
                    at = shard.stop + len(shared.FILE_END)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.doc_ids, pa.int64()),
                            "_pid": pa.array([shard.partition] * len(shard.counts), pa.int32()),
                            "rel": pa.array(shard.before + np.cumsum(shard.counts) - shard.counts),
                            "n_tokens": pa.array(shard.counts),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in shard.documents()], pa.int64()),
                        }
                    )

    read = shared.read_files(spark, path).select("content").mapInArrow(documents, "doc_id long, _pid int, rel long, n_tokens long, ids_crc32 long")
    read = shared.materialize(read, "token-docs")
    base = shared.running_base(read.groupBy("_pid").agg(F.sum("n_tokens").alias("n")), "n", "base").select("_pid", "base")
    return read.join(F.broadcast(base), "_pid").select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")
