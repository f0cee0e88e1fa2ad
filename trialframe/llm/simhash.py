"""SimHash near-duplicates: fingerprints, and their classes by a Gray-order hierarchical index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components, merge_labels

WORDS, SEED, DISTANCE = 4, 42, 4
#: Near copies for a corpus: words of a shingle, least similarity, fingerprints of a document, differing
#: bits of one of them at most, and other fingerprints that must agree as such a similarity makes them.
COPY_WORDS, COPY_SIMILARITY, COPY_PRINTS, COPY_DISTANCE, COPY_CHECKS = 5, 0.8, 6, 5, 2
#: Bits of a fingerprint, and rows of a bucket beyond which it is split by further segments.
BITS, BUCKET_ROWS = 64, 20_000
#: Pairs of index nodes that a task holds at once, and parts that a class is dealt into.
FRONT, SALTS = 400_000, 16


def _shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included.

    A-Z are lower-cased; words are runs of bytes other than space and \\x09-\\x0D; fewer words than a
    shingle count as one shingle, none give none.
    """
    from xxhash import xxh64_intdigest as h

    parts = text.encode().lower().split()
    if len(parts) <= words:
        return np.array([h(b" ".join(parts), seed)] if parts else [], "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[s:e], seed) for s, e in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes made from the first (k = 0: as they are)."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: str, words: int = WORDS, seed: int = SEED, prints: int = 1) -> list[int]:
    """SimHashes of one whole text, unsigned: bit b is set if it is set in over half of its shingles'
    hashes, XXH64 for the first fingerprint and mixtures of it for the others. No word: zeros."""
    hashes = _shingle_hashes(text, words, seed)
    return [_majority(_mixed(hashes, k)) for k in range(prints)]


def with_fingerprints(documents: DataFrame, out: list[str], words: int = WORDS, seed: int = SEED) -> DataFrame:
    """documents with as many fingerprints of text as `out` has names, as signed longs (null text: no words)."""
    columns = documents.columns

    def rows(batches):
        for batch in shared.in_slices(batches):
            found = np.array([fingerprints(t or "", words, seed, len(out)) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x.view(np.int64)) for x in np.ascontiguousarray(found.T)]], [*columns, *out])

    return documents.mapInArrow(rows, T.StructType([*documents.schema.fields, *[T.StructField(c, T.LongType()) for c in out]]))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence, where neighbours differ in one bit."""
    x = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _segments(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    edges = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _bits(segment: tuple[int, int]) -> Column:
    lo, hi = segment
    return F.shiftrightunsigned("_fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _buckets(rows: DataFrame, distance: int) -> DataFrame:
    """rows (_family, _fp, ...) with _bucket: two fingerprints of a family within the distance share one at least.

    Cut into distance + 1 segments, they agree in one, so a bucket is a segment and its value. A
    bucket of more than BUCKET_ROWS is cut again over the other bits, of which one segment agrees too.
    """
    columns = rows.columns
    outer = _segments(0, BITS, distance + 1)
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), _bits(s).alias("val")) for i, s in enumerate(outer)])
    rows = rows.select(*columns, F.explode(keys).alias("k")).select(*columns, "k.seg", "k.val")
    large = rows.groupBy("_family", "seg", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS)
    rows = rows.join(large.select("_family", "seg", "val", F.lit(True).alias("large")), ["_family", "seg", "val"], "left")
    inner = F.lit(None)
    for i, (lo, hi) in enumerate(outer):
        # the bits outside segment i, rotated to the bottom
        rest = F.shiftrightunsigned("_fp", hi) if hi < BITS else F.lit(0).cast("long")
        rest = F.shiftleft(rest, lo).bitwiseOR(F.col("_fp").bitwiseAND(F.lit((1 << lo) - 1)))
        parts = [F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in _segments(0, BITS - (hi - lo), distance + 1)]
        inner = F.when(F.col("seg") == i, F.array(*[F.xxhash64("_family", "seg", "val", F.lit(j), p) for j, p in enumerate(parts)])).otherwise(inner)
    return rows.select(*columns, F.explode(F.when(F.col("large"), inner).otherwise(F.array(F.xxhash64("_family", "seg", "val")))).alias("_bucket"))


class GrayIndex:
    """A hierarchy over fingerprints sorted by bucket and Gray rank.

    A node of level l covers 2**l neighbouring rows and holds the bits that all of them share, as the
    AND and OR of the rows. Two nodes differ at least in the shared bits of both that disagree; the
    search goes down from the root and drops a pair of nodes as soon as that count exceeds the
    distance, their buckets do not meet, or all their rows are known to be in one class. Where rows
    have further fingerprints (`others`, one array each), a link also needs that these differ in no
    more than `most` bits together.
    """

    def __init__(self, buckets: np.ndarray, prints: np.ndarray, distance: int, others: list = (), most: int = 0):
        self.order = order = np.lexsort((gray_rank(prints), buckets))
        self.prints, self.distance, self.label = prints[order], distance, np.arange(len(prints))
        self.others, self.most = [x[order] for x in others], most
        self.levels = [(self.prints, self.prints, buckets[order], buckets[order])]
        while len(self.levels[-1][0]) > 1:
            ops = (np.bitwise_and, np.bitwise_or, np.minimum, np.maximum)
            self.levels.append(tuple(self._pair(f, x) for f, x in zip(ops, self.levels[-1], strict=True)))

    @staticmethod
    def _pair(f, x: np.ndarray) -> np.ndarray:
        up = f(x[0 : len(x) - 1 : 2], x[1::2])
        return np.append(up, x[-1]) if len(x) % 2 else up

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        merge_labels(self.label, a, b)
        low, high = [self.label], [self.label]
        for _ in self.levels[1:]:
            low.append(self._pair(np.minimum, low[-1]))
            high.append(self._pair(np.maximum, high[-1]))
        self.low, self.high = low, high

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the further fingerprints of two rows allow a link."""
        return sum((np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in self.others), np.zeros(len(a), np.int64)) <= self.most

    def _open(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a link between different classes may lie between nodes i and j."""
        both, any_, first, last = self.levels[level]
        shared_bits = ~((both[i] ^ any_[i]) | (both[j] ^ any_[j]))
        near = np.bitwise_count((both[i] ^ both[j]) & shared_bits) <= self.distance
        one = (self.low[level][i] == self.high[level][j]) & (self.high[level][i] == self.low[level][j]) & (self.low[level][i] == self.low[level][j])
        return near & (first[j] <= last[i]) & (first[i] <= last[j]) & ~one

    def classes(self) -> np.ndarray:
        """A label for each row, in sorted order; rows with one label are linked, maybe over others."""
        n = len(self.prints)
        rows = np.arange(n)
        self._union(rows[:0], rows[:0])
        bucket = self.levels[0][2]
        for step in (1, 2, 3):  # near copies mostly stand side by side in Gray order
            a, b = rows[:-step], rows[step:]
            link = (bucket[a] == bucket[b]) & (np.bitwise_count(self.prints[a] ^ self.prints[b]) <= self.distance)
            a, b = a[link], b[link]
            link = self._agree(a, b)
            self._union(a[link], b[link])
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)] if n > 1 else []
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONT:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            keep = self._open(level, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not level:
                link = self._agree(i, j)  # at a leaf the bound is the distance itself
                self._union(i[link], j[link])
                continue
            size = len(self.levels[level - 1][0])
            i, j = np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j))
            there = (i <= j) & (j < size) & (i < size) & ((level > 1) | (i < j))
            stack.append((level - 1, i[there], j[there]))
        return self.label


def linked_classes(nodes: DataFrame, prints: list[str], distance: int = DISTANCE, checks: int = 0, most: int = 0) -> DataFrame:
    """(node, component) of all nodes (column _node, distinct) that have a link.

    Two nodes are linked if they differ in `distance` bits or fewer in one of the columns `prints`
    and, with `checks`, in at most `most` bits of the next so many columns together (in a ring).
    """
    names = [f"_other{k}" for k in range(checks)]
    rings = [[prints[(j + k) % len(prints)] for k in range(checks + 1)] for j in range(len(prints))]
    families = [F.struct(F.lit(j).alias("_family"), *[F.col(c).alias(n) for c, n in zip(ring, ["_fp", *names], strict=True)]) for j, ring in enumerate(rings)]
    rows = nodes.select("_node", F.explode(F.array(*families)).alias("f")).select("_node", "f.*")

    def link(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        unsigned = lambda c: table[c].to_numpy().view(np.uint64)
        index = GrayIndex(table["_bucket"].to_numpy(), unsigned("_fp"), distance, [unsigned(c) for c in names], most)
        label, node = index.classes(), table["_node"].to_numpy()[index.order]
        own = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["a", "b"])

    size = nodes.count() * len(prints) * (distance + 1)
    dealt = _buckets(rows, distance).select("_node", "_fp", *names, "_bucket").repartition(max(1, -(-size // 200_000)), "_bucket")
    edges = shared.materialize(dealt.mapInArrow(link, "a long, b long").distinct(), "simhash-edges")
    return components(edges, "simhash-classes")


def near_duplicate_classes(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, `_fp` (fingerprint as a signed long) and `component_id` (smallest doc_id of the class) of every row.

    Equal fingerprints are one node, so a group of copies of any size costs one row; only links
    between different fingerprints are searched. A null, empty or blank text has fingerprint zero and
    is linked like any other. Repeated rows and null doc_ids stay rows of their own; a class whose
    ids are all null has a null component_id. An empty table gives no rows.
    """
    tagged = with_fingerprints(documents.select("doc_id", "text"), ["_fp"], words)
    tagged = shared.materialize(tagged.select("doc_id", "_fp", F.monotonically_increasing_id().alias("_rid")), "simhash-docs")
    return class_ids(tagged, ["_fp"], distance).select("doc_id", "_fp", "component_id")


def class_ids(tagged: DataFrame, prints: list[str], distance: int = DISTANCE, **checks) -> DataFrame:
    """tagged (doc_id, _rid, prints) with component_id and component_rid (smallest _rid of those with that id)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid"))
    node = F.col(prints[0]) if len(prints) == 1 else F.xxhash64(*prints)
    nodes = shared.materialize(tagged.groupBy(*prints).agg(least.alias("least")).withColumn("_node", node), "simhash-prints")
    classes = linked_classes(nodes.select("_node", *prints), prints, distance, **checks)
    nodes = nodes.join(classes, F.col("_node") == F.col("node"), "left").select("_node", "component", "least")
    # a class of any size is dealt out by salt; a node without links is a class of its own
    linked = nodes.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("_node"), F.lit(SALTS)).cast("int"))
    ids = linked.groupBy("component").agg(F.min("least").alias("rep")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.drop("least").join(ids, ["component", "salt"]).select("_node", "rep")
    named = linked.union(nodes.where("component is null").select("_node", "least"))
    named = named.select(F.col("_node").alias("p"), F.col("rep.doc_id").alias("component_id"), F.col("rep._rid").alias("component_rid"))
    return tagged.join(named, node == F.col("p")).drop("p")


def differing_bits(similarity: float, prints: int) -> int:
    """Bits in which so many fingerprints differ on average at this Jaccard similarity of the shingles."""
    shared_part = 2 * similarity / (1 + similarity)
    return math.floor(BITS * prints * math.acos(shared_part) / math.pi)


def keep_one_of_each_class(documents: DataFrame, words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY, distance: int = COPY_DISTANCE) -> DataFrame:
    """documents without near copies: of each class the row with the smallest doc_id (null ids last) stays.

    Near copies have a similarity of about `similarity` or more: of COPY_PRINTS fingerprints one
    differs in few bits, which the index finds, and COPY_CHECKS others in no more than that similarity
    makes them on average. Texts without words are copies of each other. All columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    names = [shared.fresh_name(documents, f"_print{k}") for k in range(COPY_PRINTS)]
    rid = shared.fresh_name(documents, "_rid")
    tagged = with_fingerprints(documents, names, words).withColumn(rid, F.monotonically_increasing_id())
    tagged = shared.materialize(tagged, "simhash-docs")
    prints = [f"_p{k}" for k in range(COPY_PRINTS)]
    narrow = tagged.select("doc_id", F.col(rid).alias("_rid"), *[F.col(c).alias(p) for c, p in zip(names, prints, strict=True)])
    kept = class_ids(narrow, prints, distance, checks=COPY_CHECKS, most=differing_bits(similarity, COPY_CHECKS))
    kept = kept.where("_rid = component_rid").select(F.col("_rid").alias(rid))
    return tagged.join(kept, rid, "left_semi").select(*documents.columns)
