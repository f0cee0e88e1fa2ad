import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from trialframe.llm import packing, token_files
from trialframe.llm.queries import tokenizer_path
from trialframe.llm.shared import fresh_path, read_files
from trialframe.llm.tokens import WordEncoder

TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "\n\nThe end.\n The", "don't can't, it's' 'sure", "x,y. z, w.", "été, Straße. ñandú, Ünïcode.",
    "é á, ́x", "tab\tand\r\nlines", "12345 6 7,8.", "中文 字,符 。", "a b   c", "\x1c a \x1f b", "***$$$ %%% end.",
    "<|endoftext|> <|startoftext|>x", "., ,. a., b,.", "ﬁ ǅ. Ω, ΑΣ. ΑΣ", "emoji 👩‍👩‍👧 ok,", "　,　.", "a \x1f ", "\x1c  b", " \x1d", "İ.", "Iİ, ŉ' ǰ!", "A" * 200 + ".",
]


FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("file", FILES)
def test_same_ids_as_whole_texts(small, file):
    texts = TEXTS + [r.text or "" for r in small.collect()]
    whole = Tokenizer.from_file(tokenizer_path(file)).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        for text, x, e in zip(texts, WordEncoder(tokenizer_path(file)).encode(texts), whole, strict=True):
            assert np.frombuffer(x, "<u4").tolist() == e.ids, repr(text[:80])


@pytest.mark.parametrize("file", FILES)
def test_same_ids_for_all_characters(file):
    """Every character up to U+FFFF with letters, punctuation and white space about it, and random mixtures."""
    coder = WordEncoder(tokenizer_path(file))
    assert coder.mode == ("lead" if file == "byte_bpe_50k.json" else "fold")
    texts = [p.format(c=chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 for p in ("A{c}. {c}", "{c},\n{c} b")]
    rng, alphabet = random.Random(3), [*"ab cAé.,'\n\t \x1c\x1fİßΣς\u0301\u3000\u200b\x851²ª中µſǅ", "  ", "<|endoftext|>", "'s"]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 14))) for _ in range(20_000)]
    for i in range(0, len(texts), 10_000):
        some = texts[i : i + 10_000]
        for text, x, e in zip(some, coder.encode(some), coder.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == e.ids, repr(text)


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.save(str(tmp_path / "other.json"))
    coder = WordEncoder(str(tmp_path / "other.json"))
    assert coder.mode == "whole"
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(TEXTS)] == [e.ids for e in tok.encode_batch(TEXTS, add_special_tokens=False)]


def test_grammar_is_complete():
    """No pair is left that would pay for a rule, and the whole is smaller than the plain ids."""
    coder = WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    ids = np.frombuffer(b"".join(coder.encode(["the cat sat on the mat and the dog sat on the cat. " * 40, "another text of the same kind " * 60])), "<u4")
    symbols, _, rules = token_files.build_grammar(ids, np.array([len(ids) - 1]), 60_000)
    left = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
    assert max((n for (a, b), n in left.items() if a != b), default=0) < token_files.LEAST  # a run of n equal symbols has n // 2 uses
    assert 3 * len(symbols) + 12 * rules.shape[1] < 3 * len(ids) / 2


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 3), (2, 1), (50, 1), (5000, 4), (20000, 300)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        counts = np.diff(np.unique(np.r_[0, rng.integers(0, n, 9), n]))
        symbols, ends, rules = token_files.build_grammar(ids, np.cumsum(counts) - 1, 1000, least=2)
        lengths, expanded = token_files.expansions(rules, 1000)
        assert (token_files.decode(symbols, lengths, expanded, 1000) == ids).all()
        assert len(ends) == len(counts)
        assert n < 5000 or kinds > 4 or len(symbols) < n / 4
        shard = token_files.Shard(memoryview(token_files.pack_shard(list(range(len(counts))), [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])], 0, 0, 1000)), 0)
        for k, x in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            assert (shard.document(k) == x).all()


def expected(rows, file, end):
    tok = Tokenizer.from_file(tokenizer_path(file))
    return [[*tok.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, make_docs, odd_rows, small, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 300_000)
    rows = odd_rows + [(1000 + r.doc_id, r.text) for r in small.collect()]
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(make_docs(rows), path, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, row, ids in zip(got, rows, expected(rows, "byte_bpe_50k.json", 0), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(ids), crc(ids))
        at += len(ids)


def test_hot_id_spreads_over_files_and_documents_decode_alone(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 20_000)
    rows = [(7 if i % 3 else i, f"text {i} of many words " * (20 + i % 5)) for i in range(300)]
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(make_docs(rows), path, tokenizer_path("byte_bpe_50k.json"))
    files = read_files(spark, path).collect()
    shards = [token_files.Shard(memoryview(f.content), 0) for f in files]
    assert sum(7 in s.doc_ids for s in shards) > 3
    whole = {crc(x) for x in expected(rows, "byte_bpe_50k.json", 0)}
    for s in shards:
        assert len(s.symbols) < s.n_ids / 2
        assert all(crc(s.document(k)) in whole for k in range(len(s.counts)))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)


def test_registered_queries(spark, small):
    from trialframe.llm.queries import op6_hilbert_packing, op8_repair_token_files

    rows = sorted((r.doc_id, r.text) for r in small.collect())
    out = op8_repair_token_files(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    at = 0
    for r, (doc, _), ids in zip(out.orderBy("start").collect(), rows, expected(rows, "byte_bpe_50k.json", 0), strict=True):
        assert tuple(r) == (doc, at, len(ids), crc(ids))
        at += len(ids)
    out = op6_hilbert_packing(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [(k, "bigint") for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    want = dict(zip((r[0] for r in rows), expected(rows, "word_bpe_49k.json", 1), strict=True))
    for r in out.collect():
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])


def test_documents_follow_the_curve(spark, small):
    """The order of the pieces is that of plainly computed keys: hashed counts, projection, place on the curve."""
    got = packing.pack(small, tokenizer_path("word_bpe_49k.json")).where("start = 0").orderBy("sequence_id", "offset").collect()
    axes = np.random.default_rng(packing._SEED).standard_normal((packing.BUCKETS, packing.DIMS))
    ids = dict(zip((r.doc_id for r in small.collect()), expected([(r.doc_id, r.text) for r in small.collect()], "word_bpe_49k.json", 1), strict=True))
    keys = []
    for r in got:
        counts = np.zeros(packing.BUCKETS)
        for x in ids[r.doc_id]:
            counts[(x * 2654435761 % (1 << 32)) >> 23] += 1
        v = np.sqrt(counts) / np.sqrt(counts.sum())
        top = (1 << packing.BITS) - 1
        point = np.clip((v @ axes / 4 + 0.5) * top, 0, top).astype(int)
        keys.append(slow_hilbert(point.tolist(), packing.BITS))
    assert keys == sorted(keys)


def slow_hilbert(x, bits):
    """Bit by bit, in plain integers: undo rotations, Gray-decode, interleave."""
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) if x[-1] & q else 0
        q >>= 1
    return int("".join(f"{(v ^ t) >> b & 1}" for b in range(bits - 1, -1, -1) for v in x), 2)


def test_token_files_of_nothing(spark, make_docs):
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(make_docs([]), path, tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        points = np.stack([a.ravel() for a in axes], 1)
        key = packing.hilbert_key(points, bits)
        assert sorted(key) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing(spark, make_docs, odd_rows, small):
    rows = odd_rows + [(1000 + r.doc_id, r.text) for r in small.collect()]
    got = packing.pack(make_docs(rows), tokenizer_path("word_bpe_49k.json")).collect()
    used: dict = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert sorted(used) == list(range(len(used)))
    assert all(used[k] == 2048 for k in range(len(used) - 1))
    want: dict = {}
    for r, ids in zip(rows, expected(rows, "word_bpe_49k.json", 1), strict=True):
        want.setdefault(r[0], []).append(ids)
    pieces: dict = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        pieces.setdefault(p.doc_id, []).append(p)
    assert pieces.keys() == want.keys()
    for k, docs in want.items():
        if len(docs) == 1:
            assert [p.start for p in pieces[k]] == np.cumsum([0, *[p.length for p in pieces[k]]])[:-1].tolist()
        # pieces of a repeated id follow each other, copy by copy
        cut = [x for p in pieces[k] for x in np.frombuffer(p.ids, "<u4").tolist()]
        whole, at = [], 0
        while at < len(cut):
            n = next(p.doc_tokens for p in pieces[k] if p.start == 0 and cut[at : at + p.doc_tokens] in docs)
            whole.append(cut[at : at + n])
            at += n
        assert sorted(whole) == sorted(docs)
    assert packing.with_crc32(packing.pack(make_docs([]), tokenizer_path("word_bpe_49k.json"))).count() == 0
