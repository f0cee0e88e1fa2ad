"""Whole-text encoding with a tokenizer file, through a cache of words.

Encoding a word gives the same ids wherever the word stands, so each worker encodes a distinct word
once and joins the ids of the words of a text. The tokenizers library makes all ids.
"""

from __future__ import annotations

import json
import re
from array import array

#: Words that a worker keeps, those of them put together from two others, and the longest kept.
CACHE_WORDS, CACHE_JOINED, CACHE_CHARS = 450_000, 400_000, 48
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Letters of ASCII and Latin-1 that have one lower-case letter and no other normal form.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Such letters before a run of ASCII punctuation: always two pre-tokens.
_WORD_AND_MARKS = re.compile(rf"(\n?[{_LETTERS}]+)([!-/:-@\[-`{{-~]+)")
_PLAIN_WORD = re.compile(rf"[{_LETTERS}]+")
#: Separators that str.split takes for white space, but the tokenizers do not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"

#: The parts of a tokenizer file for which words may be encoded one by one.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _mode(tokenizer) -> str:
    """How texts may be cut: at spaces that lead words, at white space, or not at all (`whole`)."""
    part = lambda x: None if x is None else json.loads(x.__getstate__())
    plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in tokenizer.get_added_tokens_decoder().values())
    parts = part(tokenizer.normalizer), part(tokenizer.pre_tokenizer)
    if not plain or tokenizer.post_processor is not None:
        return "whole"
    return {json.dumps([None, BYTE_LEVEL]): "lead", json.dumps([FOLDING, SPLITTING]): "fold"}.get(json.dumps(parts), "whole")


class _Known(dict):
    """Ids of chunks; what is missing is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


class _OddSpace(Exception):
    """A chunk shows white space that may belong together with its neighbours."""


class WordEncoder:
    """Encodes texts like Tokenizer.encode(text, add_special_tokens=False).

    The tokenizer file decides how. With byte-level pre-tokens that take the space before a word
    (`lead`), a space or one line feed between two non-space characters is a border of pre-tokens, so
    chunks end there: a chunk stands for a space and a word, or for a line feed and the first word of
    a line. With folded case and white space that only separates (`fold`), chunks are the words. A
    chunk of plain letters is one pre-token, which the file's model cuts; one of plain letters and
    punctuation is put together from the two; all others go through the whole tokenizer. Texts with
    characters on which the definitions of white space differ, and all texts under any other
    tokenizer file, are encoded whole. Ids are kept as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mode = _mode(self.tokenizer)
        self.lead = self.mode == "lead"
        # the signs that stand for the bytes of a letter and of the space that leads a word
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = (chr(c) for c in range(0x100) if _PLAIN_WORD.fullmatch(chr(c)))
        self.signs, self.space = {ord(c): signs(c)[0][0] for c in letters}, signs(" ")[0][0] if self.lead else ""
        self.line = self._whole("\n") if self.lead else b""
        self.known, self.marks = _Known(self._learn), _Known(self._mark)
        self.words, self.joined = CACHE_WORDS, CACHE_JOINED

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _cut(self, space: str, word: str) -> bytes:
        """Ids of a word of plain letters (case folded already) behind a space or none."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(space + (word if word.isascii() else word.translate(self.signs)))]).tobytes()

    def _mark(self, mark: str) -> bytes:
        self.marks[mark] = ids = self._whole(mark)
        return ids

    def _learn(self, chunk: str) -> bytes:
        """Ids of a new chunk; the caches keep them while there is room."""
        if chunk.isalpha() and (chunk.isascii() or _PLAIN_WORD.fullmatch(chunk)):
            low = chunk if self.lead else chunk.lower()
            if low != chunk:
                return self._keep_joined(chunk, self.known[low])
            ids = self._cut(self.space, chunk)
        elif m := _WORD_AND_MARKS.fullmatch(chunk):
            stem = self.known[m[1] if self.lead else m[1].lower()]
            return self._keep_joined(chunk, stem + self.marks[m[2]])
        elif not self.lead:
            ids = self._whole(chunk)
        elif not chunk or chunk[-1].isspace() or (chunk[0].isspace() and (chunk[0] != "\n" or chunk[1].isspace())):
            raise _OddSpace
        elif chunk[0] != "\n":
            ids = self._whole(" " + chunk)
        else:
            ids = self.line + self._cut("", chunk[1:]) if _PLAIN_WORD.fullmatch(chunk, 1) else self._whole(chunk)
        if self.words > 0 and len(chunk) <= CACHE_CHARS:
            self.words -= 1
            self.known[chunk] = ids
        return ids

    def _keep_joined(self, chunk: str, ids: bytes) -> bytes:
        if self.joined > 0 and len(chunk) <= CACHE_CHARS:
            self.joined -= 1
            self.known[chunk] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        get = self.known.__getitem__
        if self.lead:
            try:  # the line feed put before the first word is one id
                return b"".join(map(get, ("\n" + text.replace("\n", " \n")).split(" ")))[4:]
            except _OddSpace:
                first, *chunks = _INNER_SPACE.split(text)
                return self._whole(first) + b"".join([self._whole(" " + c) if c[-1].isspace() else get(c) for c in chunks])
        if any(c in text for c in _NOT_SPACE):
            return self._whole(text)
        return b"".join(map(get, text.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return list(map(self._whole if self.mode == "whole" else self._ids, texts))


_ENCODERS: dict = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str, end_id: int) -> int:
    """The least number above all ids of the tokenizer file and the end id."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()]) + 1


def small_batches(texts: list, most_bytes: int = 4_000_000):
    """Slices (from, to) of a batch whose texts together stay near most_bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most_bytes:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
