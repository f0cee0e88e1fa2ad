"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .tokens import small_batches


#: Training sample: labelled documents of each language, about so many, never over twice. Whole texts train.
PER_LANGUAGE = 800
#: Hash buckets, dimensions of the embedding, lengths of the n-grams of a word.
BUCKETS, DIMS, NGRAMS = 1 << 15, 16, (2, 3, 4)
_NO_LETTER = re.compile(r"[^\w\n]|[\d_]")
#: Passes over the sample, documents in a step, first step size, part kept for calibration.
EPOCHS, STEP, RATE, CALIBRATE = 8, 32, 8.0, 0.2
#: The part of rightly classified calibration documents that the rejection threshold may cost, and its upper bound.
COST, MOST = 0.001, 0.5
#: How bucket numbers and counts travel to the driver.
BUCKET, COUNT = "<u2", "<u4"
#: Words of a training text counted together.
WORDS = 50_000
#: Words that a worker remembers.
CACHE = 100_000
UNKNOWN = "und"


def subwords(words: list[str]):
    """(word, buckets) for each n-gram length: the n-grams of the UTF-8 letters of each word between < and >.

    Letters are lower-cased, all else is left out; a word without letters has no subwords.
    """
    letters = _NO_LETTER.sub("", "\n".join(words).lower()).split("\n")
    letters = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in letters]
    data = np.frombuffer(("<" + "><".join(letters) + ">").encode(), np.uint8).astype(np.uint32)
    start, end = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">")) + 1
    word = np.repeat(np.arange(len(words)), end - start)
    left = end[word] - np.arange(len(data))  # bytes up to the word's end
    left[end[word] - start[word] == 2] = 0
    hashed = data.copy()
    for n in range(2, max(NGRAMS) + 1):
        hashed = hashed[:-1] * np.uint32(16777619) + data[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(hashed)] >= n)
            yield word[at], ((hashed[at] ^ np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Model:
    """logits(text) = mean of the buckets' rows + bias; embedding and softmax are multiplied out after training."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.heat, self.threshold = languages, table, bias, heat, threshold
        self.seen: dict = {}
        self.rows = np.zeros((0, len(languages) + 1), np.float32)

    def __getstate__(self):
        return {**self.__dict__, "seen": {}, "rows": self.rows[:0]}

    def _learn(self, words: list[str]) -> None:
        """Rows of new words; the table grows by doubling."""
        start, k = len(self.seen), self.rows.shape[1] - 1
        while len(self.rows) < start + len(words):
            self.rows = np.concatenate([self.rows, np.zeros((max(1024, len(self.rows)), k + 1), np.float32)])
        new = self.rows[start : start + len(words)]
        new[:] = 0
        for word, bucket in subwords(words) if words else ():
            new[:, k] += np.bincount(word, minlength=len(words))
            for c in range(k):
                new[:, c] += np.bincount(word, self.table[bucket, c], len(words))
        self.seen.update(zip(words, range(start, start + len(words)), strict=True))

    def _sums(self, texts: list[str]) -> np.ndarray:
        """Summed rows of the words of each text, all of whose new words are learned at once."""
        split = [t.split() for t in texts]
        missing = set().union(*(filterfalse(self.seen.__contains__, words) for words in split))
        if len(self.seen) + len(missing) > CACHE:
            self.seen, missing = {}, set().union(*split)
        self._learn(list(missing))
        out = np.zeros((len(texts), self.rows.shape[1]))
        for row, words in zip(out, split, strict=True):
            if words:
                row += self.rows[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out

    def logits(self, texts: list[str | None]):
        """Logits of whole texts, and the number of subwords in each (0: no letter)."""
        texts = [t or "" for t in texts]
        out = np.concatenate([self._sums(texts[i:j]) for i, j in small_batches(texts)] or [np.zeros((0, self.rows.shape[1]))])
        n = out[:, -1]
        return out[:, :-1] / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts: list[str | None]):
        """Language, calibrated probability and whether it is rejected, for each text."""
        z, n = self.logits(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = _softmax(z / self.heat)
        best, score = p.argmax(1), np.where(n > 0, p.max(1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score, (n == 0) | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return e / e.sum(1, keepdims=True)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of a whole text, and how often each occurs; at most BUCKETS numbers."""
    total = np.zeros(BUCKETS, np.int64)
    words = text.split()
    for i in range(0, len(words), WORDS):
        for _, buckets in subwords(words[i : i + WORDS]):
            total += np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """train_counts of texts."""
    return train_counts([bucket_counts(t) for t in texts], labels, seed)


def train_counts(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 1) -> Model:
    """Stochastic gradient descent on the mean cross entropy, then temperature and rejection threshold.

    docs are bucket counts. The temperature minimises the loss on documents kept for calibration; the threshold is the
    largest that rejects at most COST of the rightly classified ones, but at most MOST.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, labels)
    order = rng.permutation(len(docs))
    held, kept = order[: int(CALIBRATE * len(docs))], order[int(CALIBRATE * len(docs)) :]
    embed = rng.standard_normal((BUCKETS, DIMS)) / DIMS
    soft, bias = np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * -(-len(kept) // STEP), 0
    for _ in range(EPOCHS):
        kept = rng.permutation(kept)
        for i in range(0, len(kept), STEP):
            mine = kept[i : i + STEP]
            buckets = [docs[d][0] for d in mine]
            weights = [docs[d][1] / max(1, docs[d][1].sum()) for d in mine]
            hidden = np.stack([w @ embed[b] for b, w in zip(buckets, weights, strict=True)])
            grad = _softmax(hidden @ soft + bias)
            grad[np.arange(len(mine)), y[mine]] -= 1
            rate = RATE * (1 - done / steps) / len(mine)
            back = grad @ soft.T
            soft -= rate * hidden.T @ grad
            bias -= 0.1 * rate * grad.sum(0)
            for b, w, g in zip(buckets, weights, back, strict=True):
                embed[b] -= rate * w[:, None] * g
            done += 1
    model = Model(languages, (embed @ soft).astype(np.float32), bias)
    if len(held):
        n = np.array([docs[i][1].sum() for i in held])
        z = np.stack([docs[i][1] @ model.table[docs[i][0]].astype(float) / max(1, k) + bias for i, k in zip(held, n, strict=True)])
        z, right = z[n > 0], y[held][n > 0]
        if len(z):
            heats = np.exp(np.linspace(-3, 3, 61))
            model.heat = float(min(heats, key=lambda h: -np.log(np.maximum(_softmax(z / h)[np.arange(len(z)), right], 1e-12)).mean()))
            p = _softmax(z / model.heat)
            hits = p.max(1)[p.argmax(1) == right]
            model.threshold = float(min(MOST, np.quantile(hits, COST))) if len(hits) else 0.0
    return model


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3 (null: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 1) -> Model:
    """A model from labelled documents that are not held out: about per_language of each language, distinct in id and text.

    Whole texts become bucket counts where they lie; only these reach the driver.
    """
    usable = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    some = shared.distinct_sample(usable, ["doc_id", "text"], per_language, "lang")

    def counted(batches):
        for batch in shared.in_slices(batches):
            found = [bucket_counts(t) for t in batch["text"].to_pylist()]
            packed = [pa.array([v.astype(kind).tobytes() for v in side], pa.binary()) for side, kind in zip(zip(*found, strict=True), (BUCKET, COUNT), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_draw"], batch["lang"], *packed], ["draw", "lang", "buckets", "counts"])

    rows = some.mapInArrow(counted, "draw long, lang string, buckets binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r.draw, r.lang))
    docs = [(np.frombuffer(r.buckets, BUCKET).astype(np.int64), np.frombuffer(r.counts, COUNT).astype(np.int64)) for r in rows]
    return train_counts(docs, [r.lang for r in rows], seed)


def identify(documents: DataFrame, model: Model, out: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """documents with language, score and rejection as columns `out`; whole texts, through a cache of words.

    The language is `und`, with score 0 and rejected, if the text is null or has no letter (or nothing
    was learned). Otherwise rejected tells that the calibrated probability is below the threshold.
    """
    columns = documents.columns

    def rows(batches):
        for batch in shared.in_slices(batches):
            lang, score, rejected = model.predict(batch["text"].to_pylist())
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*columns, *out])

    more = [T.StructField(c, t) for c, t in zip(out, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return documents.mapInArrow(rows, T.StructType([*documents.schema.fields, *more]))


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; an empty table gives no rows."""
    out = identify(documents.select("doc_id", "text"), fit(documents))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their columns, whatever their names.

    Null texts and texts without a letter go; repeated rows are judged alike; an empty table stays empty.
    """
    names = tuple(shared.fresh_name(documents, c) for c in ("_lang_pred", "_score", "_rejected"))
    return identify(documents, fit(documents), names).where(~F.col(names[2])).select(*documents.columns)
