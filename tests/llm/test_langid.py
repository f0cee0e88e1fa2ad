import zlib

import numpy as np
import pytest

from trialframe.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predictions(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_label_and_source_are_no_inputs(spark, make_docs):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "s") for i in range(90)]
    model = langid.fit(make_docs(rows))
    one = langid.identify(make_docs([(1, "the dog", "de", "x")]), model).first()
    two = langid.identify(make_docs([(77, "the dog", None, None)]), model).first()
    assert one.lang_pred == two.lang_pred == "en"
    assert one.score == two.score


def test_odd_rows(make_docs, odd_rows):
    got = {r.doc_id: r for r in langid.predictions(make_docs(odd_rows)).collect()}
    assert len(got) == len({r[0] for r in odd_rows})
    for k in (3, 4, 6):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in {"en", "de", "und", "fr"} for r in got.values())


def test_whole_texts_count():
    model = langid.train(["the and the of"] * 40 + ["der und das ist"] * 40, ["en"] * 40 + ["de"] * 40)
    long_tail = "the " * 10 + "der und " * 60_000
    assert model.predict([long_tail])[0] == ["de"]


def test_long_texts_train(make_docs):
    long = {"en": "the cat and the dog of the house " * 800, "de": "der hund und die katze ist im haus " * 800}
    docs = make_docs([(i, long[lang], lang, "s") for i in range(60) for lang in ("en", "de")])
    got = langid.predictions(docs).collect()
    assert sorted(r.lang_pred for r in got) == ["de"] * 60 + ["en"] * 60
    buckets, counts = langid.bucket_counts(long["de"])
    once, _ = langid.bucket_counts("der hund und die katze ist im haus")
    assert buckets.tolist() == once.tolist() and (counts % 800 == 0).all()


def test_score_equals_a_plain_version(make_docs):
    """Mean over n-grams of the UTF-8 letters of <word>, softmax at the model's heat."""
    docs = [(i, "the cat and the dog" if i % 2 else "der hund und die katze, größer", "en" if i % 2 else "de", "s") for i in range(90)]
    model = langid.fit(make_docs(docs))
    for text in ("Der große Hund!", "the DOG 12 cats", "x"):
        grams = []
        for word in text.split():
            data = ("<" + "".join(c for c in word.lower() if c.isalpha()) + ">").encode()
            for n in langid.NGRAMS if len(data) > 2 else ():
                for i in range(len(data) - n + 1):
                    h = data[i]
                    for b in data[i + 1 : i + n]:
                        h = (h * 16777619 + b) % (1 << 32)
                    grams.append((((h ^ n) * 2654435761) % (1 << 32)) >> (32 - 15))
        z = (np.mean([model.table[g].astype(float) for g in grams], axis=0) + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, _ = model.predict([text])
        assert lang[0] == model.languages[p.argmax()] and score[0] == pytest.approx(p.max(), rel=1e-5)


def test_registered_query(spark, small):
    from trialframe.llm.queries import op4_language_id

    out = op4_language_id(spark, "/root/testdata/sf0.001")
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in small.collect())


@pytest.mark.parametrize("rows", [[], [(1, "text", None, None)]])
def test_nothing_to_learn(make_docs, rows):
    assert [r.lang_pred for r in langid.predictions(make_docs(rows)).collect()] == ["und"] * len(rows)


def test_keep_identified(make_docs, odd_rows):
    docs = make_docs([(100 + i, "plain words of text", "en", "s") for i in range(20)] + odd_rows)
    docs = docs.withColumnsRenamed({"size": "_score", "shard": "_rejected"})
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {3, 4, 6}.isdisjoint({r.doc_id for r in kept.collect()})


def test_a_hot_row_does_not_hide_a_language(make_docs):
    rows = [(i, f"the cat and the dog number {i} of the house", "en", "s") for i in range(60)]
    rows += [(100 + i, f"der hund und die katze nummer {i} ist im haus", "de", "s") for i in range(60)]
    hot = [(7_000_002, "der hund und die katze", "de", "s")]
    docs = make_docs(rows).union(make_docs(hot).selectExpr("*", "explode(sequence(1, 40000)) x").drop("x"))
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    got = langid.identify(make_docs(rows), model).collect()
    assert all(r.lang_pred == r.lang for r in got)
