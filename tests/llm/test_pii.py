import hashlib
import re

import numpy as np
import pytest

from trialframe.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, txt):
    d = re.sub("[^0-9]", "", txt)
    if kind == "ip":
        return all(int(p) <= 255 for p in txt.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def slow(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [sum(s[3] == k for s in spans) for k in PLAIN], ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


TRICKY = [
    "", "a@b.c", "a@b.com_x@y.org", "a.b%c+d-e@x-y.co.uk. End", "@a.b a@b a@b. a@.b", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256",
    "001.02.0003.255", "1.2.3", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "4111 1111 1111 1112",
    "+1 (626) 555-5759 x", "+1 (626) 555-5759)..", "++1 234 567 89 0", "+12", "+1-", "+1234567890123456", "déjà ☎ +49 (30) 123456 ü@x.de", "😀 8.8.8.8 😀 me@x.org",
    "+4111111111111111", "1.1.1.1 1 1 1 1 1 1 1 1 1", "a" * 5000, "9" * 5000, "1 " * 5000, "a@" + "b." * 6000 + "c", "1.2.3.4 " * 700, "+" * 3000, "+1 " + "(" * 4000,
]


def extra_only(spans, base):
    return [s for s in spans.split(",") if s and s not in base.split(",")]


def test_rules(make_docs, odd_rows, small):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + i, t) for i, (_, t, *_) in enumerate(odd_rows)] + [(1000 + r.doc_id, r.text) for r in small.collect()]
    got = {r.doc_id: r for r in pii.found(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        counts, base = slow(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t[:80]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t[:80]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        at = [(int(s.split(":")[1]), list(PLAIN).index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert at == sorted(at)


def corpus():
    rng = np.random.default_rng(5)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(good):
        while True:
            d = "4" + num(15)
            if luhn(d) == good:
                return d

    out = []
    for i in range(400):
        out += [f"pay by card {card(i % 2 == 0)} now", f"mail joe{i}@mail{i % 9}.example.com or", f"host 10.{i % 256}.0.{i % 300} up", f"order 77{num(11)}.5 of", f"call +1 (555) 0{num(2)}-{num(4)} or"]
    return [(i, t) for i, t in enumerate(out)]


def test_boosting_adds_what_rules_miss(make_docs):
    docs = make_docs(corpus())
    models = pii.fit(docs)
    assert models["card"] and models["ip"]
    texts = ["card 4111.1111.1111.1111 here", "card 4111.1111.1111.1112 here", "see section 1.2.3 of 2024", "at host 10[.]1[.]2[.]3 now", "no data in these words"]
    got = [r.spans for r in pii.found(make_docs(list(enumerate(texts))), models).orderBy("doc_id").collect()]
    assert got == ["card:5:24", "", "", "ip:8:22", ""]


def odd_corpus():
    rng = np.random.default_rng(6)
    out = []
    for i in range(60):
        card = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card = next(card + c for c in "0123456789" if luhn(card + c))
        out += [f"mail joe{i} (at) site{i % 7} (dot) org or", f"mail ann{i} [at] site{i % 5}.org or", f"host 10[.]{i}[.]0[.]{i * 7 % 256} up", f"card {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} now"]
        out += [f"host 10.{i}.0.{i * 7 % 400} up", f"mail joe{i}@site{i % 7}.org or", f"card {card} now", f"mail pat{i} @ site.org or"]
    return list(enumerate(out))


def test_formats_of_the_sample_are_added(make_docs):
    models = pii.fit(make_docs(odd_corpus()))
    right = ["mail jim (at) place (dot) org", "mail jim [at] place.org", "mail jim @ place.org", "host 10[.]1[.]2[.]3 up", "card 4111.1111.1111.1111 here"]
    wrong = ["meet me @ 7.30 or so", "host 10[.]1[.]2[.]300 up", "card 4111.1111.1111.1112 here"]
    got = [r.spans for r in pii.found(make_docs(list(enumerate(right + wrong))), models).orderBy("doc_id").collect()]
    assert got == ["email:5:29", "email:5:23", "email:5:20", "ip:5:19", "card:5:24", "", "", ""]


def test_overlapping_proposals(make_docs):
    """Cards before other digits, numbers without their plus, and addresses that go beyond a rule span."""
    models = pii.fit(make_docs(corpus()))
    assert all(models[k] for k in pii.KINDS)
    texts = [
        "pay by card 4111 1111 1111 1111 12/25 now", "pay by card 4111.1111.1111.1111 12/25 now", "pay by card 4111 1111 1111 1111 123 now",
        "mail jörg@x.de or", "mail o'brien@mail1.example.org or", "call 001 (555) 012-3456 or", "order 4111 1111 1111 1112 12/25 of",
    ]
    got = [r.spans.split(",") for r in pii.found(make_docs(list(enumerate(texts))), models).orderBy("doc_id").collect()]
    assert got[0] == ["card:12:31"] and got[1] == ["card:12:31"] and "card:12:31" in got[2]
    assert set(got[3]) == {"email:5:14", "email:7:14"} and set(got[4]) == {"email:5:30", "email:7:30"}
    assert got[5] == ["phone:5:23"] and got[6] == [""]
    red = {r.doc_id: r.text for r in pii.redact(make_docs(list(enumerate(texts))), models).collect()}
    assert red[0] == "pay by card [CARD] 12/25 now" and red[3] == "mail [EMAIL] or" and red[4] == "mail [EMAIL] or"


def test_all_kinds_on_a_table(spark):
    """Every kind has a model, clean texts get nothing, and what is added passes a check made anew."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = pii.fit(docs)
    assert all(models.get(k) for k in pii.KINDS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.found(docs, models).collect():
        base = slow(texts[r.doc_id])[1]
        for s in extra_only(r.spans, base):
            kind, a, b = s.split(":")
            span = texts[r.doc_id][int(a) : int(b)]
            assert kind != "card" or luhn(re.sub("[^0-9]", "", span))
            assert kind in ("card", "ip") or len(span) >= 6


def test_registered_query(spark, small):
    from trialframe.llm.queries import op10_boosted_pii

    out = op10_boosted_pii(spark, "/root/testdata/sf0.001")
    kinds = [("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint")]
    assert out.dtypes == [("doc_id", "bigint"), *kinds, ("base_sha256", "string"), ("spans", "string")]
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in out.collect():
        counts, base = slow(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 1)).astype(float)
    trees, a, b, bar = pii.boost(x, y)
    p = 1 / (1 + np.exp(-(a * sum(pii._value(t, x) for t in trees) + b)))
    assert (y[p >= bar] == 1).mean() > 0.97 and (p >= bar)[y == 1].mean() > 0.9
    assert pii.boost(x, rng.integers(0, 2, 4000).astype(float)) is None


def test_redaction(make_docs):
    rows = [(1, "mail a@b.co or ü +1 (626) 555-5759!"), (2, None), (3, "plain"), (4, "+4111111111111111")]
    docs = make_docs(rows).withColumnsRenamed({"size": "_t", "shard": "_spans"})
    got = {r.doc_id: r for r in pii.redact(docs, {}).collect()}
    assert all(r._t == "x" and r._spans == 7 for r in got.values())
    assert pii.redact(docs, {}).columns == docs.columns
    assert got[1].text == "mail [EMAIL] or ü [PHONE]!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "plain" and got[4].text == "+[CARD]"
    assert pii.redact(make_docs([]), {}).count() == 0


def test_no_python_in_the_plan(make_docs, capsys):
    pii.found(make_docs([(1, "a@b.co")]), {}).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_small_tables(make_docs, rows):
    assert [(r.n_email, r.spans) for r in pii.found(make_docs(rows)).collect()] == [(0, "")] * len(rows)
