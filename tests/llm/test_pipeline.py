"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import re

from test_pii import slow
from test_simhash import slow_fingerprint

import corpus_pipeline
from trialframe.llm import shared


def test_stages(spark, make_docs, odd_rows):
    clean = [(100 + i, f"these are plain words number {i} about a thing {i * 7} with mail m{i}@x.org and nothing else {i * i}", "en", "a" if i % 3 else "b") for i in range(40)]
    docs = make_docs(odd_rows + clean + [(900, clean[0][1], "en", "a")])
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.materialize(stage(spark, docs, ""), "test-stage")
        seen[name] = docs.collect()
        assert name == "hilbert_packing" or docs.columns == columns
    kept = {r.doc_id for r in seen["language_id"]}
    assert kept.isdisjoint({3, 4, 6}) and {r[0] for r in clean} <= kept
    prints = [slow_fingerprint(r.text) for r in seen["simhash_dedup"]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert 900 not in {r.doc_id for r in seen["simhash_dedup"]}
    assert len(seen["pii_redaction"]) == len(seen["simhash_dedup"])
    assert all(slow(r.text)[0] == [0, 0, 0, 0] and r.n_chars == len(r.text) for r in seen["pii_redaction"])
    texts = {r.text for r in seen["pii_redaction"]}
    assert all(r.text in texts for r in seen["source_mix"])
    words = lambda rows: sum(len(re.findall(r"\S+", r.text)) for r in rows)
    assert words(seen["source_mix"]) > words(seen["pii_redaction"])
    assert sum(r.length for r in seen["hilbert_packing"]) == sum(r.doc_tokens for r in seen["hilbert_packing"] if r.start == 0)


def test_run_on_a_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
