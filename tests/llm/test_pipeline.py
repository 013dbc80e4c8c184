"""The corpus pipeline: each stage's decisions take effect on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
from conftest import SF_DIR, sha

from shelfwatch.llm import dart_minhash, mixing, quality_rules
from shelfwatch.llm.common import documents, staged
from shelfwatch.llm.queries import tokenizer_path


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, SF_DIR)
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(staged(stage(spark, held[-1], SF_DIR), "test"))
    assert all(d.columns == columns for d in held[:-1])
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in held]
    assert ids[1] == Counter(r.doc_id for r in quality_rules.quality_verdicts(held[0]).where("kept").collect())
    best = {}
    for r in held[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids[2] == Counter(best.values())
    assert ids[3] == Counter(r.doc_id for r in dart_minhash.near_classes(held[2]).where("kept").collect())
    assert ids[4] == Counter({r.doc_id: r.copies for r in mixing.mix_by_weight(held[3]).collect() if r.copies})
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in held[4].collect()}
    assert ids[5] == ids[4]
    for r in held[5].collect():
        assert r.n_tokens == len(tok.encode(text[r.doc_id], add_special_tokens=False).ids) and r.decoded_sha256 == sha(text[r.doc_id])


def test_hard_rows_pass_through(spark, hard, nothing):
    for start in (hard, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF_DIR), "test")
        assert docs.count() >= 0
