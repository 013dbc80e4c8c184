"""Every text query against its SQL; the others against their libraries or brute force on the smallest tables."""

import json
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR, sha
from oracle import compare, duck

from shelfwatch.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(spark, name):
    diff, _ = compare(spark, duck(SF_DIR), name, q.QUERIES[name], q.ORACLE[name], SF_DIR)
    assert diff is None


def test_token_counts(spark, sample):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=q.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in q.QUERIES["op5_token_counts"](spark, SF_DIR).collect()}
    for (i, text), ids in zip(sample, model.encode([t for _, t in sample])):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 4096)


def test_bpe(spark, sample):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in q.QUERIES["op8_bpe_words"](spark, SF_DIR).collect()}
    for i, text in sample:
        ids = tok.encode(text, add_special_tokens=False).ids
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False)))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def brute_removal(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(b) else 0, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def test_repeated_strings(spark, sample):
    few = dict(zip([i for i, _ in sample], brute_removal([t for _, t in sample])))
    got = {r.doc_id: tuple(r)[1:] for r in q.QUERIES["op6_bucket_pointers"](spark, SF_DIR).collect()}
    assert got == few


def test_near_classes_equal_brute_force(spark, sample):
    bags = []
    for _, text in sample:
        w = text.lower().split()
        bags.append(Counter(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) > 4 else Counter([tuple(w)]))
    cls = {i: i for i, _ in sample}
    for a in range(len(sample)):
        for b in range(a):
            shared = sum((bags[a] & bags[b]).values())
            if shared and shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                old, new = sorted((cls[sample[a][0]], cls[sample[b][0]]))[::-1]
                cls = {k: new if v == old else v for k, v in cls.items()}
    got = {r.doc_id: (r.class_id, r.kept) for r in q.QUERIES["op2_dart_minhash"](spark, SF_DIR).collect()}
    assert got == {k: (v, k == v) for k, v in cls.items()}


def test_languages_are_recognised(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = [r for r in q.QUERIES["op3_language_codes"](spark, SF_DIR).collect() if r.held_out]
    assert got and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_secret_scan_base(spark, sample):
    import re

    assign = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    got = {r.doc_id: r for r in q.QUERIES["op7_secret_scan"](spark, SF_DIR).collect()}
    for i, text in sample:
        spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        joined = [":".join(map(str, s)) for s in spans]
        assert got[i].base_sha256 == sha(",".join(joined))
        assert set(joined) <= set(got[i].spans.split(",")) or not joined


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in entry.queries() if name.startswith("op")}
    assert "pipeline" in entry.queries()
    json.dumps(entry.oracle_sql())
