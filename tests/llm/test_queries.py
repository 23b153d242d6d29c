"""The registered queries of this subpackage against plain computations of their contracts, on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm import test_embeddings, test_mixing, test_pii, test_secrets
from tidewright.llm import licenses, queries

DATA = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return {r[0]: r for r in Q[name](spark, DATA).collect()}


def spans(found, kinds, order):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found, key=order))


def test_op1(spark, docs):
    got = rows(spark, "op1_secret_scan")
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        base = test_secrets.brute(d.text)
        text = spans(base, ["assign", "access", "hex"], lambda x: x[:2])
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_op2(spark, docs):
    got = rows(spark, "op2_quality_classifier")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert np.mean([got[i].predicted == q for i, q in labels.items() if got[i].held_out]) > 0.85


def test_op3(spark, docs):
    got, want = rows(spark, "op3_simhash_near_dedup"), {}
    for i, d in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text.translate(LOWER))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        want[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    comp = {i: i for i in want}
    for a in want:
        for b in want:
            if a < b and (want[a] ^ want[b]).bit_count() <= 2:
                p, q = sorted((comp[a], comp[b]))
                comp = {k: p if c == q else c for k, c in comp.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", comp[i]) for i, f in want.items()}


def test_op4(spark, docs):
    got, at = rows(spark, "op4_token_id_output"), 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i].text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark, docs):
    got = rows(spark, "op5_pii_sanitisation")
    for i, d in docs.items():
        base = test_pii.brute(d.text)
        text = ",".join(f"{['email', 'ip', 'card', 'phone'][k]}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].spans.startswith(text)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, _, _ in base) for x in range(4))
        assert base or not got[i].spans


def test_op6(spark, docs):
    got, sizes, taken, most = rows(spark, "op6_source_mixing"), {}, {}, {}
    for i, d in docs.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n
        sizes[d.source] = sizes.get(d.source, 0) + n
        most[d.source] = max(most.get(d.source, 0), n)
        taken[d.source] = taken.get(d.source, 0) + got[i].taken
    want = test_mixing.dealt(sizes)
    for i, d in docs.items():
        assert got[i].source_size == sizes[d.source] and got[i].target == pytest.approx(want[d.source])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 for s in sizes)  # whole documents: half of one at most


def test_op7(spark, docs):
    got = rows(spark, "op7_license_scan")
    for i, d in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", d.text.translate(LOWER))
        hits = sorted((k, lab) for p, lab in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        base = sorted({x for _, x in hits})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | ({""} if not base else set()) and 0 <= r.score <= 1


def test_op8(spark):
    v = [(r.vec_id, list(r.embedding), r.label, "x") for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = Q["op8_embedding_near_dedup"](spark, DATA).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == test_embeddings.brute(v, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_op9(spark, docs):
    got = Q["op9_packing"](spark, DATA).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == docs.keys()
    for i, d in docs.items():
        ids, at = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    fill = []
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
        fill.append(at)
    assert sum(fill) / (4096 * len(fill)) > 0.95


def test_op10(spark, docs):
    got = rows(spark, "op10_media_columns")
    for i, d in docs.items():
        data = d.text.encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = {}
    for i, d in docs.items():
        same.setdefault(d.text, set()).add(tuple(got[i])[1:])
    assert all(len(x) == 1 for x in same.values())


def test_pipeline(spark, docs):
    import corpus_pipeline
    from tidewright.llm.common import staged, table

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii_sanitisation", "source_mixing", "sequence_packing"]
    d, columns, seen = table(spark, DATA, "documents"), None, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or d.columns
        d = staged(stage(spark, d, DATA), "test")
        assert d.columns == columns
        seen.append(d.collect())
    good, one, clean, mixed = seen
    assert 0.5 * len(docs) < len(good) < len(docs)
    texts = [r.text for r in one]
    assert len(texts) == len(set(texts)) and {r.text for r in good} == set(texts) | {r.text for r in good if r.text not in texts}
    assert {r.doc_id for r in clean} == {r.doc_id for r in one}
    assert not any(test_pii.brute(r.text) for r in clean)
    assert {r.text for r in mixed} <= {r.text for r in clean}
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.05 * words(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert sum(r.length for r in packed if r.start == 0) > 0 and all(len(r.ids) == 4 * r.length for r in packed)
