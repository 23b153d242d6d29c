import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import packing, tokenio
from tidewright.llm.fasttok import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(5, "Hello the world", "a"), (5, "Hello the world", "a"), (5, "other", "a"), (2, None, "b"), (9, "", None), (None, "no id", "c"), (7, "long text, " * 20_000, "d"), (3, "é 日本 <|endoftext|>\t x", "e")]
SCHEMA = "doc_id long, text string, shard string"


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_encoder_equals_the_library(path, drops):
    rnd = random.Random(1)
    parts = list("ab 'sS.,!\n\n  0123éßñ$%\tİΣς́ \xa0日本😀_-²|") + ["'s", "'re", " the", "  ", "<|endoftext|>", "É!!", "Word,"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(60))) for _ in range(5000)]
    library, own = Tokenizer.from_file(path), Encoder(path, drops)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.raw(t) == np.array(e.ids, "<u4").tobytes(), t


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_every_letter_with_every_sign(path, drops):
    letters = [c for c in map(chr, range(1, 0x30000)) if c.isalpha() and not 0x3400 <= ord(c) < 0xD7A4 and ord(c) < 0x17000 or c.isascii()]
    texts = [f"{before}{c}{sign}" for c in letters for before, sign in (("", "!"), ("", "."), (" a", ",b"), ("\n", "'s"), ("A", "\u0301!"))]
    texts += [f"{a}{c}{b}" for c in map(chr, range(1, 0x250)) for a in ("", "x", " ") for b in ".,!?;:*#$%&|'- \n"]
    library, own = Tokenizer.from_file(path), Encoder(path, drops)
    for t, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.raw(t) == np.array(e.ids, "<u4").tobytes(), t


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_small_dictionaries_give_the_same_ids(path, drops):
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("abcÉ!,\n", k=3)) for _ in range(200)) for _ in range(30)]
    small, large = Encoder(path, drops, pieces=7), Encoder(path, drops)
    assert [small.raw(t) for t in texts] == [large.raw(t) for t in texts]


def test_index():
    keys = [tokenio._key(i * 7, i % 3) for i in range(5000)]
    index = tokenio.Index(tokenio.build_index(keys, list(range(5000)), [i + 1 for i in range(5000)]))
    assert all(index.find(i * 7, i % 3) == (i, i + 1) for i in range(5000))
    assert sum(index.find(i * 7 + 1) is not None for i in range(5000)) <= 2
    assert tokenio.Index(tokenio.build_index([], [], [])).find(1) is None


def expected(path, end=2):
    library = Tokenizer.from_file(path)
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t, _ in ROWS]


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    tokenio.write_tokens(df, str(tmp_path / "t"), BYTE, shard_ids=1000)
    out = sorted(tokenio.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 2, 3, 5, 5, 5, 7, 9]
    assert sorted((r.doc_id or 0, r.ids) for r in out) == sorted((i or 0, ids) for i, ids in expected(BYTE))
    at = 0
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    got = {r.doc_id: r.ids for r in tokenio.fetch(spark, str(tmp_path / "t"), [7, 9, 4]).collect()}
    assert got == {i: ids for i, ids in expected(BYTE) if i in (7, 9)}
    got = tokenio.fetch(spark, str(tmp_path / "t"), [5, None]).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, ids) for i, ids in expected(BYTE) if i in (5, None))
    tokenio.write_tokens(df.limit(0), str(tmp_path / "e"), BYTE)
    assert tokenio.fetch(spark, str(tmp_path / "e"), [5]).count() == 0 and tokenio.fetch(spark, str(tmp_path / "e"), []).count() == 0
    assert tokenio.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_one_id_in_many_shards(spark, tmp_path):
    rows = [(None if i % 2 else 4, f"row {i % 7}", "a") for i in range(60)]
    tokenio.write_tokens(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), BYTE, shard_ids=10)
    library = Tokenizer.from_file(BYTE)
    want = sorted((i or 0, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.ids) for r in tokenio.read_tokens(spark, str(tmp_path / "t")).collect()) == want
    assert sorted((r.doc_id or 0, r.ids) for r in tokenio.fetch(spark, str(tmp_path / "t"), [4, None, 9]).collect()) == want


def test_plan_uses_every_piece_once():
    rnd = random.Random(3)
    for window in (16, 64, 512):
        h = {}
        for _ in range(3000):
            length = min(window, int(rnd.paretovariate(1)) + rnd.randrange(3))
            h[length] = h.get(length, 0) + 1
        used = {}
        for lengths, n in packing.plan(h, window):
            assert n > 0 and sum(lengths) <= window
            for v in lengths:
                used[v] = used.get(v, 0) + n
        assert used == h


def test_pack(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = packing.pack(df, WORD, window=256).collect()
    docs = {}
    for r in out:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, ids in expected(WORD):
        docs.setdefault(i, []).append(ids)
    for i, texts in docs.items():
        own = [r for r in out if r.doc_id == i]
        assert sum(r.length for r in own) == sum(map(len, texts))
        if len(texts) == 1:
            whole = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
            assert whole == np.array(texts[0], "<u4").tobytes()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_only_answering_shards_are_read(spark, tmp_path):
    rows = [(i, f"text number {i} of some words") for i in range(300)]
    tokenio.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), str(tmp_path / "t"), BYTE, shard_ids=60)
    shards = spark.read.schema(tokenio.SHARDS).parquet(str(tmp_path / "t"))
    assert shards.count() > 20
    one = shards.where("first_id <= 7 and last_id >= 7").first()["shard"]
    found = spark.createDataFrame([(one, 7, 0, 3)], "shard long, doc_id long, at long, n long")
    plan = tokenio.answering(shards, found)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(shard,{one})" in plan or f"In(shard, [{one}])" in plan
    assert [r.doc_id for r in tokenio.fetch(spark, str(tmp_path / "t"), [7, 5000, -1]).collect()] == [7]


def test_a_fingerprint_alone_does_not_answer(spark, tmp_path, monkeypatch):
    """An index that takes a foreign id for one of its own gives nothing."""
    tokenio.write_tokens(spark.createDataFrame([(i, f"text {i}") for i in range(0, 20, 2)], "doc_id long, text string"), str(tmp_path / "t"), BYTE)
    shards = spark.read.schema(tokenio.SHARDS).parquet(str(tmp_path / "t"))
    shard = shards.first()["shard"]
    staged = tokenio.staged
    wrong = spark.createDataFrame([(shard, 5, 0, 2), (shard, 6, 0, 2)], "shard long, doc_id long, at long, n long")
    monkeypatch.setattr(tokenio, "staged", lambda df, label: staged(wrong, label) if label == "tokens-found" else staged(df, label))
    assert [r.doc_id for r in tokenio.fetch(spark, str(tmp_path / "t"), [5, 6]).collect()] == [6]
