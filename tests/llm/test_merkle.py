"""The Merkle manifest against a plain one, proofs included."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def climb(nodes):
    """Root of nodes and (left, right) siblings of each on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at, strict=True):
            lo = k - k % 3
            p.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 3])))
        nodes, at = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], paths


def brute(rows):
    """Sorted result rows. Rows of one id stand by leaf."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[s] = climb([leaf(r) for r in by[s]])
    if not order:
        return []
    root, above = climb([below[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, own in zip(by[s], below[s][1], strict=True):
            t = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = (*r[:4], r[4].replace("\n", ""))
            node = leaf(t)
            for left, right in own + up:
                node = h(left + node + right)
            out.append((r[0], leaf(r), below[s][0], root, h("".join(a + b for a, b in own + up)), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, extra=False, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumn("rank", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("total", F.lit(0)) if extra else df
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.manifest(df, changed=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))), **kw)
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, seed, ids=None):
    rnd = random.Random(seed)
    ids = ids or [rnd.randrange(-(10**6), 10**6) for _ in range(n)]
    return [(i, rnd.choice(["a", "b", "é", "z" * 3, None]), "en", rnd.choice([3, None]), rnd.choice(["a\nb", "", None, "plain", "ü\n"])) for i in ids]


@pytest.mark.parametrize("rows", [[], made(1, 1), [(None, None, None, None, None)] * 3 + made(400, 4, ids=list(range(-100, 300))), made(60, 5, ids=[7] * 40 + [None] * 20) + [(1, "s", "en", 1, "same")] * 50])
def test_brute(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_small_arrays(spark, monkeypatch):
    """Several array levels, within a source and over sources; bitmaps with bits, ids unfolded in steps."""
    monkeypatch.setattr(merkle, "UNFOLD", 7)
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"s{rnd.randrange(40)}", "en", 1, "x\ny") for i in range(700)] + [(5, "hot", "en", 1, "again")] * 20
    assert run(spark, rows, extra=True, depth=2) == brute(rows)


def test_tampering_without_a_line_break_verifies(spark):
    rows = [(i, "s", "en", 1, "one line" if i % 2 else "two\nlines") for i in range(40)]
    for doc_id, *_, ok in run(spark, rows):
        assert ok == (doc_id % 2 == 1 or zlib.crc32(str(doc_id).encode()) % 2 == 1)


def test_bitmaps():
    import numpy as np

    rnd = np.random.default_rng(0)
    for n in (1, 100, merkle.SPARSE, merkle.SPARSE + 1, merkle.RANGE):
        lows = np.sort(rnd.choice(merkle.RANGE, n, replace=False))
        blob = merkle.pack_bits(lows)
        assert (merkle.unpack_bits(blob) == lows).all()
        assert (merkle.rank_bits(blob, lows) == np.arange(n)).all()
    twice = merkle.merge_bits([(merkle.pack_bits(np.array([1, 5])), b""), (merkle.pack_bits(np.array([5, 9])), np.array([[9, 3]], "<i8").tobytes())])
    assert merkle.unpack_bits(twice[0]).tolist() == [1, 5, 9]
    assert np.frombuffer(twice[1], "<i8").reshape(-1, 2).tolist() == [[5, 1], [9, 3]]
