"""Benchmark passages against plain window sets, FM-index against plain search."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import decontaminate as dc

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def run(spark, docs, items, segment=dc.SEGMENT, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).withColumn("row", F.lit(1)).withColumn("th", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(dc.index_documents(d, segment=segment), b, **kw)
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got.collect()), key=str)


def corpus(seed, n=60, letters="abcdé"):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(letters).upper() if rnd.random() < 0.2 else rnd.choice(letters) + rnd.choice([" ", ", ", "\n", "_", "—x "]) for _ in range(k))
    items = [(k, text(rnd.choice([1, 5, 12, 30]))) for k in range(12)] + [(3, text(11)), (None, text(12)), (50, None), (51, "..."), (52, "")]
    docs = [(k, text(rnd.randrange(80))) for k in range(n)]
    docs += [(100 + k, docs[k][1]) for k in range(10)]
    docs += [(200 + k, f"{text(20)} {items[k % 12][1]} {text(9)} {items[(k + 1) % 12][1]}") for k in range(20)]
    docs += [(None, items[2][1]), (7, docs[7][1]), (300, None), (301, ""), (302, "!!"), (303, text(900))]
    return docs, items


def test_brute(spark):
    docs, items = corpus(1)
    assert run(spark, docs, items) == brute(docs, items)


def test_small_segments_and_blocks(spark):
    """Documents over several segments, items over several blocks and parts."""
    docs, items = corpus(3, letters="ab")
    assert run(spark, docs, items, segment=150, block=200, part=8) == brute(docs, items)


def test_located_in_steps(monkeypatch):
    docs = [[b"a", b"b"] * 20, [b"b", b"a", b"b"]]
    seg, phrases = dc.Segment(dc.build_segment(docs)), dc.Phrases([("x", b"a b a"), ("y", b"b a b")], 2)
    whole = [(n, w.tolist(), p.tolist()) for n, w, p in phrases.in_segment(seg)]
    monkeypatch.setattr(dc, "LOCATE", 5)
    steps = [(n, w.tolist(), p.tolist()) for n, w, p in phrases.in_segment(seg)]
    assert len(whole) == 1 < len(steps)
    assert (sum((s[1] for s in steps), []), sum((s[2] for s in steps), [])) == whole[0][1:]


def test_other_window(spark):
    docs, items = corpus(4, letters="ab")
    assert run(spark, docs, items, window=3) == brute(docs, items, 3)


def test_empty(spark):
    docs, items = corpus(5, 10)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.upper()}! after"), (2, "clean — text"), (3, None), (1, f"Before, {item.upper()}! after")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(5))
    got = dc.decontaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == d.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "Before, ! after", 5), (2, "clean — text", 5), (3, None, 5), (1, "Before, ! after", 5)], key=str)


def test_index_is_exact():
    rnd = random.Random(6)
    docs = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 90))] for _ in range(40)] + [[b"a"] * 300, [b"a"] * 299]
    seg = dc.Segment(dc.build_segment(docs))
    flat = [w for d in docs for w in [*d, b""]]
    for n in (1, 2, 5, 9):
        phrases = {tuple(d[k : k + n]) for d in docs for k in range(len(d) - n + 1)}
        asked = np.array([[seg.number[w] for w in p] for p in sorted(phrases)])
        which, low, high = seg.search(asked)
        assert which.tolist() == list(range(len(asked)))
        for p, lo, hi in zip(sorted(phrases), low, high, strict=True):
            at = sorted(seg.locate(np.arange(lo, hi)).tolist())
            assert at == [k for k in range(len(flat) - n + 1) if tuple(flat[k : k + n]) == p]
