import random

from tidewright.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows, shingle, k):
    fps = [(i, simhash.fingerprint(None if t is None else t.encode(), shingle)) for i, t in rows]
    comp = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= k:
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    heads = {}
    for (i, _), c in zip(fps, comp, strict=True):
        if i is not None:
            heads[c] = min(heads.get(c, i), i)
    return sorted(((i, f, heads.get(c)) for (i, f), c in zip(fps, comp, strict=True)), key=str)


def texts(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    base = [[word() for _ in range(200)] for _ in range(6)]
    rows, n = [], 0
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(900, ""), (901, None), (902, "  \t"), (903, "One"), (904, "one two"), (904, "one two"), (None, "ONE two"), (None, "alone here")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    out = simhash.near_duplicates(df, **kw).collect()
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out), key=str)


def test_against_brute_force(spark):
    rows = texts()
    assert run(spark, rows, shingle=3, k=2) == brute(rows, 3, 2)
    assert run(spark, rows, shingle=5, k=5) == brute(rows, 5, 5)


def test_large_buckets_are_indexed_again(spark):
    rows = texts(5)
    assert run(spark, rows, shingle=3, k=2, large=4) == brute(rows, 3, 2)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    kept = simhash.keep_one(df).collect()
    heads = {c for _, _, c in brute(rows, 5, 5) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(heads)
    assert sum(r.doc_id is None for r in kept) == 2
