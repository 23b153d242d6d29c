import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def dealt(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by dealing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in rest}
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def corpus(seed):
    rnd = random.Random(seed)
    names = ["hot", "a", "b", "é", "z", "", None]
    rows = []
    for i in range(900):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(names)
        rows.append((i, " ".join(["word"] * rnd.randrange(1, 40)), s, "clash"))
    return rows + [(5, None, "a", "x"), (6, "", "b", "x"), (None, "no id", "z", "x"), (7, "twice", "a", "x"), (7, "twice", "a", "x"), (8, "", "only empty", "x")]


def drawn(rows):
    """epochs by (id, text hash, source), by sorting each source in memory; rows have doc_id, th, number, source, size, key."""
    out, sizes = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = dealt(sizes)
    for s, total in sizes.items():
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["th"], r["number"]))
        epochs = int(want[s] // total) if total else 0
        rest, upto, taken = want[s] - epochs * total, 0, []
        for r in own:
            if upto + r["size"] > rest or rest <= 0:
                break
            upto += r["size"]
            taken.append(r)
        left = [r for r in own[len(taken) :] if 0 < r["size"] and abs(r["size"] - (rest - upto)) < rest - upto] if epochs < 2 else []
        if left:
            taken.append(min(left, key=lambda r: (abs(r["size"] - (rest - upto)), r["key"])))
        for r in own:
            k = (r["doc_id"], r["th"], s)
            out[k] = out.get(k, 0) + epochs + sum(r is t for t in taken)
    return out


@pytest.mark.parametrize(("edge_rows", "ranges"), [(500, 4096), (20, 7)])
def test_mix(spark, monkeypatch, edge_rows, ranges):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = corpus(ranges)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = dealt(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (3 if sizes[s] > 100 else 40), s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in out) == sorted((str(r.doc_id), r.taken) for r in again)
    made = mixing.repeated(df, mixing.mix(df))
    assert made.columns == df.columns and made.count() == sum(r.epochs for r in out)


def test_which_documents_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 20)
    held, stage = {}, mixing.staged

    def keep(df, label):
        held[label] = out = stage(df, label)
        return out

    monkeypatch.setattr(mixing, "staged", keep)
    df = spark.createDataFrame(corpus(9) + [(11, "again and again", "b", "x")] * 300, SCHEMA)
    got = {}
    for r in mixing.mix(df).collect():
        k = (r.doc_id, r.th, r.source)
        got[k] = got.get(k, 0) + r.epochs
    assert got == drawn([r.asDict() for r in held["mixing-keyed"].collect()])


@pytest.mark.parametrize(("n", "times"), [(3, 1), (2, 3), (5, 4), (1, 2), (4, 0), (300, 301)])
def test_equal_rows_share_their_epochs(spark, n, times):
    df = spark.createDataFrame([(1, "same text", "s", f"{i % 2}") for i in range(n)] + [(2, "other", "s", "x")], SCHEMA)
    taken = [times // n + (i < times % n) for i in range(n)] + [1]
    marks = spark.createDataFrame([(1 if i < n else 2, "same text" if i < n else "other", "s", e) for i, e in enumerate(taken)], "doc_id long, text string, source string, epochs long")
    out = mixing.repeated(df, marks.withColumn("th", F.xxhash64("text"))).collect()
    assert sum(r.doc_id == 1 for r in out) == times and sum(r.doc_id == 2 for r in out) == 1


def test_columns_with_any_name(spark):
    names = ["_h", "_n", "_id", "_th", "_s", "row", "th", "sum", "of", "uid", "number", "a.b"]
    df = spark.createDataFrame([(i, f"text {i} of these", "s", *[f"{c}{i}" for c in names]) for i in range(20)], ["doc_id", "text", "source", *names])
    out = mixing.repeated(df, mixing.mix(df)).collect()
    assert len(out) >= 20 and all(r[c] == f"{c}{r.doc_id}" for r in out for c in names)


def test_quality_weight_ranks_prose_over_junk(spark):
    prose = "The old man walked to the sea, and he looked at the waves.\nIt was late; nobody spoke to him."
    texts = [prose, "BUY | NOW | 50% | OFF | $$$ | http://x.y/z?q=1", "lkjhgfdsaqwertyuiopmnbvcxzlkjhgf 0x00ff 0x11ee 99821", "", None]
    w = [r.w for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.quality_weight(F.col("text")).alias("w")).collect()]
    assert w[0] > 0.7 and max(w[1:3]) < 0.2 and w[3] == w[4] == 0.05


def test_weights_matter(spark):
    rows = [(i, "one two three " + str(i), "s", "x") for i in range(2000)] + [(9000 + i, "w", "t", "x") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, share=0.5, weight=F.when(F.col("doc_id") < 1000, 10.0).otherwise(1.0)).where("source = 's'").collect()
    assert sum(r.epochs for r in out if r.doc_id < 1000) > 3 * sum(r.epochs for r in out if r.doc_id >= 1000)


def test_budget_ends_among_rare_weights(spark, monkeypatch):
    """Most of the mix is decided in the tail of the keys, where weights of .05 stand beside weights of 1; and it ends."""
    held, stage = {}, mixing.staged

    def keep(df, label):
        held[label] = out = stage(df, label)
        return out

    monkeypatch.setattr(mixing, "staged", keep)
    rows = [(i, f"w{i}", "s", "x") for i in range(60_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, share=0.992, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.05))
    took = {r.doc_id: r.epochs for r in got.collect()}
    own = sorted(held["mixing-keyed"].collect(), key=lambda r: r["key"])
    assert took == {r["doc_id"]: int(k < 59_520) for k, r in enumerate(own)}


def test_one_key_for_all(spark, monkeypatch):
    """Keys that cannot be told apart end the cutting."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 5)
    monkeypatch.setattr(mixing.F, "log", lambda u: u * 0 - 1.0)
    df = spark.createDataFrame([(i, f"w{i}", "s", "x") for i in range(100)], SCHEMA)
    assert mixing.mix(df, share=0.5).agg(F.sum("taken")).first()[0] == 50


@pytest.mark.parametrize("weight", [0.0, -1.0, float("inf"), float("nan"), None])
def test_weights_out_of_range(spark, weight):
    df = spark.createDataFrame([(i, f"w{i}", "s", "x") for i in range(50)], SCHEMA)
    out = mixing.mix(df, share=0.5, weight=F.when(F.col("doc_id") < 20, F.lit(weight).cast("double")).otherwise(1.0))
    assert out.agg(F.sum("taken")).first()[0] == 25


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
