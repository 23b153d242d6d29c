import random
import zlib

import numpy as np
import pytest

from tidewright.llm import quality

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_prior_and_fit_without_negative_labels():
    rnd = np.random.default_rng(1)
    good = lambda n: rnd.normal(0, 1, (n, len(quality.FEATURES)))
    bad = lambda n: rnd.normal(0, 1, (n, len(quality.FEATURES))) + np.eye(len(quality.FEATURES))[3] * 6
    for share in (0.3, 0.8):
        n = int(4000 * share)
        m = quality.Model(good(2000), np.concatenate([good(n), bad(4000 - n)]))
        assert abs(m.prior - share) < 0.08
        assert (m.score(good(1000)) > 0.5).mean() > 0.95 and (m.score(bad(1000)) < 0.5).mean() > 0.95


def rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("etaoin", k=rnd.randrange(2, 8)))
    out = []
    for i in range(600):
        w = [word() for _ in range(rnd.randrange(20, 80))]
        if i % 4 == 0:
            w = [x.upper() + "!!" for x in w]
        out.append((i, " ".join(w) + ".", "en", "s", "x"))
    return out + [(1, out[1][1], "en", "s", "x"), (900, None, None, None, None), (901, "", "en", "s", "x"), (None, "a b c", "en", "s", "x"), (902, "w " * 100_000, "en", "s", "x")]


def test_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), "t") for i in range(0, 600, 2)] + [(3, None, "t"), (None, 1, "t"), (5, 1, "t"), (5, 0, "t")], "doc_id long, quality int, text string")
    out = quality.classify(df, labels).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = [r.predicted == (r.doc_id % 4 != 0) for r in out if r.held_out and r.doc_id < 600]
    assert np.mean(right) > 0.95
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(rows()[:5], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5}
    assert quality.classify(df.limit(0), none).count() == 0


def test_held_out_labels_change_nothing(spark):
    """Scores stay the same if the held-out labels are turned round."""
    df = spark.createDataFrame(rows(), SCHEMA)
    lab = [(i, int(i % 4 != 0)) for i in range(0, 600, 2)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in lab]
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.classify(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (lab, turned))
    assert a == b


def test_order_of_rows_changes_nothing(spark):
    """Scores do not depend on the order or the parts in which Spark gives the rows."""
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    mixed = random.Random(5).sample(rows(), len(rows()))
    tables = [spark.createDataFrame(rows(), SCHEMA).coalesce(1), spark.createDataFrame(mixed, SCHEMA).coalesce(1), spark.createDataFrame(mixed, SCHEMA).repartition(5)]
    a, b, c = (sorted((str(r.doc_id), r.th, r.score) for r in quality.classify(df, labels).collect()) for df in tables)
    assert a == b == c


def test_held_out_accuracy(spark):
    pytest.importorskip("duckdb")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 500 and np.mean([r.predicted == r.quality for r in out]) > 0.97
