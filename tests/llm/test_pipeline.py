import zlib

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, n string, row string"
TEXT = "The old man walked down to the sea and looked at the waves for a long time before he spoke to his wife about the boat."


def run(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_edge_cases(spark, tmp_path):
    texts = [(i, f"{TEXT} Number {i * 7919} of this tale is told {i} times in {i + 3} towns, and each of them tells it in other words {'x' * i}.") for i in range(12)]
    odd = [(20, None), (21, ""), (21, ""), (22, "   "), (None, "no id but words enough to stay in the mix"), (3, "another text under an id that is taken"), (24, "mail me at someone@example.com or call +1 743 555 3824"), (25, "long " * 50_000)]
    rows = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or ""), f"_{i}", "n", "r") for i, t in [*texts, *texts[:2], *odd]]
    out = run(spark, tmp_path, rows, [(i, 1, 0) for i in range(12)]).collect()
    assert out and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    docs = {r.doc_id for r in out}
    assert docs <= {i for i, *_ in rows} and 0 in docs
    whole = {}
    for r in out:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for (_, n), pieces in whole.items():
        assert sum(k for _, k in pieces) % n == 0
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{TEXT} {i}" + " word" * i, "en", "s", 1, f"_{i}", f"n{i}", f"r{i}") for i in range(6)], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and all((r["_id"], r.n, r.row) == (f"_{r.doc_id}", f"n{r.doc_id}", f"r{r.doc_id}") for r in out.collect())


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []).count() == 0
