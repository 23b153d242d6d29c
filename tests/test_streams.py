"""Parted tables, streams with state: expected rows, restarts, failures half-way."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewright.operators import adperf
from tidewright.sources import files
from tidewright.sources.parted import PartedTable
from tidewright.streaming import jobs

D = datetime.date


def facts(spark, days, cost, source="direct"):
    return spark.createDataFrame([(source, "campaign", D(2024, 1, d), f"c{d}", cost) for d in days], "source string, scope string, stat_date date, CampaignId string, Cost double")


def stored(spark, path):
    return {(r.stat_date.day, r.Cost) for r in files.load_fact_range(spark, path, "direct", "campaign", "2024-01-01", "2024-12-31").collect()}


def test_a_failure_half_way_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    files.upsert_fact_partition(facts(spark, range(1, 6), 1.0), path)
    old = {(d, 1.0) for d in range(1, 6)}
    with monkeypatch.context() as m:
        m.setattr(PartedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            files.upsert_fact_partition(facts(spark, range(4, 9), 2.0), path)
    assert stored(spark, path) == old
    half = Path(path) / "manifest" / f"{1:012d}.json"
    half.write_text('{"version": 1, "par')  # a manifest whose writer was lost
    assert stored(spark, path) == old
    half.unlink()
    files.upsert_fact_partition(facts(spark, range(4, 9), 2.0), path)
    assert stored(spark, path) == {(d, 1.0) for d in range(1, 4)} | {(d, 2.0) for d in range(4, 9)}


def test_invalidated_days_go_together(spark, tmp_path):
    path = str(tmp_path / "facts")
    files.upsert_fact_partition(facts(spark, range(1, 11), 1.0).unionByName(facts(spark, range(1, 11), 5.0, "other")), path)
    reader = files.load_fact_range(spark, path, "direct", "campaign", "2024-01-01", "2024-12-31")
    assert files.invalidate_facts(spark, path, "2024-01-03", "2024-01-05", source="direct") == 3
    assert stored(spark, path) == {(d, 1.0) for d in (1, 2, *range(6, 11))}
    assert reader.count() == 10  # one that began before still has its files
    assert files.load_fact_range(spark, path, "other", "campaign", "2024-01-01", "2024-12-31").count() == 10
    assert files.invalidate_facts(spark, path, "2024-01-01", "2024-12-31") == 17 and stored(spark, path) == set()


def test_only_the_wanted_months_are_read_and_rewritten(spark, tmp_path):
    path = str(tmp_path / "facts")
    year = facts(spark, [1], 1.0).withColumn("stat_date", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))))
    files.upsert_fact_partition(year, path)
    one = files.load_fact_range(spark, path, "direct", "campaign", "2024-03-30", "2024-04-02")
    assert one.count() == 4 and len(one.inputFiles()) == 2
    before = PartedTable(spark, path, files.FACT_PARTS).manifest()["parts"]
    files.upsert_fact_partition(year.where("stat_date = '2024-05-05'").withColumn("Cost", F.lit(9.0)), path)
    assert files.invalidate_facts(spark, path, "2024-06-10", "2024-08-20") == 72
    after = PartedTable(spark, path, files.FACT_PARTS).manifest()["parts"]
    assert {p["values"][2] for k, p in before.items() if after.get(k) != p} == {"2024-05", "2024-06", "2024-07", "2024-08"}
    rows = files.load_fact_range(spark, path, "direct", "campaign", "2024-01-01", "2024-12-31").collect()
    assert len(rows) == 366 - 72 and [str(r.stat_date) for r in rows if r.Cost == 9.0] == ["2024-05-05"]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"), ["k"])
    table.replace(spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string"))
    other = PartedTable(spark, table.path, ["k"])
    stale = other.manifest()
    table.replace(spark.createDataFrame([(1, "c")], "k int, v string"))
    other.manifest = lambda: stale
    with pytest.raises(Exception, match="already exists"):
        other.replace(spark.createDataFrame([(1, "d")], "k int, v string"))
    assert {tuple(r) for r in table.read().collect()} == {(1, "c"), (None, "b")}


def test_old_folders_are_removed(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"), ["k"])
    for i in range(6):
        table.replace(spark.createDataFrame([(1, str(i)), (2, "x")] if i == 0 else [(1, str(i))], "k int, v string"))
    assert {tuple(r) for r in table.read().collect()} == {(1, "5"), (2, "x")}
    assert len(list((tmp_path / "t" / "data").glob("*/_part=*"))) <= 5


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "id long, name string, at long"
    sink = jobs.upsert_sink(spark, path, ["id"], buckets=32)
    sink(spark.createDataFrame([(i, f"n{i}", 1) for i in range(100)], schema), 0)
    before = PartedTable(spark, path, ["_bucket"]).manifest()["parts"]
    late = spark.createDataFrame([(1, "new", 5), (2, "older", 0), (3, None, 7), (777, "first", 1), (1, "mid", 3)], schema)
    sink(late, 1)
    table = PartedTable(spark, path, ["_bucket"])
    after = table.manifest()
    changed = {k for k, p in after["parts"].items() if before.get(k) != p}
    assert 0 < len(changed) <= 4
    rows = {r.id: (r.name, r.at) for r in jobs.state(spark, path).collect()}
    assert rows == {i: (f"n{i}", 1) for i in range(100)} | {1: ("new", 5), 3: ("n3", 7), 777: ("first", 1)}
    sink(late.withColumn("name", F.lit("again")), 1)  # the same batch after a restart
    assert table.manifest()["version"] == after["version"]


def replay(spark, tmp_path, batches, schema, build):
    """Run a stream over one file for each batch, in their order."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
    source.mkdir()
    for k in range(len(batches)):
        (part,) = (tmp_path / f"b{k}").glob("*.parquet")
        target = source / f"{k:03d}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    return build(stream)


def test_maturity_of_late_and_silent_campaigns(spark, tmp_path):
    t = lambda day, hour=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)
    batches = [
        [("a", t(0, 5), 1), ("b", t(0, 2), 0)],
        [("a", t(0, 4), 0), ("a", t(0, 6), 0), ("b", t(1, 1), 1)],  # a's first event comes second
        [("a", t(1, 3), 1), ("b", t(1, 2), 1)],  # inside a's first day, and not inside b's
        [("c", t(5), 1)],  # a and b fall silent
        [("c", t(9), 0)],
        [("d", t(30), 0)],
        [("c", t(2), 1)],  # too late
    ]
    out = str(tmp_path / "out")

    def build(stream):
        with jobs.keyed_state(spark):
            jobs.run_to_end(jobs.maturity_snapshots(stream.withWatermark("ts", "3 hours")), str(tmp_path / "ck"), out)
        return spark.read.parquet(out)

    got = {tuple(r) for r in replay(spark, tmp_path, batches, "campaign string, ts timestamp, clicked int", build).collect()}
    want = {("a", 1, 4, 2), ("b", 1, 2, 1)} | {("a", d, 4, 2) for d in (3, 7, 14)} | {("b", d, 3, 2) for d in (3, 7, 14)}
    want |= {("c", d, 1, 1) for d in (1, 3)} | {("c", d, 2, 1) for d in (7, 14)}
    assert got == want


def test_anomalies_day_by_day_are_those_of_the_whole(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(D(2024, 1, 1) + datetime.timedelta(days=k), float(rnd.choice([100, 104, 98, 260])), rnd.random() < 0.9) for k in range(120)]
    first = rows[:90]
    rnd.shuffle(first)
    corrected = [(d, v + 150, ok) for d, v, ok in rows[60:63]]
    batches = [first[:40], first[40:], rows[90:91], rows[91:], corrected]
    schema, past, found = "date date, value double, complete boolean", str(tmp_path / "past"), str(tmp_path / "found")

    def build(stream):
        jobs.run_to_end(stream, str(tmp_path / "ck"), sink=jobs.anomaly_sink(spark, past, found))
        return jobs.findings(spark, found)

    got = sorted(tuple(r) for r in replay(spark, tmp_path, batches, schema, build).collect())
    final = spark.createDataFrame(sorted({r[0]: r for r in rows + corrected}.values()), schema)
    want = adperf.weekday_anomaly(final.select("date", "value"), final.select(F.col("date").alias("stat_date"), "complete"))
    assert got == sorted(tuple(r) for r in want.collect())
    sink = jobs.anomaly_sink(spark, past, found)
    version = PartedTable(spark, found, ["block"]).manifest()["version"]
    sink(spark.createDataFrame(rows[:1], schema), 4)
    assert PartedTable(spark, found, ["block"]).manifest()["version"] == version
