"""Incremental jobs on Structured Streaming; batch runs replay landed files with trigger(availableNow=True)."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.functions.storage import landed
from tidewright.operators.adperf import weekday_anomaly
from tidewright.operators.market import keyed_state_merge
from tidewright.sources.parted import PartedTable


def closed_day_facts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and values per day and type; append mode gives a day only when the watermark has passed its end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").cast("date").alias("stat_date"), "event_type", "n", "value")


def first_seen(items: DataFrame, key: str, ts: str = "ts", horizon: str = "30 days") -> DataFrame:
    """The first row of each key inside the horizon; the bound on what is remembered is time, not a count."""
    return items.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


DAY = 86_400_000_000  # microseconds
SNAPSHOT = "campaign string, day int, sent long, clicks long"


def _snapshots(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"campaign": "object", "day": "int32", "sent": "int64", "clicks": "int64"}
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate(kinds.items())})


class Maturity(StatefulProcessor):
    """Totals of a campaign at each of its ages, counted from its first event.

    Until the watermark has passed the first event an earlier one may still come, so events wait in a list; then the start is
    settled, each event counts for all ages it is younger than, and a timer at each age gives that age's totals. A campaign that
    falls silent gets its snapshots all the same, as timers follow the watermark of the whole stream.
    """

    def __init__(self, days: tuple[int, ...]) -> None:
        self.days = sorted(days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at long, settled boolean, given int")
        self.waiting = handle.getListState("waiting", "at long, clicked int")
        self.totals = handle.getMapState("totals", "day int", "sent long, clicks long")

    def _count(self, start: int, events: Iterator[tuple[int, int]]) -> None:
        new = {d: [0, 0] for d in self.days}
        for at, clicked in events:
            for d in self.days:
                if at < start + d * DAY:
                    new[d][0] += 1
                    new[d][1] += clicked
        for d, (sent, clicks) in new.items():
            if sent:
                was = self.totals.getValue((d,)) if self.totals.containsKey((d,)) else (0, 0)
                self.totals.updateValue((d,), (was[0] + sent, was[1] + clicks))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, settled, given = self.start.get() if self.start.exists() else (None, False, 0)
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            events = list(zip(at.tolist(), pdf["clicked"].astype(int).tolist(), strict=True))
            if settled:
                self._count(start, iter(events))
                continue
            self.waiting.appendList(events)
            if start is None or at.min() < start:
                if start is not None:
                    self.handle.deleteTimer(start // 1000 + 1)
                start = int(at.min())
                self.handle.registerTimer(start // 1000 + 1)
        self.start.update((start, settled, given))
        yield _snapshots([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, settled, given = self.start.get()
        if not settled:
            self._count(start, self.waiting.get())
            self.waiting.clear()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while given < len(self.days) and -(-(start + self.days[given] * DAY) // 1000) <= now:
            d = self.days[given]
            sent, clicks = self.totals.getValue((d,)) if self.totals.containsKey((d,)) else (0, 0)
            out.append((key[0], d, sent, clicks))
            given += 1
        if given < len(self.days):
            self.handle.registerTimer(-(-(start + self.days[given] * DAY) // 1000))
        self.start.update((start, True, given))
        yield _snapshots(out)

    def close(self) -> None:
        pass


def maturity_snapshots(events: DataFrame, days: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """(campaign, day, sent, clicks): totals of a campaign over the events before each of its ages, once the watermark has reached
    that age. events: campaign, ts, clicked (0 or 1), with a watermark; run it inside keyed_state()."""
    return events.groupBy("campaign").transformWithStateInPandas(Maturity(days), SNAPSHOT, "Append", "EventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with several variables a key needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def upsert_sink(spark: SparkSession, path: str, keys: list[str], buckets: int = 1024) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that merges each batch by key into a table of hash buckets, of which a batch rewrites those it touches.

    The last column orders the rows of a key: the newest counts, and a late row that is older than what is stored changes nothing.
    A null keeps what is stored. The batch's number is part of the commit, so a batch that is run again changes nothing.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        table = PartedTable(spark, path, ["_bucket"])
        if table.manifest()["note"].get("epoch", -1) >= epoch:
            return
        order = batch.columns[-1]
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        newest = landed(newest, "upsert")
        touched = {str(r[0]) for r in newest.select("_bucket").distinct().collect()}  # `buckets` rows at most
        old = table.read(lambda p: p[0] in touched, newest.schema)
        stored = old.select(*keys, F.col(order).alias("_at"))
        fresh = newest.join(stored, keys, "left").where(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_at")
        merged = keyed_state_merge(old, fresh, [*keys, "_bucket"]).select(newest.columns)
        table.replace(merged, {"epoch": epoch})

    return sink


def state(spark: SparkSession, path: str) -> DataFrame:
    """What an upsert_sink has stored."""
    return PartedTable(spark, path, ["_bucket"]).read().drop("_bucket")


#: Days of one part of the history: as many as a day looks back.
BLOCK = 28


def anomaly_sink(spark: SparkSession, history: str, found: str, threshold: float = 3.5, min_abs: float = 20.0) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: days (date, value, complete) join a history of four-week blocks, and the findings of weekday_anomaly are
    brought up to date for the blocks that the batch touches and the ones behind them. Days may come in any order and again;
    what a batch reads and writes follows its own days, not the history."""
    block = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / BLOCK).alias("block")

    def sink(batch: DataFrame, epoch: int) -> None:
        past, findings = PartedTable(spark, history, ["block"]), PartedTable(spark, found, ["block"])
        if findings.manifest()["note"].get("epoch", -1) >= epoch:
            return
        new = landed(batch.select("date", "value", "complete", block), "days")
        touched = {r[0] for r in new.select("block").distinct().collect()}  # blocks of one batch
        if not touched:
            return
        near = {str(b + k) for b in touched for k in (-1, 0, 1)}
        old = past.read(lambda p: p[0] in near, new.schema).join(new.select("date"), "date", "left_anti").select(new.columns)
        days = landed(old.unionByName(new), "days")
        past.replace(days.where(F.col("block").isin(sorted(touched))))
        status = days.where("complete is not null").select(F.col("date").alias("stat_date"), "complete")
        again = sorted({b + k for b in touched for k in (0, 1)})
        rows = weekday_anomaly(days.select("date", "value"), status, threshold, min_abs).withColumn("block", block).where(F.col("block").isin(again))
        findings.replace(rows, {"epoch": epoch})

    return sink


def findings(spark: SparkSession, path: str) -> DataFrame:
    """What an anomaly_sink has found so far, a row for each day."""
    return PartedTable(spark, path, ["block"]).read().drop("block")


def run_to_end(stream: DataFrame, checkpoint: str, path: str | None = None, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process all that has landed, then stop."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").option("path", path).start()
    q.awaitTermination()
