"""Queries that land files or replay streams: their inputs are the driver's tables, their files lie in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewright.functions.storage import shared_path
from tidewright.plans.ads import WEEKDAYS
from tidewright.plans.registry import query
from tidewright.sources import files as S
from tidewright.sources.package import OBJECTS, PACKAGE, scan_nested_package
from tidewright.streaming import jobs as J


def events(v):
    return v.events.withColumn("ts", F.col("ts").cast("timestamp"))


def landed(v, rows, label: str, by: str, files: int | None = None):
    """rows written as files, read back as a stream: all that has landed in one step, or some files at a time.

    Event-time jobs take one step, as files that land together have no order among them.
    """
    path = shared_path(v.spark, label)
    rows.repartitionByRange(4, by).write.parquet(path)
    reader = v.spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


@query("stream_closed_day_facts", "SELECT CAST(ts AS DATE) AS stat_date, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM {events} WHERE CAST(ts AS DATE) < (SELECT CAST(MAX(ts) - INTERVAL 1 HOUR AS DATE) FROM {events}) GROUP BY ALL")
def _(v):
    out = shared_path(v.spark, "closed-days")
    J.run_to_end(J.closed_day_facts(landed(v, events(v).select("ts", "event_type", "value"), "events", "ts")), shared_path(v.spark, "ck"), out)
    return v.spark.read.parquet(out).select("stat_date", "event_type", "n", F.round("value", 4).alias("value"))


@query("stream_first_seen", "SELECT DISTINCT user_id FROM {events}")
def _(v):
    out = shared_path(v.spark, "first-seen")
    J.run_to_end(J.first_seen(landed(v, events(v).select("ts", "user_id"), "events", "ts"), "user_id"), shared_path(v.spark, "ck"), out)
    return v.spark.read.parquet(out).select("user_id")


@query("stream_upsert_state", "SELECT user_id, MAX(ts) AS ts FROM {events} GROUP BY user_id")
def _(v):
    out = shared_path(v.spark, "state")
    sink = J.upsert_sink(v.spark, out, ["user_id"], buckets=64)
    J.run_to_end(landed(v, v.events.select("user_id", "event_type", "ts"), "events", "ts", files=1), shared_path(v.spark, "ck"), sink=sink)
    return J.state(v.spark, out).select("user_id", "ts")


@query("stream_anomaly", WEEKDAYS)
def _(v):
    out, seen = shared_path(v.spark, "anomalies"), shared_path(v.spark, "weekdays")
    days = v.daily_series.select("date", F.col("actual").alias("value"))
    status = v.fact_status.where("source = 'metrika' and scope = 'ecommerce'").select(F.col("stat_date").alias("date"), "complete")
    rows = days.join(status, "date", "left")
    J.run_to_end(landed(v, rows, "days", "date", files=1), shared_path(v.spark, "ck"), sink=J.anomaly_sink(v.spark, seen, out, min_abs=3.0))
    return J.findings(v.spark, out).select("date", "value", "median", "mad", F.round("z", 4).alias("z"), "complete", "severity")


MATURITY = """WITH e AS (SELECT CONCAT('c', CAST(user_id % 20 AS STRING)) AS campaign, ts, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked FROM {events}),
    s AS (SELECT campaign, MIN(ts) AS start FROM e GROUP BY campaign)
    SELECT s.campaign, d AS day, COUNT(*) AS sent, SUM(clicked) AS clicks FROM s, (VALUES (1), (3), (7), (14)) x(d), e WHERE e.campaign = s.campaign AND e.ts < start + d * INTERVAL 1 DAY
    AND start + d * INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM e) GROUP BY s.campaign, d"""


@query("stream_maturity", MATURITY)
def _(v):
    out = shared_path(v.spark, "maturity")
    e = events(v).select(F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("campaign"), "ts", (F.col("event_type") == "click").cast("int").alias("clicked"))
    with J.keyed_state(v.spark):
        J.run_to_end(J.maturity_snapshots(landed(v, e, "events", "ts").withWatermark("ts", "1 hour")), shared_path(v.spark, "ck"), out)
    return v.spark.read.parquet(out)


FACT = "SELECT Date AS stat_date, CampaignId, ROUND(Cost, 4) AS Cost FROM campaign_day"


def facts(v, where):
    return v.campaign_day.where(where).select(F.lit("direct").alias("source"), F.lit("campaign").alias("scope"), F.col("Date").alias("stat_date"), "CampaignId", F.round("Cost", 4).alias("Cost"))


@query("upsert_fact_partition", f"SELECT stat_date, CampaignId, CASE WHEN stat_date >= DATE '1995-01-01' THEN Cost * 2 ELSE Cost END AS Cost FROM ({FACT})")
def _(v):
    path = shared_path(v.spark, "facts")
    S.upsert_fact_partition(facts(v, "Date < '1996-01-01'"), path)
    S.upsert_fact_partition(facts(v, "Date >= '1995-01-01'").withColumn("Cost", F.col("Cost") * 2), path)
    return S.load_fact_range(v.spark, path, "direct", "campaign", "1990-01-01", "2001-12-31").select("stat_date", "CampaignId", "Cost")


@query("invalidate_facts", f"SELECT stat_date, CampaignId, Cost FROM ({FACT}) WHERE stat_date NOT BETWEEN DATE '1995-03-10' AND DATE '1996-02-20'")
def _(v):
    path = shared_path(v.spark, "facts")
    S.upsert_fact_partition(facts(v, "true"), path)
    S.invalidate_facts(v.spark, path, "1995-03-10", "1996-02-20", "direct", "campaign")
    return S.load_fact_range(v.spark, path, "direct", "campaign", "1990-01-01", "2001-12-31").select("stat_date", "CampaignId", "Cost")


@query("scan_tsv_report", "SELECT CAST(l_suppkey AS STRING) AS CampaignId, COUNT(*) AS Clicks FROM {lineitem} GROUP BY l_suppkey")
def _(v):
    path = shared_path(v.spark, "report")
    v.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("CampaignId")).agg(F.count("*").alias("Clicks")).write.csv(path, sep="\t", header=True)
    return S.scan_tsv_report(v.spark, path, "CampaignId string, Clicks long")


@query("scan_named_metrics_json", "SELECT CAST(l_suppkey AS STRING) AS campaign, COUNT(*) AS visits, SUM(l_quantity) AS metric_1 FROM {lineitem} GROUP BY l_suppkey")
def _(v):
    g = v.lineitem.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("a"), F.sum("l_quantity").alias("b"))
    body = F.to_json(F.struct(F.struct(F.array(F.lit("campaign")).alias("dimensions"), F.array(F.lit("visits")).alias("metrics")).alias("query"), F.array(F.struct(F.array(F.struct(F.col("l_suppkey").cast("string").alias("name"))).alias("dimensions"), F.array("a", "b").alias("metrics"))).alias("data")))
    m = S.scan_named_metrics(g.select(body.alias("value")))
    return m.select(F.element_at("dimensions", "campaign").alias("campaign"), F.element_at("metrics", "visits").cast("long").alias("visits"), F.element_at("metrics", "metric_1").alias("metric_1"))


@query("scan_visibility_export", "SELECT query, url, impressions, clicks, position FROM visibility")
def _(v):
    path = shared_path(v.spark, "export")
    v.visibility.select(F.col("query").alias("Запрос"), F.col("url").alias("Страница"), F.col("impressions").alias("Показы"), F.col("clicks").alias("Клики"), F.col("position").alias("Средняя позиция")).write.csv(path, header=True)
    return S.scan_visibility_export(v.spark, csv=path).select("query", "url", "impressions", "clicks", "position")


YEARS = "SELECT DISTINCT YEAR(date) AS y FROM daily_series"
#: What a year's package holds of each list, as SQL that gives y for each item.
ITEMS = {
    "sources": f"SELECT y FROM ({YEARS}), {{{{region}}}}", "actual_series": "SELECT YEAR(date) AS y FROM daily_series", "adjustments_log": "SELECT YEAR(date) AS y FROM daily_series WHERE CAST(actual AS INT) % 5 = 0",
    "events_calendar": "SELECT YEAR(date) AS y FROM daily_series WHERE DAY(date) = 1", "horizons": f"SELECT y FROM ({YEARS}), (VALUES (7), (30)) h(k)", "scenario_totals": f"SELECT y FROM ({YEARS}), (VALUES (7), (30)) h(k), (VALUES ('pessimistic'), ('base'), ('optimistic')) s(n)",
    "uncertainty_totals": f"SELECT y FROM ({YEARS}), (VALUES (7), (30)) h(k)", "daily_forecast": "SELECT YEAR(date) AS y FROM daily_series WHERE MONTH(date) = 12", "drivers": f"SELECT y FROM ({YEARS}), {{{{nation}}}}",
    "demand_signals": "SELECT YEAR(month) AS y FROM demand_monthly WHERE MONTH(month) = 6", "blockers": f"SELECT y FROM ({YEARS}), {{{{region}}}}", "actions": f"SELECT y FROM ({YEARS}), {{{{supplier}}}} WHERE s_suppkey % 9 = y % 9",
    "business_registry": f"SELECT y FROM ({YEARS}), {{{{part}}}} WHERE p_partkey % 40 = y % 40", "hierarchical_forecasts": f"SELECT y FROM ({YEARS}), {{{{region}}}}",
}
ITEMS = {k: q.replace("{{", "{").replace("}}", "}") for k, q in ITEMS.items()}
BAD = "SELECT y, 'actual_series' AS c FROM (SELECT YEAR(date) AS y, actual FROM daily_series) WHERE CAST(actual AS INT) % 7 = 3"
FANNED = " UNION ALL ".join([*[f"SELECT y, '{k}' AS c FROM ({q})" for k, q in ITEMS.items()], *[f"SELECT y, '{k}' AS c FROM ({YEARS})" for k in OBJECTS]])


@query("scan_nested_package", f"WITH a AS ({FANNED}), b AS ({BAD}), n AS (SELECT y, c, COUNT(*) AS n FROM a GROUP BY y, c), m AS (SELECT y, c, COUNT(*) AS m FROM b GROUP BY y, c) SELECT CAST(n.y AS STRING) AS run, n.c AS collection, n - COALESCE(m, 0) AS items, COALESCE(m, 0) AS rejected FROM n LEFT JOIN m ON n.y = m.y AND n.c = m.c WHERE n - COALESCE(m, 0) > 0")
def _(v):
    """A package for each year of the daily series with all 23 collections; some of its days have no number for a fact."""
    path = shared_path(v.spark, "package")
    fill = {"string": F.lit("x"), "date": F.lit("2024-01-02"), "timestamp": F.lit("2024-01-02T03:04:05Z"), "double": F.lit(1.5), "int": F.lit(7), "bigint": F.lit(9), "boolean": F.lit(True)}
    own = lambda name: [fill[kind].alias(key) for key, _, kind in (f.replace("!", "").partition(" ") for f in PACKAGE[name].split(", ")) if kind in fill]
    docs = v.sql(YEARS)
    for name, text in ITEMS.items():
        rows = v.sql(text).select("y", F.to_json(F.struct(*own(name))).alias("item")) if name not in ("actual_series", "horizons") else None
        if name == "actual_series":
            number = F.when(F.col("actual").cast("int") % 7 == 3, F.lit('"n/a"')).otherwise(F.col("actual").cast("string"))
            rows = v.daily_series.select(F.year("date").alias("y"), F.concat(F.lit('{"date":"'), F.col("date").cast("string"), F.lit('","actual":'), number, F.lit("}")).alias("item"))
        if name == "horizons":
            rows = v.sql(f"SELECT y, CAST(k AS STRING) AS item FROM ({YEARS}), (VALUES (7), (30)) h(k)")
        body = rows.groupBy("y").agg(F.concat(F.lit(f'"{name}":['), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias(name))  # one year's
        docs = docs.join(body, "y", "left")
    lists = [F.coalesce(n, F.lit(f'"{n}":[]')) for n in ITEMS]
    run = F.concat(F.lit('"forecast_run":{"run_id":"'), F.col("y").cast("string"), F.lit('","generated_at":"2024-01-02T03:04:05Z"}'))
    objects = [F.concat(F.lit(f'"{n}":'), F.to_json(F.struct(*own(n)))) for n in OBJECTS if n != "forecast_run"]
    whole = docs.select("y", F.concat(F.lit("{"), F.concat_ws(",", *lists, *objects, run), F.lit("}")).alias("value"))
    whole.repartition("y").write.partitionBy("y").option("maxRecordsPerFile", 1).text(path)
    got = scan_nested_package(v.spark, f"{path}/*")
    counts = [t.groupBy("run").agg(F.count("*").alias("items")).select("run", F.lit(name).alias("collection"), "items") for name, t in got.tables.items()]
    lost = got.rejects.groupBy("run", "collection").agg(F.count("*").alias("rejected"))
    return reduce(lambda a, b: a.unionByName(b), counts).join(lost, ["run", "collection"], "left").select("run", "collection", "items", F.coalesce("rejected", F.lit(0)).alias("rejected"))
