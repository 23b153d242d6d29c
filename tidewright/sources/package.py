"""Forecast packages: one JSON document a run, fanned out into a table for each of its collections and one for what is rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.storage import landed

#: The collections of a package, schema version 2.0, with their fields; `!` marks those an item has to have. What is
#: nested in an item stays nested.
PACKAGE = {
    "meta": "schema_version! string, project! string, domain string, as_of! date, target_metric! string, target_unit string, timezone string, status! string",
    "forecast_run": "run_id! string, generated_at! timestamp, previous_run_id string",
    "metric_definition": "name! string, formula string, grain string, source_of_truth string, inclusions array<string>, exclusions array<string>, aggregation string",
    "sources": "id! string, status! string, required boolean, covered_from date, covered_to date, fetched_at timestamp, notes string",
    "actual_series": "date! date, actual! double, adjusted double, adjustment_ids array<string>",
    "adjustments_log": "id! string, date! date, original_value double, adjusted_value double, reason string, method string, evidence string",
    "events_calendar": "id! string, date_from! date, date_to date, type string, status! string, scope string, expected_direction string, evidence string",
    "regime": "training_from! date, training_to! date, detection_method string, change_points array<struct<date: date, type: string, evidence: string>>, excluded_periods array<struct<date_from: date, date_to: date, reason: string>>, rationale string",
    "data_fingerprint": "algorithm! string, value! string, series_rows! bigint",
    "horizons": "value! int",
    "scenario_totals": "horizon! int, scenario! string, value! double",
    "uncertainty_totals": "horizon! int, p10! double, p50! double, p90! double",
    "daily_forecast": "date! date, p10! double, p50! double, p90! double, pessimistic double, base double, optimistic double",
    "model": "selected_model_id! string, baseline_model_id! string, training_from date, training_to date, minimum_lift_pct double, selection_reason string, candidate_models array<struct<id: string, method: string, complexity: string, eligible: boolean, metrics: array<struct<horizon: int, wape: double, mae: double, mase: double, bias: double>>>>, backtest_folds array<struct<fold_id: string, model_id: string, cutoff: date, horizon: int, observations: array<struct<date: date, actual: double, forecast: double, p10: double, p90: double>>>>, backtest_summary array<struct<horizon: int, wape: double, mae: double, mase: double, bias: double, wape_std: double, baseline_wape: double, lift_vs_baseline_pct: double, interval_coverage_pct: double, folds: int>>, uncertainty_method string, confidence string, notes string",
    "scenario_confidence": "base! string, pessimistic! string, optimistic! string",
    "drivers": "id! string, metric string, direction string, evidence string",
    "demand_signals": "id! string, metric string, value double, evidence string",
    "blockers": "id! string, severity string, metric string, evidence string, resolution string, probability! double, expected_loss_by_horizon map<string, double>, daily_loss array<struct<date: date, value: double>>",
    "actions": "id! string, priority string, lever string, metric string, baseline double, target double, start_date! date, lag_days int, ramp_curve string, completion_probability! double, outcome_probability! double, impact_cap double, impact_unit string, expected_impact_by_horizon map<string, double>, impact_range_by_horizon map<string, struct<low: double, high: double>>, daily_impact array<struct<date: date, value: double>>, evidence_level string, evidence_reference string, interaction_group string, overlap_discount double, cost struct<amount: double, currency: string>, resource string, dependency string, done_when string",
    "business_registry": "product! string, audience string, customer_job string, intent_type string, cluster_id! string, url string, cta string, conversion_event string, lead_quality_rule string, business_goal string, deal_lag_days int, visit_value_level string",
    "search_funnel": "status! string, notes string, stages array<struct<id: string, label: string, source: string, metric: string, unit: string, status: string>>, links array<struct<`from`: string, `to`: string, formula: string, validated: boolean>>, forecasts array<struct<horizon: int, stage_id: string, value: double, status: string>>",
    "hierarchical_forecasts": "dimension! string, status! string, coverage_share double, rows array<struct<segment: string, horizon: int, scenario: string, value: double>>, notes string",
    "learning_loop": "status! string, evaluations array<struct<run_id: string, horizon: int, forecast: double, actual: double, wape: double, bias: double>>, action_outcomes array<struct<action_id: string, status: string, actual_effect: double, identification_method: string, evidence: string, updated_effect_factor: double>>",
}
#: Collections that are one object; the others are lists of items.
OBJECTS = ["meta", "forecast_run", "metric_definition", "regime", "data_fingerprint", "model", "scenario_confidence", "search_funnel", "learning_loop"]
CORRUPT = "_corrupt_record"


@dataclass
class Package:
    """tables: a DataFrame (run, pos, fields) for each collection; rejects: (run, collection, pos, reason, item)."""

    tables: dict[str, DataFrame]
    rejects: DataFrame


def _required(collection: str) -> list[str]:
    return [f.split("!")[0].strip() for f in PACKAGE[collection].split(", ") if "! " in f]


def scan_nested_package(spark: SparkSession, path: str) -> Package:
    """The packages of a folder, one JSON document a file, read once.

    An item with a field of another type, or without one it has to have, goes to the rejects with the reason, and so do collections
    that are missing, unknown, or no list where one is due, and documents that are no JSON object at all (without a run).
    """
    docs = spark.read.text(path, wholetext=True)
    whole = docs.select("value", F.get_json_object("value", "$.forecast_run.run_id").alias("run"), F.from_json("value", "map<string,string>").alias("m"))
    bad_docs = whole.where("m is null").select("run", F.lit(None).cast("string").alias("collection"), F.lit(None).cast("int").alias("pos"), F.lit("no_object").alias("reason"), F.col("value").alias("item"))
    parts = whole.where("m is not null").select("run", F.explode("m").alias("collection", "body"))
    one = F.col("collection").isin(OBJECTS)
    listed = F.when(one, F.array("body")).otherwise(F.from_json("body", "array<string>"))
    parts = parts.withColumn("listed", listed).withColumn("known", F.col("collection").isin(list(PACKAGE)))
    missing = whole.where("m is not null").select("run", F.explode(F.array_except(F.array(*map(F.lit, PACKAGE)), F.map_keys("m"))).alias("collection"))
    nothing = [F.lit(None).cast("int").alias("pos")]
    lost = missing.select("run", "collection", *nothing, F.lit("missing_collection").alias("reason"), F.lit(None).cast("string").alias("item"))
    lost = lost.unionByName(parts.where("not known").select("run", "collection", *nothing, F.lit("unknown_collection").alias("reason"), F.col("body").alias("item")))
    lost = lost.unionByName(parts.where("known and listed is null").select("run", "collection", *nothing, F.lit("no_list").alias("reason"), F.col("body").alias("item")))
    items = landed(parts.where("known and listed is not null").select("run", "collection", F.posexplode("listed").alias("pos", "item")), "package-items")

    tables, rejects = {}, bad_docs.unionByName(lost)
    for name, fields in PACKAGE.items():
        schema = f"{fields.replace('!', '')}, {CORRUPT} string"
        raw = F.concat(F.lit('{"value":'), "item", F.lit("}")) if name == "horizons" else F.col("item")
        parsed = items.where(F.col("collection") == name).select("run", "pos", "item", F.from_json(raw, schema, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("r"))
        lacks = F.array_compact(F.array(*[F.when(F.col(f"r.{f}").isNull(), F.lit(f)) for f in _required(name)]))
        wrong = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
        reason = F.when(wrong, F.lit("bad_field")).when(F.size(lacks) > 0, F.concat(F.lit("missing:"), F.array_join(lacks, ",")))
        judged = parsed.withColumn("reason", reason)
        tables[name] = judged.where("reason is null").select("run", "pos", "r.*").drop(CORRUPT)
        rejects = rejects.unionByName(judged.where("reason is not null").select("run", F.lit(name).alias("collection"), "pos", "reason", "item"))
    return Package(tables, rejects)
