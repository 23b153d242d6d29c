"""Advertising facts: reconciliation with web revenue, roll-ups, comparisons, coverage, anomalies, diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.expr import delta_pct, number, ratio
from tidewright.functions.storage import landed

DIRECT, BUSINESS = ["Impressions", "Clicks", "Cost", "DirectCTR", "DirectCPC"], ["MetrikaRevenue", "MetrikaTransactions", "CrossSourceROAS", "CrossSourceDRR", "MetrikaCPA", "MetrikaCR", "AOV"]


def enrich_campaign_attributes(facts: DataFrame, campaigns: DataFrame, attributes: list[str]) -> DataFrame:
    """Status, state and type of each campaign by id; unmatched facts keep null."""
    dim = campaigns.groupBy("CampaignId").agg(*[F.max(a).alias(a) for a in attributes])
    return facts.drop(*attributes).join(dim, "CampaignId", "left")


def reconcile_campaign_day(direct: DataFrame, ecom: DataFrame, allow_name: bool = False, order: str = "row_id") -> DataFrame:
    """Pair web revenue with campaigns by day and id, or by name where allowed; revenue without a campaign is never dealt out.

    The last row of a repeated campaign key in a day wins. A campaign with any revenue matched by name is estimated.
    """
    w = Window.partitionBy("Date", "CampaignId")
    d = direct.where("CampaignId is not null and CampaignId <> ''").withColumn("_n", F.row_number().over(w.orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    d = landed(d, "campaign-days")  # campaigns are read up to four times, worked out once
    sums = landed(ecom.groupBy("Date", "UTMCampaign").agg(F.sum(number("revenue")).alias("revenue"), F.sum(number("purchases")).alias("transactions")), "campaign-revenue")
    keys = d.select("Date", F.col("CampaignId").alias("UTMCampaign"))
    exact = sums.join(keys, ["Date", "UTMCampaign"], "left_semi").select("Date", F.col("UTMCampaign").alias("CampaignId"), "revenue", "transactions", F.lit(False).alias("by_name"))
    if allow_name:
        names = d.withColumn("_l", F.lower("CampaignName")).withColumn("_n", F.row_number().over(Window.partitionBy("Date", "_l").orderBy(order))).where("_n = 1").select("Date", "_l", "CampaignId")
        rest = sums.join(keys, ["Date", "UTMCampaign"], "left_anti").withColumn("_l", F.lower("UTMCampaign")).where("_l <> ''")
        exact = exact.unionByName(rest.join(names, ["Date", "_l"]).select("Date", "CampaignId", "revenue", "transactions", F.lit(True).alias("by_name")))
    found = exact.groupBy("Date", "CampaignId").agg(F.sum("revenue").alias("MetrikaRevenue"), F.sum("transactions").alias("MetrikaTransactions"), F.bool_or("by_name").alias("_est"))
    level = F.when(F.col("_est").isNull(), "unpaired_direct").when(F.col("_est"), "estimated").otherwise("exact")
    confidence = F.when(F.col("_est").isNull(), 0.0).when(F.col("_est"), 0.7).otherwise(1.0)
    return d.join(found, ["Date", "CampaignId"], "left").withColumn("attribution_level", level).withColumn("match_confidence", confidence).drop("_est")


def reconcile_summary(reconciled: DataFrame, ecom: DataFrame) -> DataFrame:
    """One row: campaigns by level, matched and unattributed revenue, status complete if nothing is unattributed."""
    n = lambda level: F.count_if(F.col("attribution_level") == level).alias(f"{level}_campaigns")
    left = reconciled.agg(F.count("*").alias("direct_campaigns"), n("exact"), n("estimated"), n("unpaired_direct"), F.coalesce(F.sum("MetrikaRevenue"), F.lit(0.0)).alias("matched"), F.coalesce(F.sum("MetrikaTransactions"), F.lit(0.0)).alias("matched_tx"), F.sum("Cost").alias("direct_cost"))
    right = ecom.agg(F.coalesce(F.sum(number("revenue")), F.lit(0.0)).alias("all_revenue"), F.coalesce(F.sum(number("purchases")), F.lit(0.0)).alias("all_tx"))
    rest = F.round(F.col("all_revenue") - F.col("matched"), 2)
    return left.join(F.broadcast(right)).select("direct_campaigns", "exact_campaigns", "estimated_campaigns", "unpaired_direct_campaigns", rest.alias("unattributed_revenue"), F.round(F.col("all_tx") - F.col("matched_tx"), 2).alias("unattributed_transactions"), F.round("direct_cost", 2).alias("direct_cost"), F.round("matched", 2).alias("matched_revenue"), F.when(rest == 0, "complete").otherwise("incomplete").alias("status"))


def rollup_sums() -> list[Column]:
    """Sums behind every KPI; money and clicks of the business side come from matched rows only."""
    hit = F.col("MetrikaRevenue").isNotNull() & F.col("attribution_level").isin("exact", "estimated")
    of = lambda c: F.coalesce(F.sum(F.when(hit, number(c))), F.lit(0.0))
    return [F.count("*").alias("rows"), *[F.sum(number(c)).alias(c) for c in ("Impressions", "Clicks", "Cost")], F.count_if(hit).alias("business_rows"), of("Cost").alias("matched_cost"), of("Clicks").alias("matched_clicks"), of("MetrikaRevenue").alias("_revenue"), of("MetrikaTransactions").alias("_tx"), F.count_if(hit & F.col("MetrikaTransactions").isNull()).alias("_unknown")]


def derived_kpis(sums: DataFrame, keys: list[str]) -> DataFrame:
    """KPIs of rollup_sums; transactions are unknown if any matched row lacks them, and so is what divides by them."""
    some, paid = F.col("business_rows") > 0, (F.col("business_rows") > 0) & (F.col("matched_cost") > 0)
    revenue, tx = F.col("_revenue"), F.when(F.col("_unknown") == 0, F.col("_tx"))
    over = lambda a, b, k=1.0: F.when(b != 0, a / b * k)
    return sums.select(
        *keys, "Impressions", "Clicks", "Cost",
        over(F.col("Clicks"), F.col("Impressions"), 100.0).alias("DirectCTR"), over(F.col("Cost"), F.col("Clicks")).alias("DirectCPC"),
        F.when(some, revenue).alias("MetrikaRevenue"), F.when(some, tx).alias("MetrikaTransactions"), F.when(some, F.col("matched_cost")).alias("matched_direct_cost"), over(F.col("business_rows"), F.col("rows")).alias("attribution_coverage"),
        F.when(paid, over(revenue, F.col("matched_cost"), 100.0)).alias("CrossSourceROAS"), F.when(paid, over(F.col("matched_cost"), revenue, 100.0)).alias("CrossSourceDRR"),
        F.when(paid, over(F.col("matched_cost"), tx)).alias("MetrikaCPA"), F.when(paid, over(tx, F.col("matched_clicks"), 100.0)).alias("MetrikaCR"), F.when(paid, over(revenue, tx)).alias("AOV"),
    )


def dimension_rollup(facts: DataFrame, dimension: str) -> DataFrame:
    """KPIs per value of a dimension; a missing value is shown as a dash."""
    key = F.coalesce(F.when(F.col(dimension).cast("string") != "", F.col(dimension).cast("string")), F.lit("—")).alias("key")
    return derived_kpis(facts.groupBy(key).agg(*rollup_sums()), ["key"])


def grand_total(facts: DataFrame) -> DataFrame:
    """The same KPIs over all source rows, not over groups."""
    return derived_kpis(facts.groupBy(F.lit("TOTAL").alias("key")).agg(*rollup_sums()), ["key"])


def top_n_dimension(facts: DataFrame, dimension: str, n: int) -> DataFrame:
    """The n values that cost most; 0 gives all."""
    r = dimension_rollup(facts, dimension).orderBy(F.col("Cost").desc(), "key")
    return r.limit(n) if n else r


def between(df: DataFrame, start: str, end: str, col: str = "Date") -> DataFrame:
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def period_compare(current: DataFrame, previous: DataFrame, dimension: str, metrics: list[str] | None = None) -> DataFrame:
    """Current KPIs per value and their change in per cent of the previous period's; null where that is missing or 0."""
    metrics = metrics or DIRECT + BUSINESS
    prior = dimension_rollup(previous, dimension).select("key", *[F.col(m).alias(f"_{m}") for m in metrics])
    return dimension_rollup(current, dimension).join(prior, "key", "left").select("key", *metrics, *[delta_pct(m, f"_{m}").alias(f"{m}_delta_pct") for m in metrics])


def likely_drivers(current: DataFrame, previous: DataFrame, metric: str, n: int = 3) -> DataFrame:
    """Campaigns of both periods with the largest change of a metric, and their share of the account's change."""
    a, b = (dimension_rollup(d, "CampaignName").select("key", F.col(metric).alias(x)) for d, x in ((current, "current"), (previous, "previous")))
    ta, tb = (grand_total(d).select(F.coalesce(F.col(metric), F.lit(0.0)).alias(x)) for d, x in ((current, "_ta"), (previous, "_tb")))
    both = a.join(b, "key").withColumn("delta", F.col("current") - F.col("previous")).where("delta <> 0")
    both = both.join(F.broadcast(ta.join(tb)))
    return both.select("key", "current", "previous", "delta", F.when(F.col("_ta") != F.col("_tb"), F.col("delta") / (F.col("_ta") - F.col("_tb"))).alias("contribution_share")).orderBy(F.abs("delta").desc(), "key").limit(n)


def session_totals(sessions: DataFrame) -> DataFrame:
    """Visits, users and the sum of all goal*reaches columns."""
    goals = [c for c in sessions.columns if c.startswith("goal") and c.endswith("reaches")]
    reach = sum((number(c) for c in goals), F.lit(0.0))
    return sessions.agg(*[F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(c) for c in ("visits", "users")], F.coalesce(F.sum(reach), F.lit(0.0)).alias("goal_reaches"))


def funnel_compare(current: DataFrame, previous: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Eight stages from serving to order value: current, previous, absolute change and change in per cent."""
    stages = [("serving", "Impressions"), ("click", "Clicks"), ("click_efficiency", "DirectCTR"), ("post_click", "visits"), ("goal", "goal_reaches"), ("business", "MetrikaTransactions"), ("business", "MetrikaRevenue"), ("business_value", "AOV")]

    def long(facts: DataFrame, sessions: DataFrame, name: str) -> DataFrame:
        one = session_totals(sessions).join(grand_total(facts), F.lit(True), "left")
        return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for s, m in stages])).alias("x")).select("x.*")

    both = long(current, now, "current").join(long(previous, before, "previous"), ["stage", "metric"])
    return both.select("stage", "metric", "current", "previous", (F.col("current") - F.col("previous")).alias("delta"), delta_pct("current", "previous").alias("delta_pct"))


def confirmed_causes(facts: DataFrame) -> DataFrame:
    """Campaigns whose status is known and not ON."""
    return facts.where("CampaignStatus is not null and CampaignStatus not in ('', 'ON')").groupBy(F.coalesce("CampaignName", "CampaignId").alias("campaign"), "CampaignStatus").agg(F.count("*").alias("rows"))


#: Rule, metrics of which one must have fallen.
HYPOTHESES = [("serving_or_demand", ["Impressions"]), ("click_acquisition", ["Clicks", "DirectCTR"]), ("post_click", ["visits", "goal_reaches"]), ("conversion_or_attribution", ["MetrikaTransactions", "MetrikaRevenue"])]


def hypothesis_rules(funnel: DataFrame, metric: str) -> DataFrame:
    """Hypotheses that the fallen stages suggest; one fallback if there are none."""
    fallen = funnel.agg(F.coalesce(F.collect_set(F.when(F.col("delta") < 0, F.col("metric"))), F.array().cast("array<string>")).alias("m"))
    asked = F.lit(metric in ("MetrikaRevenue", "CrossSourceROAS"))
    hits = [F.when(F.arrays_overlap("m", F.array(*[F.lit(x) for x in ms])) | (asked if rule.startswith("conversion") else F.lit(False)), F.lit(rule)) for rule, ms in HYPOTHESES]
    found = F.array_compact(F.array(*hits))
    return fallen.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no_driver_isolated")))).alias("hypothesis"))


def diagnosis_record(current: DataFrame, previous: DataFrame, now: DataFrame, before: DataFrame, metric: str, complete: bool, most: int = 20) -> DataFrame:
    """One row that holds funnel, confirmed causes, drivers (only if the data are complete) and hypotheses. Of the causes it names
    the `most` with the most rows, of the drivers the first `most`, and the number of all beside them."""
    funnel = funnel_compare(current, previous, now, before)
    drivers = likely_drivers(current, previous, metric) if complete else likely_drivers(current, previous, metric).limit(0)
    causes = confirmed_causes(current)
    rows = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    top = causes.orderBy(F.col("rows").desc(), "campaign", "CampaignStatus").limit(most)
    named = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("o"), F.struct("campaign", "CampaignStatus", "rows").alias("x")))).alias("c")).select(F.col("c.x").alias("confirmed_causes"))
    parts = [rows(funnel, "funnel"), named, causes.agg(F.count("*").alias("causes")), rows(drivers.limit(most), "likely_drivers"), rows(hypothesis_rules(funnel, metric), "hypotheses")]
    out = reduce(lambda a, b: a.join(b), parts)  # one row each
    level = F.when(F.lit(not complete), "low").when(F.col("causes") > 0, "high").otherwise("medium")
    return out.select(F.lit(metric).alias("metric"), F.lit(complete).alias("complete"), "*", level.alias("confidence"))


def guardrail_alerts(rollup: DataFrame, rules: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Values outside a metric's limits; unknown metrics are skipped."""
    each = []
    for metric, low, high in rules:
        v = F.col(metric).cast("double")
        each += [F.struct(F.lit(metric).alias("metric"), F.lit("min").alias("bound"), F.lit(low).cast("double").alias("limit"), F.when(v < low, v).alias("value"))] if low is not None else []
        each += [F.struct(F.lit(metric).alias("metric"), F.lit("max").alias("bound"), F.lit(high).cast("double").alias("limit"), F.when(v > high, v).alias("value"))] if high is not None else []
    return rollup.select("key", F.explode(F.array(*each)).alias("a")).select("key", "a.*").where("value is not null")


def report_spec_query(facts: DataFrame, dimension: str, metrics: list[str], top: int = 0, period: tuple[str, str] | None = None) -> DataFrame:
    """A report of registered metrics over a registered dimension; anything else is refused before planning."""
    known = {"campaign": "CampaignName", "type": "CampaignType", "region": "Region"}
    if dimension not in known or not set(metrics) <= set(DIRECT + BUSINESS + ["matched_direct_cost", "attribution_coverage"]):
        raise ValueError(f"unknown dimension or metric: {dimension}, {metrics}")
    facts = between(facts, *period) if period else facts
    return top_n_dimension(facts, known[dimension], top).select("key", *metrics)


def expected_days(spark_df: DataFrame, start: str, end: str, requirements: list[tuple[str, str]]) -> DataFrame:
    """(source, scope, stat_date): every day of a range for each required source and scope."""
    days = spark_df.sparkSession.createDataFrame(requirements, "source string, scope string")
    return days.select("source", "scope", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("stat_date"))


def missing_days(status: DataFrame, start: str, end: str, requirements: list[tuple[str, str]], today: str | None = None) -> DataFrame:
    """Expected closed days without a complete fact; a day that is not over is not expected."""
    want = expected_days(status, start, end, requirements)
    want = want.where(F.col("stat_date") < F.lit(today).cast("date")) if today else want
    return want.join(status.where("complete").select("source", "scope", "stat_date"), ["source", "scope", "stat_date"], "left_anti")


def coverage_report(status: DataFrame, start: str, end: str, requirements: list[tuple[str, str]]) -> DataFrame:
    """Per source and scope: days covered of those expected, missing and failed days, newest fetch, complete or not."""
    j = expected_days(status, start, end, requirements).join(status, ["source", "scope", "stat_date"], "left")
    return j.groupBy("source", "scope").agg(F.count_if("complete").alias("covered"), F.count("*").alias("expected"), F.count_if(F.col("complete").isNull()).alias("missing_days"), F.count_if(~F.col("complete")).alias("failed_days"), F.max("fetched_at").alias("latest_fetch"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))


def date_islands(days: DataFrame, keys: list[str], col: str = "stat_date") -> DataFrame:
    """Days as contiguous ranges: first day, last day, length."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(col))
    g = days.select(*keys, col).distinct().withColumn("_g", F.date_sub(F.col(col), n))
    return g.groupBy(*keys, "_g").agg(F.min(col).alias("date_from"), F.max(col).alias("date_to"), F.count("*").alias("days")).drop("_g")


def fact_inventory(status: DataFrame) -> DataFrame:
    return status.groupBy("source", "scope").agg(F.count("*").alias("n"), F.min("stat_date").alias("first_day"), F.max("stat_date").alias("last_day"))


def reconcile_ready_days(status: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Days for which both sources are complete."""
    of = lambda k: status.where((F.col("source") == k[0]) & (F.col("scope") == k[1]) & F.col("complete")).select("stat_date")
    return of(a).join(of(b), "stat_date").distinct()


def partition_rows_by_day(facts: DataFrame, start: str, end: str, col: str = "Date") -> DataFrame:
    """Rows per wanted day; a wanted day without rows is a complete, empty one."""
    days = facts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("stat_date"))
    return days.join(facts.groupBy(F.col(col).alias("stat_date")).agg(F.count("*").alias("n")), "stat_date", "left").select("stat_date", F.coalesce("n", F.lit(0)).alias("rows"), F.lit(True).alias("complete"))


def weekday_anomaly(daily: DataFrame, status: DataFrame, threshold: float = 3.5, min_abs: float = 20.0, weeks: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Each day's value against the same weekday of the weeks before: median, MAD, modified z; high only if complete and material.

    daily: date, value and keys; status: stat_date, complete. Days are compared by a join on shifted dates, not by order.
    """
    keys = keys or []
    past = daily.select(*keys, "date", "value").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    past = past.select(*keys, F.date_add("date", F.col("k") * 7).alias("date"), F.date_add("date", 0).alias("base_day"), F.col("value").alias("base"))
    ok = status.groupBy("stat_date").agg(F.bool_and("complete").alias("ok"))
    past = past.join(ok.select(F.col("stat_date").alias("base_day"), "ok"), "base_day", "left")
    med = past.groupBy(*keys, "date").agg(F.median("base").alias("median"), F.count("*").alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("base_ok"))
    mad = past.join(med, [*keys, "date"]).groupBy(*keys, "date").agg(F.median(F.abs(F.col("base") - F.col("median"))).alias("mad"))
    j = daily.select(*keys, "date", "value").join(med, [*keys, "date"], "left").join(mad, [*keys, "date"], "left").join(ok.withColumnRenamed("stat_date", "date"), "date", "left")
    z = F.when((F.col("mad") != 0) & (F.col("n") >= weeks), 0.6745 * (F.col("value") - F.col("median")) / F.col("mad"))
    j = j.withColumn("z", z).withColumn("complete", F.coalesce("ok", F.lit(False)) & F.coalesce("base_ok", F.lit(False)) & (F.coalesce("n", F.lit(0)) >= weeks))
    odd, big = F.coalesce(F.abs("z") >= threshold, F.lit(False)), F.coalesce(F.abs(F.col("value") - F.col("median")) >= min_abs, F.lit(False))
    severity = F.when(~odd, "normal").when(big & F.col("complete"), "high").when(~F.col("complete"), "suppressed").otherwise("low")
    return j.select(*keys, "date", "value", "median", "mad", "z", "complete", severity.alias("severity"))


def cohort_benchmark(rollup: DataFrame, rules: list[tuple[str, str]], metrics: list[str], kind: str, name: str) -> DataFrame:
    """Quartiles (linear interpolation) and counts per cohort: the campaign type and every rule its name matches."""
    hits = F.array_compact(F.array(*[F.when(F.col(name).rlike(f"(?i){p}"), F.lit(label)) for label, p in rules]))
    label = F.concat_ws("+", F.coalesce(F.col(kind), F.lit("unknown")), hits)
    stats = [f(m) for m in metrics for f in (lambda m: F.count(m).alias(f"{m}_n"), lambda m: F.expr(f"percentile({m}, 0.25)").alias(f"{m}_p25"), lambda m: F.median(m).alias(f"{m}_p50"), lambda m: F.expr(f"percentile({m}, 0.75)").alias(f"{m}_p75"))]
    return rollup.groupBy(label.alias("cohort")).agg(*stats)


def shadow_gate(verdicts: DataFrame, minimum: int = 10) -> DataFrame:
    """Is the diagnosis trustworthy: rates over judged runs; passed only with enough of them and no gaps in evidence."""
    v = verdicts.where("verdict in ('confirmed', 'partial', 'refuted')")
    yes, claim, high = F.col("verdict") == "confirmed", F.col("confirmed_causes") > 0, F.col("priority") == "high"
    gaps = F.count_if(~F.coalesce("complete", F.lit(False)) | (F.coalesce("evidence", F.lit(0)) == 0))
    a = v.agg(F.count("*").alias("cases"), gaps.alias("missing"), F.avg(yes.cast("int")).alias("confirmed_cause_rate"), F.avg(F.when(claim, (F.col("verdict") == "refuted").cast("int"))).alias("false_certainty_rate"), F.avg(F.when(high, yes.cast("int"))).alias("high_priority_precision"), F.count_if(high).alias("high_priority_cases"), F.median("hours").alias("median_hours"))
    return a.withColumn("gate", F.when((F.col("cases") >= minimum) & (F.col("missing") == 0), "passed").otherwise("blocked"))


def feedback_join(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Diagnosis runs with their verdicts; runs without one stay."""
    return runs.join(verdicts, "run_id", "left")


def focus_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which any text column contains the needle, case ignored."""
    hits = [F.contains(F.lower(c), F.lit(needle.lower())) for c, t in df.dtypes if t == "string"]
    hit = F.lit(False)
    for h in hits:
        hit = hit | F.coalesce(h, F.lit(False))
    return df.where(hit)


def shifted_period(start: str, end: str, mode: str) -> Column:
    """struct<date_from, date_to> of the period before, or of a year before (29 February becomes the 28th)."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    n = F.date_diff(b, a) + 1
    return F.struct(F.date_sub(a, n).alias("date_from"), F.date_sub(b, n).alias("date_to")) if mode == "prev_period" else F.struct(F.add_months(a, -12).alias("date_from"), F.add_months(b, -12).alias("date_to"))


def comparison_windows(series: DataFrame, target: str, col: str = "date", value: str = "actual") -> DataFrame:
    """Sum, mean and days of the target day, the day before, the last 7, the 7 before and the last 30."""
    windows = [("day", 0, 0), ("previous_day", 1, 1), ("last_7", 6, 0), ("prior_7", 13, 7), ("last_30", 29, 0)]
    w = F.array(*[F.struct(F.lit(n).alias("window"), F.date_sub(F.lit(target).cast("date"), a).alias("a"), F.date_sub(F.lit(target).cast("date"), b).alias("b")) for n, a, b in windows])
    rows = series.where(F.col(col).between(F.date_sub(F.lit(target).cast("date"), 29), F.lit(target).cast("date"))).withColumn("w", F.explode(w)).where(F.col(col).between(F.col("w.a"), F.col("w.b")))
    return rows.groupBy(F.col("w.window").alias("window")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("days"))


def total_by_ratio(a: DataFrame, num: str, den: str) -> DataFrame:
    return a.agg(ratio(F.sum(num), F.sum(den)).alias("ratio"))
