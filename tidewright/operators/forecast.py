"""Daily forecasting: candidates, rolling back-test, selection, intervals, scenarios and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.expr import ratio


def calendar(series: DataFrame, start: str, end: str) -> DataFrame:
    """series(date, actual) over every day of a range, missing days 0."""
    days = series.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.join(series.select("date", "actual"), "date", "left").select("date", F.coalesce("actual", F.lit(0.0)).alias("actual"))


def forecast_candidates(series: DataFrame, cutoffs: DataFrame, horizon: int = 30) -> DataFrame:
    """(cutoff, model_id, date, forecast): seasonal naive (last value of the weekday), median of the weekday's last 8, and the
    mean of the last 28 days plus the weekday's mean deviation from it. Training days are not after the cutoff."""
    train = series.join(F.broadcast(cutoffs), F.col("date") <= F.col("cutoff")).withColumn("wd", F.dayofweek("date"))
    train = train.withColumn("_r", F.row_number().over(Window.partitionBy("cutoff", "wd").orderBy(F.col("date").desc())))
    naive = train.where("_r = 1").select("cutoff", "wd", F.col("actual").alias("forecast"), F.lit("seasonal_naive").alias("model_id"))
    median = train.where("_r <= 8").groupBy("cutoff", "wd").agg(F.median("actual").alias("forecast")).withColumn("model_id", F.lit("weekday_median"))
    recent = train.where(F.date_diff("cutoff", "date") < 28)
    level = recent.groupBy("cutoff").agg(F.avg("actual").alias("_level"))
    shape = recent.groupBy("cutoff", "wd").agg(F.avg("actual").alias("_wd"))
    moving = shape.join(level, "cutoff").select("cutoff", "wd", (F.col("_level") + (F.col("_wd") - F.col("_level"))).alias("forecast"), F.lit("moving_week").alias("model_id"))
    days = cutoffs.select("cutoff", F.explode(F.sequence(F.date_add("cutoff", 1), F.date_add("cutoff", horizon))).alias("date")).withColumn("wd", F.dayofweek("date"))
    every = naive.unionByName(median).unionByName(moving)
    return days.join(every, ["cutoff", "wd"]).select("cutoff", "model_id", "date", "forecast")


def rolling_origin_backtest(forecasts: DataFrame, series: DataFrame, horizons: list[int]) -> DataFrame:
    """(cutoff, model_id, horizon, date, actual, forecast): each forecast day inside each horizon with what came."""
    both = forecasts.join(series.select("date", "actual"), "date").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return both.where(F.date_diff("date", "cutoff") <= F.col("horizon")).select("cutoff", "model_id", "horizon", "date", "actual", "forecast")


def backtest_metrics(folds: DataFrame, baseline: str = "seasonal_naive") -> DataFrame:
    """Pooled WAPE, MAE, bias, deviation of the folds' WAPE and MASE against the baseline, per model and horizon."""
    err = F.col("forecast") - F.col("actual")
    per_fold = folds.groupBy("model_id", "horizon", "cutoff").agg(F.sum(F.abs(err)).alias("ae"), F.sum(F.abs("actual")).alias("a"), F.sum(err).alias("e"), F.count("*").alias("n"))
    m = per_fold.groupBy("model_id", "horizon").agg((ratio(F.sum("ae"), F.sum("a"), 100)).alias("wape"), (F.sum("ae") / F.sum("n")).alias("mae"), ratio(F.sum("e"), F.sum("a"), 100).alias("bias"), F.stddev_pop(ratio("ae", "a", 100)).alias("wape_std"), F.count("*").alias("folds"))
    base = m.where(F.col("model_id") == baseline).select("horizon", F.col("mae").alias("_b"))
    return m.join(base, "horizon", "left").withColumn("mase", ratio("mae", "_b")).drop("_b")


def fold_alignment(folds: DataFrame, baseline: str = "seasonal_naive") -> DataFrame:
    """Models whose cutoffs are not those of the baseline."""
    sets = folds.groupBy("model_id", "horizon").agg(F.sort_array(F.collect_set("cutoff")).alias("cutoffs"))
    base = sets.where(F.col("model_id") == baseline).select("horizon", F.col("cutoffs").alias("_c"))
    return sets.join(base, "horizon", "left").where(F.col("_c").isNull() | (F.col("cutoffs") != F.col("_c"))).select("model_id", "horizon")


def select_model(metrics: DataFrame, complexity: list[str], lift: float = 5.0, baseline: str = "seasonal_naive") -> DataFrame:
    """The simplest model that beats the baseline's WAPE by lift per cent on every horizon, else the baseline."""
    base = metrics.where(F.col("model_id") == baseline).select("horizon", F.col("wape").alias("_b"))
    better = metrics.join(base, "horizon").groupBy("model_id").agg(F.bool_and(F.col("wape") <= F.col("_b") * (1 - lift / 100)).alias("ok"))
    place = F.coalesce(*[F.when(F.col("model_id") == m, i) for i, m in enumerate(complexity)])
    passed = better.where(F.col("ok") | (F.col("model_id") == baseline)).withColumn("_k", F.when(F.col("ok"), place).otherwise(len(complexity)))
    return passed.orderBy("_k", "model_id").limit(1).select("model_id", F.col("ok").alias("beats_baseline"))


def empirical_interval(folds: DataFrame) -> DataFrame:
    """P10, P50 and P90 of the errors per model and horizon: of single days, and of the horizon's sums, which are not the sums of the days'."""
    err = F.col("actual") - F.col("forecast")
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    days = folds.withColumn("e", err).groupBy("model_id", "horizon").agg(*[q("e", p / 100).alias(f"day_p{p}") for p in (10, 50, 90)])
    sums = folds.groupBy("model_id", "horizon", "cutoff").agg(F.sum(err).alias("s")).groupBy("model_id", "horizon").agg(*[q("s", p / 100).alias(f"sum_p{p}") for p in (10, 50, 90)])
    return days.join(sums, ["model_id", "horizon"])


def interval_coverage(folds: DataFrame, intervals: DataFrame) -> DataFrame:
    """Share of days inside P10 to P90 in per cent."""
    e = F.col("actual") - F.col("forecast")
    return folds.join(intervals, ["model_id", "horizon"]).groupBy("model_id", "horizon").agg((F.avg(e.between(F.col("day_p10"), F.col("day_p90")).cast("int")) * 100).alias("coverage"))


def forecast_confidence(metrics: DataFrame, coverage: DataFrame, history: DataFrame, sources_ok: bool) -> DataFrame:
    """high, medium or low per model, over all its horizons; history has the days (date) that models were fitted on, of which a
    high confidence needs 180."""
    days = history.agg(F.count_distinct("date").alias("_days"))
    m = metrics.join(coverage, ["model_id", "horizon"], "left").groupBy("model_id").agg(F.max("wape").alias("worst"), F.min("coverage").alias("coverage"))
    high = (F.col("_days") >= 180) & F.lit(sources_ok) & (F.col("worst") < 10) & (F.col("coverage") >= 75)
    return m.join(F.broadcast(days)).withColumn("confidence", F.when(high, "high").when(F.col("worst") <= 20, "medium").otherwise("low")).drop("_days")


def declared_vs_computed(declared: DataFrame, computed: DataFrame, keys: list[str], metric: str, tolerance: float = 0.02) -> DataFrame:
    """Declared values that differ from the computed ones by more than the tolerance, or have none."""
    c = computed.select(*keys, F.col(metric).alias("computed"))
    j = declared.select(*keys, F.col(metric).alias("declared")).join(c, keys, "left")
    return j.where(F.col("computed").isNull() | (F.abs(F.col("declared") - F.col("computed")) > F.greatest(F.abs("computed") * tolerance, F.lit(0.05))))


def close(a, b, relative: float = 0.01):
    return F.abs(a - b) <= F.greatest(F.lit(0.05), F.abs(b) * relative)


def scenario_totals_check(daily: DataFrame, totals: DataFrame) -> DataFrame:
    """Violations (rule_id, horizon, scenario): sums of the path, order of scenarios and quantiles, p50 = base.

    daily: date, p10, p50, p90, pessimistic, base, optimistic; totals: horizon, scenario, value.
    """
    d = daily.withColumn("k", F.row_number().over(Window.orderBy("date")))  # a month of days
    names = ["pessimistic", "base", "optimistic"]
    long = d.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(n).alias("v")) for n in names])).alias("x")).select("k", "x.*")
    sums = long.withColumn("horizon", F.explode(F.array(F.lit(7), F.lit(30)))).where("k <= horizon").groupBy("horizon", "scenario").agg(F.sum("v").alias("s"))
    off = totals.join(sums, ["horizon", "scenario"], "full").where(F.col("value").isNull() | F.col("s").isNull() | ~close(F.col("value"), F.col("s"))).select(F.lit("sum_of_path").alias("rule_id"), "horizon", "scenario")
    wide = totals.groupBy("horizon").pivot("scenario", names).agg(F.first("value"))
    order = wide.where(~((F.col("pessimistic") <= F.col("base")) & (F.col("base") <= F.col("optimistic")))).select(F.lit("scenario_order").alias("rule_id"), "horizon", F.lit(None).cast("string").alias("scenario"))
    day = lambda rule, ok: d.where(~ok).select(F.lit(rule).alias("rule_id"), F.col("k").alias("horizon"), F.lit(None).cast("string").alias("scenario"))
    q = day("quantile_order", (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")))
    return off.unionByName(order).unionByName(q).unionByName(day("p50_is_base", close(F.col("p50"), F.col("base"))))


def change_points(series: DataFrame, events: DataFrame, threshold: float = 5.0, min_days: int = 90, near: int = 3) -> DataFrame:
    """Days whose residual from the weekday's median is beyond threshold robust deviations. cause is the confirmed event (date,
    event) that is nearest within `near` days, else unknown: a signal alone is no cause. usable if enough days remain after."""
    wd = series.withColumn("wd", F.dayofweek("date"))
    med = wd.groupBy("wd").agg(F.median("actual").alias("_m"))
    r = wd.join(F.broadcast(med), "wd").withColumn("residual", F.col("actual") - F.col("_m"))
    mad = r.agg(F.median(F.abs("residual")).alias("_mad"), F.max("date").alias("_last"))
    z = F.when(F.col("_mad") != 0, 0.6745 * F.col("residual") / F.col("_mad"))
    signal = r.join(F.broadcast(mad)).withColumn("z", z).where(F.abs("z") >= threshold)
    days = events.select(F.explode(F.sequence(F.date_sub("date", near), F.date_add("date", near))).alias("day"), "event", F.col("date").alias("_on"))
    cause = signal.select("date").join(days, F.col("date") == F.col("day")).groupBy("date").agg(F.min(F.struct(F.abs(F.date_diff("_on", "date")).alias("off"), "event")).alias("c"))
    return signal.join(cause, "date", "left").select("date", "residual", "z", F.coalesce("c.event", F.lit("unknown")).alias("cause"), (F.date_diff("_last", "date") >= min_days).alias("usable"))


def drift_points(series: DataFrame, keys: list[str] | None = None, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """(keys, date, kind, since): alarms of cumulative sums over each series (keys, date, actual), in order of date.

    Residuals from the weekday's median, in robust deviations z, are added up above `slack` in either direction, and so is their
    spread, (sqrt |z| - .822) / .349, which is about standard normal while the variance stays as it is. A sum beyond `limit` gives an
    alarm, level_up, level_down or variance, with the day since which it was above 0, and begins again. A slow drift adds up that no
    single day shows. A series without spread has no alarms; days without a value are skipped.
    """
    keys = keys or []
    d = series.where("actual is not null").withColumn("_wd", F.dayofweek("date"))
    d = d.withColumn("_r", F.col("actual") - F.median("actual").over(Window.partitionBy(*keys, "_wd")))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    d = d.withColumn("_mad", F.median(F.abs("_r")).over(own)).where("_mad > 0").withColumn("_z", 0.6745 * F.col("_r") / F.col("_mad"))
    days = F.array_sort(F.collect_list(F.struct("date", F.col("_z").alias("z"))))  # the days of one series
    line = d.groupBy(*keys).agg(days.alias("days")) if keys else d.agg(days.alias("days"))
    gains = {"level_up": lambda z: z - slack, "level_down": lambda z: -z - slack, "variance": lambda z: (F.sqrt(F.abs(z)) - 0.822) / 0.349 - slack}
    none = F.array().cast("array<struct<date: date, kind: string, since: date>>")
    start = F.struct(*[x for k in gains for x in (F.lit(0.0).alias(k), F.lit(None).cast("date").alias(f"{k}_since"))], none.alias("found"))

    def step(state: Column, day: Column) -> Column:
        parts, found = [], state["found"]
        for k, gain in gains.items():
            total = F.greatest(F.lit(0.0), state[k] + gain(day["z"]))
            since = F.when(total > 0, F.coalesce(state[f"{k}_since"], day["date"]))
            parts += [F.when(total > limit, 0.0).otherwise(total).alias(k), F.when(total <= limit, since).alias(f"{k}_since")]
            found = F.when(total > limit, F.concat(found, F.array(F.struct(day["date"].alias("date"), F.lit(k).alias("kind"), since.alias("since"))))).otherwise(found)
        return F.struct(*parts, found.alias("found"))

    return line.select(*keys, F.inline(F.aggregate("days", start, step, lambda s: s["found"])))


def action_ramp(actions: DataFrame, as_of: str, horizon: int = 30) -> DataFrame:
    """(id, date, impact): an action's daily impact from start plus lag on, capped and weighed.

    actions: id, start_date, lag_days, impact_cap, completion_probability, outcome_probability, overlap_discount.
    """
    a = actions.withColumn("date", F.explode(F.sequence(F.date_add(F.lit(as_of).cast("date"), 1), F.date_add(F.lit(as_of).cast("date"), horizon))))
    on = F.col("date") >= F.date_add("start_date", F.col("lag_days"))
    w = F.col("impact_cap") * F.col("completion_probability") * F.col("outcome_probability") * F.col("overlap_discount")
    return a.select("id", "date", F.when(on, w).otherwise(0.0).alias("impact"))


def scenario_path(base: DataFrame, impact: DataFrame, losses: DataFrame) -> DataFrame:
    """date, base -> optimistic = base + all impacts of the day, pessimistic = base - all losses, not below 0."""
    up, down = impact.groupBy("date").agg(F.sum("impact").alias("_u")), losses.groupBy("date").agg(F.sum("loss").alias("_d"))
    j = base.join(up, "date", "left").join(down, "date", "left")
    return j.select("date", "base", (F.col("base") + F.coalesce("_u", F.lit(0.0))).alias("optimistic"), F.greatest(F.col("base") - F.coalesce("_d", F.lit(0.0)), F.lit(0.0)).alias("pessimistic"))


def overlap_guard(actions: DataFrame) -> DataFrame:
    """Interaction groups with several actions that all count in full."""
    return actions.where("interaction_group is not null").groupBy("interaction_group").agg(F.count("*").alias("n"), F.bool_and(F.col("overlap_discount") >= 1).alias("full")).where("n > 1 and full").select("interaction_group", "n")


def blocker_losses(blockers: DataFrame, as_of: str, horizon: int = 30) -> DataFrame:
    """(id, total_7, total_30): probability-weighted daily losses inside the window; blockers: id, date, probability, loss."""
    d = F.date_diff("date", F.lit(as_of).cast("date"))
    w = F.col("probability") * F.col("loss")
    return blockers.where(d.between(1, horizon)).groupBy("id").agg(F.sum(F.when(d <= 7, w).otherwise(0.0)).alias("total_7"), F.sum(w).alias("total_30"))


def event_calendar_rules(events: DataFrame, closed: list[str]) -> DataFrame:
    """Violations (id, rule_id): repeated ids, start after end, status not in the list."""
    n = F.count("*").over(Window.partitionBy("id"))
    e = events.withColumn("_n", n)
    rules = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_id"), F.when(F.col("start_date") > F.col("end_date"), "start_after_end"), F.when(~F.col("status").isin(closed), "unknown_status")))
    return e.select("id", F.explode(rules).alias("rule_id")).distinct()


def forecast_evaluation(history: DataFrame, actuals: DataFrame) -> DataFrame:
    """WAPE and bias per run of an earlier forecast, over the days that have come."""
    e = F.col("forecast") - F.col("actual")
    return history.join(actuals, "date").groupBy("run_id").agg(F.count("*").alias("days"), ratio(F.sum(F.abs(e)), F.sum(F.abs("actual")), 100).alias("wape"), ratio(F.sum(e), F.sum(F.abs("actual")), 100).alias("bias"))


def hierarchy_reconcile(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Dimension, horizon and scenario whose segments do not sum to the total."""
    s = parts.groupBy("dimension", "horizon", "scenario").agg(F.sum("value").alias("segments"))
    return s.join(totals.withColumnRenamed("value", "total"), ["horizon", "scenario"], "left").where(F.col("total").isNull() | ~close(F.col("segments"), F.col("total"))).select("dimension", "horizon", "scenario", "segments", "total")


def adjustment_reconcile(series: DataFrame, log: DataFrame) -> DataFrame:
    """Violations (date, rule_id) between adjusted days (date, actual, adjusted, adjustment_ids) and the log (adjustment_id, date, original, adjusted)."""
    changed = series.where(~F.col("actual").eqNullSafe(F.col("adjusted")) & (F.size("adjustment_ids") == 0)).select("date", F.lit("change_without_id").alias("rule_id"))
    ids = series.select("date", "actual", "adjusted", F.explode("adjustment_ids").alias("adjustment_id"))
    lg = log.select("adjustment_id", F.col("date").alias("_d"), F.col("original").alias("_o"), F.col("adjusted").alias("_a"))
    j = ids.join(lg, "adjustment_id", "left")
    rules = F.array_compact(F.array(F.when(F.col("_d").isNull(), "id_not_in_log"), F.when(F.col("_d") != F.col("date"), "date_differs"), F.when(F.col("_o") != F.col("actual"), "original_differs"), F.when(F.col("_a") != F.col("adjusted"), "adjusted_differs")))
    bad = j.select("date", F.explode(rules).alias("rule_id"))
    lost = log.join(series.select("date"), "date", "left_anti").select("date", F.lit("log_day_not_in_series").alias("rule_id"))
    return changed.unionByName(bad).unionByName(lost).distinct()


def series_rules(series: DataFrame, as_of: str, min_rows: int = 90) -> DataFrame:
    """Violations of a daily series: too short, repeated days, gaps, not ending at as_of."""
    a = series.agg(F.count("*").alias("n"), F.count_distinct("date").alias("d"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    rules = F.array_compact(F.array(F.when(F.col("n") < min_rows, "too_short"), F.when(F.col("n") > F.col("d"), "duplicate_day"), F.when(F.date_diff("hi", "lo") + 1 > F.col("d"), "missing_day"), F.when(F.coalesce(F.col("hi") != F.lit(as_of).cast("date"), F.lit(True)), "not_at_as_of")))
    return a.select(F.explode(rules).alias("rule_id"))


def regime_window(series: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Violations of a training window: outside the series, under 90 days, not ending at as_of."""
    a = series.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    rules = F.array_compact(F.array(F.when((s < F.col("lo")) | (e > F.col("hi")), "outside_series"), F.when(F.date_diff(e, s) + 1 < 90, "under_90_days"), F.when(e != F.lit(as_of).cast("date"), "not_at_as_of")))
    return a.select(F.explode(rules).alias("rule_id"))


def sources_freshness(sources: DataFrame, as_of: str) -> DataFrame:
    """(source, level, rule_id): stale for over 3 days although ok is a warning; required and not ok an error."""
    stale = F.when((F.col("status") == "ok") & (F.date_diff(F.lit(as_of).cast("date"), "last_day") > 3), F.struct(F.lit("warning").alias("level"), F.lit("stale").alias("rule_id")))
    blocked = F.when(F.col("required") & (F.col("status") != "ok"), F.struct(F.lit("error").alias("level"), F.lit("required_blocked").alias("rule_id")))
    return sources.select("source", F.explode(F.array_compact(F.array(stale, blocked))).alias("x")).select("source", "x.*")
