"""Queries over monthly demand and daily forecasts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewright.functions.expr import normalize_phrase, pct_change
from tidewright.operators import forecast as P
from tidewright.operators import trends as T
from tidewright.plans.ads import rounded
from tidewright.plans.registry import query

MIN = 30.0
PLACED = """s AS (SELECT *, n - rn + 1 AS rd FROM (SELECT cluster_id, month, value, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY month) AS rn, COUNT(*) OVER (PARTITION BY cluster_id) AS n FROM demand_monthly WHERE value >= 0)),
 ch AS (SELECT *, CASE WHEN prev > 0 THEN (cur / prev - 1) * 100 END AS period, CASE WHEN months >= 15 AND ya > 0 THEN (cur / ya - 1) * 100 END AS yoy FROM (SELECT cluster_id, MAX(n) AS months, COUNT(*) FILTER (WHERE value > 0) AS active_months,
   AVG(value) FILTER (WHERE rd BETWEEN 1 AND 3) AS cur, AVG(value) FILTER (WHERE rd BETWEEN 4 AND 6) AS prev, AVG(value) FILTER (WHERE rd BETWEEN 13 AND 15) AS ya, AVG(value) FILTER (WHERE rd BETWEEN 25 AND 27) AS two FROM s GROUP BY cluster_id))"""
ADJ = PLACED + """, ym AS (SELECT cluster_id, YEAR(month) AS y, CASE WHEN MEDIAN(value) = 0 THEN 1.0 ELSE MEDIAN(value) END AS ym FROM s GROUP BY ALL), ix AS (SELECT s.cluster_id, MONTH(month) AS m, LEAST(GREATEST(MEDIAN(value / ym), 0.25), 4.0) AS ix FROM s JOIN ym ON s.cluster_id = ym.cluster_id AND YEAR(month) = y GROUP BY s.cluster_id, MONTH(month)),
 lg AS (SELECT *, LAG(value) OVER (PARTITION BY cluster_id ORDER BY month) AS pv, LAG(month) OVER (PARTITION BY cluster_id ORDER BY month) AS pm FROM s), kd AS (SELECT cluster_id, CASE WHEN COUNT(*) FILTER (WHERE value > 0) < 24 OR COALESCE(BOOL_OR(DATE_DIFF('month', pm, month) > 1), FALSE) THEN 'none' WHEN COALESCE(BOOL_AND(value >= pv), TRUE) OR COALESCE(BOOL_AND(value <= pv), TRUE) THEN 'none_monotonic' ELSE 'median_seasonal' END AS method, COALESCE(BOOL_OR(DATE_DIFF('month', pm, month) > 1), FALSE) AS gap FROM lg GROUP BY cluster_id),
 ad AS (SELECT s.cluster_id, s.month, s.value, s.rd, s.n, method, CASE WHEN method = 'median_seasonal' THEN value / ix ELSE value END AS adjusted FROM s JOIN kd ON s.cluster_id = kd.cluster_id JOIN ix ON s.cluster_id = ix.cluster_id AND MONTH(s.month) = ix.m)"""
SLOPE = ADJ + """, sl AS (SELECT cluster_id, ts / (CASE WHEN mn = 0 THEN 1 ELSE mn END) * 100 AS slope FROM (SELECT a.cluster_id, MEDIAN((b.adjusted - a.adjusted) / (a.rd - b.rd)) AS ts FROM ad a JOIN ad b ON a.cluster_id = b.cluster_id AND a.rd > b.rd AND a.rd <= 6 GROUP BY a.cluster_id) JOIN (SELECT cluster_id, AVG(adjusted) AS mn FROM ad WHERE rd <= 6 GROUP BY cluster_id) USING (cluster_id)),
 mo AS (SELECT cluster_id, COUNT(*) FILTER (WHERE mv > 3) AS pu, COUNT(*) FILTER (WHERE mv < -3) AS pd FROM (SELECT cluster_id, rd, CASE WHEN LAG(adjusted) OVER w > 0 THEN (adjusted / LAG(adjusted) OVER w - 1) * 100 END AS mv FROM ad WINDOW w AS (PARTITION BY cluster_id ORDER BY month)) WHERE rd <= 3 GROUP BY cluster_id)"""
SIGN = lambda x: f"CASE WHEN {x} > 3 THEN 1 WHEN {x} < -3 THEN -1 WHEN {x} IS NOT NULL THEN 0 END"
FRAME = SLOPE + f""", sg AS (SELECT cluster_id, {SIGN('period')} AS s1, {SIGN('yoy')} AS s2, {SIGN('slope')} AS s3 FROM ch JOIN sl USING (cluster_id)), ag AS (SELECT cluster_id, GREATEST({', '.join('+'.join(f'(CASE WHEN {s} = {k} THEN 1 ELSE 0 END)' for s in ('s1', 's2', 's3')) for k in (1, -1, 0))}) * 1.0 / (CASE WHEN s1 IS NULL THEN 0 ELSE 1 END + CASE WHEN s2 IS NULL THEN 0 ELSE 1 END + 1) AS agreement FROM sg),
 sp AS (SELECT cluster_id, AVG(adjusted) AS mn, STDDEV_POP(adjusted) AS sd FROM ad GROUP BY cluster_id), fr AS (SELECT ch.*, slope, pu, pd, agreement, gap, LEAST(GREATEST(0.30 * LEAST(GREATEST((active_months - 6) / 18.0, 0), 1) + 0.25 * LEAST(GREATEST(LN(1 + cur) / LN(301.0), 0), 1) + 0.30 * agreement + 0.15 * (1 - LEAST(GREATEST(sd / (CASE WHEN mn = 0 THEN 1 ELSE mn END) / 1.5, 0), 1)) - CASE WHEN gap THEN 0.05 ELSE 0 END, 0), 1) AS c0
   FROM ch JOIN sl USING (cluster_id) JOIN mo USING (cluster_id) JOIN ag USING (cluster_id) JOIN sp USING (cluster_id) JOIN kd USING (cluster_id)), f2 AS (SELECT *, CASE WHEN active_months < 18 THEN LEAST(c0, 0.55) ELSE c0 END AS confidence FROM fr)"""
B = lambda x: f"COALESCE({x}, FALSE)"
UP = "+".join(f"CAST({B(x)} AS INT)" for x in ("period >= 10", "yoy >= 20", "slope >= 1", "pu >= 2"))
DOWN = "+".join(f"CAST({B(x)} AS INT)" for x in ("period <= -10", "yoy <= -20", "slope <= -1", "pd >= 2"))
SIGNAL = FRAME + f""", si AS (SELECT *, {B('yoy <= -20')} AND slope <= -1 AND months >= 27 AND {B('cur < two')} AS dec, prev <= 1.5 AND cur >= 30 AS nd FROM f2), sg2 AS (SELECT *, CASE WHEN months < 6 THEN 'insufficient_data' WHEN confidence < 0.45 OR cur < 30 THEN 'watch'
 WHEN active_months >= 24 AND NOT gap AND {B('ABS(period) >= 20')} AND {B('ABS(yoy) < 15')} AND ABS(slope) < 2 THEN CASE WHEN period > 0 THEN 'seasonal_rise' ELSE 'seasonal_fall' END WHEN nd THEN 'breakout' WHEN {B('period > 5000')} AND confidence >= 0.55 THEN 'breakout'
 WHEN active_months < 18 AND {B('period >= 50')} THEN 'emerging' WHEN active_months < 18 THEN 'watch' WHEN confidence >= 0.6 THEN CASE WHEN {B('period >= 30')} AND {B('yoy >= 100')} THEN 'rapid_growth' WHEN dec THEN 'structural_decline' WHEN {UP} >= 2 AND {B('yoy >= 20')} THEN 'growing'
 WHEN {DOWN} >= 2 AND {B('yoy <= -20')} AND (period IS NULL OR period <= 3) AND slope <= 0 THEN 'declining' WHEN GREATEST({UP}, {DOWN}) >= 2 THEN 'watch' ELSE 'stable' END ELSE 'stable' END AS signal FROM si)"""


def frame(v):
    return T.trend_signal(T.trend_frame(v.demand_monthly, MIN), MIN)


@query("scan_cluster_series", "SELECT cluster_id, month, value, TRUE AS complete FROM demand_monthly")
def _(v):
    point = F.struct(F.date_format("month", "yyyy-MM").alias("date"), F.col("value"), F.lit(True).alias("complete"))
    bad = F.array(F.struct(F.lit("2001-99").alias("date"), F.lit(1.0).alias("value"), F.lit(True).alias("complete")), F.struct(F.lit("2001-01").alias("date"), F.lit(-1.0).alias("value"), F.lit(True).alias("complete")))
    return T.scan_cluster_series(v.demand_monthly.groupBy("cluster_id").agg(F.concat(F.collect_list(point), bad).alias("series")))


@query("series_gap_check", "SELECT cluster_id, CASE WHEN COUNT(*) FILTER (WHERE DATE_DIFF('month', pm, month) > 1) > 0 THEN 'non_contiguous_history' ELSE '' END AS flags FROM (SELECT *, LAG(month) OVER (PARTITION BY cluster_id ORDER BY month) AS pm FROM demand_monthly WHERE NOT (cluster_id LIKE '%1' AND MONTH(month) = 6)) GROUP BY cluster_id")
def _(v):
    return T.series_gap_check(v.demand_monthly.where("not (cluster_id like '%1' and month(month) = 6)")).select("cluster_id", F.array_join("flags", ",").alias("flags"))


@query("trend_changes", f"WITH {PLACED} SELECT cluster_id, months, active_months, ROUND(cur, 4) AS current_3m_avg, ROUND(prev, 4) AS previous_3m_avg, ROUND(period, 4) AS period, ROUND(yoy, 4) AS yoy FROM ch")
def _(v):
    return rounded(T.trend_changes(v.demand_monthly).drop("two_years_ago"))


@query("seasonal_adjust", f"WITH {ADJ} SELECT cluster_id, month, method, ROUND(adjusted, 4) AS adjusted FROM ad")
def _(v):
    return rounded(T.seasonal_adjust(v.demand_monthly).select("cluster_id", "month", "method", "adjusted"))


@query("theil_sen_slope", f"WITH {SLOPE} SELECT cluster_id, ROUND(slope, 4) AS slope FROM sl")
def _(v):
    return rounded(T.theil_sen_slope(T.seasonal_adjust(v.demand_monthly)))


@query("momentum_persistence", f"WITH {SLOPE} SELECT cluster_id, pu AS persistence_up, pd AS persistence_down FROM mo")
def _(v):
    return T.momentum_persistence(T.seasonal_adjust(v.demand_monthly))


@query("direction_agreement", f"WITH {FRAME} SELECT cluster_id, ROUND(agreement, 4) AS agreement FROM ag")
def _(v):
    return rounded(frame(v).select("cluster_id", "agreement"))


@query("trend_confidence", f"WITH {FRAME} SELECT cluster_id, ROUND(confidence, 4) AS confidence FROM f2")
def _(v):
    return rounded(frame(v).select("cluster_id", "confidence"))


@query("trend_signal", f"WITH {SIGNAL} SELECT cluster_id, signal, dec AS structural_decline, nd AS new_demand FROM sg2")
def _(v):
    return frame(v).select("cluster_id", "signal", "structural_decline", "new_demand")


COV = "CASE CAST(SUBSTRING(cluster_id, LENGTH(cluster_id), 1) AS INT) % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' ELSE 'covered_content' END"


@query("opportunity_score", f"""WITH {SIGNAL}, cv AS (SELECT *, {COV} AS st, 0.5 + (LENGTH(cluster_id) % 3) * 0.1 AS rel FROM sg2) SELECT cluster_id, ROUND(100 * LEAST(GREATEST(COALESCE(ABS(period), 0), COALESCE(ABS(yoy), 0), ABS(slope * 6)) / 100, 1) * rel
   * CASE WHEN signal IN ('declining', 'structural_decline') AND st <> 'gap' THEN 1.0 WHEN st = 'gap' THEN 1.0 WHEN st = 'partial' THEN 0.8 ELSE 0.45 END * confidence * LEAST(LN(1 + cur) / LN(3001.0), 1), 4) AS opportunity_score, CASE WHEN confidence < 0.55 THEN 'unknown' WHEN slope >= 1 THEN 'up' WHEN slope <= -1 THEN 'down' ELSE 'flat' END AS direction FROM cv""")
def _(v):
    f = frame(v).withColumn("coverage_status", F.expr(COV)).withColumn("business_relevance", 0.5 + (F.length("cluster_id") % 3) * 0.1)
    return rounded(T.opportunity_score(f, MIN).select("cluster_id", "opportunity_score", "direction"))


@query("top_and_rising", f"WITH {PLACED}, r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cur DESC, cluster_id) AS a, ROW_NUMBER() OVER (ORDER BY CASE WHEN period > 0 THEN period END DESC NULLS LAST, cluster_id) AS b FROM ch) SELECT 'top' AS list, cluster_id, ROUND(cur, 4) AS current_3m_avg, ROUND(period, 4) AS period, COALESCE(period > 5000, FALSE) AS breakout FROM r WHERE a <= 5 UNION ALL SELECT 'rising', cluster_id, ROUND(cur, 4), ROUND(period, 4), COALESCE(period > 5000, FALSE) FROM r WHERE b <= 5 AND period > 0")
def _(v):
    return rounded(T.top_and_rising(T.trend_changes(v.demand_monthly)))


@query("pct_change", "SELECT cluster_id, month, ROUND(CASE WHEN pv > 0 THEN (value / pv - 1) * 100 END, 4) AS change FROM (SELECT *, LAG(value) OVER (PARTITION BY cluster_id ORDER BY month) AS pv FROM demand_monthly)")
def _(v):
    from pyspark.sql import Window

    d = v.demand_monthly.withColumn("pv", F.lag("value").over(Window.partitionBy("cluster_id").orderBy("month")))
    return rounded(d.select("cluster_id", "month", pct_change("value", "pv").alias("change")))


OLD = "SELECT cluster_id, month, value FROM demand_monthly WHERE month < DATE '2001-03-01' AND cluster_id <> 'Brand#11'"


GROWN, SHRUNK = "('breakout', 'emerging', 'rapid_growth', 'growing')", "('declining', 'structural_decline')"
BEFORE = "old AS (SELECT * FROM demand_monthly WHERE month < DATE '2001-03-01' AND cluster_id <> 'Brand#11')"


@query(
    "trend_delta",
    f"WITH nw AS (WITH {SIGNAL} SELECT cluster_id, signal, COALESCE(slope, 0) AS slope, COALESCE(cur, 0) AS cur, nd FROM sg2), od AS (WITH {BEFORE}, {re.sub('demand_monthly', 'old', SIGNAL)} SELECT cluster_id, signal AS s0, COALESCE(slope, 0) AS sl0, COALESCE(cur, 0) AS c0 FROM sg2) "
    f"SELECT nw.cluster_id, signal, CASE WHEN s0 IS NULL THEN CASE WHEN nd THEN 'new_demand' WHEN signal IN {GROWN} THEN 'new_growth' WHEN signal IN {SHRUNK} THEN 'new_decline' ELSE 'new_cluster' END WHEN s0 NOT IN {GROWN} AND signal IN {GROWN} THEN 'new_growth' WHEN s0 NOT IN {SHRUNK} AND signal IN {SHRUNK} THEN 'new_decline' "
    "WHEN s0 IN ('declining', 'structural_decline') AND signal = 'stable' THEN 'recovered' WHEN c0 >= cur * 3 AND cur > 0 THEN 'lost_materiality' WHEN slope >= sl0 + 2 THEN 'accelerating' WHEN slope <= sl0 - 2 THEN 'decelerating' ELSE 'unchanged' END AS delta FROM nw LEFT JOIN od ON nw.cluster_id = od.cluster_id",
)
def _(v):
    before = v.demand_monthly.where("month < date '2001-03-01' and cluster_id <> 'Brand#11'")
    return T.trend_delta(T.trend_signal(T.trend_frame(before, MIN), MIN), frame(v))


@query("store_observations", "SELECT cluster_id, month, value, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id, month ORDER BY seq DESC) AS k FROM (SELECT p_brand AS cluster_id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month, l_quantity AS value, l_orderkey * 10 + l_linenumber AS seq FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)) WHERE k = 1")
def _(v):
    rows = v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("cluster_id"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return T.store_observations(rows, ["cluster_id", "month"], "seq")


# --- daily forecasts

FROM, TO, CUTS = "1995-01-01", "1998-06-30", ["1998-03-01", "1998-04-01", "1998-05-01"]
CAL = f"cal AS (SELECT CAST(d AS DATE) AS date, COALESCE(actual, 0.0) AS actual FROM (SELECT UNNEST(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY)) AS d) LEFT JOIN daily_series ON d = date)"
CAND = CAL + f""", cut AS (SELECT CAST(c AS DATE) AS cutoff FROM (VALUES {', '.join(f"('{c}')" for c in CUTS)}) t(c)), tr AS (SELECT cutoff, date, actual, DAYOFWEEK(date) AS wd, ROW_NUMBER() OVER (PARTITION BY cutoff, DAYOFWEEK(date) ORDER BY date DESC) AS r FROM cal, cut WHERE date <= cutoff),
 mdl AS (SELECT cutoff, wd, 'seasonal_naive' AS model_id, actual AS forecast FROM tr WHERE r = 1 UNION ALL SELECT cutoff, wd, 'weekday_median', MEDIAN(actual) FROM tr WHERE r <= 8 GROUP BY cutoff, wd UNION ALL SELECT cutoff, wd, 'moving_week', AVG(actual) FROM tr WHERE cutoff - date < 28 GROUP BY cutoff, wd),
 dy AS (SELECT cutoff, CAST(UNNEST(generate_series(cutoff + 1, cutoff + 30, INTERVAL 1 DAY)) AS DATE) AS date FROM cut), fc AS (SELECT dy.cutoff, model_id, dy.date, forecast FROM dy JOIN mdl ON dy.cutoff = mdl.cutoff AND DAYOFWEEK(dy.date) = wd)"""
BACK = CAND + ", bt AS (SELECT fc.cutoff, model_id, h AS horizon, fc.date, actual, forecast FROM fc JOIN cal ON fc.date = cal.date, (VALUES (7), (30)) x(h) WHERE fc.date - fc.cutoff <= h)"
METR = BACK + """, pf AS (SELECT model_id, horizon, cutoff, SUM(ABS(forecast - actual)) AS ae, SUM(ABS(actual)) AS a, SUM(forecast - actual) AS e, COUNT(*) AS n FROM bt GROUP BY ALL), mt AS (SELECT model_id, horizon, SUM(ae) / SUM(a) * 100 AS wape, SUM(ae) / SUM(n) AS mae, SUM(e) / SUM(a) * 100 AS bias, STDDEV_POP(ae / a * 100) AS wape_std, COUNT(*) AS folds FROM pf GROUP BY ALL)"""
INTV = BACK + """, iv AS (SELECT * FROM (SELECT model_id, horizon, QUANTILE_CONT(actual - forecast, 0.1) AS day_p10, QUANTILE_CONT(actual - forecast, 0.5) AS day_p50, QUANTILE_CONT(actual - forecast, 0.9) AS day_p90 FROM bt GROUP BY ALL) JOIN (SELECT model_id, horizon, QUANTILE_CONT(s, 0.1) AS sum_p10, QUANTILE_CONT(s, 0.5) AS sum_p50, QUANTILE_CONT(s, 0.9) AS sum_p90 FROM (SELECT model_id, horizon, cutoff, SUM(actual - forecast) AS s FROM bt GROUP BY ALL) GROUP BY ALL) USING (model_id, horizon)),
 cg AS (SELECT bt.model_id, bt.horizon, AVG(CASE WHEN actual - forecast BETWEEN day_p10 AND day_p90 THEN 1.0 ELSE 0 END) * 100 AS coverage FROM bt JOIN iv ON bt.model_id = iv.model_id AND bt.horizon = iv.horizon GROUP BY ALL)"""


def cal(v):
    return P.calendar(v.daily_series, FROM, TO)


def cuts(v):
    return v.spark.createDataFrame([(c,) for c in CUTS], "c string").select(F.col("c").cast("date").alias("cutoff"))


def folds(v):
    c = cal(v)
    return P.rolling_origin_backtest(P.forecast_candidates(c, cuts(v)), c, [7, 30])


@query("forecast_candidates", f"WITH {CAND} SELECT cutoff, model_id, date, ROUND(forecast, 4) AS forecast FROM fc")
def _(v):
    return rounded(P.forecast_candidates(cal(v), cuts(v)))


@query("rolling_origin_backtest", f"WITH {BACK} SELECT cutoff, model_id, horizon, date, actual, ROUND(forecast, 4) AS forecast FROM bt")
def _(v):
    return rounded(folds(v))


@query("backtest_metrics", f"WITH {METR} SELECT m.model_id, m.horizon, ROUND(m.wape, 4) AS wape, ROUND(m.mae, 4) AS mae, ROUND(m.bias, 4) AS bias, ROUND(m.wape_std, 4) AS wape_std, m.folds, ROUND(m.mae / b.mae, 4) AS mase FROM mt m JOIN mt b ON m.horizon = b.horizon AND b.model_id = 'seasonal_naive'")
def _(v):
    return rounded(P.backtest_metrics(folds(v)))


@query("fold_alignment", f"WITH {BACK}, cs AS (SELECT model_id, horizon, LIST(DISTINCT cutoff ORDER BY cutoff) AS c FROM bt WHERE NOT (model_id = 'moving_week' AND cutoff = DATE '1998-04-01') GROUP BY ALL) SELECT a.model_id, a.horizon FROM cs a JOIN cs b ON a.horizon = b.horizon AND b.model_id = 'seasonal_naive' WHERE a.c <> b.c")
def _(v):
    return P.fold_alignment(folds(v).where("not (model_id = 'moving_week' and cutoff = date '1998-04-01')"))


@query("select_model", f"WITH {METR}, ok AS (SELECT m.model_id, BOOL_AND(m.wape <= b.wape * 0.95) AS ok FROM mt m JOIN mt b ON m.horizon = b.horizon AND b.model_id = 'seasonal_naive' GROUP BY m.model_id) SELECT model_id, ok AS beats_baseline FROM ok WHERE ok OR model_id = 'seasonal_naive' ORDER BY CASE WHEN NOT ok THEN 3 WHEN model_id = 'seasonal_naive' THEN 0 WHEN model_id = 'weekday_median' THEN 1 ELSE 2 END LIMIT 1")
def _(v):
    return P.select_model(P.backtest_metrics(folds(v)), ["seasonal_naive", "weekday_median", "moving_week"])


@query("empirical_interval", f"WITH {INTV} SELECT model_id, horizon, {', '.join(f'ROUND({a}_p{p}, 4) AS {a}_p{p}' for a in ('day', 'sum') for p in (10, 50, 90))} FROM iv")
def _(v):
    return rounded(P.empirical_interval(folds(v)))


@query("interval_coverage", f"WITH {INTV} SELECT model_id, horizon, ROUND(coverage, 4) AS coverage FROM cg")
def _(v):
    f = folds(v)
    return rounded(P.interval_coverage(f, P.empirical_interval(f)))


@query("forecast_confidence", f"WITH {INTV}, {METR[len(BACK) + 2:]} SELECT model_id, ROUND(MAX(wape), 4) AS worst, ROUND(MIN(coverage), 4) AS coverage, CASE WHEN MAX(wape) < 10 AND MIN(coverage) >= 75 THEN 'high' WHEN MAX(wape) <= 20 THEN 'medium' ELSE 'low' END AS confidence FROM mt JOIN cg USING (model_id, horizon) GROUP BY model_id")
def _(v):
    f = folds(v)
    return rounded(P.forecast_confidence(P.backtest_metrics(f), P.interval_coverage(f, P.empirical_interval(f)), cal(v), True))


@query("declared_vs_computed", f"WITH {METR} SELECT model_id, horizon, ROUND(mae * (CASE WHEN horizon = 7 THEN 1.1 ELSE 1.0 END), 4) AS declared, ROUND(mae, 4) AS computed FROM mt WHERE ABS(mae * (CASE WHEN horizon = 7 THEN 1.1 ELSE 1.0 END) - mae) > GREATEST(mae * 0.02, 0.05)")
def _(v):
    m = P.backtest_metrics(folds(v))
    return rounded(P.declared_vs_computed(m.withColumn("mae", F.col("mae") * F.when(F.col("horizon") == 7, 1.1).otherwise(1.0)), m, ["model_id", "horizon"], "mae"))


@query("change_points", f"WITH {CAL}, md AS (SELECT DAYOFWEEK(date) AS wd, MEDIAN(actual) AS m FROM cal GROUP BY 1), r AS (SELECT date, actual - m AS residual FROM cal JOIN md ON DAYOFWEEK(date) = wd), k AS (SELECT MEDIAN(ABS(residual)) AS mad, MAX(date) AS last FROM r) SELECT date, residual, ROUND(0.6745 * residual / mad, 4) AS z, CASE WHEN DAY(date) <= 4 OR date + 3 >= LAST_DAY(date) + 1 THEN 'month opens' ELSE 'unknown' END AS cause, last - date >= 90 AS usable FROM r, k WHERE mad <> 0 AND ABS(0.6745 * residual / mad) >= 2.5")
def _(v):
    days = cal(v).select(F.explode(F.array(F.trunc("date", "month"), F.add_months(F.trunc("date", "month"), 1))).alias("date")).distinct()
    return rounded(P.change_points(cal(v), days.withColumn("event", F.lit("month opens")), 2.5))


STEP = "GREATEST(0.0, c.{k} + {g})"
GAIN = {"level_up": "n.z - 0.5", "level_down": "-n.z - 0.5", "variance": "(SQRT(ABS(n.z)) - 0.822) / 0.349 - 0.5"}
TOTAL = {k: STEP.format(k=k, g=g) for k, g in GAIN.items()}


@query(
    "drift_points",
    f"WITH RECURSIVE {CAL}, md AS (SELECT DAYOFWEEK(date) AS wd, MEDIAN(actual) AS m FROM cal GROUP BY 1), r AS (SELECT date, actual - m AS residual FROM cal JOIN md ON DAYOFWEEK(date) = wd), "
    "k AS (SELECT MEDIAN(ABS(residual)) AS mad FROM r), n AS (SELECT date, 0.6745 * residual / mad AS z, ROW_NUMBER() OVER (ORDER BY date) AS i FROM r, k WHERE mad > 0), "
    "c AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, " + ", ".join(f"CAST(0.0 AS DOUBLE) AS {k}, CAST(NULL AS DATE) AS {k}_since, FALSE AS {k}_hit, CAST(NULL AS DATE) AS {k}_from" for k in GAIN)
    + " UNION ALL SELECT n.i, n.date, " + ", ".join(f"CASE WHEN {t} > 5.0 THEN 0.0 ELSE {t} END, CASE WHEN {t} > 0 AND {t} <= 5.0 THEN COALESCE(c.{k}_since, n.date) END, {t} > 5.0, COALESCE(c.{k}_since, n.date)" for k, t in TOTAL.items())
    + " FROM c JOIN n ON n.i = c.i + 1) " + " UNION ALL ".join(f"SELECT date, '{k}' AS kind, {k}_from AS since FROM c WHERE {k}_hit" for k in GAIN),
)
def _(v):
    return P.drift_points(cal(v))


ACT = """act AS (SELECT CAST(s_suppkey AS STRING) AS id, CAST(DATE '1998-06-30' + CAST(s_suppkey % 20 AS INT) AS DATE) AS start_date, CAST(s_suppkey % 5 AS INT) AS lag_days, s_acctbal / 100 AS impact_cap, 0.5 + (s_suppkey % 5) * 0.1 AS completion_probability, 0.8 AS outcome_probability, CASE WHEN s_suppkey % 4 = 0 THEN 0.7 ELSE 1.0 END AS overlap_discount, n_name AS interaction_group FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > 0)"""
RAMP = ACT + ", d30 AS (SELECT CAST(UNNEST(generate_series(DATE '1998-07-01', DATE '1998-07-30', INTERVAL 1 DAY)) AS DATE) AS date), ip AS (SELECT id, date, CASE WHEN date >= start_date + lag_days THEN impact_cap * completion_probability * outcome_probability * overlap_discount ELSE 0.0 END AS impact FROM act, d30)"


def actions(v):
    s = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 0")
    k = F.col("s_suppkey")
    return s.select(k.cast("string").alias("id"), F.date_add(F.lit("1998-06-30").cast("date"), (k % 20).cast("int")).alias("start_date"), (k % 5).cast("int").alias("lag_days"), (F.col("s_acctbal") / 100).alias("impact_cap"), (0.5 + (k % 5) * 0.1).alias("completion_probability"), F.lit(0.8).alias("outcome_probability"), F.when(k % 4 == 0, 0.7).otherwise(1.0).alias("overlap_discount"), F.col("n_name").alias("interaction_group"))


def blockers(v):
    e = v.events.where("event_type = 'error'")
    return e.select(F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("id"), F.to_date("ts").alias("date"), F.lit(0.4).alias("probability"), F.col("value").alias("loss"))


@query("action_ramp", f"WITH {RAMP} SELECT id, date, ROUND(impact, 4) AS impact FROM ip")
def _(v):
    return rounded(P.action_ramp(actions(v), "1998-06-30"))


@query("overlap_guard", f"WITH {ACT} SELECT interaction_group, COUNT(*) AS n FROM act GROUP BY 1 HAVING COUNT(*) > 1 AND BOOL_AND(overlap_discount >= 1)")
def _(v):
    return P.overlap_guard(actions(v))


@query("blocker_losses", "SELECT CONCAT('b', CAST(user_id % 7 AS STRING)) AS id, ROUND(SUM(CASE WHEN CAST(ts AS DATE) - DATE '2023-12-31' <= 7 THEN 0.4 * value ELSE 0 END), 4) AS total_7, ROUND(SUM(0.4 * value), 4) AS total_30 FROM {events} WHERE event_type = 'error' AND CAST(ts AS DATE) - DATE '2023-12-31' BETWEEN 1 AND 30 GROUP BY 1")
def _(v):
    return rounded(P.blocker_losses(blockers(v), "2023-12-31"))


PATH = RAMP + ", bs AS (SELECT date, 100.0 + DAY(date) AS base FROM d30), ls AS (SELECT CAST(CAST(ts AS DATE) + 182 AS DATE) AS date, SUM(0.01 * value) AS l FROM {events} WHERE event_type = 'error' GROUP BY 1)"


@query("scenario_path", f"WITH {PATH.replace('+ 182', '- 2010')} SELECT bs.date, base, ROUND(base + COALESCE(u, 0), 4) AS optimistic, ROUND(GREATEST(base - COALESCE(l, 0), 0), 4) AS pessimistic FROM bs LEFT JOIN (SELECT date, SUM(impact) AS u FROM ip GROUP BY date) i ON bs.date = i.date LEFT JOIN ls ON bs.date = ls.date")
def _(v):
    base = v.spark.range(1, 31).select(F.date_add(F.lit("1998-06-30").cast("date"), F.col("id").cast("int")).alias("date"), (100.0 + F.col("id")).alias("base"))
    loss = v.events.where("event_type = 'error'").select(F.date_sub(F.to_date("ts"), 2010).alias("date"), (0.01 * F.col("value")).alias("loss"))
    return rounded(P.scenario_path(base, P.action_ramp(actions(v), "1998-06-30"), loss))


@query("forecast_evaluation", f"WITH {CAND} SELECT CONCAT(model_id, '@', CAST(cutoff AS STRING)) AS run_id, COUNT(*) AS days, ROUND(SUM(ABS(forecast - actual)) / SUM(ABS(actual)) * 100, 4) AS wape, ROUND(SUM(forecast - actual) / SUM(ABS(actual)) * 100, 4) AS bias FROM fc JOIN cal USING (date) GROUP BY 1")
def _(v):
    c = cal(v)
    h = P.forecast_candidates(c, cuts(v)).withColumn("run_id", F.concat_ws("@", "model_id", F.col("cutoff").cast("string")))
    return rounded(P.forecast_evaluation(h, c))


HIER = "SELECT n_name AS segment, CASE WHEN YEAR(o_orderdate) < 1998 THEN 7 ELSE 30 END AS horizon, c_mktsegment AS scenario, SUM(o_totalprice) AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ALL"


@query("hierarchy_reconcile", f"WITH p AS ({HIER}), t AS (SELECT horizon, scenario, SUM(value * (CASE WHEN scenario = 'BUILDING' THEN 1.05 ELSE 1 END)) AS total FROM p GROUP BY ALL), s AS (SELECT horizon, scenario, SUM(value) AS segments FROM p GROUP BY ALL) SELECT 'nation' AS dimension, horizon, scenario, ROUND(segments, 2) AS segments, ROUND(total, 2) AS total FROM s JOIN t USING (horizon, scenario) WHERE ABS(segments - total) > GREATEST(0.05, ABS(total) * 0.01)")
def _(v):
    p = v.sql(HIER.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")).withColumn("dimension", F.lit("nation"))
    t = p.groupBy("horizon", "scenario").agg((F.sum("value") * F.when(F.col("scenario") == "BUILDING", 1.05).otherwise(1.0)).alias("value"))
    return rounded(P.hierarchy_reconcile(p, t), 2)


@query("series_rules", f"WITH a AS (SELECT COUNT(*) AS n, COUNT(DISTINCT date) AS d, MIN(date) AS lo, MAX(date) AS hi FROM daily_series WHERE MONTH(date) <> 2) SELECT 'too_short' AS rule_id FROM a WHERE n < 90 UNION ALL SELECT 'missing_day' FROM a WHERE hi - lo + 1 > d UNION ALL SELECT 'not_at_as_of' FROM a WHERE hi <> DATE '2001-01-01'")
def _(v):
    return P.series_rules(v.daily_series.where("month(date) <> 2"), "2001-01-01")


@query("regime_window", "WITH a AS (SELECT MIN(date) AS lo, MAX(date) AS hi FROM daily_series) SELECT 'outside_series' AS rule_id FROM a WHERE DATE '1994-12-01' < lo OR DATE '1995-02-01' > hi UNION ALL SELECT 'under_90_days' UNION ALL SELECT 'not_at_as_of'")
def _(v):
    return P.regime_window(v.daily_series, "1994-12-01", "1995-02-01", "1998-06-30")


@query("sources_freshness", "WITH s AS (SELECT source || '/' || scope AS source, MAX(stat_date) AS last_day, BOOL_AND(complete) AS ok FROM fact_status GROUP BY 1) SELECT source, 'warning' AS level, 'stale' AS rule_id FROM s WHERE ok AND DATE '2024-02-10' - last_day > 3 UNION ALL SELECT source, 'error', 'required_blocked' FROM s WHERE NOT ok")
def _(v):
    s = v.fact_status.groupBy(F.concat_ws("/", "source", "scope").alias("source")).agg(F.max("stat_date").alias("last_day"), F.bool_and("complete").alias("ok"))
    return P.sources_freshness(s.select("source", "last_day", F.when(F.col("ok"), "ok").otherwise("error").alias("status"), F.lit(True).alias("required")), "2024-02-10")


@query("adjustment_reconcile", "WITH d AS (SELECT date, actual, CAST(actual AS INT) % 4 AS k FROM daily_series) SELECT date, 'change_without_id' AS rule_id FROM d WHERE k = 1 UNION ALL SELECT date, 'adjusted_differs' FROM d WHERE k = 2")
def _(v):
    d = v.daily_series.withColumn("k", F.col("actual").cast("int") % 4)
    ids = F.when(F.col("k") >= 2, F.array(F.col("date").cast("string"))).otherwise(F.array().cast("array<string>"))
    s = d.select("date", "actual", F.when(F.col("k") > 0, F.col("actual") + 1).otherwise(F.col("actual")).alias("adjusted"), ids.alias("adjustment_ids"))
    log = d.where("k >= 2").select(F.col("date").cast("string").alias("adjustment_id"), "date", F.col("actual").alias("original"), (F.col("actual") + F.when(F.col("k") == 2, 2).otherwise(1)).alias("adjusted"))
    return P.adjustment_reconcile(s, log)


@query("event_calendar_rules", "WITH e AS (SELECT CAST(user_id AS STRING) AS id, event_type, COUNT(*) OVER (PARTITION BY user_id) AS n FROM {events} ) SELECT DISTINCT id, 'duplicate_id' AS rule_id FROM e WHERE n > 1 UNION ALL SELECT DISTINCT id, 'unknown_status' FROM e WHERE event_type = 'error'")
def _(v):
    e = v.events.select(F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("start_date"), F.to_date("ts").alias("end_date"), F.col("event_type").alias("status"))
    return P.event_calendar_rules(e, ["click", "view", "signup", "purchase"])


NAMES = [("pessimistic", 0.95), ("base", 1.0), ("optimistic", 1.05)]
TOTALS = f"dj AS (SELECT date, actual, ROW_NUMBER() OVER (ORDER BY date) AS k FROM cal WHERE date >= DATE '1998-06-01'), tt AS (SELECT h AS horizon, s AS scenario, f, f * (SELECT SUM(actual) FROM dj) AS value FROM (VALUES {', '.join(f'({h}, {chr(39)}{n}{chr(39)}, {k})' for h in (7, 30) for n, k in NAMES)}) x(h, s, f)), su AS (SELECT horizon, scenario, value, (SELECT SUM(actual) FROM dj WHERE k <= horizon) * f AS s FROM tt)"


@query("scenario_totals_check", f"WITH {CAL}, {TOTALS} SELECT 'sum_of_path' AS rule_id, horizon, scenario FROM su WHERE ABS(value - s) > GREATEST(0.05, ABS(s) * 0.01)")
def _(v):
    d = cal(v).where("date >= date '1998-06-01'").select("date", *[(F.col("actual") * k).alias(n) for n, k in [("p10", 0.9), ("p50", 1.0), ("p90", 1.1), ("pessimistic", 0.95), ("base", 1.0), ("optimistic", 1.05)]])
    t = cal(v).where("date >= date '1998-06-01'").agg(F.sum("actual").alias("s")).select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("scenario"), (F.col("s") * k).alias("value")) for h in (7, 30) for n, k in [("pessimistic", 0.95), ("base", 1.0), ("optimistic", 1.05)]])).alias("x")).select("x.*")
    return P.scenario_totals_check(d, t)


@query("normalize_phrase", "SELECT p_partkey AS id, TRIM(REGEXP_REPLACE(LOWER(CONCAT('  ', p_name, '   ', p_type)), '\\s+', ' ', 'g')) AS phrase FROM {part}")
def _(v):
    return v.part.select(F.col("p_partkey").alias("id"), normalize_phrase(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("phrase"))
