"""Queries over advertising facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import adperf as A
from tidewright.plans.registry import query


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CUR, PREV = ("1997-01-01", "1997-06-30"), ("1996-07-05", "1996-12-31")
HIT = "MetrikaRevenue IS NOT NULL AND attribution_level IN ('exact','estimated')"
KPI_NAMES = "Impressions Clicks Cost DirectCTR DirectCPC MetrikaRevenue MetrikaTransactions matched_direct_cost attribution_coverage CrossSourceROAS CrossSourceDRR MetrikaCPA MetrikaCR AOV".split()


def kpis(key: str, source: str = "matched", where: str = "TRUE", group: str | None = None) -> str:
    """SQL of the KPIs per key, not rounded."""
    return f"""SELECT key, Impressions, Clicks, Cost, CASE WHEN Impressions <> 0 THEN Clicks / Impressions * 100 END AS DirectCTR, CASE WHEN Clicks <> 0 THEN Cost / Clicks END AS DirectCPC,
      CASE WHEN br > 0 THEN rev END AS MetrikaRevenue, CASE WHEN br > 0 THEN tx END AS MetrikaTransactions, CASE WHEN br > 0 THEN mc END AS matched_direct_cost, br * 1.0 / n AS attribution_coverage,
      CASE WHEN br > 0 AND mc > 0 THEN rev / mc * 100 END AS CrossSourceROAS, CASE WHEN br > 0 AND mc > 0 AND rev <> 0 THEN mc / rev * 100 END AS CrossSourceDRR,
      CASE WHEN br > 0 AND mc > 0 AND tx <> 0 THEN mc / tx END AS MetrikaCPA, CASE WHEN br > 0 AND mc > 0 AND cl <> 0 THEN tx / cl * 100 END AS MetrikaCR, CASE WHEN br > 0 AND mc > 0 AND tx <> 0 THEN rev / tx END AS AOV
      FROM (SELECT {key} AS key, COUNT(*) AS n, SUM(Impressions) AS Impressions, SUM(Clicks) AS Clicks, SUM(Cost) AS Cost, COUNT(*) FILTER (WHERE {HIT}) AS br, COALESCE(SUM(Cost) FILTER (WHERE {HIT}), 0) AS mc,
      COALESCE(SUM(Clicks) FILTER (WHERE {HIT}), 0) AS cl, COALESCE(SUM(MetrikaRevenue) FILTER (WHERE {HIT}), 0) AS rev,
      CASE WHEN COUNT(*) FILTER (WHERE {HIT} AND MetrikaTransactions IS NULL) = 0 THEN COALESCE(SUM(MetrikaTransactions) FILTER (WHERE {HIT}), 0) END AS tx FROM {source} WHERE {where} GROUP BY {group or key})"""


def rnd(names, digits: int = 4) -> str:
    return ", ".join(f"ROUND({n}, {digits}) AS {n}" for n in names)


def day_range(r, col="Date"):
    return f"{col} BETWEEN DATE '{r[0]}' AND DATE '{r[1]}'"


@query("reconcile_campaign_day", """SELECT c.Date, c.CampaignId, c.CampaignName, ROUND(c.Cost, 4) AS Cost, ROUND(e.r, 2) AS MetrikaRevenue, e.t AS MetrikaTransactions, CASE WHEN e.UTMCampaign IS NULL THEN 'unpaired_direct' ELSE 'exact' END AS attribution_level,
    CASE WHEN e.UTMCampaign IS NULL THEN 0.0 ELSE 1.0 END AS match_confidence FROM campaign_day c LEFT JOIN (SELECT Date, UTMCampaign, SUM(revenue) AS r, SUM(COALESCE(purchases, 0)) AS t FROM ecom_facts GROUP BY Date, UTMCampaign) e ON c.Date = e.Date AND c.CampaignId = e.UTMCampaign""")
def _(v):
    r = A.reconcile_campaign_day(v.campaign_day, v.ecom_facts, allow_name=True)
    return r.select("Date", "CampaignId", "CampaignName", F.round("Cost", 4).alias("Cost"), F.round("MetrikaRevenue", 2).alias("MetrikaRevenue"), "MetrikaTransactions", "attribution_level", "match_confidence")


@query("reconcile_summary", """WITH e AS (SELECT Date, UTMCampaign, SUM(revenue) AS r, SUM(COALESCE(purchases, 0)) AS t FROM ecom_facts GROUP BY Date, UTMCampaign), j AS (SELECT c.Cost, e.UTMCampaign AS k, e.r, e.t FROM campaign_day c LEFT JOIN e ON c.Date = e.Date AND c.CampaignId = e.UTMCampaign)
    SELECT COUNT(*) AS direct_campaigns, COUNT(k) AS exact_campaigns, 0 AS estimated_campaigns, COUNT(*) - COUNT(k) AS unpaired_direct_campaigns, ROUND((SELECT SUM(r) FROM e) - COALESCE(SUM(r), 0), 2) AS unattributed_revenue, ROUND((SELECT SUM(t) FROM e) - COALESCE(SUM(t), 0), 2) AS unattributed_transactions,
    ROUND(SUM(Cost), 2) AS direct_cost, ROUND(COALESCE(SUM(r), 0), 2) AS matched_revenue, CASE WHEN ROUND((SELECT SUM(r) FROM e) - COALESCE(SUM(r), 0), 2) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM j""")
def _(v):
    return A.reconcile_summary(A.reconcile_campaign_day(v.campaign_day, v.ecom_facts, allow_name=True), v.ecom_facts)


@query("enrich_campaign_attributes", "SELECT f.Date, f.CampaignId, ROUND(f.Cost, 4) AS Cost, d.CampaignStatus, d.CampaignType FROM campaign_day f LEFT JOIN (SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN s_acctbal < 0 THEN 'OFF' ELSE 'ON' END AS CampaignStatus, CONCAT('T', CAST(s_nationkey % 3 AS STRING)) AS CampaignType FROM {supplier} WHERE s_suppkey % 4 <> 0) d ON f.CampaignId = d.id")
def _(v):
    dim = v.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").cast("string").alias("CampaignId"), F.when(F.col("s_acctbal") < 0, "OFF").otherwise("ON").alias("CampaignStatus"), F.concat(F.lit("T"), (F.col("s_nationkey") % 3).cast("string")).alias("CampaignType"))
    return rounded(A.enrich_campaign_attributes(v.campaign_day, dim, ["CampaignStatus", "CampaignType"]).select("Date", "CampaignId", "Cost", "CampaignStatus", "CampaignType"))


@query("dimension_rollup", f"SELECT key, {rnd(KPI_NAMES[:3] + ['MetrikaRevenue', 'MetrikaTransactions', 'matched_direct_cost'])} FROM ({kpis('Region')})")
def _(v):
    return rounded(A.dimension_rollup(v.matched, "Region").select("key", *KPI_NAMES[:3], "MetrikaRevenue", "MetrikaTransactions", "matched_direct_cost"))


@query("derived_kpis", f"SELECT key, {rnd(KPI_NAMES)} FROM ({kpis('CampaignName')})")
def _(v):
    return rounded(A.dimension_rollup(v.matched, "CampaignName"))


@query("grand_total", f"SELECT key, {rnd(KPI_NAMES)} FROM ({kpis(chr(39) + 'TOTAL' + chr(39), group='1')})")
def _(v):
    return rounded(A.grand_total(v.matched))


@query("top_n_dimension", f"SELECT key, {rnd(KPI_NAMES)} FROM ({kpis('CampaignName')}) ORDER BY Cost DESC, key LIMIT 10")
def _(v):
    return rounded(A.top_n_dimension(v.matched, "CampaignName", 10))


PC = ["Impressions", "Clicks", "Cost", "MetrikaRevenue", "CrossSourceROAS"]


@query("period_compare", f"SELECT c.key, {', '.join(f'ROUND(c.{m}, 4) AS {m}' for m in PC)}, {', '.join(f'ROUND(CASE WHEN p.{m} <> 0 THEN (c.{m} - p.{m}) / ABS(p.{m}) * 100 END, 4) AS {m}_delta_pct' for m in PC)} FROM ({kpis('CampaignName', where=day_range(CUR))}) c LEFT JOIN ({kpis('CampaignName', where=day_range(PREV))}) p ON c.key = p.key")
def _(v):
    return rounded(A.period_compare(A.between(v.matched, *CUR), A.between(v.matched, *PREV), "CampaignName", PC))


@query("likely_drivers", f"WITH c AS ({kpis('CampaignName', where=day_range(CUR))}), p AS ({kpis('CampaignName', where=day_range(PREV))}) SELECT c.key, ROUND(c.Cost, 4) AS current, ROUND(p.Cost, 4) AS previous, ROUND(c.Cost - p.Cost, 4) AS delta, ROUND((c.Cost - p.Cost) / ((SELECT SUM(Cost) FROM c) - (SELECT SUM(Cost) FROM p)), 4) AS contribution_share FROM c JOIN p ON c.key = p.key WHERE c.Cost <> p.Cost ORDER BY ABS(c.Cost - p.Cost) DESC, c.key LIMIT 3")
def _(v):
    return rounded(A.likely_drivers(A.between(v.matched, *CUR), A.between(v.matched, *PREV), "Cost"))


@query("session_totals", "SELECT SUM(visits) AS visits, SUM(users) AS users, SUM(goal1reaches + goal2reaches) AS goal_reaches FROM sessions")
def _(v):
    return A.session_totals(v.sessions)


S1, S2 = ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15")


def _funnel(v):
    return A.funnel_compare(A.between(v.matched, *CUR), A.between(v.matched, *PREV), A.between(v.sessions, *S1), A.between(v.sessions, *S2))


def _stage(stage, metric, col, table):
    return f"SELECT '{stage}' AS stage, '{metric}' AS metric, CAST((SELECT {col} FROM {table[0]}) AS DOUBLE) AS a, CAST((SELECT {col} FROM {table[1]}) AS DOUBLE) AS b"


FUNNEL = f"""WITH c AS ({kpis("'T'", where=day_range(CUR), group='1')}), p AS ({kpis("'T'", where=day_range(PREV), group='1')}), sc AS (SELECT SUM(visits) AS visits, SUM(goal1reaches + goal2reaches) AS goal_reaches FROM sessions WHERE {day_range(S1)}), sp AS (SELECT SUM(visits) AS visits, SUM(goal1reaches + goal2reaches) AS goal_reaches FROM sessions WHERE {day_range(S2)}),
    u AS ({' UNION ALL '.join(_stage(s, m, m, ('sc', 'sp') if m in ('visits', 'goal_reaches') else ('c', 'p')) for s, m in [('serving', 'Impressions'), ('click', 'Clicks'), ('click_efficiency', 'DirectCTR'), ('post_click', 'visits'), ('goal', 'goal_reaches'), ('business', 'MetrikaTransactions'), ('business', 'MetrikaRevenue'), ('business_value', 'AOV')])})"""


@query("funnel_compare", FUNNEL + " SELECT stage, metric, ROUND(a, 4) AS current, ROUND(b, 4) AS previous, ROUND(a - b, 4) AS delta, ROUND(CASE WHEN b <> 0 THEN (a - b) / ABS(b) * 100 END, 4) AS delta_pct FROM u")
def _(v):
    return rounded(_funnel(v))


@query("confirmed_causes", "SELECT CampaignName AS campaign, CampaignStatus, COUNT(*) AS rows FROM matched WHERE CampaignStatus <> 'ON' GROUP BY ALL")
def _(v):
    return A.confirmed_causes(v.matched)


HYP = {"serving_or_demand": "'Impressions'", "click_acquisition": "'Clicks','DirectCTR'", "post_click": "'visits','goal_reaches'", "conversion_or_attribution": "'MetrikaTransactions','MetrikaRevenue'"}


@query("hypothesis_rules", FUNNEL + ", f AS (SELECT metric FROM u WHERE a < b), h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS hypothesis WHERE EXISTS (SELECT 1 FROM f WHERE metric IN ({m}))" for k, m in HYP.items()) + ") SELECT hypothesis FROM h UNION ALL SELECT 'no_driver_isolated' WHERE NOT EXISTS (SELECT 1 FROM h)")
def _(v):
    return A.hypothesis_rules(_funnel(v), "Cost")


@query("diagnosis_record")
def _(v):
    return A.diagnosis_record(A.between(v.matched, *CUR), A.between(v.matched, *PREV), A.between(v.sessions, *S1), A.between(v.sessions, *S2), "Cost", True)


@query("guardrail_alerts", f"WITH k AS ({kpis('CampaignName')}) SELECT key, 'DirectCPC' AS metric, 'max' AS bound, 75.0 AS \"limit\", ROUND(DirectCPC, 4) AS value FROM k WHERE DirectCPC > 75 UNION ALL SELECT key, 'Cost', 'min', 100000.0, ROUND(Cost, 4) FROM k WHERE Cost < 100000 UNION ALL SELECT key, 'AOV', 'min', 150000.0, ROUND(AOV, 4) FROM k WHERE AOV < 150000")
def _(v):
    return rounded(A.guardrail_alerts(A.dimension_rollup(v.matched, "CampaignName"), [("DirectCPC", None, 75.0), ("Cost", 100000.0, None), ("AOV", 150000.0, None)]))


@query("report_spec_query", f"SELECT key, {rnd(['Clicks', 'Cost', 'CrossSourceROAS'])} FROM ({kpis('Region', where=day_range(CUR))}) ORDER BY Cost DESC, key LIMIT 5")
def _(v):
    return rounded(A.report_spec_query(v.matched, "region", ["Clicks", "Cost", "CrossSourceROAS"], top=5, period=CUR))


@query("focus_filter", "SELECT CampaignId, COUNT(*) AS n FROM matched WHERE LOWER(CampaignName) LIKE '%7%' OR LOWER(Region) LIKE '%7%' OR CampaignId LIKE '%7%' OR LOWER(CampaignType) LIKE '%7%' OR LOWER(CampaignStatus) LIKE '%7%' OR attribution_level LIKE '%7%' GROUP BY CampaignId")
def _(v):
    return A.focus_filter(v.matched, "7").groupBy("CampaignId").agg(F.count("*").alias("n"))


REQ = [("direct", "campaign"), ("metrika", "ecommerce")]
RANGE = ("1997-01-01", "1997-12-31")
WANT = f"w AS (SELECT source, scope, CAST(d AS DATE) AS stat_date FROM (VALUES ('direct','campaign'),('metrika','ecommerce')) r(source, scope), (SELECT UNNEST(generate_series(DATE '{RANGE[0]}', DATE '{RANGE[1]}', INTERVAL 1 DAY)) AS d) g)"


@query("missing_days", f"WITH {WANT} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM fact_status s WHERE s.source = w.source AND s.scope = w.scope AND s.stat_date = w.stat_date AND s.complete)")
def _(v):
    return A.missing_days(v.fact_status, *RANGE, REQ)


@query("late_day_retry", f"WITH {WANT} SELECT * FROM w WHERE stat_date < DATE '1997-07-01' AND NOT EXISTS (SELECT 1 FROM fact_status s WHERE s.source = w.source AND s.scope = w.scope AND s.stat_date = w.stat_date AND s.complete)")
def _(v):
    return A.missing_days(v.fact_status, *RANGE, REQ, today="1997-07-01")


@query("coverage_report", f"WITH {WANT} SELECT w.source, w.scope, COUNT(*) FILTER (WHERE complete) AS covered, COUNT(*) AS expected, COUNT(*) FILTER (WHERE complete IS NULL) AS missing_days, COUNT(*) FILTER (WHERE NOT complete) AS failed_days, MAX(fetched_at) AS latest_fetch, BOOL_AND(COALESCE(complete, FALSE)) AS complete FROM w LEFT JOIN fact_status s ON s.source = w.source AND s.scope = w.scope AND s.stat_date = w.stat_date GROUP BY w.source, w.scope")
def _(v):
    return A.coverage_report(v.fact_status, *RANGE, REQ)


@query("date_islands", f"WITH {WANT}, m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM fact_status s WHERE s.source = w.source AND s.scope = w.scope AND s.stat_date = w.stat_date AND s.complete)), g AS (SELECT *, stat_date - CAST(ROW_NUMBER() OVER (PARTITION BY source, scope ORDER BY stat_date) AS INT) AS k FROM m) SELECT source, scope, MIN(stat_date) AS date_from, MAX(stat_date) AS date_to, COUNT(*) AS days FROM g GROUP BY source, scope, k")
def _(v):
    return A.date_islands(A.missing_days(v.fact_status, *RANGE, REQ), ["source", "scope"])


@query("fact_inventory", "SELECT source, scope, COUNT(*) AS n, MIN(stat_date) AS first_day, MAX(stat_date) AS last_day FROM fact_status GROUP BY source, scope")
def _(v):
    return A.fact_inventory(v.fact_status)


@query("reconcile_ready_days", "SELECT DISTINCT a.stat_date FROM fact_status a JOIN fact_status b ON a.stat_date = b.stat_date WHERE a.source = 'direct' AND a.complete AND b.source = 'metrika' AND b.scope = 'ecommerce' AND b.complete")
def _(v):
    return A.reconcile_ready_days(v.fact_status, ("direct", "campaign"), ("metrika", "ecommerce"))


@query("partition_rows_by_day", f"SELECT CAST(d AS DATE) AS stat_date, COALESCE(n, 0) AS rows, TRUE AS complete FROM (SELECT UNNEST(generate_series(DATE '1998-10-01', DATE '1999-01-31', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT Date, COUNT(*) AS n FROM campaign_day WHERE CampaignId = '7' GROUP BY Date) ON d = Date")
def _(v):
    return A.partition_rows_by_day(v.campaign_day.where("CampaignId = '7'"), "1998-10-01", "1999-01-31")


@query("load_fact_range", "SELECT Date, CampaignId, ROUND(Cost, 4) AS Cost FROM campaign_day WHERE Date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'")
def _(v):
    return rounded(A.between(v.campaign_day, "1996-03-01", "1996-03-31").select("Date", "CampaignId", "Cost"))


WEEKDAYS = """WITH p AS (SELECT CAST(d.date + 7 * k AS DATE) AS date, d.date AS base_day, d.actual AS base FROM daily_series d, (VALUES (1),(2),(3),(4)) x(k)), ok AS (SELECT stat_date, BOOL_AND(complete) AS ok FROM fact_status WHERE source = 'metrika' AND scope = 'ecommerce' GROUP BY stat_date),
    m AS (SELECT date, MEDIAN(base) AS median, COUNT(*) AS n, BOOL_AND(COALESCE(ok, FALSE)) AS base_ok FROM p LEFT JOIN ok ON base_day = stat_date GROUP BY date), q AS (SELECT p.date, MEDIAN(ABS(base - median)) AS mad FROM p JOIN m ON p.date = m.date GROUP BY p.date),
    j AS (SELECT d.date, d.actual AS value, median, mad, n, CASE WHEN mad <> 0 AND n >= 4 THEN 0.6745 * (d.actual - median) / mad END AS z, COALESCE(ok, FALSE) AND COALESCE(base_ok, FALSE) AND COALESCE(n, 0) >= 4 AS complete FROM daily_series d LEFT JOIN m ON d.date = m.date LEFT JOIN q ON d.date = q.date LEFT JOIN ok ON d.date = stat_date)
    SELECT date, value, median, mad, ROUND(z, 4) AS z, complete, CASE WHEN NOT COALESCE(ABS(z) >= 3.5, FALSE) THEN 'normal' WHEN COALESCE(ABS(value - median) >= 3, FALSE) AND complete THEN 'high' WHEN NOT complete THEN 'suppressed' ELSE 'low' END AS severity FROM j"""


@query("weekday_anomaly", WEEKDAYS)
def _(v):
    status = v.fact_status.where("source = 'metrika' and scope = 'ecommerce'")
    return rounded(A.weekday_anomaly(v.daily_series.withColumnRenamed("actual", "value"), status, min_abs=3.0))


@query("cohort_benchmark", """SELECT CONCAT_WS('+', CampaignType, CASE WHEN REGEXP_MATCHES(CampaignName, '(?i)1$') THEN 'one' END, CASE WHEN REGEXP_MATCHES(CampaignName, '(?i)supplier.*2') THEN 'two' END) AS cohort, COUNT(cpc) AS cpc_n, ROUND(QUANTILE_CONT(cpc, 0.25), 4) AS cpc_p25, ROUND(MEDIAN(cpc), 4) AS cpc_p50, ROUND(QUANTILE_CONT(cpc, 0.75), 4) AS cpc_p75
    FROM (SELECT CampaignName, CampaignType, SUM(Cost) / SUM(Clicks) AS cpc FROM campaign_day GROUP BY CampaignName, CampaignType) GROUP BY 1""")
def _(v):
    base = v.campaign_day.groupBy("CampaignName", "CampaignType").agg((F.sum("Cost") / F.sum("Clicks")).alias("cpc"))
    return rounded(A.cohort_benchmark(base, [("one", "1$"), ("two", "supplier.*2")], ["cpc"], "CampaignType", "CampaignName"))


@query("shadow_gate", """SELECT COUNT(*) AS cases, COUNT(*) FILTER (WHERE NOT complete OR evidence = 0) AS missing, ROUND(AVG(CASE WHEN verdict = 'confirmed' THEN 1.0 ELSE 0 END), 4) AS confirmed_cause_rate, ROUND(AVG(CASE WHEN verdict = 'refuted' THEN 1.0 ELSE 0 END) FILTER (WHERE confirmed_causes > 0), 4) AS false_certainty_rate,
    ROUND(AVG(CASE WHEN verdict = 'confirmed' THEN 1.0 ELSE 0 END) FILTER (WHERE priority = 'high'), 4) AS high_priority_precision, COUNT(*) FILTER (WHERE priority = 'high') AS high_priority_cases, MEDIAN(hours) AS median_hours, CASE WHEN COUNT(*) >= 10 AND COUNT(*) FILTER (WHERE NOT complete OR evidence = 0) = 0 THEN 'passed' ELSE 'blocked' END AS gate FROM verdicts""")
def _(v):
    return rounded(A.shadow_gate(v.verdicts))


@query("feedback_join", "SELECT d.doc_id AS run_id, source, verdict, hours FROM {documents} d LEFT JOIN verdicts v ON d.doc_id = v.run_id")
def _(v):
    return A.feedback_join(v.documents.select(F.col("doc_id").alias("run_id"), "source"), v.verdicts.select("run_id", "verdict", "hours"))


@query("comparison_windows", """SELECT w AS "window", SUM(actual) AS total, ROUND(AVG(actual), 4) AS mean, COUNT(*) AS days FROM daily_series, (VALUES ('day',0,0),('previous_day',1,1),('last_7',6,0),('prior_7',13,7),('last_30',29,0)) x(w, a, b) WHERE date BETWEEN DATE '1998-03-01' - a AND DATE '1998-03-01' - b GROUP BY w""")
def _(v):
    return rounded(A.comparison_windows(v.daily_series, "1998-03-01"))
