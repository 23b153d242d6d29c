"""Expected values of small cases: reconciliation, anomalies, trends, rates, claims, pages, robots, state, news."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions import expr as X
from tidewright.operators import adperf, claims, email, forecast, market, news, pages, trends

D = dt.date


def ads(spark, rows):
    return spark.createDataFrame(rows, "Date date, CampaignId string, CampaignName string, Impressions double, Clicks double, Cost double, row_id long")


def test_reconcile_never_deals_out_revenue(spark):
    day = D(2026, 1, 1)
    d = ads(spark, [(day, "1", "Brand", 1000.0, 50.0, 100.0, 1), (day, "2", "Other", 500.0, 10.0, 100.0, 2), (day, "2", "Other", 500.0, 10.0, 90.0, 3)])
    e = spark.createDataFrame([(day, "1", 500.0, 2.0), (day, "unknown", 300.0, 1.0), (day, "BRAND", 50.0, 1.0)], "Date date, UTMCampaign string, revenue double, purchases double")
    r = {x.CampaignId: x for x in adperf.reconcile_campaign_day(d, e).collect()}
    assert (r["1"].MetrikaRevenue, r["1"].attribution_level, r["1"].match_confidence) == (500.0, "exact", 1.0)
    assert (r["2"].MetrikaRevenue, r["2"].attribution_level, r["2"].Cost) == (None, "unpaired_direct", 90.0)
    s = adperf.reconcile_summary(adperf.reconcile_campaign_day(d, e), e).first()
    assert (s.unattributed_revenue, s.matched_revenue, s.status) == (350.0, 500.0, "incomplete")
    by_name = {x.CampaignId: x for x in adperf.reconcile_campaign_day(d, e, allow_name=True).collect()}
    assert (by_name["1"].MetrikaRevenue, by_name["1"].attribution_level, by_name["1"].match_confidence) == (550.0, "estimated", 0.7)


def test_roas_counts_matched_cost_only(spark):
    f = spark.createDataFrame([("a", 10.0, 5.0, 100.0, 500.0, 2.0, "exact"), ("b", 10.0, 5.0, 100.0, None, None, "unpaired_direct")], "k string, Impressions double, Clicks double, Cost double, MetrikaRevenue double, MetrikaTransactions double, attribution_level string")
    t = adperf.grand_total(f).first()
    assert (t.matched_direct_cost, t.CrossSourceROAS, t.attribution_coverage, t.Cost) == (100.0, 500.0, 0.5, 200.0)
    u = f.unionByName(spark.createDataFrame([("c", 1.0, 1.0, 1.0, 10.0, None, "exact")], f.schema))
    t = adperf.grand_total(u).first()
    assert t.MetrikaTransactions is None and t.MetrikaCPA is None and t.MetrikaCR is None and t.AOV is None and t.MetrikaRevenue == 510.0


def test_coverage_of_days(spark):
    s = spark.createDataFrame([("d", "c", D(2026, 1, 1), True, None, None), ("d", "c", D(2026, 1, 2), False, "timeout", None)], "source string, scope string, stat_date date, complete boolean, error string, fetched_at timestamp")
    gone = adperf.missing_days(s, "2026-01-01", "2026-01-03", [("d", "c")])
    assert sorted(r.stat_date.day for r in gone.collect()) == [2, 3]
    c = adperf.coverage_report(s, "2026-01-01", "2026-01-03", [("d", "c")]).first()
    assert (c.covered, c.expected, c.missing_days, c.failed_days, c.complete) == (1, 3, 1, 1, False)
    assert [(r.date_from.day, r.date_to.day) for r in adperf.date_islands(gone, ["source"]).collect()] == [(2, 3)]


@pytest.mark.parametrize(("bad", "severity"), [(None, "high"), (D(2026, 1, 8), "suppressed")])
def test_weekday_anomaly(spark, bad, severity):
    days = [D(2026, 1, 1) + dt.timedelta(7 * i) for i in range(5)]
    v = spark.createDataFrame(list(zip(days, [100.0, 101.0, 99.0, 100.0, 200.0], strict=True)), "date date, value double")
    s = spark.createDataFrame([(d, d != bad) for d in days], "stat_date date, complete boolean")
    r = adperf.weekday_anomaly(v, s).where(F.col("date") == days[-1]).first()
    assert (r.median, r.mad, r.severity) == (100.0, 0.5, severity)


def months(values, start=(2023, 1)):
    y, m = start
    return [(D(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1), float(v)) for i, v in enumerate(values)]


WAVE = [1, 1, 1, 2, 3, 4, 5, 4, 3, 2, 1.2, 1]
SERIES = {
    "growing": ([100 * 1.05**i for i in range(36)], {"growing", "rapid_growth"}),
    "declining": ([600 * 0.96**i for i in range(36)], {"declining", "structural_decline"}),
    "seasonal": ([100 * WAVE[i % 12] for i in range(36)], {"seasonal_rise", "seasonal_fall"}),
    "breakout": ([0] * 27 + [120] * 3, {"breakout"}),
    "emerging": ([10 + 10 * i for i in range(8)], {"emerging"}),
    "watch": ([0] * 24 + [50 + 20 * k for k in range(12)], {"watch", "emerging", "growing", "rapid_growth"}),
    "rapid": ([20 * 1.12**i for i in range(36)], {"rapid_growth"}),
    "structural": ([1200 * 0.92**i for i in range(36)], {"structural_decline"}),
    "short": ([5, 6, 7], {"insufficient_data"}),
    "recovery": ([300 - 8 * i for i in range(30)] + [90, 120, 150, 180, 220, 260], {"growing", "stable", "watch", "rapid_growth"}),
}


def test_trend_classes(spark):
    rows = [(k, m, v) for k, (values, _) in SERIES.items() for m, v in months(values)]
    s = spark.createDataFrame(rows, "cluster_id string, month date, value double")
    got = {r.cluster_id: r for r in trends.trend_signal(trends.trend_frame(s, 30.0), 30.0).collect()}
    for k, (_, want) in SERIES.items():
        assert got[k].signal in want, (k, got[k])
    assert got["breakout"].new_demand and got["structural"].structural_decline and got["emerging"].confidence <= 0.55
    assert got["watch"].active_months == 12


def test_series_flags(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, True), ("a", D(2024, 1, 1), -1.0, True), ("a", D(2024, 4, 1), 1.0, False)], "cluster_id string, month date, value double, complete boolean")
    assert trends.series_gap_check(s, "2024-04-15").first().flags == ["duplicate_month", "incomplete_month", "negative_value", "non_contiguous_history", "possibly_incomplete_current_month"]


def test_trend_deltas(spark):
    old = spark.createDataFrame([("a", "stable", 0.0, 100.0), ("b", "declining", -3.0, 100.0), ("d", "stable", 0.0, 90.0), ("e", "stable", 0.0, 50.0)], "cluster_id string, signal string, slope double, current_3m_avg double")
    new = spark.createDataFrame([("a", "growing", 1.0, 100.0, False), ("b", "stable", 0.0, 100.0, False), ("c", "breakout", 0.0, 100.0, True), ("d", "stable", 0.0, 30.0, False), ("e", "stable", 2.0, 50.0, False)], "cluster_id string, signal string, slope double, current_3m_avg double, new_demand boolean")
    assert {r.cluster_id: r.delta for r in trends.trend_delta(old, new).collect()} == {"a": "new_growth", "b": "recovered", "c": "new_demand", "d": "lost_materiality", "e": "accelerating"}


def test_null_is_not_zero(spark):
    c = spark.createDataFrame([("x", 2, 10), ("x", None, 10), ("y", 2, 10), ("y", 4, 10)], "k string, leads int, sessions int")
    got = {r.k: r.lead_cr for r in email.weighted_baseline(c, ["k"]).collect()}
    assert got == {"x": None, "y": 0.3}
    r = spark.range(1).select(X.ratio(F.lit(0), F.lit(5)).alias("zero"), X.ratio(F.lit(None), F.lit(5)).alias("unknown"), X.ratio(F.lit(1), F.lit(0)).alias("none"), X.strict_number(F.lit(True)).alias("b"), X.number(F.lit("--"), dashes=True).alias("n")).first()
    assert tuple(r) == (0.0, None, None, None, 0.0)


def test_urls(spark):
    bad = ["https://e.org/?email=x", "https://e.org/?q=a%40b.org", "https://e.org/?a=1;Phone=2"]
    d = spark.createDataFrame([(u,) for u in [*bad, "https://e.org/?page=2"]], "url string")
    assert sorted(r.url for r in email.url_pii_scan(d).collect()) == sorted(bad)
    c = lambda u: spark.range(1).select(X.canonical_url(F.lit(u)).alias("u")).first().u
    assert c("https://doi.org/10.1000/ABC.1") == "doi:10.1000/ABC.1" and c("http://arxiv.org/abs/2401.12345v2") == "arxiv:2401.12345v2"
    assert c("HTTPS://E.org:443/a/?utm_source=x&b=2&a=1#f") == "https://e.org/a?a=1&b=2"


def test_claims(spark):
    cl = spark.createDataFrame([("a", "Paris has 2 million people.", "factual"), ("b", "Paris has 3 million people.", "factual"), ("c", "It might rain in the coming weeks.", "speculation"), ("d", "Nothing is linked to this claim.", "factual")], "claim_id string, text string, claim_type string")
    ev = spark.createDataFrame([("e1", "Paris  has 2 million people."), ("e2", "Paris has 2 million people.")], "evidence_id string, quote string")
    ln = spark.createDataFrame([("a", "e1"), ("b", "e2")], "claim_id string, evidence_id string")
    got = {r.claim_id: r.support_status for r in claims.claim_support(cl, ln, ev).collect()}
    assert got == {"a": "supported", "b": "partial", "c": "supported", "d": "unsupported"}


def test_links_are_told_apart_by_choice(spark, monkeypatch):
    """Claims of one choice of ids and sources share its lists, long lists are cut; scores in batches are those of joined rows."""
    texts = ["Paris has 2 million people and Rome 19% in 1999.", "Rome grew by 19% of its people.", "", None, "Berlin has many large parks."]
    ev = [(f"e{i % 11}" if i else None, f"s{i % 3}", texts[i % 5]) for i in range(14)]
    cl = [(f"c{i % 19}", texts[i % 4], "factual", [f"e{i % 4}", None, "nowhere"] if i % 3 else None, [f"s{i % 3}", f"s{i % 2}"] if i % 5 else []) for i in range(40)]
    c = spark.createDataFrame(cl, "claim_id string, text string, claim_type string, evidence_ids array<string>, cited_source_ids array<string>")
    e = spark.createDataFrame(ev, "evidence_id string, source_id string, quote string")
    want = {(k, x) for k, _, _, ids, sources in cl for x, s, _ in ev if x in {*(ids or [])} - {None} or s in sources and x}
    monkeypatch.setattr(claims, "LIST", 3)
    lists = claims.claim_evidence_lists(c, e).collect()
    assert lists and any(len(r.found) < len({x for k, x in want if k == r.claim_id}) for r in lists)
    links = claims.claim_evidence_link(c, e)
    got = [tuple(r) for r in links.where("evidence_id is not null").collect()]
    assert set(got) == want and len(got) == len(want)
    scores = []
    for few, some in ((20_000, claims.claim_evidence_lists(c, e)), (0, links)):
        monkeypatch.setattr(claims, "FEW_QUOTES", few)
        scores.append({tuple(r) for r in claims.claim_support(c, some.where("claim_id <> 'c3'"), e).collect()})
    assert scores[0] == scores[1] and len(scores[0]) == 19 and {r[2] for r in scores[0]} >= {"supported", "unsupported"}


def test_news_keeps_the_heavier_source(spark):
    n = spark.createDataFrame([(1, "Openai ships a new model today", "light"), (2, "Openai ships a new model today", "heavy"), (3, "Completely different headline about boats", "light")], "id long, title string, source string")
    got = news.batch_near_dedup(n, {"heavy": 1.0, "light": 0.5}).collect()
    assert sorted(r.id for r in got) == [2, 3]


def test_robots_truth_table(spark):
    cases = {"User-agent: *\nDisallow: /": "blocked", "User-agent: GPTBot\nAllow: /": "allowed", "": "allowed", "User-agent: *\nDisallow: /*": "unknown", "User-agent: *\nAllow: /\nDisallow: /": "unknown", "User-agent: GPTBot\nUser-agent: X\n\nUser-agent: *\nDisallow: /a": "allowed", "User-agent: *\nDisallow: /x\nUser-agent: *\nDisallow: /": "unknown"}
    r = spark.createDataFrame([(b, b) for b in cases], "host string, body string")
    assert {x.host: x.access for x in pages.robots_access(r, ["GPTBot"]).collect()} == cases


HTML = """<!DOCTYPE html><html lang="en"><head><title>A title</title><meta name="description" content="d"><meta name="viewport" content="w"><link rel="canonical" href="/x"><link rel="icon" href="/i">
<link rel="alternate" hreflang="de" href="/de"><meta property="og:title" content="o"><meta name="twitter:card" content="t"><script type="application/ld+json">{"@type": "Article", "author": {"@type": ["Person"]}}</script></head>
<body><nav>menu <a href="/about">About</a></nav><h1>One</h1><h3>Skipped</h3><p>Updated 2024-01-02, written by Ann. <a href="/a">a</a><a href="/b#x">b</a><a href="https://doi.org/1">c</a><a href="mailto:x@y">m</a><a href="/privacy">p</a><img src="x" alt="y"><img src="z"></p></body></html>"""


def test_page_pass(spark):
    a = pages.audit_html(spark.createDataFrame([(1, "https://e.org/x", HTML), (2, "http://e.org/y", "<p>broken"), (3, None, None)], "page_id long, url string, html string")).collect()
    p = {r.page_id: r for r in a}
    assert (p[1].title, p[1].description, p[1].lang, p[1].canonical, p[1].schema_types) == ("A title", "d", "en", "/x", ["Article", "Person"])
    assert [(h.level, h.text) for h in p[1].headings] == [(1, "One"), (3, "Skipped")] and p[1].images.total == 2 and p[1].images.with_alt == 1
    assert [x.internal for x in p[1].links] == [True, True, True, False, True] and "menu" not in p[1].text
    df = spark.createDataFrame(a, pages.SCHEMA)
    s = {r.page_id: r for r in pages.page_score(df).collect()}
    assert {i.rule_id for i in s[1].issues} == {"few_alts", "thin_content"} and s[1].score == 90
    assert {"no_https", "no_title", "no_h1"} <= {i.rule_id for i in s[2].issues}
    ctx = spark.createDataFrame([(1, True, True, False, 2)], "page_id long, search_blocked boolean, ai_blocked boolean, sitemap boolean, redirects int")
    assert pages.page_score(df.where("page_id = 1"), ctx).first().score == 90 - 15 - 10 - 10 - 5
    assert [(r.level, r.previous) for r in pages.heading_level_skips(df).collect()] == [(3, 1)]


def test_state_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", ["p"]), ("b", "y", None)], "k string, name string, tags array<string>")
    new = spark.createDataFrame([("a", "", ["q", "p"]), ("c", "z", ["r"])], "k string, name string, tags array<string>")
    once = market.keyed_state_merge(old, new, ["k"])
    rows = lambda d: sorted((r.k, r.name, r.tags) for r in d.collect())
    assert rows(once) == [("a", "x", ["p", "q"]), ("b", "y", None), ("c", "z", ["r"])] == rows(market.keyed_state_merge(once, new, ["k"]))
    with pytest.raises(ValueError):
        market.keyed_state_merge(old, new.unionByName(new), ["k"])


def test_scenarios(spark):
    days = [(D(2026, 1, 1) + dt.timedelta(i), 90.0, 100.0, 110.0, 99.0, 100.0, 101.0) for i in range(30)]
    d = spark.createDataFrame(days, "date date, p10 double, p50 double, p90 double, pessimistic double, base double, optimistic double")
    t = spark.createDataFrame([(h, n, v) for h, vs in {7: (693.0, 700.0, 707.0), 30: (2970.0, 3000.0, 3030.0)}.items() for n, v in zip(("pessimistic", "base", "optimistic"), vs, strict=True)], "horizon int, scenario string, value double")
    assert forecast.scenario_totals_check(d, t).count() == 0
    worse = t.withColumn("value", F.when((F.col("horizon") == 7) & (F.col("scenario") == "base"), 900.0).otherwise(F.col("value")))
    assert {r.rule_id for r in forecast.scenario_totals_check(d, worse).collect()} == {"sum_of_path", "scenario_order"}
    assert {r.rule_id for r in forecast.scenario_totals_check(d.withColumn("p10", F.lit(120.0)), t).collect()} == {"quantile_order"}


def test_campaign_days_are_worked_out_once(spark, tmp_path):
    """Lines are summed by numbers and give the rows of the SQL view, repeated suppliers included; what reconciles reads them once."""
    from tidewright.operators import adperf
    from tidewright.plans.views import Views

    small = Views(spark, "/root/testdata/sf0.001")
    for t in ("lineitem", "part", "nation", "orders"):
        small.table(t).write.parquet(f"{tmp_path}/{t}.parquet")
    twice = small.supplier.where("s_suppkey % 4 = 0").withColumn("s_name", F.concat(F.lit("A"), "s_name")).withColumn("s_nationkey", F.pmod(F.col("s_nationkey") + 1, F.lit(25)).cast("int"))
    small.supplier.unionByName(twice).write.parquet(f"{tmp_path}/supplier.parquet")
    v = Views(spark, str(tmp_path))
    columns = ["Date", "CampaignId", "CampaignName", "CampaignType", "CampaignStatus", "Region", "Impressions", "Clicks", F.round("Cost", 2).alias("Cost"), "row_id"]
    got, want = v.campaign_day.select(*columns), v.sql("SELECT * FROM campaign_day").select(*columns)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert "l_shipdate" not in adperf.reconcile_campaign_day(v.campaign_day, v.ecom_facts, True)._jdf.queryExecution().optimizedPlan().toString()
