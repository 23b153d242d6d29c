"""Queries over e-mail campaigns, visibility, phrases, brands, competitors, registries and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import expr as X
from tidewright.operators import email as E
from tidewright.operators import market as M
from tidewright.plans.ads import rounded
from tidewright.plans.demand import MIN, SIGNAL, frame
from tidewright.plans.registry import query

R = lambda a, b, k=1: f"CASE WHEN {b} > 0 THEN {a} * {float(k)} / {b} END"
RATES = list(E.RATES.items())


@query("campaign_rates", f"SELECT campaign_id, {', '.join(f'ROUND({R(*v)}, 6) AS {n}' for n, v in RATES)}, DATE '2024-02-01' - sent_on AS age_days, DATE '2024-02-01' - sent_on >= 7 AS baseline_eligible FROM email_campaigns")
def _(v):
    return rounded(E.campaign_rates(v.email_campaigns, "2024-02-01").select("campaign_id", *E.RATES, "age_days", "baseline_eligible"), 6)


COLS = sorted({c for _, v in RATES for c in v[:2]})


@query("weighted_baseline", f"WITH t AS (SELECT campaign_type, COUNT(*) AS campaigns, {', '.join(f'CASE WHEN COUNT({c}) = COUNT(*) THEN SUM({c}) END AS t_{c}' for c in COLS)}, {', '.join(f'MEDIAN({R(*v)}) AS median_{n}' for n, v in RATES)} FROM email_campaigns GROUP BY campaign_type) SELECT campaign_type, campaigns, {', '.join(f'ROUND({R(chr(116) + chr(95) + v[0], chr(116) + chr(95) + v[1], v[2])}, 6) AS {n}' for n, v in RATES)}, {', '.join(f'ROUND(median_{n}, 6) AS median_{n}' for n, v in RATES)} FROM t")
def _(v):
    return rounded(E.weighted_baseline(v.email_campaigns, ["campaign_type"]), 6)


@query("safe_ratio", "SELECT campaign_id, ROUND(CASE WHEN leads > 0 THEN sales * 1.0 / leads END, 6) AS r FROM email_campaigns")
def _(v):
    return rounded(v.email_campaigns.select("campaign_id", X.ratio("sales", "leads").alias("r")), 6)


@query("campaign_counts", "SELECT campaign_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE DATE '2024-02-01' - sent_on >= 7) AS eligible FROM email_campaigns GROUP BY campaign_type")
def _(v):
    return E.campaign_counts(E.campaign_rates(v.email_campaigns, "2024-02-01"))


@query("source_gap_list", "SELECT campaign_id, 'web' AS source FROM email_campaigns WHERE sessions IS NULL UNION ALL SELECT campaign_id, 'crm' FROM email_campaigns WHERE campaign_type <> 't0' AND leads = 0")
def _(v):
    state = F.create_map(F.lit("mailer"), F.lit("complete"), F.lit("web"), F.when(F.col("sessions").isNull(), "failed").otherwise("complete"), F.lit("crm"), F.when(F.col("leads") > 0, "complete").otherwise("missing"))
    c = v.email_campaigns.select("campaign_id", F.when(F.col("campaign_type") == "t0", "resend").otherwise("primary").alias("campaign_type"), state.alias("source_status"))
    return E.source_gap_list(c, ["mailer", "web", "crm"])


@query("snapshot_uniqueness", "SELECT campaign_type, sent_on, COUNT(*) AS n FROM email_campaigns GROUP BY ALL HAVING COUNT(*) > 1")
def _(v):
    return E.snapshot_uniqueness(v.email_campaigns, ["campaign_type", "sent_on"])


#: Campaigns as an audit's export, and two links of each.
AUDIT = """SELECT *, CASE WHEN sent % 4 = 0 THEN 'resend' WHEN sent % 11 = 0 THEN 'test' ELSE 'primary' END AS kind, CASE WHEN sent % 8 <> 0 THEN 'c1' END AS original_campaign_id, CASE WHEN sent % 9 = 0 THEN 'soon' WHEN sent % 10 <> 0 THEN CAST(sent_on AS STRING) END AS sent_at,
 'D+7' AS observation_window, CASE WHEN sent % 3 <> 0 THEN 0 END AS complaints, leads AS qualified_leads, sent % 3 AS engaged_sessions, CASE WHEN sent % 2 = 0 THEN 'metrika' ELSE 'other' END AS analytics, CASE WHEN sent % 5 = 0 THEN 'complete' ELSE 'partial' END AS compared,
 CASE WHEN sent % 7 = 0 THEN 'lost' ELSE 'complete' END AS crm_state, CASE WHEN sent % 6 = 0 THEN 'not_applicable' ELSE 'complete' END AS dedup, CASE WHEN sent % 3 = 0 THEN 'available' ELSE 'unavailable' END AS link_unique_clickers_status, CASE WHEN sent % 13 = 0 THEN 3 ELSE 2 END AS expected_link_count, 2 * unique_clickers + 3 AS link_map_total_clicks FROM email_campaigns"""
AUDIT_LINKS = """SELECT campaign_id, CONCAT('https://e.org/a', CAST(i AS STRING), '?utm_source=unisender&utm_medium=email&utm_campaign=', CASE WHEN sent % 5 = 0 THEN 'x' ELSE campaign_type END, '&utm_content=p', CASE WHEN sent % 7 = 0 THEN '1' ELSE CAST(i AS STRING) END, CASE WHEN sent % 6 = 0 THEN '&Last_Name=x' WHEN sent % 6 = 1 THEN '&q=a%40b.org' ELSE '' END) AS url,
 CONCAT('p', CASE WHEN sent % 7 = 0 THEN '1' ELSE CAST(i AS STRING) END) AS utm_content, CASE WHEN sent % 10 = 3 THEN NULL ELSE unique_clickers + i END AS all_clicks, CASE WHEN sent % 3 = 0 THEN unique_clickers END AS unique_clickers, sessions, unsubscribes AS engaged_sessions, leads, leads + i - 1 AS qualified_leads, sales FROM email_campaigns, (SELECT 1 AS i UNION ALL SELECT 2) x"""
PAIRS = {"incremental_unique_openers": "unique_opens", "incremental_unique_clickers": "unique_clickers", "incremental_sessions": "0", "incremental_leads": "leads", "deduplicated_unique_openers": "unique_opens", "deduplicated_unique_clickers": "CASE WHEN sent % 5 = 1 THEN -1 ELSE 1 END"}
UNI = ["sent", "delivered", "unique_opens", "unique_clickers", "unsubscribes", "complaints"]
QR = [
    ("kind = 'test'", "campaign_type_unknown"),
    ("kind = 'resend' AND original_campaign_id IS NULL", "original_campaign_id_required"),
    ("sent_at IS NULL", "sent_at_required"),
    ("sent_at = 'soon'", "sent_at_not_iso"),
    *[(f"{a} > {b}", f"{a}_above_{b}") for a, b in (("delivered", "sent"), ("unique_opens", "delivered"), ("unique_clickers", "delivered"), ("unsubscribes", "delivered"), ("complaints", "delivered"), ("engaged_sessions", "sessions"), ("qualified_leads", "leads"), ("sales", "leads"))],
    ("crm_state = 'lost'", "source_status_crm_unknown"),
    *[(f"{c} IS NULL", f"{c}_required_by_unisender") for c in UNI],
    ("sessions IS NOT NULL AND analytics = 'other'", "web_analytics_source_unknown"),
    ("compared = 'complete'", "web_analytics_comparison_source_same"),
    ("compared = 'complete' AND analytics = 'other'", "web_analytics_comparison_source_unknown"),
    ("compared = 'complete' AND sessions IS NULL", "comparison_sessions_required"),
    ("compared = 'complete' AND leads > sessions", "comparison_engaged_sessions_above_sessions"),
    ("crm_state = 'complete'", "crm_source_required"),
    *[(f"crm_state = 'complete' AND {c} IS NULL", f"{c}_required_by_crm") for c in ("leads", "qualified_leads", "sales", "revenue")],
    ("kind = 'primary' AND dedup <> 'not_applicable'", "resend_dedup_of_primary"),
    ("kind = 'resend' AND dedup = 'not_applicable'", "resend_dedup_not_applicable"),
    ("kind = 'resend' AND dedup = 'complete' AND sent % 5 = 1", "pair_deduplicated_unique_clickers_required"),
]
LR = [
    ("sent % 6 = 0", "link_pii_key"),
    ("sent % 6 = 1", "link_mail_as_value"),
    ("sent % 5 = 0", "link_utm_campaign_differs"),
    ("all_clicks IS NULL", "link_all_clicks_required"),
    ("l.engaged_sessions > l.sessions", "link_engaged_sessions_above_sessions"),
    ("l.qualified_leads > l.leads", "link_qualified_leads_above_leads"),
    ("l.sales > l.leads", "link_sales_above_leads"),
    ("sent % 3 = 0 AND l.unique_clickers IS NULL", "link_unique_clickers_required"),
    ("sent % 3 <> 0 AND l.unique_clickers IS NOT NULL", "link_unique_clickers_not_null"),
]
TR_ = [("expected_link_count = 3", "expected_link_count_differs"), ("sent % 7 = 0", "utm_content_repeated"), ("sent % 10 = 3", "link_map_total_clicks_differs")]


@query(
    "campaign_quality_rules",
    f"WITH au AS ({AUDIT}), al AS ({AUDIT_LINKS}) "
    + " UNION ALL ".join([f"SELECT campaign_id, NULL AS url, '{r}' AS rule_id FROM au WHERE {c}" for c, r in QR + TR_] + [f"SELECT l.campaign_id, l.url, '{r}' FROM al l JOIN au ON l.campaign_id = au.campaign_id WHERE {c}" for c, r in LR]),
)
def _(v):
    a = v.sql(AUDIT)
    state = lambda **kw: F.map_from_arrays(F.array(*[F.lit(k) for k in kw]), F.array(*kw.values()))
    full = F.lit("complete")
    status = state(unisender=full, link_stats=full, utm=full, web_analytics=F.when(F.col("sessions").isNull(), "partial").otherwise("complete"), web_analytics_comparison=F.col("compared"), crm=F.col("crm_state"), resend_dedup=F.col("dedup"))
    pair = state(**{k: F.expr(f"CAST({x} AS BIGINT)") for k, x in PAIRS.items()})
    c = a.withColumns({"campaign_type": F.col("kind"), "utm_campaign": F.expr("campaign_type"), "source_status": status, "web_analytics_source": F.col("analytics"), "web_analytics_comparison_source": F.col("analytics"), "comparison_metrics": state(sessions=F.col("sessions").cast("bigint"), engaged_sessions=F.col("leads").cast("bigint")), "pair_metrics": pair})
    return E.campaign_quality_rules(c, v.sql(AUDIT_LINKS))


RESENDS = """SELECT CONCAT('r-', campaign_id) AS campaign_id, CASE WHEN sent % 5 = 0 THEN 'none' ELSE campaign_id END AS original_campaign_id, CAST(CASE WHEN sent % 3 = 0 THEN sent_on ELSE sent_on + INTERVAL 2 DAY END AS DATE) AS sent_on, leads AS delivered, unique_opens, unique_clickers, sessions, leads, sent % 7 <> 0 AS deduplicated,
 unique_opens - 1 + sent % 3 AS incremental_unique_openers, 1 AS incremental_unique_clickers, 1 AS incremental_sessions, sales AS incremental_leads, 2 * unique_opens - 1 + sent % 3 + sent % 2 AS deduplicated_unique_openers, unique_clickers + 1 AS deduplicated_unique_clickers FROM email_campaigns"""
RP = [
    ("s IS NULL", "original_missing"),
    ("sent_on <= s", "not_later"),
    *[(f"s IS NOT NULL AND deduplicated AND NOT COALESCE({x} <= {m}, FALSE)", f"{x}_above_resend") for x, m in zip(E.PAIR[:4], ["unique_opens", "unique_clickers", "sessions", "leads"], strict=True)],
    *[(f"s IS NOT NULL AND deduplicated AND {x} <> {o} + {i}", f"{x}_differs") for x, o, i in ((E.PAIR[4], "o", E.PAIR[0]), (E.PAIR[5], "k", E.PAIR[1]))],
    *[(f"s IS NOT NULL AND deduplicated AND {x} > d + delivered", f"{x}_above_pair_delivery") for x in E.PAIR[4:]],
]


@query("resend_pair_check", f"WITH rs AS ({RESENDS}), j AS (SELECT rs.*, c.sent_on AS s, c.unique_opens AS o, c.unique_clickers AS k, c.delivered AS d FROM rs LEFT JOIN email_campaigns c ON rs.original_campaign_id = c.campaign_id) " + " UNION ALL ".join(f"SELECT campaign_id, '{r}' AS rule_id FROM j WHERE {c}" for c, r in RP))
def _(v):
    return E.resend_pair_check(v.email_campaigns, v.sql(RESENDS))


@query("resend_increment", f"WITH rs AS ({RESENDS}) SELECT rs.campaign_id, original_campaign_id, incremental_unique_openers AS extra_opens, ROUND({R('incremental_unique_openers', 'c.delivered', 1000)}, 6) AS extra_opens_per_1000 FROM rs JOIN email_campaigns c ON rs.original_campaign_id = c.campaign_id")
def _(v):
    return rounded(E.resend_increment(v.email_campaigns, v.sql(RESENDS)), 6)


@query("link_funnel", "WITH e AS (SELECT user_id % 20 AS campaign, user_id % 6 AS placement, event_type FROM {events}), g AS (SELECT campaign, placement, NULLIF(COUNT(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, NULLIF(COUNT(*) FILTER (WHERE event_type = 'view'), 0) AS visits, NULLIF(COUNT(*) FILTER (WHERE event_type IN ('signup', 'purchase')), 0) AS leads FROM e GROUP BY ALL) SELECT * FROM g WHERE clicks IS NOT NULL OR visits IS NOT NULL OR leads IS NOT NULL")
def _(v):
    e = v.events.select((F.col("user_id") % 20).alias("campaign"), (F.col("user_id") % 6).alias("placement"), "event_type")
    of = lambda name, *kinds: e.where(F.col("event_type").isin(*kinds)).groupBy("campaign", "placement").agg(F.count("*").alias(name))
    return E.link_funnel(of("clicks", "click"), of("visits", "view"), of("leads", "signup", "purchase"), ["campaign", "placement"])


LINKS = "CONCAT('https://e.org/p', CAST(user_id AS STRING), CASE WHEN user_id % 7 = 0 THEN '?Email=a' WHEN user_id % 7 = 3 THEN '?First_Name=a' WHEN user_id % 7 = 4 THEN '?uid=a&user=b' WHEN user_id % 7 = 1 THEN '?x=1;q=a%40b.org' WHEN user_id % 7 = 2 THEN '?utm_source=mail&utm_medium=email&utm_campaign=c1&utm_content=p1' ELSE '?a=1' END)"


def links(v):
    return v.events.select(F.col("user_id").alias("id")).distinct().selectExpr("id", "CAST(id % 5 AS STRING) AS campaign_id", LINKS.replace("user_id", "id") + " AS url")


@query("url_pii_scan", "SELECT DISTINCT user_id AS id FROM {events} WHERE user_id % 7 IN (0, 1, 3)")
def _(v):
    return E.url_pii_scan(links(v)).select("id")


@query("utm_contract_check", f"WITH l AS (SELECT DISTINCT user_id AS id, CAST(user_id % 5 AS STRING) AS campaign_id, {LINKS} AS url, user_id % 7 AS k FROM {{events}}) SELECT campaign_id, url, r AS rule_id FROM l, (VALUES ('utm_source_differs'), ('utm_medium_differs'), ('utm_campaign_differs'), ('utm_content_differs')) x(r) WHERE k <> 2 OR r = 'utm_content_differs' AND id % 2 = 0 UNION ALL SELECT campaign_id, url, 'utm_content_repeated' FROM (SELECT *, COUNT(*) OVER (PARTITION BY campaign_id, k = 2) AS n FROM l) WHERE n > 1")
def _(v):
    d = links(v).withColumns({"utm_source": F.lit("mail"), "utm_medium": F.lit("email"), "utm_campaign": F.lit("c1"), "utm_content": F.when(F.col("id") % 2 == 0, "p2").otherwise("p1")})
    return E.utm_contract_check(d)


@query("utm_build", f"WITH l AS (SELECT DISTINCT user_id AS id, {LINKS} AS url FROM {{events}}) SELECT CONCAT('p', CAST(id AS STRING)) AS placement_id, CONCAT('https://e.org/p', CAST(id AS STRING), CASE WHEN id % 7 = 0 THEN '?Email=a&' WHEN id % 7 = 3 THEN '?First_Name=a&' WHEN id % 7 = 4 THEN '?uid=a&user=b&' WHEN id % 7 = 1 THEN '?x=1&q=a%40b.org&' WHEN id % 7 = 2 THEN '?' ELSE '?a=1&' END, 'utm_source=mail&utm_medium=email&utm_campaign=jan&utm_content=p', CAST(id AS STRING)) AS url, 'tracked' AS status FROM l")
def _(v):
    return E.utm_build(links(v).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("placement_id"), "url", F.lit(True).alias("tracked")), "mail", "email", "jan")


GATED = "CASE page_id % 8 WHEN 0 THEN 'https://e.org/' WHEN 1 THEN 'https://e.org/x/tag/y' WHEN 2 THEN 'https://u:p@e.org/a' WHEN 3 THEN 'https://e.org/news/' WHEN 4 THEN 'https://e.org/newsroom?x=1' WHEN 5 THEN 'https://e.org/services' ELSE url END"


@query("material_url_gate", "SELECT page_id, page_id % 8 IN (4, 5) OR page_id % 8 >= 6 AND url LIKE 'https://%' AND NOT REGEXP_MATCHES(url, '^https://[^/]+(/(news|blog|articles|category|tag|search)?/?$|.*/(category|tag|search)(/|$))') AND LEN(STRING_SPLIT(url, '/')) > 3 AS accepted FROM {pages}")
def _(v):
    return E.material_url_gate(v.pages.select("page_id", F.expr(GATED).alias("url"))).select("page_id", "accepted")


TOPIC = "SELECT CONCAT('t', CAST(p_partkey AS STRING)) AS topic_id, p_brand AS digest, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS demand, p_size % 6 AS momentum, p_partkey % 6 AS product_fit, p_partkey % 5 AS audience_value, p_size % 4 AS actionability, p_partkey % 3 AS novelty, CASE p_partkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'missing' END AS wordstat_status, p_partkey % 7 AS materials FROM {part}"


@query(
    "rank_topics",
    f"WITH t AS ({TOPIC}), s AS (SELECT topic_id, digest, ROUND(GREATEST("
    + " + ".join(f"COALESCE({c}, 2.5) / 5.0 * {w}" for c, w in E.TOPIC_WEIGHTS.items())
    + " - CASE wordstat_status WHEN 'complete' THEN 0 WHEN 'partial' THEN 5 ELSE 10 END, 0), 2) AS score, materials >= 3 AS eligible FROM t), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY digest, eligible ORDER BY score DESC, topic_id) AS rk FROM s) SELECT topic_id, score, eligible, eligible AND rk = 1 AS selected FROM r",
)
def _(v):
    return E.rank_topics(v.sql(TOPIC), "digest").select("topic_id", "score", "eligible", "selected")


@query("latest_snapshot", "SELECT campaign_type, MAX(sent_on) AS sent_on FROM email_campaigns GROUP BY campaign_type")
def _(v):
    return E.latest_snapshot(v.email_campaigns.select("campaign_type", "sent_on").distinct(), ["campaign_type"], "sent_on")


@query("sample_size_band", "SELECT c_nationkey, c_mktsegment, n, CASE WHEN n >= 25 THEN 'working_baseline' WHEN n >= 8 THEN 'diagnostic_baseline' WHEN n >= 3 THEN 'probable_pattern' ELSE 'observation' END AS band FROM (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment)")
def _(v):
    return E.sample_size_band(v.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")))


@query("crm_attribution", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN CONCAT('k', CAST(user_id % 8 AS STRING)) END AS campaign_id, CASE WHEN user_id % 4 = 0 THEN 'exact' ELSE 'unattributed' END AS attribution FROM {events} WHERE event_type = 'signup'")
def _(v):
    e = v.events.where("event_type = 'signup'").select("event_id", F.lit("mail").alias("utm_source"), F.lit("email").alias("utm_medium"), (F.col("user_id") % 8).cast("string").alias("utm_campaign"))
    c = v.spark.createDataFrame([("mail", "email", "0", "k0"), ("mail", "email", "4", "k4"), ("web", "email", "1", "k1")], "utm_source string, utm_medium string, utm_campaign string, campaign_id string")
    return E.crm_attribution(e, c).select("event_id", "campaign_id", "attribution")


def drafts(v):
    colors = F.create_map(*[x for r in E.COLOR_ROLES for x in (F.lit(r), F.lit("#1A2b3C"))])
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return v.pages.select(F.col("page_id").alias("draft_id"), title.alias("subject"), F.regexp_replace("html", "<[^>]*>", " ").alias("preheader"), "html", F.lit("c1").alias("utm_campaign"), (F.col("page_id") % 6).cast("int").alias("expected_articles"), title.alias("brand_name"), F.lit(None).cast("string").alias("sender_name"), F.lit("Arial").alias("font_family"), colors.alias("colors"), F.array(F.lit("Ad")).alias("required_labels"))


@query("email_draft_lint")
def _(v):
    return E.email_draft_lint(drafts(v))


TITLE, BODY, PRE = "REGEXP_EXTRACT(html, '<title>([^<]*)', 1)", "LOWER(html)", "REGEXP_REPLACE(html, '<[^>]*>', ' ', 'g')"
TEXT_RULES = {
    "subject_required": f"TRIM({TITLE}) = ''",
    "subject_length": f"LENGTH(TRIM({TITLE})) > 50",
    "preheader_required": f"TRIM({PRE}) = ''",
    "preheader_length": f"TRIM({PRE}) <> '' AND NOT LENGTH(TRIM({PRE})) BETWEEN 70 AND 110",
    "preheader_not_in_html": f"{PRE} <> '' AND NOT CONTAINS(html, {PRE})",
    "expected_articles": "NOT page_id % 6 BETWEEN 3 AND 5",
    "placeholder": r"REGEXP_MATCHES(html, '(?i)\{\{[^{}]+\}\}|\bTODO\b|example\.com')",
    "no_doctype": f"NOT CONTAINS({BODY}, '<!doctype html')",
    "script": f"CONTAINS({BODY}, '<script') OR CONTAINS({BODY}, 'javascript:')",
    "flexbox": f"CONTAINS({BODY}, 'display:flex') OR CONTAINS({BODY}, 'display: flex')",
    "css_grid": f"CONTAINS({BODY}, 'display:grid') OR CONTAINS({BODY}, 'display: grid')",
    "no_600px_container": f"NOT CONTAINS({BODY}, 'max-width:600px') AND NOT CONTAINS({BODY}, 'max-width: 600px')",
    "label_not_kept": "NOT CONTAINS(html, 'Ad')",
    "brand_name_required": f"TRIM({TITLE}) = ''",
    "brand_name_not_kept": f"TRIM({TITLE}) <> '' AND NOT CONTAINS({BODY}, LOWER({TITLE}))",
    "sender_name_required": "TRUE",
    "font_family_not_kept": f"NOT CONTAINS({BODY}, 'arial')",
    **{f"color_{r}_not_kept": f"NOT CONTAINS({BODY}, '#1a2b3c')" for r in E.COLOR_ROLES},
}


@query("email_draft_text_rules", " UNION ALL ".join(f"SELECT page_id AS draft_id, '{code}' AS rule_id FROM {{pages}} WHERE {rule}" for code, rule in TEXT_RULES.items()))
def _(v):
    return E.draft_text_rules(drafts(v))


# --- visibility and phrases

BUCKET = lambda p: f"CASE WHEN {p} IS NULL THEN 'no_data' WHEN {p} <= 0 THEN 'not_visible' WHEN {p} <= 3 THEN 'top3' WHEN {p} <= 10 THEN 'top10' WHEN {p} <= 50 THEN 'top50' ELSE 'weak' END"


@query("position_bucket", f"SELECT query, url, position, {BUCKET('position')} AS bucket FROM visibility")
def _(v):
    return v.visibility.select("query", "url", "position", M.position_bucket("position").alias("bucket"))


@query("demand_band", "SELECT phrase_id, CASE WHEN volume = 0 THEN 'zero' WHEN volume > 5000 THEN 'high' WHEN volume >= 500 THEN 'mid' ELSE 'low' END AS band FROM phrases")
def _(v):
    return v.phrases.select("phrase_id", M.demand_band("volume").alias("band"))


@query("keep_min_volume", "SELECT phrase_id, CASE WHEN r = 1 THEN 'focus' ELSE 'secondary' END AS role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY volume DESC, phrase_id) AS r FROM phrases WHERE volume >= 4700) WHERE r <= 9")
def _(v):
    return M.keep_min_volume(v.phrases, 4700).select("phrase_id", "role")


WORDS = "LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(TRIM(REGEXP_REPLACE(LOWER({c}), '[^a-zа-я0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
DEM = "SELECT p_partkey AS id, SUBSTRING(p_name, 1 + POSITION(' ' IN p_name), 50) AS phrase, CAST(FLOOR(p_retailprice) AS BIGINT) AS volume FROM {part}"


@query(
    "demand_visibility_match",
    f"WITH d AS ({DEM}), t AS (SELECT DISTINCT {WORDS.format(c='phrase')} AS w FROM d), q AS (SELECT {WORDS.format(c='query')} AS w, SUM(impressions) AS impressions, SUM(clicks) AS clicks, MIN(CASE WHEN position > 0 THEN position END) AS position FROM visibility GROUP BY 1), "
    f"g AS (SELECT t.w, SUM(impressions) AS impressions, SUM(clicks) AS clicks, COALESCE(MIN(position), 0) AS position FROM t, q WHERE LEN(t.w) > 0 AND LIST_HAS_ALL(q.w, t.w) GROUP BY t.w) SELECT d.id, phrase, volume, impressions, clicks, position, {BUCKET('position')} AS bucket FROM d LEFT JOIN g ON {WORDS.format(c='phrase')} = g.w",
)
def _(v):
    return M.demand_visibility_match(v.sql(DEM), v.visibility)


@query("nested_query_guard", f"WITH p AS (SELECT cluster_id, phrase_id, volume, LIST_SORT({WORDS.format(c='phrase')}) AS t FROM (SELECT phrase_id, cluster_id, volume, CASE WHEN phrase_id % 3 = 0 THEN SUBSTRING(phrase, 1 + POSITION(' ' IN phrase), 50) ELSE phrase END AS phrase FROM phrases)), u AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id, t ORDER BY volume DESC, phrase_id) AS r FROM p) WHERE r = 1) SELECT cluster_id, COUNT(*) AS phrases, SUM(volume) AS volume FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.cluster_id = b.cluster_id AND a.phrase_id <> b.phrase_id AND LEN(LIST_FILTER(b.t, lambda w: NOT LIST_CONTAINS(a.t, w))) = 0) GROUP BY cluster_id")
def _(v):
    p = v.phrases.withColumn("phrase", F.when(F.col("phrase_id") % 3 == 0, F.expr("SUBSTRING(phrase, 1 + POSITION(' ' IN phrase), 50)")).otherwise(F.col("phrase")))
    return M.nested_query_guard(p)


AGG = "SELECT cluster_id, SUM(impressions) AS impressions, SUM(clicks) AS clicks, AVG(position) AS position, STRING_AGG(DISTINCT query, '|' ORDER BY query) AS queries, STRING_AGG(DISTINCT url, '|' ORDER BY url) AS urls, SUM(clicks) * 1.0 / SUM(impressions) AS ctr FROM visibility WHERE position % 7 <> 0 AND impressions % 11 <> 0 GROUP BY cluster_id"


def lacking(v):
    """Some rows of visibility without a position, some without a URL."""
    position, url = F.when(F.col("position") % 7 != 0, F.col("position")), F.when(F.col("impressions") % 11 != 0, F.col("url"))
    return v.visibility.withColumn("position", position).withColumn("url", url)



@query("visibility_aggregate", f"SELECT cluster_id, impressions, clicks, ROUND(position, 4) AS position, queries, urls, ROUND(ctr, 4) AS ctr FROM ({AGG})")
def _(v):
    a = M.visibility_aggregate(lacking(v))
    return rounded(a.withColumns({c: F.array_join(c, "|") for c in ("queries", "urls")}))


UPS, DNS = "('breakout','emerging','rapid_growth','growing')", "('declining','structural_decline')"
ACTION = f"CASE WHEN COALESCE(impressions, 0) = 0 THEN CASE WHEN signal IN {UPS} AND cov IN ('gap', 'partial') THEN 'market_rising_no_page' END WHEN signal IN {UPS} AND position > 10 THEN 'optimize_visibility' WHEN position <= 10 AND ctr < 0.03 AND impressions >= 50 THEN 'improve_ctr' WHEN signal IN {DNS} THEN 'review_offer' END"


@query("visibility_merge", f"WITH {SIGNAL}, va AS ({AGG}), cv AS (SELECT *, CASE WHEN cluster_id LIKE '%3' THEN 'covered' ELSE 'partial' END AS cov FROM sg2) SELECT cv.cluster_id, signal, impressions, ROUND(ctr, 4) AS ctr, {ACTION} AS action FROM cv LEFT JOIN va ON cv.cluster_id = va.cluster_id AND cv.cluster_id <> 'Brand#2'")
def _(v):
    t = frame(v).withColumn("coverage_status", F.when(F.col("cluster_id").like("%3"), "covered").otherwise("partial"))
    return rounded(M.visibility_merge(t, lacking(v).where("cluster_id <> 'Brand#2'")).select("cluster_id", "signal", "impressions", "ctr", "action"))


SHOWN = "SELECT query, url, position, clicks, CASE WHEN position % 5 = 0 THEN NULL WHEN position % 5 = 1 THEN 0 ELSE impressions END AS impressions, CASE position % 4 WHEN 0 THEN 'growing' WHEN 1 THEN 'declining' WHEN 2 THEN 'seasonal_rise' ELSE 'breakout' END AS signal, CASE position % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' ELSE 'covered' END AS cov FROM visibility"


@query("visibility_action", f"SELECT query, url, {ACTION} AS action FROM (SELECT *, CASE WHEN impressions > 0 THEN clicks * 1.0 / impressions END AS ctr FROM ({SHOWN}))")
def _(v):
    return v.sql(SHOWN).withColumn("ctr", X.ratio("clicks", "impressions")).select("query", "url", M.visibility_action(F.col("signal"), F.col("cov")).alias("action"))


@query("visibility_status_share", f"SELECT bucket, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (), 6) AS share FROM (SELECT {BUCKET('position')} AS bucket FROM visibility) GROUP BY bucket")
def _(v):
    return rounded(M.status_share(v.visibility.select(M.position_bucket("position").alias("bucket"))), 6)


@query("ctr_anomalies", f"WITH d AS (SELECT *, clicks * 1.0 / impressions AS ctr, {BUCKET('position')} AS bucket FROM visibility), m AS (SELECT bucket, MEDIAN(ctr) AS median_ctr FROM d GROUP BY bucket) SELECT query, url, d.bucket, ROUND(ctr, 6) AS ctr, CASE WHEN d.bucket IN ('top3', 'top10') THEN 'high_position_low_ctr' ELSE 'strong_ctr_middling_position' END AS flag FROM d JOIN m ON d.bucket = m.bucket WHERE (d.bucket IN ('top3', 'top10') AND ctr < median_ctr * 0.5) OR (d.bucket IN ('top50', 'weak') AND ctr > median_ctr * 2)")
def _(v):
    return rounded(M.ctr_anomalies(v.visibility).select("query", "url", "bucket", "ctr", "flag"), 6)


@query("growth_points", "SELECT phrase_id, volume FROM phrases WHERE fit <= 5 ORDER BY volume DESC, phrase_id LIMIT 15")
def _(v):
    return M.top_by(v.phrases, F.col("fit") <= 5, "volume", "phrase_id", 15).select("phrase_id", "volume")


@query("quick_wins", "SELECT phrase_id, volume FROM phrases WHERE fit BETWEEN 6 AND 40 ORDER BY volume DESC, phrase_id LIMIT 10")
def _(v):
    return M.top_by(v.phrases, F.col("fit").between(6, 40), "volume", "phrase_id", 10).select("phrase_id", "volume")


@query("representative_phrases", "SELECT phrase_id, r AS place FROM (SELECT phrase_id, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY fit DESC, volume DESC, LENGTH(phrase), phrase_id) AS r FROM phrases) WHERE r <= 5")
def _(v):
    return M.representative_phrases(v.phrases).select("phrase_id", "place")


@query("topic_priority_matrix", "SELECT phrase_id, CASE WHEN fit <= CASE WHEN kind = 'SMALL' AND volume >= 5000 THEN 60 ELSE 20 END THEN CASE WHEN volume >= 5000 THEN 'urgent' ELSE 'social_now' END WHEN kind = 'SMALL' THEN CASE WHEN volume >= 5000 THEN 'important' ELSE 'planned' END WHEN volume >= 5000 THEN 'important' ELSE 'next_quarter' END AS priority FROM phrases")
def _(v):
    return v.phrases.select("phrase_id", M.topic_priority(F.col("fit"), F.col("volume") / 10, F.col("kind") == "SMALL").alias("priority"))


@query("merge_demand_lists", "SELECT phrase, MAX(n) AS count FROM (SELECT LOWER(p_name) AS phrase, p_size AS n FROM {part} UNION ALL SELECT LOWER(p_type), p_size * 2 FROM {part}) GROUP BY phrase ORDER BY count DESC, phrase LIMIT 20")
def _(v):
    return M.merge_demand_lists([v.part.select(F.col("p_name").alias("phrase"), F.col("p_size").alias("count")), v.part.select(F.col("p_type").alias("phrase"), (F.col("p_size") * 2).alias("count"))], 20)


VOICE = "SELECT p_type AS contour, p_brand AS brand, SUM(l_quantity) AS volume FROM {part} JOIN {lineitem} ON p_partkey = l_partkey GROUP BY p_type, p_brand"


@query("share_of_voice", f"SELECT contour, brand, volume, ROUND(100 * volume / SUM(volume) OVER (PARTITION BY contour), 6) AS share FROM ({VOICE})")
def _(v):
    return rounded(M.share_of_voice(v.sql(VOICE)), 6)


PARTS = "SELECT p_brand AS brand, YEAR(l_shipdate) AS period, SUM(l_quantity) AS d, CAST(COUNT(*) AS DOUBLE) AS s, SUM(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS m, SUM(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS a, CASE WHEN YEAR(l_shipdate) = 1998 THEN 2 ELSE 1 END AS config_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, YEAR(l_shipdate)"


@query("brand_index", f"WITH p AS ({PARTS}), b AS (SELECT * FROM p WHERE period = 1996) SELECT p.brand, p.period, ROUND(CASE WHEN p.config_id = b.config_id AND b.d > 0 AND b.s > 0 THEN 100 * POW(p.d / b.d, 0.35) * POW(p.s / b.s, 0.25) * POW((p.m + 1) / (b.m + 1), 0.25) * POW((p.a + 1) / (b.a + 1), 0.15) END, 4) AS index, COALESCE(p.config_id = b.config_id, FALSE) AS comparable FROM p LEFT JOIN b ON p.brand = b.brand")
def _(v):
    p = v.sql(PARTS)
    return rounded(M.brand_index(p, "1996"))


@query("mention_weight", "WITH m AS (SELECT DISTINCT doc_id % 6 AS period, MD5(text) AS content_hash FROM {documents}), t AS (SELECT m.period, m.content_hash, MIN(source) AS source FROM m JOIN {documents} ON doc_id % 6 = m.period AND MD5(text) = content_hash GROUP BY ALL) SELECT period, FALSE AS paid, SUM(CASE WHEN LENGTH(source) = 4 THEN 8 ELSE 5 END) AS m FROM t GROUP BY period")
def _(v):
    d = v.documents.select((F.col("doc_id") % 6).alias("period"), F.md5("text").alias("content_hash"), "source")
    d = d.groupBy("period", "content_hash").agg(F.min("source").alias("source"))
    return M.mention_weight(d.withColumn("class", F.when(F.length("source") == 4, "business").otherwise("trade")).withColumn("paid", F.lit(False)))


@query("loss_reason_share", "WITH l AS (SELECT segment, 'competitor' AS kind, competitor AS value FROM lost_deals UNION ALL SELECT segment, 'reason', reason FROM lost_deals), g AS (SELECT segment, kind, value, COUNT(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, n * 1.0 / SUM(n) OVER (PARTITION BY segment, kind) AS share FROM g) SELECT segment, kind, value, n, ROUND(share, 6) AS share FROM s WHERE (kind = 'competitor' AND share >= 0.012) OR (kind = 'reason' AND share >= 0.2)")
def _(v):
    return rounded(M.loss_reason_share(v.lost_deals, 0.012, 0.2), 6)


@query("page_concentration", "WITH p AS (SELECT url, SUM(impressions) AS n FROM visibility GROUP BY url), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, url) AS r, SUM(n) OVER () AS t FROM p) SELECT ROUND(SUM(n) FILTER (WHERE r <= 1) / MAX(t), 6) AS top1, ROUND(SUM(n) FILTER (WHERE r <= 5) / MAX(t), 6) AS top5, ROUND(SUM(n) FILTER (WHERE r <= 10) / MAX(t), 6) AS top10 FROM r")
def _(v):
    return rounded(M.page_concentration(v.visibility.groupBy(F.col("url").alias("page")).agg(F.sum("impressions").alias("visits"))), 6)


REGION = "SELECT p_type AS phrase, n_name AS region, SUM(l_quantity) AS volume FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY p_type, n_name"


@query("regional_share", f"SELECT phrase, region, volume, ROUND(share, 6) AS share, place FROM (SELECT *, volume / SUM(volume) OVER (PARTITION BY phrase) AS share, ROW_NUMBER() OVER (PARTITION BY phrase ORDER BY volume DESC, region) AS place FROM ({REGION})) WHERE place <= 5")
def _(v):
    return rounded(M.regional_share(v.sql(REGION)), 6)


@query("repeat_complaint_run", "WITH r AS (SELECT event_id AS review_id, user_id AS company, event_type AS complaint, value % 5 AS rating, LAG(event_type, 1) OVER w AS c1, LAG(event_type, 2) OVER w AS c2, LAG(value % 5) OVER w AS r1 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT review_id, COALESCE(complaint = c1 AND complaint = c2, FALSE) AS run, COALESCE(ABS(rating - r1) >= 0.3, FALSE) AS moved FROM r WHERE COALESCE(complaint = c1 AND complaint = c2, FALSE) OR COALESCE(ABS(rating - r1) >= 0.3, FALSE)")
def _(v):
    return M.repeat_complaint_run(v.events.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("company"), "ts", F.col("event_type").alias("complaint"), (F.col("value") % 5).alias("rating"))).select("review_id", "run", "moved")


@query("consecutive_wins", "SELECT tender_id FROM (SELECT o_orderkey AS tender_id, o_orderpriority AS w, LAG(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM {orders}) WHERE w = p")
def _(v):
    return M.consecutive_wins(v.orders.select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("winner"))).select("tender_id")


@query("frequency_shift", "WITH c AS (SELECT c_nationkey AS company, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS period, COUNT(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY ALL), l AS (SELECT *, LAG(n) OVER (PARTITION BY company ORDER BY period) AS previous FROM c) SELECT company, period, n, previous, CASE WHEN n >= 2 * previous THEN 'doubled' ELSE 'halved' END AS shift FROM l WHERE n >= 2 * previous OR n * 2 <= previous")
def _(v):
    c = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("company"), F.trunc("o_orderdate", "month").alias("period")).agg(F.count("*").alias("n"))
    return M.frequency_shift(c)


@query("seed_manifest", "WITH e AS (SELECT TRIM(REGEXP_REPLACE(LOWER(p_name), '\\s+', ' ', 'g')) AS phrase, CASE WHEN p_size > 40 THEN 4 WHEN p_size > 20 THEN 3 ELSE 1 END AS rank, p_brand AS ref, p_type AS t, p_size = 50 AS f FROM {part} WHERE p_size % 10 <> 1) SELECT phrase, MAX(rank) AS priority, STRING_AGG(DISTINCT ref, ',' ORDER BY ref) AS refs, STRING_AGG(DISTINCT t, ',' ORDER BY t) AS source_types, BOOL_OR(f) AS force_monitor, CONCAT('seed_', SUBSTRING(SHA1(phrase), 1, 12)) AS seed_id FROM e GROUP BY phrase")
def _(v):
    e = v.part.select(F.when(F.col("p_size") % 10 == 1, "paused").otherwise("active").alias("status"), F.col("p_name").alias("phrase"), F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "high").otherwise("low").alias("priority"), F.col("p_brand").alias("ref"), F.col("p_type").alias("source_type"), (F.col("p_size") == 50).alias("force_monitor"))
    m = M.seed_manifest(e)
    return m.select("phrase", "priority", F.array_join("refs", ",").alias("refs"), F.array_join("source_types", ",").alias("source_types"), "force_monitor", "seed_id")


@query("reference_integrity", "SELECT DISTINCT CAST(l_orderkey AS STRING) AS id, 'dangling_reference' AS rule_id FROM {lineitem} WHERE l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_suppkey % 9 <> 0) UNION ALL SELECT CAST(s_suppkey AS STRING), 'duplicate_id' FROM {supplier} WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 = 0")
def _(v):
    s = v.supplier.where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").cast("string").alias("id"))
    e = v.lineitem.select(F.col("l_orderkey").cast("string").alias("from_id"), F.col("l_suppkey").cast("string").alias("to_id"))
    return M.reference_integrity(s.unionByName(s.where("cast(id as long) % 10 = 0")), e)


OLD = "SELECT c_custkey AS draft_key, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS STRING) END AS message_id, CASE WHEN c_custkey % 4 = 0 THEN 'created' ELSE 'draft' END AS status, c_name AS name, c_nationkey AS n FROM {customer} WHERE c_custkey % 3 <> 0"
NEW = "SELECT c_custkey AS draft_key, CASE c_custkey % 7 WHEN 0 THEN ' Unknown' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(c_custkey AS STRING) END AS message_id, CASE WHEN c_custkey % 8 < 5 THEN 'missing' ELSE 'sent' END AS status, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new' END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 99 END AS n FROM {customer} WHERE c_custkey % 4 <> 1"


@query("keyed_state_merge", f"SELECT COALESCE(a.draft_key, b.draft_key) AS draft_key, COALESCE(CASE WHEN b.draft_key % 7 > 2 THEN b.message_id END, a.message_id) AS message_id, CASE WHEN a.status = 'created' AND b.status = 'missing' THEN a.status ELSE COALESCE(b.status, a.status) END AS status, COALESCE(NULLIF(b.name, ''), a.name) AS name, COALESCE(b.n, a.n) AS n FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.draft_key = b.draft_key")
def _(v):
    return M.draft_state_merge(v.sql(OLD), v.sql(NEW), 1)[0]


@query("state_validate", "SELECT k, 'duplicate_key' AS rule_id FROM (SELECT c_custkey % 1000 AS k FROM {customer}) GROUP BY k HAVING COUNT(*) > 1 UNION ALL SELECT DISTINCT c_custkey % 1000, 'missing:n' FROM {customer} WHERE c_acctbal < 0")
def _(v):
    return M.state_validate(v.customer.select((F.col("c_custkey") % 1000).alias("k"), F.when(F.col("c_acctbal") >= 0, 1).alias("n")), "k", ["n"])


@query("required_minus_present", "SELECT c_custkey AS k FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')")
def _(v):
    return M.required_minus_present(v.customer.select(F.col("c_custkey").alias("k")), v.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


GATE = "SELECT phrase_id, kind = 'PROMO' AS forbidden, phrase_id % 17 = 0 AS ambiguous, CASE phrase_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'exploratory' WHEN 3 THEN 'direct' END AS relevance_level, CASE WHEN phrase_id % 11 <> 0 THEN volume END AS volume, cluster_id = 'Brand#4' AS required, fit < 20 AS exposed FROM phrases"


@query(
    "candidate_gate",
    f"WITH g AS ({GATE}), d AS (SELECT phrase_id, CASE WHEN forbidden THEN 'reject/FORBIDDEN_THEME' WHEN ambiguous THEN 'reject/AMBIGUOUS_MEANING' WHEN relevance_level IS NULL THEN 'reject/NO_PRODUCT_FIT' WHEN relevance_level = 'exploratory' THEN 'review/EXPLORATORY_FIT' WHEN volume IS NULL THEN 'review/MANUAL_APPROVAL' WHEN volume < 5000 AND required THEN 'watch/REQUIRED_BELOW_THRESHOLD' WHEN volume < 5000 AND exposed THEN 'watch/EXISTING_EXPOSURE_BELOW_THRESHOLD' WHEN volume < 5000 THEN 'reject/BELOW_VOLUME_THRESHOLD' WHEN relevance_level = 'direct' THEN 'include/DIRECT_PRODUCT_FIT' ELSE 'review/ADJACENT_PRODUCT_FIT' END AS x FROM g) SELECT phrase_id, SPLIT_PART(x, '/', 1) AS decision, SPLIT_PART(x, '/', 2) AS reason FROM d",
)
def _(v):
    return M.candidate_gate(v.sql(GATE), F.lit(5000)).select("phrase_id", "decision", "reason")


@query("cluster_key", "SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#4' AND p_size = 1 THEN 'kept-id' ELSE CONCAT(REGEXP_REPLACE(LOWER(p_brand), '[^a-z0-9]+', '-', 'g'), '__', LOWER(p_type), '__job-', CAST(p_size AS STRING)) END AS cluster_id FROM {part}")
def _(v):
    c = v.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"), F.col("p_type").alias("intent"), F.concat(F.lit("Job "), F.col("p_size").cast("string")).alias("job"))
    reg = c.where("entity = 'Brand#4' and job = 'Job 1'").select("entity", "intent", "job").distinct().withColumn("cluster_id", F.lit("kept-id"))
    return M.cluster_key(c, reg).select("id", "cluster_id")


COVER = "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' WHEN 2 THEN 'covered_product' WHEN 3 THEN 'covered' END AS coverage, CASE WHEN p_partkey % 2 = 0 THEN 'informational_definition' ELSE 'commercial_research' END AS intent, CASE p_partkey % 7 WHEN 0 THEN 'reject' WHEN 1 THEN 'review' ELSE 'include' END AS decision, CASE WHEN p_partkey % 4 = 0 THEN 'declining' ELSE 'stable' END AS signal FROM {part}"


@query("coverage_action", f"SELECT id, CASE WHEN decision = 'review' THEN 'confirm_by_person' WHEN decision = 'reject' THEN 'none' WHEN signal = 'declining' AND coverage IN ('partial', 'covered_product', 'covered') THEN 'check_wording_sales_margin_visibility' WHEN coverage = 'gap' AND intent LIKE 'informational%' THEN 'article_faq_or_hub' WHEN coverage = 'gap' THEN 'check_economics_then_landing' WHEN coverage = 'partial' THEN 'update_page' WHEN coverage = 'covered_product' THEN 'supporting_content_and_links' ELSE 'none' END AS action FROM ({COVER})")
def _(v):
    return v.sql(COVER).select("id", M.coverage_action(F.col("coverage"), F.col("intent"), F.col("decision"), F.col("signal")).alias("action"))


CLIENTS = "SELECT c_custkey AS client_id, CASE c_custkey % 8 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PROSPECT_ONLY' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'CONFLICT' WHEN 4 THEN 'DORMANT' WHEN 5 THEN 'LOST' WHEN 6 THEN 'COMPLETED' ELSE 'OTHER' END AS state, CASE c_nationkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'HUMAN_REVIEW' END AS eligibility, CASE c_custkey % 6 WHEN 0 THEN 'ACTIVE_CLIENT' WHEN 1 THEN 'PROSPECT_SALES' WHEN 2 THEN 'HUMAN_REVIEW' WHEN 3 THEN 'OPPORTUNITY' WHEN 4 THEN 'REACTIVATION' ELSE 'CLOSE' END AS route, CASE c_nationkey % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS_WITH_GAPS' WHEN 2 THEN 'HUMAN_REVIEW' WHEN 3 THEN 'FAIL' END AS result, c_nationkey % 11 AS iterations, c_custkey % 9 = 0 AS decisive_gap, c_custkey % 10 = 0 AS decisive_conflict, c_custkey % 12 = 0 AS restricted, CASE WHEN c_custkey % 4 = 0 THEN 'CONFIRMED' WHEN c_custkey % 4 < 3 THEN 'UNKNOWN' ELSE 'MAYBE' END AS stop_status, c_custkey % 3 AS stop_evidence FROM {customer}"
TRIPLE = " OR ".join(f"(state = '{s}' AND eligibility = '{e}' AND route = '{r}')" for s, e, r in M.ROUTES)
CR = [
    ("result IS NULL", "result_unknown"),
    ("iterations > 8", "iterations_above_limit"),
    (f"state = 'OTHER' OR NOT (COALESCE(result, '') = 'HUMAN_REVIEW' AND eligibility = 'HUMAN_REVIEW' AND route = 'HUMAN_REVIEW' OR {TRIPLE})", "route_not_allowed"),
    ("result IN ('HUMAN_REVIEW', 'FAIL') AND route <> 'HUMAN_REVIEW'", "automatic_route_after_review"),
    ("result IN ('PASS', 'PASS_WITH_GAPS') AND (state IN ('UNKNOWN', 'CONFLICT') OR eligibility = 'HUMAN_REVIEW' OR decisive_gap OR decisive_conflict)", "decisive_uncertainty_passed"),
    ("eligibility = 'YES' AND restricted", "restriction_needs_review"),
    ("stop_status = 'MAYBE'", "stop_reason_unknown"),
    ("stop_status = 'CONFIRMED' AND stop_evidence = 0", "stop_reason_without_evidence"),
]


@query("client_route_check", f"WITH cl AS ({CLIENTS}) " + " UNION ALL ".join(f"SELECT client_id, '{r}' AS rule_id FROM cl WHERE {c}" for c, r in CR))
def _(v):
    return M.client_route_check(v.sql(CLIENTS))


DELTAS = "SELECT CAST(s_suppkey AS STRING) AS company, CASE s_suppkey % 18 " + " ".join(f"WHEN {i} THEN '{t[1]}'" for i, t in enumerate(M.TRIGGERS)) + " END AS event, CASE WHEN s_suppkey % 18 IN (4, 9) THEN 0.25 + s_suppkey % 5 * 0.5 WHEN s_suppkey % 18 >= 12 THEN s_suppkey % 7 * 0.1 + CASE WHEN s_suppkey % 18 = 14 THEN 2.6 ELSE 0 END ELSE s_suppkey % 3 END AS value FROM {supplier}"
RULE = "(VALUES " + ", ".join(f"('{a}', '{e}', {x}, '{d}', {n})" for a, e, x, d, n in M.TRIGGERS) + ") AS r(loop, event, least, decision, deadline_days)"
SIZE = "CASE WHEN d.event LIKE '%\\_ratio' ESCAPE '\\' AND value > 0 AND value <= 1 THEN 1 / value ELSE ABS(value) END"


@query("competitor_triggers", f"WITH d AS ({DELTAS}) SELECT company, loop, d.event, value, decision, deadline_days FROM d JOIN {RULE} ON d.event = r.event WHERE CASE WHEN d.event = 'reply_speed_ratio' THEN {SIZE} > least ELSE ROUND({SIZE}, 9) >= least END".replace("\\\\", "\\"))
def _(v):
    return M.competitor_triggers(v.sql(DELTAS).withColumn("value", F.col("value").cast("double")))


@query("decisions_on_time", "WITH m AS (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, AVG(CASE WHEN l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN 1.0 ELSE 0 END) AS share FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1), l AS (SELECT *, LAG(share) OVER (ORDER BY month) AS p FROM m) SELECT month, ROUND(share, 6) AS share FROM l WHERE share < 0.7 AND p < 0.7")
def _(v):
    t = v.orders.join(v.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.trunc("o_orderdate", "month").alias("month"), F.expr("o_orderdate + INTERVAL 60 DAY").alias("due"), F.col("l_shipdate").alias("decided"))
    return rounded(M.decisions_on_time(t), 6)


@query("funnel_graph_rules", "SELECT l_orderkey * 10 + l_linenumber AS id, 'unknown_stage' AS rule_id FROM {lineitem} WHERE l_suppkey % 9 = 0 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'gap_on_complete_link' FROM {lineitem} WHERE l_returnflag = 'R' AND l_discount > 0.08")
def _(v):
    links_ = v.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link_id"), F.col("l_suppkey").alias("to_stage"), (F.col("l_returnflag") == "R").alias("complete"), F.when(F.col("l_discount") > 0.08, F.col("l_discount")).alias("readiness_gap"))
    return M.funnel_graph_rules(v.supplier.where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("stage_id")), links_)


@query("third_party_audit_check", "SELECT COALESCE(e.url, o.url) AS url, 'title' AS check, CASE WHEN e.url IS NULL THEN 'out_of_scope' WHEN o.url IS NULL THEN 'insufficient_evidence' WHEN e.c = o.c THEN 'confirmed' ELSE 'false_positive' END AS status FROM (SELECT url, page_id % 2 AS c FROM {pages} WHERE page_id % 3 <> 0) e FULL JOIN (SELECT url, page_id % 4 AS c FROM {pages} WHERE page_id % 5 <> 0) o ON e.url = o.url")
def _(v):
    p = v.pages.select("url", "page_id", F.lit("title").alias("check"))
    return M.third_party_audit_check(p.where("page_id % 3 <> 0").select("url", "check", (F.col("page_id") % 2).alias("claim")), p.where("page_id % 5 <> 0").select("url", "check", (F.col("page_id") % 4).alias("value")))


@query("nap_consistency", "WITH l AS (SELECT c_nationkey AS entity, UPPER(c_mktsegment) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Main St. 1' ELSE 'main st 1' END AS address, CAST(c_nationkey AS STRING) AS phone FROM {customer}) SELECT entity, COUNT(DISTINCT LOWER(name)) AS name, COUNT(DISTINCT REGEXP_REPLACE(LOWER(address), '[^a-z0-9]+', '', 'g')) AS address, COUNT(DISTINCT phone) AS phone FROM l GROUP BY entity HAVING COUNT(DISTINCT name) > 1")
def _(v):
    return M.nap_consistency(v.customer.select(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Main St. 1").otherwise("main st 1").alias("address"), F.col("c_nationkey").cast("string").alias("phone")))


@query("web_vitals_band", "SELECT user_id % 20 AS host, QUANTILE_CONT(value / 10, 0.75) AS lcp, QUANTILE_CONT(value * 6, 0.75) AS inp, QUANTILE_CONT(value / 300, 0.75) AS cls, QUANTILE_CONT(value * 20, 0.75) AS ttfb, QUANTILE_CONT(value / 10, 0.75) < 2.5 AND QUANTILE_CONT(value * 6, 0.75) < 200 AND QUANTILE_CONT(value / 300, 0.75) < 0.1 AND QUANTILE_CONT(value * 20, 0.75) < 600 AS good FROM {events} GROUP BY 1")
def _(v):
    return M.web_vitals_band(v.events.select((F.col("user_id") % 20).alias("host"), (F.col("value") / 10).alias("lcp"), (F.col("value") * 6).alias("inp"), (F.col("value") / 300).alias("cls"), (F.col("value") * 20).alias("ttfb")))


STATUS = "CASE WHEN {c} % 3 = 0 THEN 'missing' WHEN {c} % 3 = 1 THEN 'partial' ELSE 'complete' END"
PLAN = {
    "source_gap": f"SELECT 'source_gap' AS kind, campaign_id AS id, CONCAT('crm:', {STATUS.format(c='sent')}) AS detail, CAST(NULL AS DOUBLE) AS age_days FROM email_campaigns WHERE sent % 3 < 2 UNION ALL SELECT 'source_gap', CONCAT('s', CAST(c_custkey AS STRING)), CONCAT('web:', {STATUS.format(c='c_custkey')}), NULL FROM {{customer}} WHERE c_custkey % 3 < 2",
    "mature_campaign": "SELECT 'mature_campaign', campaign_id, 'D+7', CAST(DATE '2024-01-25' - sent_on AS DOUBLE) FROM email_campaigns WHERE DATE '2024-01-25' - sent_on >= 7 AND sent % 2 = 0",
    "demand_refresh": "SELECT 'demand_refresh', cluster_id, 'r1', CAST(DATE '2024-01-25' - MAX(month) AS DOUBLE) FROM demand_monthly GROUP BY cluster_id HAVING DATE '2024-01-25' - MAX(month) >= 28",
    "previous_experiment": "SELECT 'previous_experiment', CAST(MAX(o_orderkey) AS STRING), 'running', NULL FROM {orders} WHERE o_orderstatus = 'O'",
    "known_draft": "SELECT 'known_draft', CAST(page_id AS STRING), NULL, NULL FROM {pages}",
}


@query("refresh_plan", " UNION ALL ".join(PLAN.values()))
def _(v):
    status = lambda c: F.when(c % 3 == 0, "missing").when(c % 3 == 1, "partial").otherwise("complete")
    campaigns = v.email_campaigns.select("campaign_id", F.col("sent_on").alias("sent_at"), F.when(F.col("sent") % 2 == 0, "D+3").otherwise("D+7").alias("observation_window"), F.create_map(F.lit("crm"), status(F.col("sent"))).alias("source_status"))
    baselines = v.customer.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("snapshot_id"), F.create_map(F.lit("web"), status(F.col("c_custkey"))).alias("source_status"))
    demand = v.demand_monthly.groupBy(F.col("cluster_id").alias("phrase")).agg(F.max("month").alias("observed_at")).withColumn("region", F.lit("r1"))
    experiments = v.orders.select(F.col("o_orderkey").alias("experiment_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderkey").alias("position"))
    return M.refresh_plan(baselines, campaigns, demand, experiments, v.pages.select(F.col("page_id").alias("draft_key")), "2024-01-25")


LISTS = "[" + ", ".join(f"'{x}'" for x in M.LIST_KEYS) + "]"


@query("state_lists_merge", f"WITH o AS (SELECT {LISTS}[1 + CAST(c_custkey % 11 AS INT)] AS list, c_custkey AS k, c_mktsegment AS status, c_name AS name FROM {{customer}} WHERE c_custkey % 3 < 2), n AS (SELECT {LISTS}[1 + CAST(c_custkey % 11 AS INT)] AS list, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'new' END AS status, CONCAT('p', c_name) AS phone FROM {{customer}} WHERE c_custkey % 3 > 0) SELECT COALESCE(o.list, n.list) AS list, COALESCE(o.k, n.k) AS k, COALESCE(n.status, o.status) AS status, name, phone FROM o FULL JOIN n ON o.list = n.list AND o.k = n.k")
def _(v):
    fields = sorted({f for fs in M.LIST_KEYS.values() for f in fs})
    name = F.element_at(F.array(*map(F.lit, M.LIST_KEYS)), (F.col("c_custkey") % 11 + 1).cast("int")).alias("list")
    item = lambda *more: F.create_map(*[x for f in fields for x in (F.lit(f), F.col("c_custkey").cast("string"))], *more).alias("item")
    old = v.customer.where("c_custkey % 3 < 2").select(name, item(F.lit("status"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")))
    new = v.customer.where("c_custkey % 3 > 0").select(name, item(F.lit("status"), F.when(F.col("c_custkey") % 5 != 0, "new"), F.lit("phone"), F.concat(F.lit("p"), F.col("c_name"))))
    one = lambda f: F.try_element_at("item", F.lit(f))
    return M.state_lists_merge(old, new).select("list", F.get("key", F.lit(0)).cast("long").alias("k"), one("status").alias("status"), one("name").alias("name"), one("phone").alias("phone"))


@query("coerce_number", "SELECT page_id, COALESCE(TRY_CAST(CASE WHEN page_id % 4 = 0 THEN '--' WHEN page_id % 4 = 1 THEN '' WHEN page_id % 4 = 2 THEN CAST(page_id AS STRING) ELSE 'n/a' END AS DOUBLE), 0.0) AS x FROM {pages}")
def _(v):
    t = F.when(F.col("page_id") % 4 == 0, "--").when(F.col("page_id") % 4 == 1, "").when(F.col("page_id") % 4 == 2, F.col("page_id").cast("string")).otherwise("n/a")
    return v.pages.select("page_id", X.number(t, dashes=True).alias("x"))


@query("strict_number", "SELECT page_id, CASE WHEN page_id % 5 = 2 THEN CAST(page_id AS DOUBLE) END AS x FROM {pages}")
def _(v):
    k = F.col("page_id")
    t = F.when(k % 5 == 0, "true").when(k % 5 == 1, "NaN").when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, "-3").otherwise("inf")
    return v.pages.select("page_id", X.strict_number(t).alias("x"))
