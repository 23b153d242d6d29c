"""Queries over news, claims, evidence and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import expr as X
from tidewright.functions.storage import landed, shared_path
from tidewright.operators import claims as C
from tidewright.operators import news as N
from tidewright.operators import titles as T
from tidewright.plans.ads import rounded
from tidewright.plans.registry import query
from tidewright.sources import files as S

WEIGHTS = {f"src{i}": 1.0 - i * 0.02 for i in range(12)}
NT = lambda c: f"TRIM(REGEXP_REPLACE(REGEXP_REPLACE(LOWER({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS) + "]"
KW = lambda c: f"LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({NT(c)}, ' '), lambda w: w <> '' AND NOT LIST_CONTAINS({STOP}, w)))"


def news(v):
    return v.news.select(F.col("doc_id").alias("id"), "title", "link", "summary", "source", "lang", "age_hours")


@query("normalize_title", f"SELECT doc_id AS id, {NT('title')} AS t FROM news")
def _(v):
    return news(v).select("id", X.normalize_title("title").alias("t"))


@query("title_keywords", f"SELECT doc_id AS id, ARRAY_TO_STRING(LIST_SORT({KW('title')}), ' ') AS kw FROM news")
def _(v):
    return N.with_keywords(news(v)).select("id", F.array_join(F.array_sort("kw"), " ").alias("kw"))


HASH = "SUBSTRING(SHA256(CONCAT(LOWER(TRIM(title)), '|', LOWER(TRIM(link)))), 1, 16)"


@query("news_hash", f"SELECT doc_id AS id, {HASH} AS hash FROM news")
def _(v):
    return news(v).select("id", N.news_hash("title", "link").alias("hash"))


@query("history_hash_filter", f"SELECT doc_id AS id, {HASH} AS hash FROM news WHERE doc_id % 3 <> 0")
def _(v):
    sent = news(v).where("id % 3 = 0").select(N.news_hash("title", "link").alias("hash"))
    return N.history_hash_filter(news(v), sent).select("id", "hash")


def sent(v):
    return news(v).where("source = 'src3'").withColumn("sent_at", F.col("age_hours"))


@query("history_fuzzy_filter")
def _(v):
    return N.history_fuzzy_filter(news(v), sent(v)).select("id", "title")


JAC = lambda a, b: f"(LEN(LIST_INTERSECT({a}, {b})) * 1.0 / (LEN({a}) + LEN({b}) - LEN(LIST_INTERSECT({a}, {b}))))"
KWT = f"k AS (SELECT doc_id AS id, source, age_hours, title, {KW('title')} AS kw FROM news)"


@query("history_jaccard_filter", f"WITH {KWT}, o AS (SELECT * FROM k WHERE source = 'src3' ORDER BY age_hours DESC, title LIMIT 500) SELECT id FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE LEN(k.kw) >= 2 AND LEN(o.kw) >= 2 AND {JAC('k.kw', 'o.kw')} >= 0.5)")
def _(v):
    return N.history_jaccard_filter(news(v), sent(v)).select("id")


@query("jaccard_pairs", f"WITH {KWT} SELECT a.id AS id_a, b.id AS id_b, ROUND({JAC('a.kw', 'b.kw')}, 4) AS jaccard FROM k a JOIN k b ON a.id < b.id WHERE LEN(a.kw) >= 2 AND LEN(b.kw) >= 2 AND {JAC('a.kw', 'b.kw')} >= 0.4")
def _(v):
    k = N.with_keywords(news(v)).select("id", "kw")
    return rounded(T.jaccard_links(k, 0.4).where("id_a < id_b"))


@query("title_similarity_pairs")
def _(v):
    return N.title_similarity_pairs(news(v))


NAMED = ["tion", "ment", "heit", "ción", "ness", "ing the"]
NAMES = "[" + ", ".join(f"'{e}'" for e in NAMED) + "]"


@query("entity_overlap", f"WITH s AS (SELECT doc_id AS id, LIST_SORT(LIST_FILTER({NAMES}, lambda e: CONTAINS(LOWER(title), e))) AS e FROM news), g AS (SELECT e, COUNT(*) AS n, MIN(id) AS class_id FROM s GROUP BY e), j AS (SELECT a.e AS e, a.class_id AS class_id, SUM(CASE WHEN LEN(LIST_INTERSECT(a.e, b.e)) >= 2 THEN b.n ELSE 0 END) - CASE WHEN LEN(a.e) >= 2 THEN 1 ELSE 0 END AS links FROM g a, g b GROUP BY a.e, a.class_id) SELECT s.id AS id, ARRAY_TO_STRING(s.e, '|') AS entities, j.class_id AS class_id, CAST(j.links AS BIGINT) AS links FROM s JOIN j ON s.e = j.e")
def _(v):
    return N.entity_links(news(v), NAMED)


@query("batch_near_dedup")
def _(v):
    return N.batch_near_dedup(news(v), WEIGHTS).select("id", "source", "authority", "root")


def boosted(v):
    return N.text_filter_boost(news(v), ["license"], ["tion"])


@query("topic_clusters")
def _(v):
    return N.topic_clusters(boosted(v))


@query("cluster_score")
def _(v):
    return rounded(N.cluster_score(N.topic_clusters(boosted(v))))


@query("mention_score")
def _(v):
    return N.mention_score(news(v))


@query("freshness_authority_score", "WITH s AS (SELECT doc_id AS id, CASE WHEN age_hours < 6 THEN 1.0 WHEN age_hours < 12 THEN 0.8 WHEN age_hours < 24 THEN 0.6 ELSE 0.4 END AS freshness, CASE " + " ".join(f"WHEN source = '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " ELSE 0.65 END AS authority FROM news) SELECT id, freshness, authority, ROUND(0.3 * freshness + 0.2 * authority + 0.1, 4) AS score FROM s")
def _(v):
    return rounded(N.freshness_authority_score(news(v), WEIGHTS))


@query("banned_topic_filter", "SELECT doc_id AS id FROM news WHERE NOT (LOWER(CONCAT(title, ' ', summary)) LIKE '%idiot%' OR LOWER(CONCAT(title, ' ', summary)) LIKE '%license%')")
def _(v):
    return N.banned_topic_filter(news(v), ["idiot", "license"]).select("id")


@query("text_filter_boost", "SELECT doc_id AS id, CASE WHEN LOWER(CONCAT(title, ' ', summary)) LIKE '%license%' THEN 3.0 ELSE 0.0 END + CASE WHEN LOWER(CONCAT(title, ' ', summary)) LIKE '%tion%' THEN 1.5 ELSE 0.0 END AS boost FROM news WHERE LOWER(CONCAT(title, ' ', summary)) LIKE '%the%'")
def _(v):
    return N.text_filter_boost(news(v), ["license"], ["tion"], "the").select("id", "boost")


@query("adaptive_recency_window", "SELECT doc_id AS id FROM news WHERE age_hours <= CASE WHEN (SELECT COUNT(*) FROM news WHERE age_hours <= 24) >= 15 THEN 24 ELSE 36 END")
def _(v):
    return N.adaptive_recency_window(news(v)).select("id")


@query("scan_feed_items", "WITH p AS (SELECT SPLIT_PART(url, '/', 3) AS feed, page_id, TRIM(REGEXP_EXTRACT(html, '<title>([^<]*)', 1)) AS title, url AS link, html FROM {pages}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feed ORDER BY page_id) - 1 AS pos FROM p WHERE title <> '') SELECT feed, pos, title, link, SUBSTRING(TRIM(REGEXP_REPLACE(html, '<[^>]+>', '', 'g')), 1, 500) AS summary FROM r WHERE pos < 15")
def _(v):
    path = shared_path(v.spark, "feeds")
    items = v.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("feed"), F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url").alias("link"), F.col("html").alias("description"))
    items = items.repartition("feed").sortWithinPartitions("feed", "page_id").drop("page_id")
    items.write.partitionBy("feed").format("xml").option("rowTag", "item").option("rootTag", "rss").save(path)
    return N.scan_feed_items(S.scan_feed_xml(v.spark, path)[0]).drop("pub_date")


RULES = [("r1", "exact", "small ring"), ("r2", "contains", "widget"), ("r3", "regex", "b[a-z]*t$")]


@query("forbidden_theme_match", "SELECT phrase_id, 'r1' AS rule_id FROM phrases WHERE LOWER(phrase) = 'small ring' UNION ALL SELECT phrase_id, 'r2' FROM phrases WHERE LOWER(phrase) LIKE '%widget%' UNION ALL SELECT phrase_id, 'r3' FROM phrases WHERE REGEXP_MATCHES(LOWER(phrase), 'b[a-z]*t$')")
def _(v):
    return N.forbidden_theme_match(v.phrases, v.spark.createDataFrame(RULES, "rule_id string, match_type string, pattern string"))


SECTION = "CASE WHEN head = '' THEN 'preamble' WHEN REGEXP_MATCHES(head, '^finding\\s+\\d+') THEN CONCAT('finding_', REGEXP_EXTRACT(head, '^finding\\s+(\\d+)', 1)) " + " ".join(f"WHEN STARTS_WITH(head, '{n}') THEN '{n.replace(' ', '_')}'" for n in ("executive summary", "introduction", "synthesis", "limitations", "recommendations", "conclusion")) + r" ELSE SUBSTRING(REGEXP_REPLACE(head, '[^\p{L}\p{N}_]+', '_', 'g'), 1, 30) END"
#: Sections at second-level headings, markup taken off, sentences.
CLEAN = rf"""pt AS (SELECT doc_id, UNNEST(STRING_SPLIT(REGEXP_REPLACE(CONCAT(CHR(10), text), '\n(##\s)', CHR(2) || '\1', 'g'), CHR(2))) AS part FROM {{documents}} WHERE text IS NOT NULL),
 hd AS (SELECT doc_id, LOWER(TRIM(REGEXP_EXTRACT(part, '^##\s+([^\n]*)', 1))) AS head, REGEXP_REPLACE(part, '^##[^\n]*', '') AS body FROM pt),
 pl AS (SELECT doc_id, {SECTION} AS section_id, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(body, '(?m)^[-*]\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g') AS body FROM hd),
 sn AS (SELECT doc_id, section_id, TRIM(REGEXP_REPLACE(s, '^\s+|\s+$', '', 'g')) AS text FROM (SELECT doc_id, section_id, UNNEST(STRING_SPLIT(REGEXP_REPLACE(body, '([.!?])\s+([A-Z])', '\1' || CHR(1) || '\2', 'g'), CHR(1))) AS s FROM pl)),
 sc AS (SELECT doc_id, section_id, text, SUBSTRING(SHA256(CONCAT(section_id, '|', text)), 1, 16) AS claim_id FROM sn WHERE LENGTH(text) > 30 AND NOT STARTS_WITH(text, '#') AND NOT STARTS_WITH(text, '|'))"""
ANY = lambda c, ws: "(" + " OR ".join(f"CONTAINS(LOWER({c}), '{w}')" for w in ws) + ")"
TYPE = f"CASE WHEN {ANY('text', C.RECOMMEND)} THEN 'recommendation' WHEN {ANY('text', C.SPECULATE)} THEN 'speculation' WHEN section_id IN ('synthesis', 'conclusion', 'limitations') AND {ANY('text', C.SYNTHESIS)} THEN 'synthesis' ELSE 'factual' END"


def claims(v):
    return C.sentence_claims(v.documents.where("text is not null"))


@query("sentence_claims", f"WITH {CLEAN} SELECT doc_id, section_id, claim_id, text FROM sc")
def _(v):
    return claims(v).select("doc_id", "section_id", "claim_id", "text")


@query("claim_type", f"WITH {CLEAN} SELECT doc_id, claim_id, {TYPE} AS claim_type FROM sc")
def _(v):
    return claims(v).select("doc_id", "claim_id", "claim_type")


@query("claim_stats", f"WITH {CLEAN}, t AS (SELECT {TYPE} AS claim_type, section_id FROM sc) SELECT 'claim_type' AS dimension, claim_type AS value, COUNT(*) AS n FROM t GROUP BY claim_type UNION ALL SELECT 'section_id', section_id, COUNT(*) FROM t GROUP BY section_id")
def _(v):
    return C.claim_stats(claims(v))


def cited(v):
    """Claims that cite one evidence row of their own and all of one source, as often as they stand in a text; the evidence."""
    c = claims(v).select((F.concat_ws("-", F.col("doc_id").cast("string"), "claim_id")).alias("claim_id"), "text", "claim_type", F.array((F.col("doc_id") % 40).cast("string")).alias("evidence_ids"), F.array(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).alias("cited_source_ids"))
    e = v.benchmark.select(F.col("item_id").cast("string").alias("evidence_id"), F.concat(F.lit("s"), (F.col("item_id") % 11).cast("string")).alias("source_id"), F.col("text").alias("quote"))
    return c, e


def supported(v):
    """Each claim once, scored by its evidence."""
    c, e = cited(v)
    c = landed(c.distinct(), "claims")  # texts are taken apart once
    return C.claim_support(c, C.claim_evidence_lists(c, e), e)


LINK = CLEAN + f""", cl AS (SELECT DISTINCT CONCAT(CAST(doc_id AS STRING), '-', claim_id) AS claim_id, text, {TYPE} AS claim_type, CAST(doc_id % 40 AS STRING) AS eid, CONCAT('s', CAST(doc_id % 7 AS STRING)) AS sid FROM sc),
 ev AS (SELECT CAST(item_id AS STRING) AS evidence_id, CONCAT('s', CAST(item_id % 11 AS STRING)) AS source_id, text AS quote FROM {{benchmark}}),
 lk AS (SELECT claim_id, evidence_id FROM cl JOIN ev ON eid = evidence_id UNION SELECT claim_id, evidence_id FROM cl JOIN ev ON sid = source_id)"""


@query("claim_evidence_link", f"WITH {LINK} SELECT claim_id, evidence_id FROM lk")
def _(v):
    return C.claim_evidence_link(*cited(v))


def traits(c):
    """Words, numbers, years and names of a text, each once, as SQL; words with accented letters are no places for ASCII ones."""
    stop = ", ".join(f"'{w}'" for w in C.STOP_ENTITIES)
    bare = rf"REGEXP_REPLACE({c}, '[\p{{L}}\p{{N}}_]*[\x{{C0}}-\x{{24F}}][\p{{L}}\p{{N}}_]*', '·', 'g')"
    return rf"""LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: REGEXP_FULL_MATCH(w, '\p{{L}}{{4,}}'))) AS w_, LIST_DISTINCT(REGEXP_EXTRACT_ALL({bare}, '\b\d+(?:\.\d+)?(?:%|x|X)?\b')) AS n_,
 LIST_DISTINCT(REGEXP_EXTRACT_ALL({bare}, '\b(?:19|20)\d{{2}}\b')) AS y_, LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL({bare}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), lambda w: NOT LIST_CONTAINS([{stop}], w))) AS p_, LOWER(TRIM(REGEXP_REPLACE({c}, '\s+', ' ', 'g'))) AS f_"""


PART = lambda k, empty: f"CASE WHEN LEN(a.{k}) > 0 THEN LEN(LIST_INTERSECT(a.{k}, b.{k})) * 1.0 / LEN(a.{k}) ELSE {empty} END"
SUPPORT = LINK + f""", ca AS (SELECT claim_id, claim_type, {traits('text')} FROM cl), eb AS (SELECT evidence_id, {traits('quote')} FROM ev),
 jn AS (SELECT a.claim_id, a.claim_type, b.evidence_id, a.f_ = b.f_ AND a.f_ <> '' AS lit, 0.4 * {PART('w_', 0)} + 0.25 * {PART('n_', 1)} + 0.15 * {PART('y_', 1)} + 0.2 * {PART('p_', 1)} AS s FROM ca a LEFT JOIN lk ON a.claim_id = lk.claim_id LEFT JOIN eb b ON lk.evidence_id = b.evidence_id),
 gr AS (SELECT claim_id, claim_type, COUNT(evidence_id) AS n, COALESCE(BOOL_OR(lit), FALSE) AS lit, MAX(s) FILTER (WHERE evidence_id IS NOT NULL) AS s FROM jn GROUP BY claim_id, claim_type),
 su AS (SELECT claim_id, claim_type, CASE WHEN n = 0 THEN CASE WHEN claim_type = 'speculation' THEN 'supported' ELSE 'unsupported' END WHEN lit THEN 'supported' WHEN s >= 0.35 THEN 'partial' ELSE 'needs_review' END AS support_status,
 CASE WHEN n = 0 THEN CASE WHEN claim_type = 'speculation' THEN 1.0 ELSE 0.0 END WHEN lit THEN 1.0 ELSE s END AS score FROM gr)"""


@query("claim_support", f"WITH {SUPPORT} SELECT claim_id, claim_type, support_status, ROUND(score, 4) AS score FROM su")
def _(v):
    return rounded(supported(v))


@query("support_gate", f"WITH {SUPPORT}, x AS (SELECT COUNT(*) AS claims, COUNT(*) FILTER (WHERE claim_type = 'factual' AND support_status <> 'supported') AS unsupported_factual FROM su) SELECT claims, unsupported_factual, CASE WHEN unsupported_factual = 0 THEN 'passed' ELSE 'failed' END AS gate FROM x")
def _(v):
    return C.support_gate(supported(v))


@query("dedupe_keep_first", "SELECT source, MIN(doc_id) AS doc_id FROM {documents} GROUP BY source")
def _(v):
    return C.dedupe_keep_first(v.documents.select("source", "doc_id"), "source", "doc_id")


@query("display_numbers", "SELECT source, first_seen, ROW_NUMBER() OVER (ORDER BY first_seen, source) AS display_number FROM (SELECT source, MIN(doc_id) AS first_seen FROM {documents} GROUP BY source)")
def _(v):
    return C.display_numbers(v.documents, "source", "doc_id")


@query("append_ledger", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def _(v):
    return C.append_ledger(v.labels.select("doc_id"), v.documents.select("doc_id"), "doc_id")


@query("scan_jsonl_ledger", "SELECT doc_id, quality, toxic FROM {labels}")
def _(v):
    from tidewright.sources.files import parse_ledger

    lines = v.labels.select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("value"))
    return parse_ledger(lines, "doc_id long, quality int, toxic int")


@query("citation_set_diff", "SELECT doc_id % 50 AS doc_id, quality AS n, 'cited_not_listed' AS problem FROM {labels} GROUP BY ALL EXCEPT SELECT doc_id % 50, toxic, 'cited_not_listed' FROM {labels} UNION ALL (SELECT doc_id % 50, toxic, 'listed_not_cited' FROM {labels} EXCEPT SELECT doc_id % 50, quality, 'listed_not_cited' FROM {labels})")
def _(v):
    k = (F.col("doc_id") % 50).alias("doc_id")
    return C.citation_set_diff(v.labels.select(k, F.col("quality").alias("n")), v.labels.select(k, F.col("toxic").alias("n")))


SQLSTR = lambda s: "'" + s.replace("'", "''") + "'"
SENSITIVE = " UNION ALL ".join(f"SELECT doc_id, line, '{c}' AS code FROM l WHERE REGEXP_MATCHES(t, {SQLSTR(p)})" for c, p in C.SENSITIVE.items())
DOMAIN = "STRING_SPLIT(LOWER(m), '@')[2]"
MAILS = r"LIST_FILTER(LIST_FILTER(REGEXP_EXTRACT_ALL(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), lambda m: REGEXP_MATCHES(m, '\.[A-Za-z]{2,}$')), " + f"lambda m: {DOMAIN} NOT IN ({', '.join(map(SQLSTR, C.EXAMPLE_DOMAINS))}) AND LOWER(m) NOT IN ({', '.join(map(SQLSTR, C.EXAMPLE_MAILBOXES))}))"
IDS = f"LIST_FILTER(REGEXP_EXTRACT_ALL(t, {SQLSTR(C.ACCOUNT_ID)}, 1), lambda x: LEN(LIST_DISTINCT(STRING_SPLIT(x, ''))) > 1 AND NOT CONTAINS('{C.DIGITS_IN_ORDER[0]}', x) AND NOT CONTAINS('{C.DIGITS_IN_ORDER[1]}', x))"


@query("sensitive_text_scan", f"WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS t, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, CHR(10)), 1) AS line FROM {{documents}}) {SENSITIVE} UNION ALL SELECT doc_id, line, 'mailbox' FROM l WHERE LEN({MAILS}) > 0 UNION ALL SELECT doc_id, line, 'account_id' FROM l WHERE LEN({IDS}) > 0")
def _(v):
    return C.sensitive_text_scan(v.documents)


#: Every second document as a report whose summary it is, the others as they are.
HEADS = "CONCAT(CHR(10), '## Introduction', CHR(10), '## Main Analysis', CHR(10), '## Synthesis', CHR(10), '## Limitations', CHR(10), '## Recommendations', CHR(10), '## Methodology', CHR(10), '## Bibliography', CHR(10), '[1] A', CHR(10), '[3] B [2]', CHR(10), CASE WHEN doc_id % 4 = 0 THEN '[2] C and so on' ELSE '[2] D' END, CHR(10))"
REPORT = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CONCAT('## Executive Summary', CHR(10), text, {HEADS}) ELSE text END AS text FROM {{documents}} WHERE text IS NOT NULL"
NUMS = lambda c, p: f"LIST_DISTINCT(LIST_TRANSFORM(REGEXP_EXTRACT_ALL({c}, {SQLSTR(p)}, 1), lambda x: TRY_CAST(x AS HUGEINT)))"
COUNT = lambda c: f"LEN(REGEXP_EXTRACT_ALL({c}, '\\S+'))"
BODY = lambda name: f"REGEXP_EXTRACT(text, '(?is)## {name}(.*?)(?:##|\\z)', 1)"
FEW = "COALESCE(LEN(LIST_FILTER({0}, lambda n: n > 0)) < LIST_MAX({0}), FALSE)"
ERRORS = [("NOT hs", "missing_executive_summary"), *[(f"NOT REGEXP_MATCHES(text, '(?i)##.*{s}')", f"missing_section:{s}") for s in C.REQUIRED], ("LEN(cited) = 0", "no_citations"), ("bibrule IS NOT NULL", None), ("(" + " OR ".join(f"CONTAINS(text, '{p}')" for p in C.PLACEHOLDERS) + ")", "placeholder"), (f"REGEXP_MATCHES(text, '(?i)(?:{'|'.join(C.CUT_REPORT)})')", "cut_report")]
WARNINGS = [("hs AND summary > 400", "summary_too_long"), ("hs AND summary < 50", "summary_too_short"), *[(f"NOT REGEXP_MATCHES(text, '(?i)##.*{s}')", f"missing_recommended:{s}") for s in C.RECOMMENDED], ("LEN(cited) BETWEEN 1 AND 9", "few_sources_cited"), (FEW.format("cited"), "citation_gap"), ("hb AND LEN(LIST_FILTER(listed, lambda n: NOT LIST_CONTAINS(cited, n))) > 0", "listed_not_cited"), ("n < 500", "too_short"), ("hb AND LEN(listed) < 10", "few_sources")]
CUT = "|".join(C.CUT_BIBLIOGRAPHY).replace(r"etc\.(?!\w)", r"etc\.(?:\W|$)")
LINT = f"""r0 AS ({REPORT}), r1 AS (SELECT *, {COUNT('text')} AS n, {COUNT(BODY('Executive Summary'))} AS summary, REGEXP_MATCHES(text, '(?i)## Executive Summary') AS hs, REGEXP_MATCHES(text, '(?i)## Bibliography') AS hb, {BODY('Bibliography')} AS bib, {NUMS('text', r'\[(\d+)\]')} AS cited FROM r0),
 r2 AS (SELECT *, {NUMS('bib', r'(?m)^\[(\d+)\]')} AS listed FROM r1),
 r3 AS (SELECT *, CASE WHEN NOT hb THEN 'missing_bibliography' WHEN REGEXP_MATCHES(bib, '(?i)(?:{CUT})') THEN 'cut_bibliography' WHEN LEN(listed) = 0 THEN 'empty_bibliography' WHEN {FEW.format('listed')} THEN 'bibliography_gap' WHEN LEN(LIST_FILTER(cited, lambda n: NOT LIST_CONTAINS(listed, n))) > 0 THEN 'cited_not_listed' END AS bibrule FROM r2)"""


@query("report_lint", f"WITH {LINT} " + " UNION ALL ".join(f"SELECT doc_id, '{sev}' AS severity, {SQLSTR(r) if r else 'bibrule'} AS rule_id FROM r3 WHERE {c}" for sev, rules in (("error", ERRORS), ("warning", WARNINGS)) for c, r in rules))
def _(v):
    return C.report_lint(v.sql(REPORT.replace("CHR(10)", "'\\n'")))


#: Each document as the title of an entry of its own, and a second entry without one.
TITLE = "REGEXP_REPLACE(text, '[\"#\\s]+', ' ', 'g')"
YEAR = "CAST(1990 + doc_id % 40 AS STRING)"
ENTRY = f"CONCAT('Doe, J. (', {YEAR}, '). \"', {TITLE}, '\". Venue. ', CASE WHEN doc_id % 3 = 0 THEN CONCAT('https://doi.org/10.1234/x', CAST(doc_id AS STRING)) ELSE 'print' END)"
OTHER = "CONCAT('Roe, R. (1999). Notes (https://e.org/', CAST(doc_id AS STRING), ')')"
EN = f"en AS (SELECT doc_id, 1 AS n, TRIM({ENTRY}) AS first, CONCAT(TRIM({ENTRY}), ' second line') AS entry FROM {{documents}} WHERE text IS NOT NULL UNION ALL SELECT doc_id, 2, {OTHER}, {OTHER} FROM {{documents}} WHERE text IS NOT NULL), bp AS (SELECT doc_id, n, entry, TRY_CAST(REGEXP_EXTRACT(first, '\\((\\d{{{{4}}}})\\)', 1) AS INT) AS year, NULLIF(REGEXP_EXTRACT(first, '\"([^\"]+)\"', 1), '') AS title, NULLIF(REGEXP_EXTRACT(first, 'doi\\.org/(10\\.\\S+)', 1), '') AS doi, NULLIF(REGEXP_EXTRACT(first, '(https?://[^\\s)]+)', 1), '') AS url FROM en)".replace("{{4}}", "{4}")


def entries(v):
    title = F.regexp_replace("text", r'["#\s]+', " ")
    first = F.concat(F.lit("Doe, J. ("), (1990 + F.col("doc_id") % 40).cast("string"), F.lit('). "'), title, F.lit('". Venue. '), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/x"), F.col("doc_id").cast("string"))).otherwise("print"))
    text = F.concat(F.col("text"), F.lit("\n## Bibliography\n\n[1] "), first, F.lit("\n  second line\n\n[2] Roe, R. (1999). Notes (https://e.org/"), F.col("doc_id").cast("string"), F.lit(")\n## End\n[9] no entry\n"))
    return C.bibliography_parse(v.documents.select("doc_id", text.alias("text")))


@query("bibliography_parse", f"WITH {EN} SELECT doc_id, n, entry, year, title, doi, url FROM bp")
def _(v):
    return entries(v)


SUSPECT = "CASE doc_id % 4 WHEN 0 THEN CONCAT('Study of ', title) WHEN 1 THEN CONCAT('recent advances in ', title) WHEN 2 THEN 'Deep Learning: A Comprehensive Review' ELSE title END"
SUSPICIOUS = [*[(f"REGEXP_MATCHES(title, {SQLSTR(p)})", c) for c, p in C.MADE_UP.items()], ("year >= 2025 AND doi IS NULL AND url IS NULL", "recent_without_locator"), ("year > 2026", "future_year"), ("year < 2000 AND (" + " OR ".join(f"CONTAINS(LOWER(title), '{w}')" for w in C.MODERN) + ")", "anachronism")]


@query("suspicious_citations", f"WITH {EN}, sx AS (SELECT * REPLACE ({SUSPECT} AS title) FROM bp WHERE title IS NOT NULL) " + " UNION ALL ".join(f"SELECT doc_id, n, '{r}' AS rule_id FROM sx WHERE {c}" for c, r in SUSPICIOUS))
def _(v):
    return C.suspicious_citations(entries(v).withColumn("title", F.expr(SUSPECT)).where("title is not null and n = 1"), 2026)


@query("title_match_score", f"SELECT a.doc_id AS id, ROUND(COALESCE({JAC('wa', 'wb')}, 0), 4) AS score, COALESCE({JAC('wa', 'wb')}, 0) < 0.5 AS suspicious FROM (SELECT doc_id, source, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({NT('title')}, ' '), lambda w: w <> '')) AS wa FROM news) a JOIN (SELECT source, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({NT('title')}, ' '), lambda w: w <> '')) AS wb FROM news WHERE doc_id IN (SELECT MIN(doc_id) FROM news GROUP BY source)) b ON a.source = b.source")
def _(v):
    n = news(v)
    reg = C.dedupe_keep_first(n.select("source", "id", "title"), "source", "id").select(F.col("source").alias("locator"), "title")
    return rounded(C.title_match_score(n.select("id", F.col("source").alias("locator"), "title"), reg))


IN = lambda ws: "(" + ", ".join(map(SQLSTR, ws)) + ")"
HAS = lambda c, ws: "(" + " OR ".join(f"CONTAINS({c}, {SQLSTR(w)})" for w in ws) + ")"
#: Every fifth page under a host of high, every seventh under one of moderate, every eleventh under one of low authority.
HOSTED = "CASE WHEN page_id % 5 = 0 THEN 'https://www.nature.com/x' WHEN page_id % 7 = 0 THEN 'http://GitHub.com/x' WHEN page_id % 11 = 0 THEN 'https://a.blogspot.com' WHEN page_id % 13 = 0 THEN 'https://docs.x.gov/y' ELSE url END"
CRED = f"""s0 AS (SELECT CAST(page_id AS STRING) AS source_id, REPLACE(LOWER(REGEXP_EXTRACT({HOSTED}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') AS host, LOWER(REGEXP_EXTRACT(html, '<title>([^<]*)', 1)) AS title, LOWER(html) AS content, DATE '2026-01-01' - CASE WHEN page_id % 9 <> 0 THEN CAST(DATE '2020-01-01' + CAST(page_id % 2190 AS INT) AS DATE) END AS age, CASE WHEN page_id % 4 = 0 THEN 'dr. no' ELSE '' END AS author FROM {{pages}}),
 s1 AS (SELECT source_id, CASE WHEN host IN {IN(C.HIGH_AUTHORITY)} THEN 90.0 WHEN host IN {IN(C.MODERATE_AUTHORITY)} THEN 70.0 WHEN {HAS('host', C.LOW_AUTHORITY)} THEN 40.0 ELSE 55.0 END AS domain, CASE WHEN age IS NULL THEN 50.0 WHEN age < 90 THEN 100.0 WHEN age < 365 THEN 85.0 WHEN age < 730 THEN 70.0 WHEN age < 1825 THEN 50.0 ELSE 30.0 END AS recency,
 LEAST(50.0 + CASE WHEN {HAS('host', C.LEARNED)} THEN 30 ELSE 0 END + CASE WHEN {HAS('host', ['.gov', 'who.int'])} THEN 25 ELSE 0 END + CASE WHEN CONTAINS(host, 'docs.') OR CONTAINS(title, 'documentation') THEN 20 ELSE 0 END + CASE WHEN {HAS('author', C.CREDENTIALS)} THEN 15 ELSE 0 END, 100.0) AS expertise,
 LEAST(70.0 - CASE WHEN {HAS('title', C.SENSATIONAL)} THEN 20 ELSE 0 END + CASE WHEN {HAS('host', C.LEARNED[:4])} THEN 20 ELSE 0 END + CASE WHEN {HAS('content', C.BALANCED)} THEN 10 ELSE 0 END, 100.0) AS neutrality FROM s0),
 s2 AS (SELECT *, ROUND(0.35 * domain + 0.20 * recency + 0.25 * expertise + 0.20 * neutrality, 2) AS score FROM s1)"""


@query("source_credibility", f"WITH {CRED} SELECT source_id, domain, recency, expertise, neutrality, score, CASE WHEN score >= 80 THEN 'high_trust' WHEN score >= 60 THEN 'moderate_trust' WHEN score >= 40 THEN 'low_trust' ELSE 'verify' END AS band FROM s2")
def _(v):
    day = F.when(F.col("page_id") % 9 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 2190).cast("int")))
    s = v.pages.select(F.col("page_id").cast("string").alias("source_id"), F.expr(HOSTED).alias("url"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("html").alias("content"), day.alias("published"), F.when(F.col("page_id") % 4 == 0, "Dr. No").alias("author"))
    return C.source_credibility(s, "2026-01-01")


WORD = r"'[\p{L}\p{N}]+(?:[-\x{2011}][\p{L}\p{N}]+)*'"


@query("speech_metrics", rf"WITH d AS (SELECT conv_id, turn, text, LEN(REGEXP_EXTRACT_ALL(text, {WORD})) AS w, LIST_TRANSFORM(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(text, '([.!?])\s+([А-ЯA-ZЁ«])', '\1' || CHR(1) || '\2', 'g'), CHR(1)), lambda s: REGEXP_MATCHES(s, '\S')), lambda s: LEN(REGEXP_EXTRACT_ALL(s, {WORD}))) AS s FROM {{conversations}}) SELECT CONCAT(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS id, w AS words, LEN(s) AS sentences, LEN(LIST_FILTER(s, lambda n: n > 28)) AS long_sentences, LEN(text) - LEN(REPLACE(text, '?', '')) AS questions, ROUND(w / 135.0 * 60 + 3, 4) AS seconds FROM d")
def _(v):
    return rounded(C.speech_metrics(v.conversations.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")))


HEADED = "LEN(REGEXP_EXTRACT_ALL(text, '(?m)^\\d+\\.[ \\t]'))"


@query("digest_lint", f"WITH d AS (SELECT doc_id, {HEADED} AS m FROM {{documents}} WHERE text IS NOT NULL) SELECT doc_id, 'item_count' AS rule_id FROM d WHERE m + 1 + doc_id % 5 NOT BETWEEN 3 AND 20 UNION ALL SELECT doc_id, 'one_link_per_item' FROM d WHERE m > 0 OR doc_id % 4 = 0 UNION ALL SELECT doc_id, 'unsafe_url' FROM d WHERE doc_id % 6 = 1")
def _(v):
    k = F.col("doc_id")
    url = F.when(k % 6 == 1, "javascript:x").otherwise("https://e.org/a")
    item = F.concat(F.lit(". Title [s]("), url, F.lit(")"), F.when(k % 4 == 0, " [t](https://e.org/b)").otherwise(""))
    lines = F.transform(F.sequence(F.lit(1), (1 + k % 5).cast("int")), lambda i: F.concat(i.cast("string"), item))
    return C.digest_lint(v.documents.where("text is not null").select("doc_id", F.concat(F.col("text"), F.lit("\n"), F.array_join(lines, "\n")).alias("text")))


CLAIM = "SELECT doc_id AS claim_id, text, CASE WHEN doc_id % 3 = 0 THEN 'external_fact' WHEN doc_id % 3 = 1 THEN 'author_fact' ELSE 'opinion' END AS claim_kind, CASE WHEN doc_id % 2 = 0 THEN 'material' ELSE 'minor' END AS materiality, CASE WHEN lang = 'en' THEN 'verified' ELSE 'open' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'blog' ELSE 'official' END AS source_type, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN CONCAT('http://', source, '.org') ELSE CONCAT('HTTPS://', source, '.org') END AS source_url, '2026-01-01' AS source_date, CASE WHEN doc_id % 11 <> 0 THEN '2026-02-02' END AS checked_at, source AS locator, lang AS article_locator FROM {documents}"
FACT = "materiality = 'material' AND claim_kind IN ('external_fact', 'author_fact')"
CLAIM_RULES = [("COALESCE(text, '') = ''", "missing:text"), ("materiality = 'material' AND COALESCE(status, '') <> 'verified'", "material_not_verified"), *[(f"{FACT} AND COALESCE({c}, '') = ''", f"fact_missing:{c}") for c in C.FACT_FIELDS], (f"{FACT} AND source_url LIKE 'http:%'", "not_https"), ("materiality = 'material' AND claim_kind = 'external_fact' AND source_type = 'blog'", "weak_source")]


@query("article_claim_lint", f"WITH c AS ({CLAIM}) " + " UNION ALL ".join(f"SELECT claim_id, '{r}' AS rule_id FROM c WHERE {c}" for c, r in CLAIM_RULES))
def _(v):
    return C.article_claim_lint(v.sql(CLAIM))


URL = "CASE doc_id % 4 WHEN 0 THEN CONCAT('see https://dx.doi.org/10.1234/', source, CAST(doc_id AS STRING), '.') WHEN 1 THEN CONCAT('arXiv:2301.0', CAST(1000 + doc_id % 9000 AS STRING), 'v2') ELSE CONCAT('HTTPS://', UPPER(source), '.Example.com:443/a/', CAST(doc_id AS STRING), '/?utm_source=x&b=2&mc_cid=7&a=', lang, '&yclid=1&source=z#frag') END"
CANONICAL = "CASE doc_id % 4 WHEN 0 THEN CONCAT('doi:10.1234/', source, CAST(doc_id AS STRING)) WHEN 1 THEN CONCAT('arxiv:2301.0', CAST(1000 + doc_id % 9000 AS STRING), 'v2') ELSE CONCAT('https://', LOWER(source), '.example.com/a/', CAST(doc_id AS STRING), '?a=', lang, '&b=2&yclid=1') END"


@query("canonicalize_url", f"SELECT doc_id, {CANONICAL} AS url FROM {{documents}}")
def _(v):
    return v.documents.select("doc_id", X.canonical_url(F.expr(URL)).alias("url"))


@query("stable_id", "SELECT doc_id, SUBSTRING(SHA256(CONCAT(source, '|', lang, '|', CAST(doc_id AS STRING))), 1, 16) AS id FROM {documents}")
def _(v):
    return v.documents.select("doc_id", X.short_sha(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query("dataset_fingerprint", """WITH o AS (SELECT h, COUNT(*) AS n FROM (SELECT SHA256(CONCAT_WS('|', COALESCE(CAST(doc_id AS STRING), '\\N'), COALESCE(text, '\\N'), COALESCE(lang, '\\N'), COALESCE(source, '\\N'))) AS h FROM {documents}) GROUP BY h),
 p AS (SELECT CAST(CONCAT('0x', SUBSTRING(h, 1, 8)) AS BIGINT) % 4096 AS b, SHA256(STRING_AGG(CONCAT(h, ':', CAST(n AS STRING)), ',' ORDER BY CONCAT(h, ':', CAST(n AS STRING)))) AS d, SUM(n) AS n FROM o GROUP BY 1)
 SELECT CAST(SUM(n) AS BIGINT) AS rows, SHA256(STRING_AGG(CONCAT(LPAD(CAST(b AS STRING), 8, '0'), ':', d), ',' ORDER BY b)) AS fingerprint FROM p""")
def _(v):
    return X.fingerprint(v.documents.select("doc_id", "text", "lang", "source"))
