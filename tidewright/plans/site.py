"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.expr import keywords
from tidewright.operators import pages as P
from tidewright.plans.registry import query
from tidewright.plans.text import KW


def audit(v):
    return P.audit_html(v.pages)


for _name, _f in {
    "page_meta": lambda v: P.page_meta(audit(v)).select("page_id", "title", "title_length", "description", "viewport", "canonical", "lang"),
    "page_headings": lambda v: P.page_headings(audit(v)),
    "page_images": lambda v: P.page_images(audit(v)),
    "page_links": lambda v: P.page_links(audit(v)),
    "page_content": lambda v: P.page_content(audit(v)),
    "page_schema_types": lambda v: P.page_schema_types(audit(v)),
    "page_eeat": lambda v: P.page_eeat(audit(v)),
    "page_score": lambda v: P.page_score(audit(v)).select("page_id", "url", "score", F.size("issues").alias("issues")),
    "link_integrity": lambda v: P.link_integrity(audit(v)),
    "heading_level_skips": lambda v: P.heading_level_skips(audit(v)),
    "geo_score": lambda v: P.geo_score(audit(v)),
    "issue_summary": lambda v: P.issue_summary(P.page_score(audit(v))),
}.items():
    query(_name)(_f)


@query("site_duplicates", "SELECT LOWER(REGEXP_EXTRACT(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, REGEXP_EXTRACT(html, 'lang=.([a-z]+)', 1) AS value, COUNT(*) AS pages FROM {pages} GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(v):
    return P.site_duplicates(v.pages.select("url", F.regexp_extract("html", 'lang=.([a-z]+)', 1).alias("content")), "content")


ALT = "SELECT url, LOWER(REGEXP_EXTRACT(url, '^([A-Za-z]+://[^/?#]+)', 1)) AS href, page_id FROM {pages}"


@query("hreflang_reciprocity", f"WITH a AS (SELECT DISTINCT url, href FROM ({ALT}) UNION SELECT DISTINCT href, url FROM ({ALT}) WHERE page_id % 3 = 0) SELECT url, href FROM a WHERE url <> href AND NOT EXISTS (SELECT 1 FROM a b WHERE b.url = a.href AND b.href = a.url)")
def _(v):
    a = v.sql(ALT)
    alt = a.select("url", "href").unionByName(a.where("page_id % 3 = 0").select(F.col("href").alias("url"), F.col("url").alias("href"))).distinct()
    return P.hreflang_reciprocity(alt)


TOKENS = KW("REGEXP_EXTRACT(html, '<title>([^<]*)', 1)")


@query(
    "link_candidates",
    f"WITH p AS (SELECT page_id, LOWER(REGEXP_EXTRACT(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, page_id % 10 <> 0 AND REGEXP_MATCHES(url, '^[!-~]+$') AS ok, {TOKENS} AS t FROM {{pages}}), "
    "j AS (SELECT a.page_id, b.page_id AS target, LEN(LIST_INTERSECT(a.t, b.t)) AS shared FROM p a JOIN p b ON a.host = b.host AND a.page_id <> b.page_id AND b.ok), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY shared DESC, target) AS r FROM j WHERE shared > 0) SELECT page_id, target, shared FROM r WHERE r <= 6",
)
def _(v):
    a = v.pages.select("page_id", "url", F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status"), keywords(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("tokens"))
    return P.link_candidates(a, common=20)


@query("duplicate_cards", "SELECT l_orderkey AS page_id, CAST(l_suppkey AS STRING) AS card_id, COUNT(*) AS n FROM {lineitem} WHERE l_suppkey <> 7 GROUP BY l_orderkey, l_suppkey, l_returnflag, l_linestatus HAVING COUNT(*) > 1")
def _(v):
    c = v.lineitem.select(F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").cast("string").alias("card_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("price"))
    return P.duplicate_cards(c, ["7"])


@query("robots_access")
def _(v):
    k = F.col("page_id") % 4
    body = F.when(k == 0, "User-agent: *\nDisallow: /").when(k == 1, "User-agent: GPTBot\nDisallow: /\nUser-agent: *\nAllow: /").when(k == 2, "User-agent: *\nDisallow: /*?x=").otherwise("")
    return P.robots_access(v.pages.select(P.host("url").alias("host"), body.alias("body")), ["GPTBot", "Googlebot"])
