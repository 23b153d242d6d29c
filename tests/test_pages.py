"""Expected rows of every page operator on three small pages."""

import pytest

from tidewright.operators import pages as P

FULL = """<!DOCTYPE html><html lang="en"><head><title>Boats and waves</title><meta name="description" content="About boats"><meta name="viewport" content="width=device-width">
<meta name="keywords" content="boats, waves, sea"><meta property="og:title" content="Boats"><meta name="twitter:card" content="summary"><link rel="canonical" href="https://e.org/a"><link rel="icon" href="/i.png">
<link rel="alternate" hreflang="de" href="https://e.org/de/a"><script type="application/ld+json">{"@graph": [{"@type": "Article"}, {"@type": ["FAQPage", "Thing"]}]}</script></head>
<body><nav><a href="/hidden">skip</a></nav><h1>Boats</h1><p>A boat is a small ship.</p><p>More words, written by A. Author. Updated: 2026-01-02. TL;DR boats float.</p><dl><dt>Keel</dt></dl><aside>Box</aside>
<h3>What floats?</h3><ul><li>x</li></ul><ol><li>y</li></ol><table><tr><td>1</td></tr></table>
<img src="1.png" alt="boat" width="1" height="1"><img src="2.png" alt=" " loading="lazy">
<a href="/b">B</a><a href="/b#part">B again</a><a href="/gone">Gone</a><a href="/about">About us</a><a href="/contact">Contact</a><a href="/privacy">Privacy</a><a href="https://en.wikipedia.org/wiki/Boat">wiki</a><a href="mailto:a@b.org">mail</a></body></html>"""
ROWS = [(1, "https://e.org/a", FULL), (2, "https://e.org/b", "<h2>No first</h2><p>short"), (3, "http://e.org/privacy", None)]


@pytest.fixture(scope="module")
def audit(spark):
    return P.audit_html(spark.createDataFrame(ROWS, "page_id long, url string, html string")).cache()


def row(df, page=1):
    return df.where(f"page_id = {page}").first().asDict(recursive=True)


def test_meta_headings_images(audit):
    m = row(P.page_meta(audit))
    assert (m["title"], m["title_length"], m["description"], m["canonical"], m["lang"], m["favicon"], m["og"], m["twitter"]) == ("Boats and waves", 15, "About boats", "https://e.org/a", "en", "/i.png", {"og:title": "Boats"}, {"twitter:card": "summary"})
    assert m["hreflang"] == [{"lang": "de", "href": "https://e.org/de/a"}] and row(P.page_meta(audit), 3)["title"] is None
    h = row(P.page_headings(audit))
    assert (h["h1"], h["h2"], h["h3"]) == (["Boats"], [], ["What floats?"])
    assert row(P.page_images(audit)) == {"page_id": 1, "total": 2, "with_alt": 1, "with_size": 1, "lazy": 1, "alt_ratio": 50.0}
    assert row(P.page_images(audit), 2)["alt_ratio"] == 100.0


def test_links_content_types_trust(audit):
    assert row(P.page_links(audit)) == {"page_id": 1, "internal": 7, "internal_unique": 7, "external": 1, "external_unique": 1}
    c = row(P.page_content(audit))
    assert (c["has_faq"], c["has_summary"], c["has_date"]) == (False, True, True) and row(P.page_content(audit), 3)["words"] == 0
    assert sorted((r.page_id, r.type) for r in P.page_schema_types(audit).collect()) == [(1, "Article"), (1, "FAQPage"), (1, "Thing")]
    e = row(P.page_eeat(audit))
    assert e == {"page_id": 1, "about_page": True, "contact_page": True, "privacy_policy": True, "social_links": False, "author_page": True, "external_citations": 1}
    assert not any(row(P.page_eeat(audit), 2)[k] for k in ("about_page", "contact_page", "privacy_policy", "social_links", "author_page"))


def test_scores_and_issues(audit):
    s = {r.page_id: (r.score, {i.rule_id for i in r.issues}) for r in P.page_score(audit).collect()}
    assert s[1] == (90, {"few_alts", "thin_content"})
    assert {"no_title", "no_h1", "no_description", "no_viewport", "no_canonical", "no_schema", "no_open_graph"} <= s[2][1] and s[2][0] == 0
    assert "no_https" in s[3][1] and "no_https" not in s[2][1]
    issues = {r.rule_id: (r.priority, r.pages) for r in P.issue_summary(P.page_score(audit)).collect()}
    assert issues["no_title"] == ("critical", 2) and issues["no_https"] == ("critical", 1) and issues["thin_content"] == ("medium", 3)


def test_integrity_and_levels(audit):
    lost = sorted((r.page_id, r.href) for r in P.link_integrity(audit).collect())
    assert lost == [(1, "https://e.org/about"), (1, "https://e.org/contact"), (1, "https://e.org/gone"), (1, "https://e.org/hidden"), (1, "https://e.org/privacy")]
    assert [(r.page_id, r.level, r.previous) for r in P.heading_level_skips(audit).collect()] == [(1, 3, 1)]


def test_structure_points(audit):
    # the lead, a definition, a box, the summary, Article, FAQPage, internal links, keywords, a table and two lists
    assert {r.page_id: r.geo_score for r in P.geo_score(audit).collect()} == {1: 10, 2: 0, 3: 0}


def test_python_gets_small_batches(spark):
    """A worker's memory follows the batch, not the partition: pages and drafts come in batches of bounded rows and bytes."""
    from tidewright.functions import storage
    from tidewright.operators import email

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for made in (lambda: P.audit_html(spark.range(250).selectExpr("id page_id", "'https://e.org/a' url", "concat('<title>t', id, '</title>') html")), lambda: email.draft_tags(spark.range(250).selectExpr("id draft_id", "'<p>x</p>' html"))):
        spark.conf.set(key, 10000)
        out = made()
        assert int(spark.conf.get(key)) == storage.BATCH_ROWS
        assert out.select(out.columns[0]).distinct().count() == 250
