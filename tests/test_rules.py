"""Rule tables: set values member by member, a clean case without findings, and cases that break one rule each."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewright.functions import expr as X
from tidewright.operators import claims as C
from tidewright.operators import email as E
from tidewright.operators import market as M
from tidewright.operators import news as N


def codes(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["rule_id"])
    return out


def test_set_values():
    assert E.PII_KEYS == ["email", "e-mail", "mail", "phone", "telephone", "tel", "name", "first_name", "last_name", "fio"]
    assert X.TRACKING == ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid"]
    assert E.GENERAL_PATHS == ["/", "/news", "/blog", "/articles", "/category", "/tag", "/search"]
    assert E.TOPIC_WEIGHTS == {"demand": 20, "momentum": 20, "product_fit": 20, "audience_value": 15, "actionability": 15, "novelty": 10}
    assert C.REQUIRED == ["Executive Summary", "Introduction", "Main Analysis", "Synthesis", "Limitations", "Recommendations", "Bibliography", "Methodology"]
    assert C.STRONG_SOURCES == ["primary", "official", "original_research", "authoritative"]
    assert len(C.HIGH_AUTHORITY) == 32 and len(C.MODERATE_AUTHORITY) == 17 and len(M.TRIGGERS) == 18 and len(M.ROUTES) == 17
    assert M.RISING == ["breakout", "emerging", "rapid_growth", "growing"] and M.FALLING == ["declining", "structural_decline"]


def test_urls(spark):
    one = lambda u: spark.range(1).select(X.canonical_url(F.lit(u)).alias("u")).first().u
    assert one("HTTPS://user@E.org:443/A/b/?mc_cid=1&b=2&a=1&yclid=3&REF=x#f") == "https://e.org/A/b?a=1&b=2&yclid=3"
    assert one("//E.org/x;p=1/") == "https://e.org/x;p=1" and one("doi:10.1234/a.b.") == "doi:10.1234/a.b" and one("arXiv:2301.00001") == "arxiv:2301.00001"
    gate = {"https://e.org/a": True, "http://e.org/a": False, "https://u@e.org/a": False, "https://e.org": False, "https://e.org/news/": False, "https://e.org/x/tag/y": False, "https://e.org/newsroom": True, "https://e.org/services": True}
    got = {r.url: r.accepted for r in E.material_url_gate(spark.createDataFrame([(u,) for u in gate], "url string")).collect()}
    assert got == gate


GOOD = (
    '<!DOCTYPE html><html><style>body{max-width:600px;font-family:Arial;color:' + ";".join(f"#00000{i}" for i in range(8)) + '}</style><body em="group">' + "Brand Sender " + "p" * 80
    + '<table><tr em="block"></tr>' + "".join(f'<tr data-role="article-card"><td><a href="https://e.org/m{i}?utm_source=unisender&utm_medium=email&utm_campaign=c1&utm_content=p{i}">x</a><img src="https://e.org/i.png" alt="a"></td></tr>' for i in range(3)) + "</table>Ad</body></html>"
)


TRACK = "utm_source=unisender&utm_medium=email&utm_campaign=c1&utm_content="


def draft(spark, rows):
    colors = {r: f"#00000{i}" for i, r in enumerate(E.COLOR_ROLES)}
    base = {"subject": "News", "preheader": "p" * 80, "html": GOOD, "utm_campaign": "c1", "expected_articles": 3, "brand_name": "Brand", "sender_name": "Sender", "font_family": "Arial", "colors": colors, "required_labels": ["Ad"]}
    schema = "draft_id long, subject string, preheader string, html string, utm_campaign string, expected_articles int, brand_name string, sender_name string, font_family string, colors map<string,string>, required_labels array<string>"
    return codes(E.email_draft_lint(spark.createDataFrame([(i, *(base | change).values()) for i, change in enumerate(rows)], schema)), "draft_id")


def test_drafts(spark):
    swap = lambda a, b: {"html": GOOD.replace(a, b)}
    cases = [
        ({}, set()),
        ({"subject": "s" * 51}, {"subject_length"}),
        ({"expected_articles": 4}, {"article_cards"}),
        (swap("<!DOCTYPE html>", ""), {"no_doctype"}),
        (swap("utm_content=p1", "utm_content=p0"), {"link_utm_content_repeated"}),
        (swap("utm_campaign=c1&utm_content=p2", "utm_campaign=c9&utm_content=p2"), {"link_utm_campaign_differs"}),
        (swap("/m1?", "/news?"), {"link_to_general_section"}),
        (swap("/m1?", "/m1?Last_Name=x&"), {"link_pii_key"}),
        (swap("/m1?", "/m1?q=a%40b.org&"), {"link_mail_as_value"}),
        (swap("https://e.org/m1", "http://e.org/m1"), {"link_not_https"}),
        (swap('alt="a"', 'alt=" "'), {"image_without_alt"}),
        (swap("https://e.org/i.png", "i.png"), {"image_source"}),
        (swap("Ad</body>", "TODO Ad</body>"), {"placeholder"}),
        (swap('em="block"', ""), {"no_block"}),
        ({"brand_name": "Other"}, {"brand_name_not_kept"}),
        ({"required_labels": ["Legal"]}, {"label_not_kept"}),
        (swap("/m1?", "/x/../news/?"), {"link_to_general_section"}),
        (swap("/m1?", "/a/./tag/b?"), {"link_to_general_section"}),
        (swap("</table>", f'</tr></tr><tr><td><a href="https://e.org/news?{TRACK}p9">x</a></td></tr></table>'), set()),
        (swap("<td>", "<td><table><tr><td></td></tr></table>"), set()),
        (swap('<td><a href="https://e.org/m1', '<td><table><tr><td><a href="https://e.org/news'), {"link_to_general_section"}),
        (swap("https://e.org/m1", "https://user@e.org/m1"), {"link_not_https"}),
        (swap("https://e.org/m1", "HTTPS://e.org/m1"), set()),
        (swap("</table>", '</table><a href="mailto:a@b.org">m</a><a href=" # ">e</a><a name="x">n</a>'), {"link_empty"}),
        (swap("</table>", '</table><a href="https://e.org/q" data-tracking="operational">o</a><a href="http://e.org/q" data-tracking="operational">o</a>'), {"link_not_https"}),
        (swap("/m1?", "/m1?x=1;name=2&"), {"link_pii_key"}),
        (swap("utm_source=unisender&utm_medium=email&utm_campaign=c1&utm_content=p1", "utm_source=chatgpt.com&utm_medium=&utm_medium=email&utm_campaign=c1&utm_content="), {"link_from_chatbot", "link_utm_source_differs", "link_utm_content_required"}),
        (swap('<a href="https://e.org/m1', '<a href="#" href="https://e.org/m1'), {"repeated_link_attributes"}),
    ]
    got = draft(spark, [c for c, _ in cases])
    assert {i: got.get(i, set()) for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}
    assert {"html_required", "subject_required", "no_tracked_links", "expected_articles"} <= draft(spark, [{"subject": None, "html": None, "expected_articles": None}])[0]


def report(bib="\n".join(f"[{i}] Source" for i in range(1, 11)), extra="", words=600):
    cites = " ".join(f"[{i}]" for i in range(1, 11))
    heads = "\n".join(f"## {s}\ntext" for s in ["Introduction", "Main Analysis", "Synthesis", "Limitations", "Recommendations", "Methodology", "Counterevidence Register", "Claims-Evidence Table"])
    return f"## Executive Summary\n{'word ' * 60}\n{heads}\n{'more ' * words}{cites} {extra}\n## Bibliography\n{bib}\n"


def test_reports(spark):
    ten = "\n".join(f"[{i}] Source" for i in range(1, 11))
    cases = [
        (report(), set()),
        (report(ten + "\n[11-75] more"), {"cut_bibliography"}),
        (report(ten + " and so on"), {"cut_bibliography"}),
        (report(ten.replace("[3] Source", "")), {"bibliography_gap", "few_sources"}),
        (report(extra="[11]"), {"cited_not_listed"}),
        (report(extra="[needs citation]"), {"placeholder"}),
        (report(extra="Due to length we stop"), {"cut_report"}),
        (report(words=10), {"too_short"}),
        (report().replace("## Methodology", "## Way"), {"missing_section:Methodology"}),
        (report().replace("## Claims-Evidence Table", "## Table"), {"missing_recommended:Claims-Evidence Table"}),
        (report().replace("word " * 60, "word " * 20), {"summary_too_short"}),
    ]
    got = codes(C.report_lint(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")), "doc_id")
    assert {i: got.get(i, set()) for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}


def test_sensitive_texts(spark):
    cases = {
        "see /home/me/x": "private_path", "C:\\Users\\me": "private_windows_path", "GoogleDrive-a@b.c/": "cloud_storage_path", "-----BEGIN RSA PRIVATE KEY-----": "private_key", "ghp_" + "a1" * 18: "credential_token",
        'password = "' + "a1" * 12 + '"': "literal_credential", "write me@firm.io": "mailbox", "client_id: 48151623": "account_id",
    }
    clean = ["me@example.com", "user@gmail.com", "a@b.example", "client_id: 11111111", "user_id=12345678", "password: short", "/homes/x"]
    lines = [*cases, *clean]
    out = C.sensitive_text_scan(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert {lines[r.line - 1]: r.code for r in out} == cases and len(out) == len(cases)


@pytest.mark.parametrize(("title", "year", "rule"), [("A Study of Things", 2020, "generic_title"), ("Recent Advances in Cooking", 2020, "generic_advances_title"), ("Deep Learning: A Comprehensive Review", 2020, "templated_title"), ("Plain words", 2027, "future_year"), ("GPT at work", 1995, "anachronism")])
def test_citations(spark, title, year, rule):
    e = spark.createDataFrame([(1, 1, title, year, None, "https://e.org")], "doc_id long, n int, title string, year int, doi string, url string")
    assert codes(C.suspicious_citations(e, 2026), "doc_id") == {1: {rule}}


def test_credibility(spark):
    rows = [("a", "https://www.nature.com/x", "T", "2026-05-01", "Dr. A", None), ("b", "https://x.blogspot.com", "Shocking!", None, None, None), ("c", "https://docs.agency.gov/a", "T", "2019-01-01", None, "however")]
    d = spark.createDataFrame(rows, "source_id string, url string, title string, published string, author string, content string").withColumn("published", F.col("published").cast("date"))
    got = {r.source_id: (r.domain, r.recency, r.expertise, r.neutrality, r.band) for r in C.source_credibility(d, "2026-06-01").collect()}
    assert got == {"a": (90.0, 100.0, 95.0, 90.0, "high_trust"), "b": (40.0, 50.0, 50.0, 50.0, "low_trust"), "c": (55.0, 30.0, 95.0, 80.0, "moderate_trust")}


def test_draft_registry(spark):
    schema = "draft_key string, message_id string, status string, tags array<string>"
    old = spark.createDataFrame([("a", "m1", "created", ["x"]), ("b", None, "draft", None)], schema)
    new = spark.createDataFrame([("a", " Unknown ", "missing", ["y", "x"]), ("b", "m2", "sent", ["z"]), ("c", None, "draft", None)], schema)
    merged, revision = M.draft_state_merge(old, new, 4)
    assert revision == 5 and sorted(tuple(r) for r in merged.collect()) == [("a", "m1", "created", ["x", "y"]), ("b", "m2", "sent", ["z"]), ("c", None, "draft", None)]
    with pytest.raises(ValueError):
        M.draft_state_merge(old, spark.createDataFrame([("a", "m9", None, None)], schema), 4)


def titles(n=500):
    rnd = random.Random(6)
    words = "quarterly earnings report reports published publishes openai launches launched new newer model models market shares rise rises fall falls city council votes vote storm hits coast north trade deal signed talks".split()
    base = [" ".join(rnd.choices(words, k=rnd.randrange(4, 9))) for _ in range(n // 2)]
    near = [" ".join(w if rnd.random() < 0.8 else rnd.choice(words) for w in t.split()) + rnd.choice(["", "s", " today"]) for t in base]
    return [(i, t, f"s{i % 3}", float(i)) for i, t in enumerate(base + near)]


def test_history_looks_at_all_pairs(spark):
    rows = titles(300)
    df = spark.createDataFrame(rows, "id long, title string, source string, sent_at double")
    old = [t for i, t, _, _ in rows if i % 5 == 0]
    want = {i for i, t, _, _ in rows if not any(SequenceMatcher(None, t, o).ratio() >= 0.65 for o in set(old))}
    assert {r.id for r in N.history_fuzzy_filter(df, df.where("id % 5 = 0")).collect()} == want
