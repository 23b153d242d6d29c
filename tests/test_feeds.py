"""XML feeds and forecast packages, good and bad."""

import json
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from tidewright.operators import news
from tidewright.sources import files
from tidewright.sources.package import OBJECTS, PACKAGE, scan_nested_package

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title>
<item><title> One &amp; only </title><link>https://e.org/1</link><description><![CDATA[<p>Text <b>bold</b></p>]]></description><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>No link</title></item>
<item><title>Dated</title><link>https://e.org/2</link><dc:date>2024-01-03T08:00:00Z</dc:date><content:encoded>whole</content:encoded></item>
<item><title>  </title><link>https://e.org/3</link></item>
<item><title>Undated</title><link>https://e.org/4</link><pubDate>soon</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><title type="html">First</title><link rel="self" href="https://a.org/self"/><link rel="alternate" href="https://a.org/1"/><summary type="html">S</summary><updated>2024-01-05T00:00:00Z</updated></entry>
<entry><title type="text">Second</title><link href="https://a.org/2"/><published>2024-01-04T12:30:00+01:00</published><updated>2024-01-06T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RSS)
    (tmp_path / "two.xml").write_text(ATOM)
    (tmp_path / "bad.xml").write_text("<rss><channel><item><title>This & that</title><link>https://b.org/1</link></item><item><title>Whole</title><link>https://b.org/2</link></item></channel></rss>")
    (tmp_path / "open.xml").write_text("<rss><channel><item><title>Before</title><link>https://c.org/1</link></item><item><title>Broken</title><link>https://c.org/2</lin></item></channel></rss>")
    items, rejects = files.scan_feed_xml(spark, str(tmp_path))
    got = {(r.feed, r.pos): (r.title, r.link, r.published, r.updated) for r in items.collect()}
    day = lambda *a: T(2024, 1, *a)
    assert got == {
        ("one", 0): ("One & only", "https://e.org/1", day(2, 8), None), ("one", 1): ("Dated", "https://e.org/2", day(3, 8), None), ("one", 2): ("Undated", "https://e.org/4", None, None),
        ("two", 0): ("First", "https://a.org/1", None, day(5)), ("two", 1): ("Second", "https://a.org/2", day(4, 11, 30), day(6)), ("bad", 0): ("Whole", "https://b.org/2", None, None), ("open", 0): ("Before", "https://c.org/1", None, None),
    }
    assert sorted((r.feed, r.reason) for r in rejects.collect()) == [("bad", "not_xml"), ("one", "no_link"), ("one", "no_title"), ("open", "not_xml")]
    out = {r.title: (r.summary, r.pub_date) for r in news.scan_feed_items(items).collect()}
    assert out["One & only"] == ("Text bold", day(2, 8)) and out["Dated"][0] == "whole" and out["First"] == ("S", day(5))


VALUES = {"string": "x", "date": "2024-01-02", "timestamp": "2024-01-02T03:04:05Z", "double": 1.5, "int": 7, "bigint": 9, "boolean": True}


def item(name):
    out = {}
    for field in PACKAGE[name].split(", "):
        key, _, kind = field.replace("!", "").partition(" ")
        if kind in VALUES:
            out[key] = VALUES[kind]
    return out


def whole(run):
    p = {name: item(name) if name in OBJECTS else [item(name), item(name)] for name in PACKAGE}
    return p | {"forecast_run": item("forecast_run") | {"run_id": run}, "horizons": [7, 30]}


def test_all_collections(spark, tmp_path):
    assert len(PACKAGE) == 23
    (tmp_path / "a.json").write_text(json.dumps(whole("r1")))
    got = scan_nested_package(spark, str(tmp_path))
    assert set(got.tables) == set(PACKAGE) and got.rejects.count() == 0
    counts = got.tables["meta"].select(F.lit("meta").alias("c"), "run")
    for name in list(PACKAGE)[1:]:
        counts = counts.unionByName(got.tables[name].select(F.lit(name).alias("c"), "run"))
    assert {(r.c, r.run): r["count"] for r in counts.groupBy("c", "run").count().collect()} == {(n, "r1"): 1 if n in OBJECTS else 2 for n in PACKAGE}
    assert [r.value for r in got.tables["horizons"].orderBy("pos").collect()] == [7, 30]


@pytest.mark.parametrize("how", ["type", "missing"])
def test_one_field_broken_in_each_collection(spark, tmp_path, how):
    p = whole("r2")
    for name in PACKAGE:
        target = p[name] if name in OBJECTS else p[name][0]
        if name == "horizons":
            p[name][0] = "soon" if how == "type" else None
        elif name != "forecast_run":
            keys = [f.split("! ") for f in PACKAGE[name].split(", ") if "! " in f]
            key, kind = next((k for k in keys if k[1] != "string"), keys[0])
            target[key] = [] if how == "type" and kind != "string" else None  # anything can be read as text
    (tmp_path / "a.json").write_text(json.dumps(p | {"odd": 1}))
    (tmp_path / "b.json").write_text("[1, 2")
    (tmp_path / "c.json").write_text(json.dumps({k: v for k, v in whole("r3").items() if k != "model"} | {"sources": {"id": 1}}))
    got = scan_nested_package(spark, str(tmp_path))
    rejected = {(r.run, r.collection): r.reason for r in got.rejects.collect()}
    assert {c for run, c in rejected if run == "r2"} == set(PACKAGE) - {"forecast_run"} | {"odd"}
    assert rejected["r2", "odd"] == "unknown_collection" and rejected[None, None] == "no_object"
    assert rejected["r3", "model"] == "missing_collection" and rejected["r3", "sources"] == "no_list"
    assert got.tables["actual_series"].where("run = 'r2'").count() == 1 and got.tables["meta"].where("run = 'r2'").count() == 0
