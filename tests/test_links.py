"""Link candidates against all pairs, where every page has frequent words of its own; containment at hot words."""

import itertools
import random

import pytest
from tidewright.operators import market, pages


def brute(rows, k):
    out = set()
    for i, url, _, own in rows:
        near = [(-len(set(own) & set(t)), j) for j, u, s, t in rows if j != i and u.split("/")[2] == url.split("/")[2] and s in (200, 403) and u.isascii() and set(own) & set(t)]
        out |= {(i, j, -n) for n, j in sorted(near)[:k]}
    return out


@pytest.mark.parametrize("wide", [10, 3])
def test_each_page_has_its_own_frequent_words(spark, monkeypatch, wide):
    monkeypatch.setattr(pages, "WIDE", wide)
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, f"https://h{i % 2}.org/{'ü' if i % 11 == 0 else 'p'}{i}", rnd.choice([200, 200, 403, 404]), rnd.sample(vocabulary, rnd.randrange(0, 6)) + rnd.choice([[], [f"r{i % 40}"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, status int, tokens array<string>")
    got = {tuple(r) for r in pages.link_candidates(df, k=6, common=5).select("page_id", "target", "shared").collect()}
    assert got == brute(rows, 6)


def test_link_candidates_send_no_table_to_the_driver(spark):
    """Pages, words and sets all grow with the input: none of them is broadcast, small as its files may be."""
    rows = [(i, f"https://h{i % 2}.org/p{i}", 200, [f"w{i % 3}", f"v{i % 7}", f"r{i // 2}"]) for i in range(60)]
    got = pages.link_candidates(spark.createDataFrame(rows, "page_id long, url string, status int, tokens array<string>"), k=2, common=5)
    assert {tuple(r) for r in got.select("page_id", "target", "shared").collect()} == brute(rows, 2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_containment_with_a_word_in_half_of_all(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    b = [(i, sorted({*rnd.sample(words, rnd.randrange(1, 6)), *(["hot"] if i % 2 else [])})) for i in range(600)]
    a = [(i, sorted({*rnd.sample(words, rnd.randrange(0, 3)), *(["hot"] if i % 2 else ["w1"])})) for i in range(200)] + [(900, ["nowhere", "w1"]), (901, ["hot"])]
    schema = "id long, toks array<string>"
    got = [tuple(r) for r in market.contained(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for (i, x), (j, y) in itertools.product(a, b) if set(x) <= set(y)}


def test_refresh_plan(spark):
    from datetime import datetime as T

    base = spark.createDataFrame([("s1", {"crm": "missing", "web": "complete", "mail": "partial"})], "snapshot_id string, source_status map<string,string>")
    camp = spark.createDataFrame([("c1", "D+3", T(2024, 1, 1, 12), {"web": "partial"}), ("c2", "D+7", T(2024, 1, 1), {}), ("c3", "D+1", T(2024, 1, 8, 13), None)], "campaign_id string, observation_window string, sent_at timestamp, source_status map<string,string>")
    demand = spark.createDataFrame([("boats", "r1", T(2023, 12, 18)), ("cars", "r2", T(2023, 12, 19))], "phrase string, region string, observed_at timestamp")
    tries = spark.createDataFrame([("e1", "running", 1), ("e2", "planned", 2), ("e3", "done", 3)], "experiment_id string, status string, position int")
    drafts = spark.createDataFrame([("d1",)], "draft_key string")
    got = {tuple(r) for r in market.refresh_plan(base, camp, demand, tries, drafts, "2024-01-15 12:00:00").collect()}
    assert got == {
        ("source_gap", "s1", "crm:missing", None), ("source_gap", "s1", "mail:partial", None), ("source_gap", "c1", "web:partial", None), ("mature_campaign", "c1", "D+7", 14.0),
        ("demand_refresh", "boats", "r1", 28.5), ("previous_experiment", "e2", "planned", None), ("known_draft", "d1", None, None),
    }
    none = tries.where("status = 'done'")
    assert market.refresh_plan(base, camp, demand, none, drafts, "2024-01-15").where("kind = 'previous_experiment'").count() == 0


def test_state_lists(spark):
    schema = "list string, item map<string,string>"
    old = spark.createDataFrame([("experiments", {"experiment_id": "e1", "status": "running", "note": "a"}), ("draft_registry", {"draft_key": "d1", "message_id": "m1", "status": "created"}), ("wordstat_observations", {"phrase": "p", "region": "r", "observed_at": "1", "n": "5"})], schema)
    new = spark.createDataFrame([("experiments", {"experiment_id": "e1", "status": "done", "note": None}), ("draft_registry", {"draft_key": "d1", "message_id": " Unknown", "status": "missing", "x": "1"}), ("wordstat_observations", {"phrase": "p", "region": "r", "observed_at": "2"})], schema)
    got = {(r.list, tuple(r.key)): r.item for r in market.state_lists_merge(old, new).collect()}
    assert got == {
        ("experiments", ("e1",)): {"experiment_id": "e1", "status": "done", "note": "a"},
        ("draft_registry", ("d1",)): {"draft_key": "d1", "message_id": "m1", "status": "created", "x": "1"},
        ("wordstat_observations", ("p", "r", "1")): {"phrase": "p", "region": "r", "observed_at": "1", "n": "5"},
        ("wordstat_observations", ("p", "r", "2")): {"phrase": "p", "region": "r", "observed_at": "2"},
    }
    for bad in ([("other", {"id": "1"})], [("experiments", {"id": "1"})], [("experiments", {"experiment_id": "1"})] * 2, [("draft_registry", {"draft_key": "d1", "message_id": "m2"})]):
        with pytest.raises(ValueError):
            market.state_lists_merge(old, spark.createDataFrame(bad, schema))


def test_slow_drift(spark):
    """A drift of a third of a deviation a week is found, though no day of it stands out; so is a spread that doubles."""
    from datetime import date, timedelta

    from tidewright.operators import forecast

    rnd = random.Random(5)
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    rows = [("flat", day(k), 100 + rnd.gauss(0, 5)) for k in range(200)]
    rows += [("drift", day(k), 100 + rnd.gauss(0, 5) + max(0, k - 120) * 0.12) for k in range(200)]
    rows += [("wild", day(k), 100 + rnd.gauss(0, 5 if k < 150 else 20)) for k in range(200)]
    rows += [("none", day(k), 7.0) for k in range(30)]
    df = spark.createDataFrame(rows, "name string, date date, actual double")
    events = spark.createDataFrame([], "date date, event string")
    assert forecast.change_points(df.where("name = 'drift'").drop("name"), events).count() == 0
    found = {}
    for r in forecast.drift_points(df, ["name"]).collect():
        found.setdefault((r.name, r.kind), []).append((r.since, r.date))
    assert ("drift", "level_up") in found and min(s for s, _ in found["drift", "level_up"]) >= day(110)
    assert ("wild", "variance") in found and min(d for _, d in found["wild", "variance"]) >= day(150)
    assert not [k for k in found if k[0] in ("flat", "none")]


def test_display_numbers(spark):
    rows = [(f"s{i % 37}", (i * 7919) % 1000) for i in range(1000)]
    from tidewright.operators import claims

    got = claims.display_numbers(spark.createDataFrame(rows, "source string, seen long"), "source", "seen")
    first = {}
    for s, n in rows:
        first[s] = min(first.get(s, 10**9), n)
    assert {r.source: r.display_number for r in got.collect()} == {s: k for k, (_, s) in enumerate(sorted((n, s) for s, n in first.items()), 1)}
    assert "SinglePartition" not in got._jdf.queryExecution().toString()


def test_diagnosis_record(spark, monkeypatch):
    from tidewright.operators import adperf

    causes = spark.createDataFrame([(f"c{i}", "OFF", i) for i in range(50)], "campaign string, CampaignStatus string, rows long")
    funnel = spark.createDataFrame([("ads", "Clicks", 5.0, 9.0, -4.0, -44.4)], "stage string, metric string, current double, previous double, delta double, delta_pct double")
    drivers = spark.createDataFrame([("c1", -4.0)], "key string, delta double")
    monkeypatch.setattr(adperf, "funnel_compare", lambda *a: funnel)
    monkeypatch.setattr(adperf, "confirmed_causes", lambda d: causes)
    monkeypatch.setattr(adperf, "likely_drivers", lambda *a: drivers)
    r = adperf.diagnosis_record(causes, causes, causes, causes, "Clicks", True, most=3).first()
    assert (r.metric, r.complete, r.causes, r.confidence) == ("Clicks", True, 50, "high")
    assert [tuple(c) for c in r.confirmed_causes] == [("c49", "OFF", 49), ("c48", "OFF", 48), ("c47", "OFF", 47)]
    assert [tuple(d) for d in r.likely_drivers] == [("c1", -4.0)] and [h.hypothesis for h in r.hypotheses] == ["click_acquisition"]
    r = adperf.diagnosis_record(causes, causes, causes, causes, "Clicks", False).first()
    assert r.confidence == "low" and r.likely_drivers == [] and len(r.confirmed_causes) == 20
