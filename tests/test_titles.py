"""Similar titles against all pairs, events and topics against passes one by one."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions.expr import STOP_WORDS
from tidewright.operators import news as N
from tidewright.operators import titles as T

SCHEMA = "id long, title string, source string, boost double"


def made(n, seed=6):
    rnd = random.Random(seed)
    words = "quarterly earnings report reports published publishes openai launches launched new newer model models market shares rise rises fall falls city council votes vote storm hits coast north trade deal signed talks gpt".split()
    base = [" ".join(rnd.choices(words, k=rnd.randrange(1, 9))) for _ in range(n // 2)]
    near = [rnd.choice(["", "The "]) + " ".join(w if rnd.random() < 0.8 else rnd.choice(words) for w in t.split()) + rnd.choice(["", "s", " today", "-like!"]) for t in base]
    odd = ["Gemini", "what is the new Gemini about and how does it say so", "open-source models", "open source models", "", "?!", "a" * 250, "ab" * 150, "ab" * 150, "x" * 70 + " y", base[0], base[0], near[1].upper(), "é" * 30, "É" * 29]
    return [(i, t, f"s{i % 3}", float(i % 5)) for i, t in enumerate(base + near + odd)]


def plain(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()


def kw(t):
    return {w for w in plain(t).split() if w not in STOP_WORDS}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def topical(later, earlier):
    a, b = (set(re.sub(r"[^\w\s]", " ", t.lower()).split()) for t in (later, earlier))
    return max(jaccard(a, b), 0.8 * SequenceMatcher(None, later.lower(), earlier.lower()).ratio()) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.55])
def test_ratio_pairs(spark, threshold):
    rows = [(i, plain(t)) for i, t, *_ in made(160)]
    got = {(r.id_a, r.id_b): (r.ab, r.ba) for r in T.ratio_pairs(spark.createDataFrame(rows, "id long, t string"), threshold, tile=25).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows[i:]:
            both = T.ratio(a, b), T.ratio(b, a)
            if max(both) >= threshold:
                want[i, j] = both
    assert got == want


def test_subsequences():
    rnd = random.Random(1)
    for n in (1, 63, 64, 65, 130, 257, 400):
        a = np.array([rnd.randrange(4) for _ in range(n)], np.uint8)
        others = [np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 200))], np.uint8) for _ in range(5)]
        for b, got in zip(others, T.subsequences(a, others), strict=True):
            row = [0] * (n + 1)
            for c in b:
                new = [0]
                for i in range(n):
                    new.append(row[i] + 1 if a[i] == c else max(row[i + 1], new[-1]))
                row = new
            assert got == row[-1]


def test_title_similarity_pairs(spark):
    rows = made(160)
    got = {(r.id_a, r.id_b): r.similarity for r in N.title_similarity_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(a[0], b[0]): s for i, a in enumerate(rows) for b in rows[i + 1 :] if (s := topical(b[1], a[1])) >= 0.35}
    assert got == pytest.approx(want)
    ids = {t: i for i, t, *_ in rows}
    assert got[ids["open-source models"], ids["open source models"]] == 1.0


def alike(a, b, ratio, least):
    """Rule of the daily digest: ratio, or Jaccard of two keywords or more on both sides."""
    ka, kb = kw(a), kw(b)
    return SequenceMatcher(None, plain(a), plain(b)).ratio() >= ratio or (min(len(ka), len(kb)) >= 2 and jaccard(ka, kb) >= least)


def test_mention_score(spark):
    rows = made(160)
    got = {r.id: r.mention_score for r in N.mention_score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: min(1.0, sum(alike(t, o, 0.5, 0.35) for j, o, *_ in rows if i != j) / 5) for i, t, *_ in rows}


def test_batch_near_dedup(spark):
    """Links followed: the events of all pairs; a pass one by one keeps the same but for chains."""
    rows = made(160)
    df = spark.createDataFrame(rows, SCHEMA)
    got = N.batch_near_dedup(df, {"s0": 0.9}).collect()

    def same(a, b):
        ka, kb = kw(a), kw(b)
        two = sum(e in a.lower() and e in b.lower() for e in N.KEY_ENTITIES) >= 2
        return alike(a, b, 0.55, 0.4) or alike(b, a, 0.55, 0.4) or (two and min(len(ka), len(kb)) >= 2 and jaccard(ka, kb) >= 0.25)

    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if same(a[1], b[1]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    best = {}
    for i, _, s, _ in rows:
        best[find(i)] = min(best.get(find(i), (9, 0)), (-0.9 if s == "s0" else -0.65, i))
    assert {(r.id, r.root) for r in got} == {(i, r) for r, (_, i) in best.items()}
    kept = []
    for r in rows:
        if not any(same(r[1], k[1]) for k in kept):
            kept.append(r)
    assert {find(k[0]) for k in kept} == set(best) and len(kept) >= len(got)
    titles = {r[1]: find(r[0]) for r in rows}
    assert titles["Gemini"] != titles["what is the new Gemini about and how does it say so"]


@pytest.mark.parametrize("few", [10**6, 0])
def test_topics_as_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_PAIRS", few)
    rows = made(120)
    topics = {}
    for i, t, s, boost in rows:
        lead = next((x for x in topics if topical(t, rows[x][1]) >= 0.35), i)
        members, sources, most = topics.get(lead, (0, set(), 0.0))
        topics[lead] = members + 1, sources | {s}, max(most, boost)
    got = N.cluster_score(N.topic_clusters(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.leader: (r.members, r.sources, r.boost) for r in got} == {k: (m, len(s), b) for k, (m, s, b) in topics.items()}
    assert {r.leader: r.score for r in got} == pytest.approx({k: (2 * len(s) + m) * (1 + b / 10) for k, (m, s, b) in topics.items()})


def test_hot_words_bring_few_together(spark):
    """A word in half of all titles: candidates stay near the result, and the result is that of all pairs."""
    rnd = random.Random(2)
    rows = [(i, sorted({*rnd.sample(range(900), rnd.randrange(1, 5)), *([1000] if i % 2 else [])})) for i in range(1000)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in rows], "id long, kw array<string>")
    for threshold in (0.25, 0.4, 0.5):
        got = {(r.id_a, r.id_b): r.jaccard for r in T.jaccard_pairs(df, df, threshold).where("id_a < id_b").collect()}
        sets = [set(s) for _, s in rows]
        want = {(i, j): x for i in range(1000) for j in range(i + 1, 1000) if min(len(sets[i]), len(sets[j])) >= 2 and (x := jaccard(sets[i], sets[j])) >= threshold}
        assert got == pytest.approx(want)
        assert T.candidates(df, df, threshold).where("id_a < id_b").count() <= 4 * len(want) + 5000


@pytest.mark.parametrize("block", [256, 7])
def test_copies_meet_as_one_set(spark, monkeypatch, block):
    """Copies are expanded behind the join: pairs that are verified do not grow with them, and no pair of copies is lost or doubled."""
    rows = [(i, ["x", "y", "z"] if i % 3 else ["y", "x", "u"] if i % 2 else ["x", f"w{i}"]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, kw array<string>")
    met, verified = [], T.verified
    monkeypatch.setattr(T, "DEALT", block, raising=False)
    monkeypatch.setattr(T, "verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    want = {(i, j): x for i, a in rows for j, b in rows if (x := jaccard(set(a), set(b))) >= 0.4}
    got = [(r.id_a, r.id_b, r.jaccard) for r in T.jaccard_pairs(df, df, 0.4).collect()]
    assert {(i, j): x for i, j, x in got} == pytest.approx(want) and len(got) == len(want)
    assert met[0] <= 1000
    got = [(r.id_a, r.id_b, r.jaccard) for r in T.jaccard_links(df, 0.4).collect()]
    assert {(i, j): x for i, j, x in got} == pytest.approx({(i, j): x for (i, j), x in want.items() if i <= j}) and len(got) == len(set(got)) == sum(i <= j for i, j in want)


def test_many_terms(spark):
    """5,000 terms, overlapping and nested ones among them, and the same by plain expressions."""
    from tidewright.functions import terms

    rnd = random.Random(3)
    some = ["".join(rnd.choices("abc", k=rnd.randrange(1, 9))) for _ in range(5000)] + ["", "é"]
    texts = [None, "", *("".join(rnd.choices("abcdé ", k=60)) for _ in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: list(r.x) for r in df.select("id", terms.terms_in(spark, F.col("t"), some).alias("x")).collect()}
    want = {i: [k for k, x in enumerate(some) if x and x in (t or "") and some.index(x) == k] for i, t in enumerate(texts)}
    assert got == want
    few = [x for x in some[:9] if x]
    got = {r.id: [few[k] for k in r.x or []] for r in df.select("id", terms.terms_in(spark, F.col("t"), few).alias("x")).collect()}
    assert got == {i: [x for x in dict.fromkeys(few) if x in (t or "")] for i, t in enumerate(texts)}


def test_rules_of_three_kinds(spark):
    rules = [("e", "exact", "Small Ring")] + [(f"c{k}", "contains", f"x{k}") for k in range(60)] + [("d", "contains", "X7"), ("r", "regex", "^b.*t$")]
    phrases = [(1, "small ring"), (2, "a small ring"), (3, "has X7 and x59"), (4, "boat"), (5, None)]
    got = N.forbidden_theme_match(spark.createDataFrame(phrases, "phrase_id int, phrase string"), spark.createDataFrame(rules, "rule_id string, match_type string, pattern string"))
    assert {tuple(r) for r in got.collect()} == {(1, "e"), (3, "c7"), (3, "d"), (3, "c5"), (3, "c59"), (4, "r")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for f in (N.title_similarity_pairs, N.mention_score, N.topic_clusters, lambda d: N.batch_near_dedup(d, {})):
        assert f(df).count() == 0
    one = spark.createDataFrame([(1, None, "s", None)], SCHEMA).withColumn("extra", F.lit(1))
    assert N.mention_score(one).first().mention_score == 0 and N.topic_clusters(one).count() == 1


def long_ones(n=90, seed=9):
    """Titles around the lengths from which other rules hold, and signs of several scripts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 8))) for _ in range(30)] + ["zebra", "q9", "漢字", "ж"]
    out = [" ".join(rnd.choices(words, k=rnd.choice([1, 4, 9, 40, 43, 70, 120]))) for _ in range(n)]
    out += [" ".join(w for w in t.split() if rnd.random() < 0.9) for t in out[::2]]
    return sorted([*out, "", "é" * 30, "ab" * 130, "".join(chr(0x4E00 + rnd.randrange(300)) for _ in range(300))], key=len)


@pytest.mark.parametrize("threshold", [0.35, 0.55])
def test_blocks_side_by_side(threshold, monkeypatch):
    """As SequenceMatcher has it, with few pairs left to it: each pair once, one by one, is what took the time."""
    titles, one = long_ones(), T.ratio
    want = {(i, j): both for i, a in enumerate(titles) for j, b in enumerate(titles[i:], i) if max(both := (one(a, b), one(b, a))) >= threshold}
    calls = []
    monkeypatch.setattr(T, "ratio", lambda a, b: calls.append(1) or one(a, b))
    assert {(i, j): (x, y) for i, j, x, y in T.like_in_tiles(titles, titles, threshold, True)} == want
    assert len(calls) < len(want)


def test_history_of_titles(spark):
    news = [(i, t, i) for i, t in enumerate(long_ones())]
    old = news[::7]
    at = {i for i, t, _ in news if plain(t) and any(SequenceMatcher(None, plain(t), plain(o)).ratio() >= 0.65 for _, o, _ in old if plain(o))}
    df = spark.createDataFrame(news, "id long, title string, sent_at int")
    assert {r.id for r in N.history_fuzzy_filter(df, df.where("sent_at % 7 = 0")).collect()} == {i for i, *_ in news} - at
    assert T.reaching([t for _, t, _ in news], [o for _, o, _ in old], 0.65).tolist() == [i for i, t, _ in news if any(SequenceMatcher(None, t, o).ratio() >= 0.65 for _, o, _ in old)]


def test_entity_links(spark):
    """One row a title, with every link between titles counted."""
    rnd = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rnd.sample(names, rnd.randrange(5))).title() or None) for i in range(60)]
    of = {i: {n for n in names if n in (t or "").lower()} for i, t in rows}
    got = N.entity_links(spark.createDataFrame(rows, "id long, title string"), names).collect()
    assert {r.id: (r.entities, r.class_id, r.links) for r in got} == {
        i: ("|".join(sorted(e)), min(j for j in of if of[j] == e), sum(len(e & of[j]) >= 2 for j in of if j != i)) for i, e in of.items()
    }
    assert len(got) == 60


@pytest.mark.parametrize("threshold", [0.4375, 0.5])
def test_long_titles_are_bounded(threshold, monkeypatch):
    """Long titles that are unlike are told by bounds; copies, near copies, shared starts and frequent characters are not lost."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("etaoinshrdlu" * 6 + "bcfgkmpvwxyz", k=rnd.randrange(2, 8))) for _ in range(6000)]
    base = [" ".join(rnd.choices(words, k=k)) for k in (40, 60, 110, 130, 160, 200, 240, 300) for _ in range(5)]
    near = [" ".join(w for w in t.split() if rnd.random() < p) for t, p in zip(base[::2], [0.6, 0.8, 0.9, 0.95] * 5, strict=True)]
    start = base[30][:700]
    odd = ["a" * 700, "a" * 900, "ab" * 400, start + "x" * 300, start + "y" * 400, "ab" * 400 + "q" + "ba" * 100]
    titles = sorted([*base, *near, *odd], key=len)
    want = {(i, j): both for i, a in enumerate(titles) for j, b in enumerate(titles[i:], i) if max(both := (T.ratio(a, b), T.ratio(b, a))) >= threshold}
    done, one = [], T._one_by_one
    monkeypatch.setattr(T, "_one_by_one", lambda a, b, left, right: done.append(len(left)) or one(a, b, left, right))
    assert {(i, j): (x, y) for i, j, x, y in T.like_in_tiles(titles, titles, threshold, True)} == want
    long = sum(len(titles[j]) > T.BLOCKS for _, j in want)
    assert sum(done) <= 3 * long


@pytest.mark.parametrize("first", [12, 50])
def test_topics_by_blocks(spark, monkeypatch, first):
    """Blocks meet the leaders before them: the topics of a pass one by one, though few titles are compared with each other."""
    monkeypatch.setattr(N, "FIRST_BLOCK", first, raising=False)
    seen, compared = [], N.compared
    monkeypatch.setattr(N, "compared", lambda titles, *rest: seen.append(titles.count()) or compared(titles, *rest))
    rows = made(120, seed=7)
    topics = {}
    for i, t, s, boost in rows:
        lead = next((x for x in topics if topical(t, rows[x][1]) >= 0.35), i)
        members, sources, most = topics.get(lead, (0, set(), 0.0))
        topics[lead] = members + 1, sources | {s}, max(most, boost)
    got = N.topic_clusters(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.leader: (r.members, r.sources, r.boost) for r in got} == {k: (m, len(s), b) for k, (m, s, b) in topics.items()}
    assert len(seen) > 1 and max(seen) < len(rows) // 2


@pytest.mark.parametrize("threshold", [0.35, 0.55])
def test_ratios_of_long_titles(spark, threshold):
    """Around the lengths from which other rules hold, as SequenceMatcher has them, in a tile and between tiles."""
    titles = long_ones()
    rows = list(enumerate(titles))
    got = {(r.id_a, r.id_b): (r.ab, r.ba) for r in T.ratio_pairs(spark.createDataFrame(rows, "id long, t string"), threshold, tile=50).collect()}
    assert got == {(i, j): both for i, a in rows for j, b in rows[i:] if max(both := (T.ratio(a, b), T.ratio(b, a))) >= threshold}


def test_events_by_few_links(spark, monkeypatch):
    """Like titles are joined by as many links as events take, not by all their pairs."""
    rnd = random.Random(8)
    base = ["".join(rnd.choices("abcdefghijklm", k=60)), "".join(rnd.choices("nopqrstuvwxyz", k=60))]
    rows = [(i, "".join(c for c in base[i % 2] if rnd.random() < 0.9), "s", 0.0) for i in range(300)]
    links, joining = [], T.joining_links

    def counted(*args):
        out = joining(*args)
        links.append(out.count())
        return out

    monkeypatch.setattr(T, "joining_links", counted)
    got = N.batch_near_dedup(spark.createDataFrame(rows, SCHEMA), {}).collect()
    assert [(r.id, r.root) for r in sorted(got)] == [(0, 0), (1, 1)]
    assert sum(links) <= 300


def test_mentions_until_enough(spark, monkeypatch):
    """Only titles whose words do not bring enough mentions are asked for like ones."""
    rnd = random.Random(3)
    rows = [(i, f"storm hits coast {'abcd'[i % 4] * 9}", "s", 0.0) for i in range(200)] + [(200 + i, "".join(rnd.choices("etaoin ", k=40)), "s", 0.0) for i in range(30)]
    asked, like_news = [], T.like_news
    monkeypatch.setattr(T, "like_news", lambda titles, open_, *rest: asked.append(open_.count()) or like_news(titles, open_, *rest))
    got = {r.id: r.mention_score for r in N.mention_score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: min(1.0, sum(alike(t, o, 0.5, 0.35) for j, o, *_ in rows if i != j) / 5) for i, t, *_ in rows}
    assert asked == [30]


def test_leaders_by_steps(spark, monkeypatch):
    """The first leader a title is like, though later leaders are only met by titles that have found none."""
    titles, met, tiles = long_ones(40), [], T._tiles
    random.Random(2).shuffle(titles)
    rows = list(enumerate(titles))
    monkeypatch.setattr(T, "FIRST_LEADERS", 5)
    monkeypatch.setattr(T, "_tiles", lambda d, *rest: met.append(d.count()) or tiles(d, *rest))
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.leader for r in T.first_likes(df.where("id >= 45"), df.where("id < 45"), 0.4).collect()}
    assert got == {i: first for i, t in rows[45:] if (first := next((j for j, o in rows[:45] if T.ratio(t, o) >= 0.4), None)) is not None}
    assert met[0] == len(rows) - 45 and met[2] < met[0]


def test_all_links_whatever_was_near(spark):
    """Tiles are dealt anew each time, so titles that now share one meet though no step before has joined them."""
    df = spark.createDataFrame([(i, f"storm hits the north coast {i}") for i in range(40)], "id long, t string")
    events = df.select("id", F.col("id").alias("root"))
    for near in (True, False):
        assert T.joining_links(df, events, 0.55, near).count() == 39


def test_like_pairs_are_not_kept(spark, monkeypatch):
    """Pairs grow with the square of the titles: they go on to the copies without a table of their own."""
    labels, landed = [], N.landed
    monkeypatch.setattr(N, "landed", lambda df, label: labels.append(label) or landed(df, label))
    rows = made(40)
    assert N.title_similarity_pairs(spark.createDataFrame(rows, SCHEMA)).count() == sum(topical(b[1], a[1]) >= 0.35 for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert labels and "like-titles" not in labels
