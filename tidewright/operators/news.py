"""News: hashes, histories, near-duplicate titles, topic clusters and scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.expr import keywords, normalize_title, short_sha, spaced_title
from tidewright.functions import jvm
from tidewright.functions.storage import by_shuffle, landed, tasks
from tidewright.functions.terms import terms_in
from tidewright.operators import titles as titles_join
from tidewright.operators.titles import jaccard_pairs

#: Entities of which two shared ones speak for one event.
KEY_ENTITIES = [
    "openai", "google", "microsoft", "meta", "apple", "amazon", "anthropic", "deepmind", "gemini", "gpt", "claude", "llama", "mistral", "sora", "copilot", "chatgpt",
    "dall-e", "stable diffusion", "midjourney", "hugging face", "nvidia", "tesla", "perplexity", "groq",
]


def news_hash(title: Column | str, link: Column | str) -> Column:
    one = lambda c: F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return short_sha(one(title), one(link))


def with_keywords(news: DataFrame) -> DataFrame:
    return news.withColumn("kw", keywords("title"))


def history_hash_filter(news: DataFrame, sent: DataFrame) -> DataFrame:
    """News whose hash was not sent before."""
    return news.withColumn("hash", news_hash("title", "link")).join(sent.select("hash"), "hash", "left_anti")


def recent_history(sent: DataFrame, n: int = 500) -> DataFrame:
    """The last n titles sent: a bounded table."""
    return sent.orderBy(F.col("sent_at").desc(), "title").limit(n)


def history_fuzzy_filter(news: DataFrame, sent: DataFrame, threshold: float = 0.65, n: int = 500) -> DataFrame:
    """News without a title as like any of the last n sent ones. n titles are a bounded table that every task holds; each different
    title meets it once, by the bounds and blocks of operators/titles.py."""
    t = normalize_title("title")
    old = sorted((r["t"] for r in recent_history(sent, n).select(t.alias("t")).where("t <> ''").distinct().collect()), key=len)  # n rows

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            titles = sorted(pdf["t"], key=len)
            for at in range(0, len(titles), titles_join.TILE):
                some = titles[at : at + titles_join.TILE]
                yield pd.DataFrame({"t": [some[k] for k in titles_join.reaching(some, old, threshold)]}, dtype="object")

    each = news.select("id", t.alias("t")).where("t <> ''")
    different = each.select("t").distinct()
    gone = each.join(different.repartition(tasks(news), "t").mapInPandas(hits, "t string"), "t").select("id").distinct()
    return news.join(gone, "id", "left_anti")


def history_jaccard_filter(news: DataFrame, sent: DataFrame, threshold: float = 0.5, n: int = 500) -> DataFrame:
    """News whose keywords are not like those of any of the last n sent titles; titles of one keyword pass."""
    old = with_keywords(recent_history(sent, n)).select(F.col("id"), "kw")
    hits = jaccard_pairs(with_keywords(news).select("id", "kw"), old, threshold).select(F.col("id_a").alias("id")).distinct()
    return news.join(hits, "id", "left_anti")


def _different(news: DataFrame, t: Column, words: Column) -> tuple[DataFrame, DataFrame]:
    """(id, t of each news; id, t, kw of each different title under its least id)."""
    each = landed(news.select("id", F.coalesce(t, F.lit("")).alias("t"), words.alias("kw")), "titles")
    return each.select("id", "t"), landed(each.groupBy("t").agg(F.min("id").alias("id"), F.first("kw").alias("kw")), "different-titles")


def compared(titles: DataFrame, least_ratio: float, least_jaccard: float, least_words: int) -> DataFrame:
    """(id_a, id_b, jaccard, ab, ba), id_a <= id_b, of different titles (id, t, kw): all pairs with such a ratio in one direction
    or the other, or such a Jaccard similarity; each title with itself too. What stays below its threshold is null; ab is the ratio
    of a to b. Word sets of fewer than least_words have no Jaccard similarity."""
    near = titles_join.ratio_pairs(titles, least_ratio)
    sets = titles.select("id", "kw")
    alike = titles_join.jaccard_links(sets, least_jaccard, least_words)
    return near.join(alike, ["id_a", "id_b"], "full").select("id_a", "id_b", "jaccard", "ab", "ba")


def _copies(each: DataFrame, titles: DataFrame) -> DataFrame:
    """(rep, id): the news behind each different title."""
    return each.join(titles.select("t", F.col("id").alias("rep")), "t").select("rep", "id")


def _topical(news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rule for topics: (each news, different titles)."""
    words = lambda c: F.filter(F.array_distinct(F.split(spaced_title(c), " ")), lambda w: w != "")
    return _different(news, F.lower("title"), words(F.col("title")))


def _topical_pairs(titles: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, ab, ba): pairs of different titles with their similarities; titles without words are like none."""
    pairs = compared(titles.where(F.size("kw") > 0), threshold / 0.8, threshold, 1)
    likeness = lambda c: F.greatest(F.coalesce("jaccard", F.lit(0.0)), 0.8 * F.coalesce(c, F.lit(0.0))).alias(c)
    return pairs.select("id_a", "id_b", likeness("ab"), likeness("ba"))


def _first_like(titles: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """(id, leader): the first of the leaders that a title is like, if any."""
    ratios = titles_join.first_likes(titles, leaders, threshold / 0.8)
    words = jaccard_pairs(titles.select("id", "kw"), leaders.select("id", "kw"), threshold, 1).select(F.col("id_a").alias("id"), F.col("id_b").alias("leader"))
    return landed(ratios.unionByName(words).groupBy("id").agg(F.min("leader").alias("leader")), "topic-followers")


def title_similarity_pairs(news: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: the larger of the Jaccard similarity of all words and .8 of the ratio of the later
    title to the earlier one, in lower case. Titles without words are like none."""
    each, titles = _topical(news)
    pairs = _topical_pairs(titles, threshold)
    both = titles_join.dealt(pairs, _copies(each, titles)).where("a <> b")
    later = F.when(F.col("a") < F.col("b"), F.col("ba")).otherwise(F.col("ab"))
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), later.alias("similarity")).where(F.col("similarity") >= threshold)


def entity_overlap(a: Column | str, b: Column | str, entities: list[str] | None = None) -> Column:
    """Number of known entities that both titles name."""
    e = F.array(*[F.lit(x) for x in (entities or KEY_ENTITIES)])
    a, b = (F.lower(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    return F.size(F.filter(e, lambda x: F.contains(a, x) & F.contains(b, x)))


def _named(news: DataFrame, entities: list[str] | None) -> Column:
    """The entities that a title names, in order."""
    names = entities or KEY_ENTITIES
    at = terms_in(news.sparkSession, F.lower("title"), names)
    return F.array_sort(F.transform(at, lambda k: F.element_at(F.array(*[F.lit(x) for x in names]), k + 1)))


def _set_pairs(sets: DataFrame, least: int) -> DataFrame:
    """(ea, eb, titles_a, titles_b, shared): the sets (e, n) that share at least `least` entities, in both orders, each with itself too."""
    keys = sets.select("e", "n", F.explode("e").alias("k"))
    met = keys.select(F.col("e").alias("ea"), F.col("n").alias("titles_a"), "k").join(keys.select(F.col("e").alias("eb"), F.col("n").alias("titles_b"), "k"), "k")
    return met.groupBy("ea", "eb", "titles_a", "titles_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def entity_sets(news: DataFrame, entities: list[str] | None = None, least: int = 2) -> DataFrame:
    """(set_a, set_b, shared, titles_a, titles_b): the sets of entities that titles name, which share at least `least` of them, and how
    many titles name each set; a set meets itself too. Titles are counted by set before sets meet, so an entity that every title
    names is one row a set."""
    sets = landed(news.select(_named(news, entities).alias("e")).where(F.size("e") >= least).groupBy("e").agg(F.count("*").alias("n")), "entity-sets")
    out = _set_pairs(sets, least).select(F.array_join("ea", "|").alias("set_a"), F.array_join("eb", "|").alias("set_b"), "shared", "titles_a", "titles_b")
    return out.where("set_a <= set_b")


def entity_links(news: DataFrame, entities: list[str] | None = None, least: int = 2) -> DataFrame:
    """(id, entities, class_id, links) of each news: the entities that its title names, the least id that names the same ones, and how
    many other titles share at least `least` of them with it. Two news share what stands in the entities of both."""
    each = landed(news.select("id", F.coalesce(_named(news, entities), F.array().cast("array<string>")).alias("e")), "entities")
    sets = landed(each.groupBy("e").agg(F.count("*").alias("n"), F.min("id").alias("class_id")), "entity-sets")
    linked = _set_pairs(sets.where(F.size("e") >= least), least).groupBy(F.col("ea").alias("e")).agg((F.sum("titles_b") - 1).alias("links"))
    of = sets.join(linked, "e", "left").select("e", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return each.join(of, "e").select("id", F.array_join("e", "|").alias("entities"), "class_id", "links")


def min_label(edges: DataFrame) -> DataFrame:
    """(id, root): least id reachable over edges (a, b), by repeated minimum over neighbours and a jump, until nothing changes."""
    both = landed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = landed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, "a", "left").select("a", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = step.join(step.select(F.col("a").alias("root"), F.col("root").alias("r2")), "root", "left").select("a", F.least("root", F.coalesce("r2", "root")).alias("root"))
        jump = landed(jump, "labels")
        if not jump.join(label.withColumnRenamed("root", "old"), "a").where("root <> old").take(1):
            return jump.select(F.col("a").alias("id"), "root")
        label = jump


def _like_themselves(titles: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b) of titles whose ratio to themselves reaches the threshold: all but some long ones of frequent characters."""
    one = lambda c: F.array(F.col(c))
    long = titles.where(F.length("t") >= titles_join.JUNK).select(jvm.rows(titles.sparkSession, "like_pairs", one("id"), one("t"), one("id"), one("t"), F.lit(threshold), F.lit(True)).alias("r")).select("r.id_a", "r.id_b")
    return titles.where(F.length("t") < titles_join.JUNK).select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).unionByName(long)


def batch_near_dedup(news: DataFrame, weights: dict[str, float], default: float = 0.65) -> DataFrame:
    """One row of each event: titles alike by ratio .55, or of two keywords or more by Jaccard .40, or by two entities and Jaccard
    .25, are linked, links are followed, and the most authoritative source stays (then the least id)."""
    each, titles = _different(news, normalize_title("title"), keywords("title"))
    named = titles.join(_copies(each, titles).join(news.select("id", "title"), "id").groupBy(F.col("rep").alias("id")).agg(F.min("title").alias("title")), "id")
    e = F.array(*[F.lit(x) for x in KEY_ENTITIES])
    side = lambda x: by_shuffle(named.select(F.col("id").alias(f"id_{x}"), F.filter(e, lambda w: F.contains(F.lower("title"), w)).alias(f"e{x}")))
    weak = (F.col("jaccard") >= 0.25) & (F.size(F.array_intersect("ea", "eb")) >= 2)
    words = titles_join.jaccard_links(titles.select("id", "kw"), 0.25, 2).join(side("a"), "id_a").join(side("b"), "id_b")
    links = landed(words.where((F.col("jaccard") >= 0.40) | weak).select("id_a", "id_b").unionByName(_like_themselves(titles, 0.55)), "events")
    for near in (True, False):  # first what joins many titles at little cost, then all that is not joined yet
        links = links.unionByName(titles_join.joining_links(titles, min_label(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), 0.55, near))
    roots = min_label(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    # a title that is not even like itself (long, and made of common characters only) speaks for one event a news
    roots = _copies(each, titles).join(roots.withColumnRenamed("id", "rep"), "rep").select("id", "root")
    n = news.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("authority", authority(F.col("source"), weights, default))
    best = n.groupBy("root").agg(F.min(F.struct((-F.col("authority")).alias("a"), "id")).alias("_b")).select(F.col("_b.id").alias("id"))
    return n.join(best, "id", "left_semi")


def authority(source: Column, weights: dict[str, float], default: float = 0.65) -> Column:
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    return F.coalesce(F.element_at(m, source), F.lit(default))


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours.isNull(), 0.5).when(age_hours < 6, 1.0).when(age_hours < 12, 0.8).when(age_hours < 24, 0.6).otherwise(0.4)


#: Mentions from which on a score is 1.
ENOUGH = 5


def mention_score(news: DataFrame) -> DataFrame:
    """(id, mention_score): the other news whose title this one's is like, by ratio .5 or, with two keywords or more on both
    sides, by Jaccard .35; in fifths, at most 1. Titles that have enough are not asked for more."""
    each, titles = _different(news, normalize_title("title"), keywords("title"))
    of = landed(_copies(each, titles), "copies")
    many = landed(of.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("n")), "copies")
    words = landed(titles_join.jaccard_links(titles.select("id", "kw"), 0.35, 2), "like-titles")  # each with itself too
    both = words.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(words.where("id_a < id_b").select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    by_words = landed(both.join(by_shuffle(many.withColumnRenamed("id", "other")), "other").groupBy("id").agg(F.sum(F.col("n") - (F.col("id") == F.col("other")).cast("long")).alias("n")), "mentions")
    few = landed(titles.select("id", "t").join(by_shuffle(by_words), "id", "left").where(F.coalesce("n", F.lit(0)) < ENOUGH).select("id"), "few-mentions")
    known = both.join(by_shuffle(few), "id").groupBy("id").agg(F.collect_list("other").alias("known"))  # ENOUGH at most, itself included
    asked = landed(few.join(by_shuffle(known), "id", "left").select("id", F.coalesce("known", F.array().cast("array<long>")).alias("known")), "few-mentions")
    by_ratio = titles_join.like_news(titles.select("id", "t").join(by_shuffle(many), "id"), asked, 0.5, ENOUGH)
    found = by_words.unionByName(by_ratio).groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    mine = of.join(by_shuffle(found), "rep", "left").select("id", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / ENOUGH).alias("mention_score"))
    return news.select("id").join(mine, "id")


def freshness_authority_score(news: DataFrame, weights: dict[str, float]) -> DataFrame:
    """.3 freshness + .3 mention + .2 authority + .2 impact (default .5); news may carry mention_score and impact."""
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in news.columns else F.lit(d)
    f, a = freshness(F.col("age_hours")), authority(F.col("source"), weights)
    return news.select("id", f.alias("freshness"), a.alias("authority"), (0.3 * f + 0.3 * col("mention_score", 0.0) + 0.2 * a + 0.2 * col("impact", 0.5)).alias("score"))


#: Like pairs up to this number are settled in one task when topics are formed.
FEW_PAIRS = 200_000


def _settled(before: pd.DataFrame) -> pd.DataFrame:
    """Who leads among (before, id, leads of before so far): one after the other."""
    leads = dict(zip(before["before"].tolist(), before["known"].tolist(), strict=True))
    of: dict[int, list[int]] = {}
    for b, i in zip(before["before"].tolist(), before["id"].tolist(), strict=True):
        of.setdefault(i, []).append(b)
    for i in sorted({*leads, *of}):
        if leads.get(i) is None:
            leads[i] = not any(leads[b] for b in of.get(i, ()))
    return pd.DataFrame({"id": list(leads), "leads": pd.Series(list(leads.values()), dtype="bool")})


#: Different titles of the first block when topics are formed; each further block ends at GROWTH times as many.
FIRST_BLOCK, GROWTH = 4096, 4


def _led(titles: DataFrame, threshold: float) -> DataFrame:
    """(id, leader) of different titles among themselves: in order of id, each joins the first leader it is like, or leads.

    Who leads is settled in rounds over the table of like pairs: a title without an undecided or leading like one before it leads;
    one with a leading one before it follows. Ids that say nothing of likeness leave a round's depth to the logarithm of their
    number; once few pairs are open, they are settled in one go, however long a chain they make.
    """
    pairs = _topical_pairs(titles, threshold)
    edges = landed(pairs.where((F.col("id_a") < F.col("id_b")) & (F.col("ba") >= threshold)).select(F.col("id_a").alias("before"), F.col("id_b").alias("id")), "topic-links")
    leads = landed(edges.select(F.explode(F.array("before", "id")).alias("id")).distinct().withColumn("leads", F.lit(None).cast("boolean")), "leaders")
    while True:
        open_ = landed(edges.join(leads.where("leads is null").select("id"), "id").join(leads.select(F.col("id").alias("before"), F.col("leads").alias("known")), "before"), "topic-open")
        if open_.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
            break
        seen = open_.groupBy("id").agg(F.bool_or("known").alias("_any"), F.count_if(F.col("known").isNull()).alias("_open"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("_any", F.lit(False)), F.lit(False)).when(F.coalesce("_open", F.lit(0)) == 0, F.lit(True))
        leads = landed(leads.join(seen, "id", "left").select("id", now.alias("leads")), "leaders")
    rest = open_.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: _settled(pdf), "id long, leads boolean").withColumnRenamed("leads", "_l")  # FEW_PAIRS rows
    led = landed(leads.join(rest, "id", "left").select("id", F.coalesce("leads", "_l", F.lit(True)).alias("leads")), "leaders")
    first = edges.join(led.where("leads").select(F.col("id").alias("before")), "before").groupBy("id").agg(F.min("before").alias("_first"))
    top = titles.select("id").join(led, "id", "left").join(first, "id", "left")
    return top.select("id", F.when(F.coalesce("leads", F.lit(True)), F.col("id")).otherwise(F.col("_first")).alias("leader"))


def topic_clusters(news: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(leader, members, sources, boost) over all news, whatever their source: in order of id, news join the first leader that
    their title is like, or lead a new topic. boost is the largest of the members', if news have one.

    Different titles go by blocks in order of id, each a few times longer than all before it. A block meets the leaders of those
    before, which come first for all of its titles; only titles that are like none of them are compared with each other.
    """
    each, titles = _topical(news)
    n, ends = titles.count(), [FIRST_BLOCK]
    while ends[-1] * GROWTH < n:
        ends.append(ends[-1] * GROWTH)
    ids = titles.approxQuantile("id", [e / n for e in ends if e < n], 0.01 / GROWTH ** len(ends)) if ends[0] < n else []
    block = F.lit(0)
    for i in ids:
        block = block + (F.col("id") > int(i)).cast("int")
    tops = None
    for k in range(len(ids) + 1):
        now = titles.where(block == k)
        if tops is None:
            tops = landed(_led(now, threshold), "topic-leaders")
            continue
        leaders = titles.join(tops.where("id = leader").select("id"), "id").where(F.size("kw") > 0)
        found = _first_like(now.where(F.size("kw") > 0), leaders, threshold)
        own = _led(landed(now.join(found, "id", "left_anti"), "topic-rest"), threshold)
        tops = landed(tops.unionByName(found).unionByName(own), "topic-leaders")
    top = tops.withColumnRenamed("id", "rep").join(titles.select(F.col("id").alias("rep"), (F.size("kw") > 0).alias("worded")), "rep")
    boost = F.col("boost") if "boost" in news.columns else F.lit(None).cast("double")
    n = _copies(each, titles).join(top, "rep").join(news.select("id", "source", boost.alias("boost")), "id")
    # copies of a title without words are like nothing, themselves included: topics of their own
    return n.groupBy(F.when(F.col("worded"), F.col("leader")).otherwise(F.col("id")).alias("leader")).agg(F.count("*").alias("members"), F.count_distinct("source").alias("sources"), F.max("boost").alias("boost"))


def cluster_score(clusters: DataFrame) -> DataFrame:
    """(2 sources + mentions) (1 + boost / 10)."""
    return clusters.withColumn("score", (2 * F.col("sources") + F.col("members")) * (1 + F.coalesce("boost", F.lit(0.0)) / 10))


def banned_topic_filter(news: DataFrame, banned: list[str]) -> DataFrame:
    """News that name no banned topic, however many there are."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    return news.where(F.size(terms_in(news.sparkSession, text, banned)) == 0)


#: Rules that are sent to all tasks and applied as one automaton.
MOST_RULES = 100_000


def forbidden_theme_match(phrases: DataFrame, rules: DataFrame) -> DataFrame:
    """(phrase_id, rule_id): rules(rule_id, match_type exact / contains / regex, pattern), MOST_RULES at most. Exact ones meet by a
    join, contained ones in one pass over each phrase, regular expressions one by one."""
    spark = phrases.sparkSession
    p = phrases.select("phrase_id", F.lower("phrase").alias("_p"))
    exact = p.join(rules.where("match_type = 'exact'").select("rule_id", F.lower("pattern").alias("_p")), "_p").select("phrase_id", "rule_id")
    some = rules.where("match_type = 'contains' and pattern <> ''").select("rule_id", F.lower("pattern").alias("pattern")).limit(MOST_RULES + 1).collect()
    if len(some) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    terms = sorted({r["pattern"] for r in some})
    place = {t: k for k, t in enumerate(terms)}
    of = spark.createDataFrame([(place[r["pattern"]], r["rule_id"]) for r in some], "_k int, rule_id string")
    held = p.select("phrase_id", F.explode(terms_in(spark, F.col("_p"), terms)).alias("_k")).join(F.broadcast(of), "_k").select("phrase_id", "rule_id")
    regex = p.join(F.broadcast(rules.where("match_type = 'regex'")), F.regexp_like(F.col("_p"), F.col("pattern"))).select("phrase_id", "rule_id")
    return exact.unionByName(held).unionByName(regex)


def text_filter_boost(news: DataFrame, keywords_: list[str], brands: list[str], needle: str = "") -> DataFrame:
    """News that contain the needle, with 3 for a priority keyword and 1.5 for a priority brand."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    any_ = lambda ws: F.size(terms_in(news.sparkSession, text, [w.lower() for w in ws])) > 0
    boost = F.when(any_(keywords_), 3.0).otherwise(0.0) + F.when(any_(brands), 1.5).otherwise(0.0)
    return news.where(F.contains(text, F.lit(needle.lower()))).withColumn("boost", boost)


def adaptive_recency_window(news: DataFrame, least: int = 15) -> DataFrame:
    """The last 24 hours if they hold enough, else 36; undated news always stay."""
    n = news.agg(F.count_if(F.col("age_hours") <= 24).alias("_n"))
    return news.join(F.broadcast(n)).where(F.col("age_hours").isNull() | (F.col("age_hours") <= F.when(F.col("_n") >= least, 24).otherwise(36))).drop("_n")


def scan_feed_items(items: DataFrame, size: int = 500, per_feed: int = 15) -> DataFrame:
    """Landed items (feed, pos, title, link, summary, published, updated): title and link required, tags stripped, summary cut."""
    text = F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]+>", ""))
    ok = items.where("trim(coalesce(title, '')) <> '' and trim(coalesce(link, '')) <> ''")
    r = F.row_number().over(Window.partitionBy("feed").orderBy("pos"))
    return ok.withColumn("_r", r).where(F.col("_r") <= per_feed).select("feed", "pos", F.trim("title").alias("title"), F.trim("link").alias("link"), F.substring(text, 1, size).alias("summary"), F.coalesce("published", "updated").alias("pub_date"))
