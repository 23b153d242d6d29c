"""Search visibility, phrases, brand and competitor measures, registries and keyed state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import landed
from tidewright.functions.expr import normalize_phrase, normalize_query, ratio, short_sha


def position_bucket(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p.isNull(), "no_data").when(p <= 0, "not_visible").when(p <= 3, "top3").when(p <= 10, "top10").when(p <= 50, "top50").otherwise("weak")


def demand_band(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v == 0, "zero").when(v > 5000, "high").when(v >= 500, "mid").otherwise("low")


def keep_min_volume(phrases: DataFrame, least: int = 100, secondary: int = 8) -> DataFrame:
    """Phrases of enough demand: the largest of a cluster is the focus, the next ones are secondary."""
    p = phrases.where(F.col("volume") >= least).withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("volume").desc(), "phrase_id")))
    return p.where(F.col("_r") <= secondary + 1).withColumn("role", F.when(F.col("_r") == 1, "focus").otherwise("secondary")).drop("_r")


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, other): phrases of a (id, toks) whose words all stand in a phrase of b.

    Words are put in one order, the rarest of b first, so phrases of a form a prefix tree, of which two levels are walked by a join
    each: a word of b that begins a phrase of a, then a later word that goes on in it. Only keys and ids meet; a word that half of
    b holds comes late in every phrase and is met under its rare first word alone, unless a phrase is nothing but that word. What
    is longer than two words is compared in whole.
    """
    often = b.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def ordered(d: DataFrame) -> DataFrame:
        w = d.select("id", F.explode("toks").alias("w")).join(often, "w", "left")
        return landed(w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("r")).select("id", F.col("r.w").alias("r"), F.get("r.f", F.lit(0)).alias("least")), "ordered-words")

    phrases = ordered(a).where("least > 0").select("id", F.get("r", F.lit(0)).alias("w1"), F.get("r", F.lit(1)).alias("w2"), F.col("r").alias("ra"))
    held = ordered(b).select(F.col("id").alias("other"), F.col("r").alias("rb"))
    begun = held.select("other", F.posexplode("rb").alias("i", "w1"), "rb").select("other", "w1", F.slice("rb", F.col("i") + 2, F.size("rb")).alias("later"))
    begun = begun.join(phrases.select("w1").distinct(), "w1")
    one = begun.join(phrases.where("w2 is null").select("id", "w1"), "w1").select("id", "other")
    on = begun.select("other", "w1", F.explode("later").alias("w2")).join(phrases.where("w2 is not null").select("id", "w1", "w2", F.size("ra").alias("n")), ["w1", "w2"])
    long = on.where("n > 2").select("id", "other").join(phrases.select("id", "ra"), "id").join(held, "other").where(F.size(F.array_except("ra", "rb")) == 0)
    return one.unionByName(on.where("n = 2").select("id", "other")).unionByName(long.select("id", "other"))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_query(c), " "), lambda w: w != ""))


def demand_visibility_match(demand: DataFrame, visibility: DataFrame) -> DataFrame:
    """Per demand phrase (id, phrase, volume): shows and clicks of every query that holds its words, the best position (0 if none
    is above 0); null where nothing matches. Phrases and queries of the same set of words are one each, named by a hash of it."""
    words = lambda c: F.array_sort(tokens(c))
    d = demand.withColumn("_t", words("phrase")).withColumn("_k", F.xxhash64("_t"))
    q = visibility.select(words("query").alias("toks"), "impressions", "clicks", "position").groupBy("toks").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.min(F.when(F.col("position") > 0, F.col("position"))).alias("position"))
    q = q.withColumn("id", F.xxhash64("toks"))
    a = d.where(F.size("_t") > 0).select(F.col("_k").alias("id"), F.col("_t").alias("toks")).distinct()
    m = contained(a, q.select("id", "toks")).join(q.select(F.col("id").alias("other"), "impressions", "clicks", "position"), "other")
    g = m.groupBy("id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.coalesce(F.min("position"), F.lit(0.0)).alias("position"))
    g = g.withColumnRenamed("id", "_k")
    return d.join(g, "_k", "left").drop("_k", "_t").withColumn("bucket", position_bucket("position"))


def nested_query_guard(phrases: DataFrame) -> DataFrame:
    """(cluster_id, phrases, volume) without phrases that hold all words of another, shorter phrase of the cluster."""
    t = phrases.select("cluster_id", "phrase_id", "volume", F.array_sort(tokens("phrase")).alias("toks"))
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "toks").orderBy(F.col("volume").desc(), "phrase_id"))).where("_r = 1").drop("_r")
    tag = F.transform("toks", lambda w: F.concat_ws("\u0001", F.col("cluster_id"), w))
    d = t.select(F.col("phrase_id").alias("id"), tag.alias("toks"))
    inner = contained(d, d).where("id <> other").select(F.col("other").alias("phrase_id")).distinct()
    return t.join(inner, "phrase_id", "left_anti").groupBy("cluster_id").agg(F.count("*").alias("phrases"), F.sum("volume").alias("volume"))


def visibility_aggregate(v: DataFrame) -> DataFrame:
    """Sums, mean position, sorted distinct URLs and queries of each cluster, over the rows that lack no field."""
    names = lambda c: F.sort_array(F.collect_set(c))
    return v.dropna(subset=["query", "cluster_id", "url", "impressions", "clicks", "position"]).groupBy("cluster_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("position").alias("position"), names("query").alias("queries"), names("url").alias("urls"), ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"))


#: Signals of a rising and of a falling market.
RISING, FALLING = ["breakout", "emerging", "rapid_growth", "growing"], ["declining", "structural_decline"]


def visibility_action(signal: Column, coverage: Column) -> Column:
    """Action by trend and visibility, null if none; needs impressions, position, ctr columns. coverage is gap if unknown."""
    unseen = F.coalesce(F.col("impressions") == 0, F.lit(True))
    open_ = F.coalesce(coverage, F.lit("gap")).isin("gap", "partial")
    seen = F.when(signal.isin(RISING) & (F.col("position") > 10), "optimize_visibility").when((F.col("position") <= 10) & (F.coalesce("ctr", F.lit(0.0)) < 0.03) & (F.col("impressions") >= 50), "improve_ctr").when(signal.isin(FALLING) & (F.col("impressions") > 0), "review_offer")
    return F.when(unseen, F.when(signal.isin(RISING) & open_, "market_rising_no_page")).otherwise(seen)


def visibility_merge(trend: DataFrame, v: DataFrame) -> DataFrame:
    """Trend results with aggregated search metrics by cluster, and the action."""
    j = trend.join(visibility_aggregate(v), "cluster_id", "left")
    return j.withColumn("action", visibility_action(F.col("signal"), F.col("coverage_status")))


def visibility_flags(v: DataFrame) -> DataFrame:
    """(query, url, rule_id): rows with missing fields, negative figures, more clicks than impressions."""
    lost = [F.when(F.col(c).isNull(), f"missing:{c}") for c in ("query", "cluster_id", "url", "impressions", "clicks", "position")]
    rules = [*lost, F.when((F.col("impressions") < 0) | (F.col("clicks") < 0), "negative_metrics"), F.when(F.col("clicks") > F.col("impressions"), "clicks_exceed_impressions")]
    return v.select("query", "url", F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


def status_share(buckets: DataFrame) -> DataFrame:
    g = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def ctr_anomalies(v: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Queries whose CTR is far from the median of their position bucket."""
    d = v.withColumn("ctr", ratio("clicks", "impressions")).withColumn("bucket", position_bucket("position"))
    m = d.groupBy("bucket").agg(F.median("ctr").alias("median_ctr"))
    j = d.join(F.broadcast(m), "bucket")
    flag = F.when(F.col("bucket").isin("top3", "top10") & (F.col("ctr") < F.col("median_ctr") * low), "high_position_low_ctr").when(F.col("bucket").isin("top50", "weak") & (F.col("ctr") > F.col("median_ctr") * high), "strong_ctr_middling_position")
    return j.withColumn("flag", flag).where("flag is not null")


def top_by(df: DataFrame, where: Column, order: str, key: str, n: int) -> DataFrame:
    return df.where(where).orderBy(F.col(order).desc(), key).limit(n)


def representative_phrases(phrases: DataFrame, k: int = 5) -> DataFrame:
    """Up to k phrases of a cluster by fit, volume and shortness."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("fit").desc(), F.col("volume").desc(), F.length("phrase"), "phrase_id")
    return phrases.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def topic_priority(age_days: Column, demand: Column, seasonal: Column, window: int = 20, season_window: int = 60, high: int = 500) -> Column:
    """urgent, social_now, important, next_quarter or planned: an event inside its window (longer for a seasonal one in peak
    demand) by demand, else a season's peak by demand, else an older event by demand. high is 500 a month, 100 in the smaller
    region."""
    big = F.coalesce(demand >= high, F.lit(False))
    fresh = F.coalesce(age_days <= F.when(seasonal & big, season_window).otherwise(window), F.lit(False))
    return F.when(fresh, F.when(big, "urgent").otherwise("social_now")).when(seasonal, F.when(big, "important").otherwise("planned")).otherwise(F.when(big, "important").otherwise("next_quarter"))


def merge_demand_lists(lists: list[DataFrame], n: int = 100) -> DataFrame:
    u = reduce(lambda a, b: a.unionByName(b), [d.select(normalize_phrase("phrase").alias("phrase"), "count") for d in lists])
    return u.where("phrase <> ''").groupBy("phrase").agg(F.max("count").alias("count")).orderBy(F.col("count").desc(), "phrase").limit(n)


def share_of_voice(demand: DataFrame) -> DataFrame:
    """Share of a brand in its contour's demand in per cent; contours are never summed."""
    return demand.withColumn("share", 100 * F.col("volume") / F.sum("volume").over(Window.partitionBy("contour")))


#: Weights of demand, share, mentions and answers.
BRAND = {"d": 0.35, "s": 0.25, "m": 0.25, "a": 0.15}


def brand_index(parts: DataFrame, base_period: str) -> DataFrame:
    """100 x product of each part's ratio to the base period to its weight; parts that may be 0 are compared plus one; a zero
    base gives null; another configuration is not comparable."""
    base = parts.where(F.col("period") == base_period).select("brand", F.col("config_id").alias("_c"), *[F.col(p).alias(f"_{p}") for p in BRAND])
    j = parts.join(base, "brand", "left")
    r = {p: F.when(F.lit(p in "ma"), (F.col(p) + 1) / (F.col(f"_{p}") + 1)).otherwise(ratio(p, f"_{p}")) for p in BRAND}
    same = F.col("config_id") == F.col("_c")
    index = 100 * reduce(lambda a, b: a * b, [F.pow(r[p], F.lit(w)) for p, w in BRAND.items()])
    return j.select("brand", "period", F.when(same, index).alias("index"), F.coalesce(same, F.lit(False)).alias("comparable"))


def mention_weight(mentions: DataFrame) -> DataFrame:
    """Per period and paid or own: 5 for trade press, 8 for business press, each text once, at its highest weight, own first."""
    w = F.when(F.col("class") == "business", 8).when(F.col("class") == "trade", 5).otherwise(0)
    once = mentions.groupBy("period", "content_hash").agg(F.min(F.struct((-w).alias("w"), "paid")).alias("x"))
    return once.groupBy("period", F.col("x.paid").alias("paid")).agg(F.sum(-F.col("x.w")).alias("m"))


def loss_reason_share(deals: DataFrame, competitor: float = 0.30, reason: float = 0.40) -> DataFrame:
    """(segment, kind, value, n, share) of competitors and reasons that take more than their limit of a segment's losses."""
    long = deals.select("segment", F.explode(F.array(F.struct(F.lit("competitor").alias("kind"), F.col("competitor").alias("value")), F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")))).alias("x")).select("segment", "x.*")
    g = long.groupBy("segment", "kind", "value").agg(F.count("*").alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("segment", "kind")))
    return g.where(((F.col("kind") == "competitor") & (F.col("share") >= competitor)) | ((F.col("kind") == "reason") & (F.col("share") >= reason)))


def page_concentration(visits: DataFrame) -> DataFrame:
    """Share of the top 1, 5 and 10 pages; only ten rows are placed."""
    total = visits.agg(F.sum("visits").alias("t"))
    top = visits.orderBy(F.col("visits").desc(), "page").limit(10).withColumn("r", F.row_number().over(Window.orderBy(F.col("visits").desc(), "page")))
    return top.join(total).groupBy("t").agg(*[F.sum(F.when(F.col("r") <= k, F.col("visits"))).alias(f"s{k}") for k in (1, 5, 10)]).select(*[(F.col(f"s{k}") / F.col("t")).alias(f"top{k}") for k in (1, 5, 10)])


def regional_share(demand: DataFrame, n: int = 5) -> DataFrame:
    d = demand.withColumn("share", F.col("volume") / F.sum("volume").over(Window.partitionBy("phrase")))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("phrase").orderBy(F.col("volume").desc(), "region"))).where(F.col("place") <= n)


def repeat_complaint_run(reviews: DataFrame, step: float = 0.3) -> DataFrame:
    """Reviews that are the third in a row with one complaint, or whose rating moved by step or more."""
    w = Window.partitionBy("company").orderBy("ts", "review_id")
    run = (F.col("complaint") == F.lag("complaint", 1).over(w)) & (F.col("complaint") == F.lag("complaint", 2).over(w))
    move = F.abs(F.col("rating") - F.lag("rating", 1).over(w)) >= step
    d = reviews.withColumn("run", F.coalesce(run, F.lit(False))).withColumn("moved", F.coalesce(move, F.lit(False)))
    return d.where("run or moved")


def consecutive_wins(tenders: DataFrame) -> DataFrame:
    w = Window.partitionBy("customer").orderBy("ts", "tender_id")
    return tenders.withColumn("_p", F.lag("winner").over(w)).where("winner = _p").drop("_p")


def frequency_shift(counts: DataFrame) -> DataFrame:
    """Periods whose activity at least doubled or halved against the one before."""
    d = counts.withColumn("previous", F.lag("n").over(Window.partitionBy("company").orderBy("period")))
    return d.withColumn("shift", F.when(F.col("n") >= 2 * F.col("previous"), "doubled").when(F.col("n") * 2 <= F.col("previous"), "halved")).where("shift is not null")


def seed_manifest(entities: DataFrame) -> DataFrame:
    """Active phrases of all collections once each: highest priority, refs and types sorted, any forced."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"low": 1, "medium": 2, "high": 3, "critical": 4}.items() for x in kv]), F.col("priority"))
    e = entities.where("status = 'active'").select(normalize_phrase("phrase").alias("phrase"), F.coalesce(rank, F.lit(2)).alias("rank"), "ref", "source_type", F.coalesce("force_monitor", F.lit(False)).alias("force"))
    g = e.where("phrase <> ''").groupBy("phrase").agg(F.max("rank").alias("priority"), F.sort_array(F.collect_set("ref")).alias("refs"), F.sort_array(F.collect_set("source_type")).alias("source_types"), F.bool_or("force").alias("force_monitor"))
    return g.withColumn("seed_id", F.concat(F.lit("seed_"), short_sha(F.col("phrase"), bits=1, size=12)))


def reference_integrity(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule_id): references to ids that do not exist, ids used twice."""
    lost = edges.join(entities.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(F.col("from_id").alias("id"), F.lit("dangling_reference").alias("rule_id"))
    return lost.unionByName(entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("rule_id"))).distinct()


def keyed_state_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key: a null never erases a value, arrays are joined in order, repeated keys are an error."""
    twice = new.groupBy(*keys).count().where("count > 1")
    if twice.take(1):
        raise ValueError("repeated keys in the delta")
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys])
    j = old.join(n, keys, "full")
    kinds = dict(new.dtypes)

    def value(c: str) -> Column:
        if c not in kinds:
            return F.col(c)
        if kinds[c].startswith("array"):
            return F.when(F.col(c).isNull(), F.col(f"_{c}")).when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.array_union(c, f"_{c}"))
        blank = F.col(f"_{c}") == "" if kinds[c] == "string" else F.lit(False)
        return F.coalesce(F.when(~F.coalesce(blank, F.lit(False)), F.col(f"_{c}")), F.col(c))

    return j.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


#: Drafts whose state is settled, and states and ids that say nothing.
SETTLED, UNSETTLED, NO_ID = ["created", "existing_unchanged"], ["unknown", "missing"], ["", "unknown", "missing"]


def draft_state_merge(old: DataFrame, new: DataFrame, revision: int) -> tuple[DataFrame, int]:
    """keyed_state_merge of a draft registry (draft_key, message_id, status, ...) and its next revision: a known message id is
    never erased, another one in its place is an error, and a settled status does not become unknown again."""
    said = F.lower(F.trim("message_id"))
    n = new.withColumn("message_id", F.when(~F.coalesce(said, F.lit("")).isin(NO_ID), F.col("message_id")))
    known = old.select("draft_key", F.col("message_id").alias("_m"), F.col("status").alias("_s"))
    j = n.join(known, "draft_key", "left")
    if j.where("_m <> '' and message_id is not null and _m <> message_id").take(1):
        raise ValueError("a draft has another message id")
    settled = F.coalesce(F.col("_s").isin(SETTLED) & F.col("status").isin(UNSETTLED), F.lit(False))
    return keyed_state_merge(old, j.withColumn("status", F.when(~settled, F.col("status"))).select(*new.columns), ["draft_key"]), revision + 1


def state_validate(state: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, rule_id): missing keys and required values, repeated keys."""
    n = state.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    rules = [F.when(F.col(key).isNull(), "missing_key"), F.when(F.col("_n") > 1, "duplicate_key"), *[F.when(F.col(c).isNull(), f"missing:{c}") for c in required]]
    return n.select(key, F.explode(F.array_compact(F.array(*rules))).alias("rule_id")).distinct()


def required_minus_present(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def candidate_gate(c: DataFrame, threshold: Column, adjacent: str = "review") -> DataFrame:
    """Ordered decision include / watch / review / reject with its reason code, the first that applies.

    c: forbidden, ambiguous, required, exposed (a product or URL is there) as booleans, relevance_level (direct, adjacent,
    exploratory; anything else is none), volume. An unknown volume is not taken for a low one: a person decides.
    """
    r = lambda d, why: F.struct(F.lit(d).alias("decision"), F.lit(why).alias("reason"))
    is_ = lambda x: F.coalesce(F.col(x), F.lit(False))
    level, low = F.coalesce("relevance_level", F.lit("none")), F.col("volume") < threshold
    pick = (
        F.when(is_("forbidden"), r("reject", "FORBIDDEN_THEME"))
        .when(is_("ambiguous"), r("reject", "AMBIGUOUS_MEANING"))
        .when(~level.isin("direct", "adjacent", "exploratory"), r("reject", "NO_PRODUCT_FIT"))
        .when(level == "exploratory", r("review", "EXPLORATORY_FIT"))
        .when(F.col("volume").isNull(), r("review", "MANUAL_APPROVAL"))
        .when(low & is_("required"), r("watch", "REQUIRED_BELOW_THRESHOLD"))
        .when(low & is_("exposed"), r("watch", "EXISTING_EXPOSURE_BELOW_THRESHOLD"))
        .when(low, r("reject", "BELOW_VOLUME_THRESHOLD"))
        .when(level == "direct", r("include", "DIRECT_PRODUCT_FIT"))
        .otherwise(r(adjacent, "ADJACENT_PRODUCT_FIT"))
    )
    return c.withColumn("_d", pick).select(*c.columns, "_d.*")


def cluster_key(c: DataFrame, registry: DataFrame) -> DataFrame:
    """cluster_id {entity}__{intent}__{job}; an id that the registry has for these stays."""
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    keys = ["entity", "intent", "job"]
    made = F.concat_ws("__", *[slug(F.col(k)) for k in keys])
    return c.join(registry.select(*keys, F.col("cluster_id").alias("_old")), keys, "left").select(*c.columns, F.coalesce("_old", made).alias("cluster_id"))


def coverage_action(coverage: Column, intent: Column, decision: Column, signal: Column | None = None) -> Column:
    """What to do about a cluster: nothing before a person confirmed a review; an offer in decline is checked; gaps by intent."""
    informational = F.coalesce(intent.startswith("informational"), F.lit(False))
    falling = F.lit(False) if signal is None else F.coalesce(signal.isin(FALLING), F.lit(False))
    offered = F.coalesce(coverage.isin("partial", "covered_product", "covered_content", "covered"), F.lit(False))
    return (
        F.when(decision == "review", "confirm_by_person")
        .when(decision == "reject", "none")
        .when(falling & offered, "check_wording_sales_margin_visibility")
        .when((coverage == "gap") & informational, "article_faq_or_hub")
        .when(coverage == "gap", "check_economics_then_landing")
        .when(coverage == "partial", "update_page")
        .when(coverage == "covered_product", "supporting_content_and_links")
        .otherwise("none")
    )


#: States of a client, eligibility, and where a client may be sent.
ROUTES = [
    ("ACTIVE", "NO", "ACTIVE_CLIENT"),
    ("PROSPECT_ONLY", "NO", "PROSPECT_SALES"),
    ("PROSPECT_ONLY", "NO", "CLOSE"),
    ("UNKNOWN", "HUMAN_REVIEW", "HUMAN_REVIEW"),
    ("CONFLICT", "HUMAN_REVIEW", "HUMAN_REVIEW"),
    *[(s, e, r) for s in ("DORMANT", "LOST", "COMPLETED") for e, r in (("YES", "OPPORTUNITY"), ("YES", "REACTIVATION"), ("NO", "CLOSE"), ("HUMAN_REVIEW", "HUMAN_REVIEW"))],
]
RESULTS = ["PASS", "PASS_WITH_GAPS", "HUMAN_REVIEW", "FAIL"]


def client_route_check(clients: DataFrame, routes: list[tuple[str, str, str]] = ROUTES) -> DataFrame:
    """(client_id, rule_id) of clients(client_id, state, eligibility, route, result, iterations, decisive_gap, decisive_conflict,
    restricted, stop_status, stop_evidence): an allowed triple or a full human review, no automatic way after a review or a
    failure, nothing decisive open in a pass, no automatic yes against a restriction, a reason with evidence."""
    ok = clients.sparkSession.createDataFrame(routes, "state string, eligibility string, route string").withColumn("_ok", F.lit(True))
    known = ok.select("state").distinct().withColumn("_state", F.lit(True))
    c = clients.join(F.broadcast(ok), ["state", "eligibility", "route"], "left").join(F.broadcast(known), "state", "left")
    result, review = F.coalesce("result", F.lit("")), F.lit("HUMAN_REVIEW")
    override = (result == review) & (F.col("eligibility") == review) & (F.col("route") == review)
    open_ = F.col("state").isin("UNKNOWN", "CONFLICT") | (F.col("eligibility") == review) | F.coalesce("decisive_gap", F.lit(False)) | F.coalesce("decisive_conflict", F.lit(False))
    stop = F.coalesce("stop_status", F.lit(""))
    rules = [
        F.when(~result.isin(RESULTS), "result_unknown"),
        F.when(~F.coalesce(F.col("iterations").between(0, 8), F.lit(False)), "iterations_above_limit"),
        F.when(F.col("_state").isNull() | (~F.coalesce(override, F.lit(False)) & F.col("_ok").isNull()), "route_not_allowed"),
        F.when(result.isin("HUMAN_REVIEW", "FAIL") & ~F.coalesce(F.col("route") == review, F.lit(False)), "automatic_route_after_review"),
        F.when(result.isin("PASS", "PASS_WITH_GAPS") & F.coalesce(open_, F.lit(False)), "decisive_uncertainty_passed"),
        F.when((F.col("eligibility") == "YES") & F.coalesce("restricted", F.lit(False)), "restriction_needs_review"),
        F.when(~stop.isin("CONFIRMED", "UNKNOWN", "CONFLICT", "NOT_APPLICABLE"), "stop_reason_unknown"),
        F.when((stop == "CONFIRMED") & (F.coalesce("stop_evidence", F.lit(0)) == 0), "stop_reason_without_evidence"),
    ]
    return c.select("client_id", F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


#: Loop, measured event, least value, decision, days to decide. Counts count from 1; ratios are new to old.
TRIGGERS = [
    ("S1", "home_win", 1.0, "review_participation_and_loss", 5),
    ("S1", "wins_in_a_row", 2.0, "check_relationship_not_only_price", 3),
    ("S1", "purchase_outside_registry", 1.0, "count_blind_spot", 0),
    ("S2", "reply_speed_ratio", 2.0, "measure_own_turnaround", 10),
    ("S2", "only_competitor_gives_terms", 1.0, "rules_data_authority", 10),
    ("S2", "rejected_assortment_added", 1.0, "purchase_or_reasoned_refusal", 10),
    ("S3", "new_numeric_promise", 1.0, "compare_offer_and_battlecard", 10),
    ("S4", "new_promotion", 1.0, "mechanics_and_need_to_answer", 10),
    ("S4", "event_case_or_landing", 1.0, "decide_before_event", 10),
    ("S4", "frequency_ratio", 2.0, "transferability_or_measurement_fault", 30),
    ("S5", "new_capacity_product_contract", 1.0, "strategic_step", 5),
    ("S5", "negative_mention", 1.0, "facts_and_answer", 2),
    ("S5", "press_covers_competitors", 1.0, "expert_pr_plan", 30),
    ("S6", "rating_change", 0.3, "read_reviews_check_cause", 10),
    ("S6", "same_complaint_in_a_row", 3.0, "operational_cause", 5),
    ("S6", "new_home_location", 1.0, "effect_on_segment", 10),
    ("S0", "competitor_loss_share", 0.3, "proposal_and_battlecard", 5),
    ("S0", "reason_loss_share", 0.4, "internal_commercial_task", 30),
]


def competitor_triggers(deltas: DataFrame, rules: list[tuple[str, str, float, str, int]] = TRIGGERS) -> DataFrame:
    """(company, loop, event, value, decision, deadline_days) where a measured event reaches its rule's value; a reply has to be
    more than twice as fast, a ratio below 1 is taken as its inverse."""
    r = deltas.sparkSession.createDataFrame(rules, "loop string, event string, least double, decision string, deadline_days int")
    size = F.when(F.col("event").endswith("_ratio") & F.col("value").between(1e-12, 1.0), 1 / F.col("value")).otherwise(F.abs("value"))
    hit = F.when(F.col("event") == "reply_speed_ratio", size > F.col("least")).otherwise(F.round(size, 9) >= F.col("least"))
    return deltas.join(F.broadcast(r), "event").where(hit).select("company", "loop", "event", "value", "decision", "deadline_days")


def decisions_on_time(triggers: DataFrame, least: float = 0.7) -> DataFrame:
    """Months with under 70 per cent decided in time, after another such month."""
    m = triggers.groupBy("month").agg(F.avg((F.coalesce(F.col("decided") <= F.col("due"), F.lit(False))).cast("int")).alias("share"))
    m = m.withColumn("_p", F.lag("share").over(Window.orderBy("month")))
    return m.where((F.col("share") < least) & (F.col("_p") < least)).select("month", "share")


def funnel_graph_rules(stages: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rule_id): links to stages that do not exist; a readiness gap must be null where a link is complete."""
    s = stages.select(F.col("stage_id"))
    lost = links.join(s.withColumnRenamed("stage_id", "to_stage"), "to_stage", "left_anti").select(F.col("link_id").alias("id"), F.lit("unknown_stage").alias("rule_id"))
    gap = links.where("complete and readiness_gap is not null").select(F.col("link_id").alias("id"), F.lit("gap_on_complete_link").alias("rule_id"))
    return lost.unionByName(gap)


def third_party_audit_check(external: DataFrame, own: DataFrame) -> DataFrame:
    """(url, check, status) of imported findings against our own: confirmed, false_positive, insufficient_evidence, out_of_scope."""
    j = external.select("url", "check", F.col("claim").alias("_c")).join(own.select("url", "check", "value"), ["url", "check"], "full")
    return j.select("url", "check", F.when(F.col("_c").isNull(), "out_of_scope").when(F.col("value").isNull(), "insufficient_evidence").when(F.col("_c") == F.col("value"), "confirmed").otherwise("false_positive").alias("status"))


def nap_consistency(listings: DataFrame) -> DataFrame:
    """Entities with more than one name, address or phone over directories, signs and case ignored."""
    n = lambda c: F.count_distinct(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")).alias(c)
    return listings.groupBy("entity").agg(n("name"), n("address"), n("phone")).where("name > 1 or address > 1 or phone > 1")


def web_vitals_band(vitals: DataFrame) -> DataFrame:
    """75th percentile of each measure per host, and whether all are good."""
    limit = {"lcp": 2.5, "inp": 200.0, "cls": 0.1, "ttfb": 600.0}
    g = vitals.groupBy("host").agg(*[F.expr(f"percentile({m}, 0.75)").alias(m) for m in limit])
    return g.withColumn("good", reduce(lambda a, b: a & b, [F.col(m) < v for m, v in limit.items()]))


#: States of a source that ask for it again, windows that are not final, states of an experiment that is open.
GAPS, EARLY, OPEN = ["missing", "partial"], ["D+1", "D+3"], ["planned", "running", "awaiting_result"]


def refresh_plan(baselines: DataFrame, campaigns: DataFrame, demand: DataFrame, experiments: DataFrame, drafts: DataFrame, as_of: str) -> DataFrame:
    """(kind, id, detail, age_days) of what is to be fetched or known before the next run:

    source_gap: each source of a baseline or campaign that is missing or partial, with its state; mature_campaign: campaigns last
    seen at D+1 or D+3 that were sent 7 days ago or earlier; demand_refresh: phrase and region observed 28 days ago or earlier;
    previous_experiment: the last open one, by its position; known_draft: keys of drafts that exist.

    baselines: snapshot_id, source_status (map). campaigns: campaign_id, observation_window, sent_at, source_status. demand: phrase,
    region, observed_at. experiments: experiment_id, status, position. drafts: draft_key.
    """
    now = F.lit(as_of).cast("timestamp")
    age = lambda c: F.round((F.unix_micros(now) - F.unix_micros(F.col(c).cast("timestamp"))) / 86_400_000_000, 2)
    row = lambda d, kind, i, detail, old=None: d.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), detail.cast("string").alias("detail"), (age(old) if old else F.lit(None).cast("double")).alias("age_days"))
    states = lambda d, i: d.select(F.col(i).alias("id"), F.explode("source_status").alias("source", "state")).where(F.col("state").isin(GAPS))
    gaps = states(baselines, "snapshot_id").unionByName(states(campaigns, "campaign_id"))
    days = lambda c, n: F.unix_micros(now) - F.unix_micros(F.col(c).cast("timestamp")) >= n * 86_400_000_000
    last = experiments.where(F.col("status").isin(OPEN)).agg(F.max_by("experiment_id", "position").alias("id"), F.max_by("status", "position").alias("status")).where("id is not null")
    out = row(gaps, "source_gap", "id", F.concat_ws(":", "source", "state"))
    out = out.unionByName(row(campaigns.where(F.col("observation_window").isin(EARLY) & days("sent_at", 7)), "mature_campaign", "campaign_id", F.lit("D+7"), "sent_at"))
    out = out.unionByName(row(demand.where(days("observed_at", 28)), "demand_refresh", "phrase", F.col("region"), "observed_at"))
    return out.unionByName(row(last, "previous_experiment", "id", F.col("status"))).unionByName(row(drafts, "known_draft", "draft_key", F.lit(None)))


#: The lists of a pipeline state and what names an item of each.
LIST_KEYS = {
    "baseline_snapshots": ["snapshot_id"],
    "campaign_observations": ["campaign_id", "observation_window", "as_of"],
    "link_snapshots": ["snapshot_id"],
    "web_analytics_snapshots": ["snapshot_id"],
    "crm_snapshots": ["snapshot_id"],
    "wordstat_observations": ["phrase", "region", "observed_at"],
    "content_registry": ["canonical_url"],
    "recommendations": ["recommendation_id"],
    "experiments": ["experiment_id"],
    "draft_registry": ["draft_key"],
    "run_history": ["run_id"],
}


def state_lists_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """All lists of a state at once: items (list, item: map of field to text) of old and new, merged by the key fields of their
    list. A field that new does not have, or has as null, keeps what is stored; the draft registry has rules of its own, see
    draft_state_merge. Unknown lists, items without a key field and repeated keys of one side are errors.
    """
    names = F.create_map(*[x for name, fields in LIST_KEYS.items() for x in (F.lit(name), F.array(*map(F.lit, fields)))])

    def keyed(d: DataFrame, side: str) -> DataFrame:
        fields = F.transform(F.try_element_at(names, F.col("list")), lambda f: F.try_element_at(F.col("item"), f))
        k = landed(d.select("list", fields.alias("key"), F.map_filter("item", lambda _, x: x.isNotNull()).alias("item")), f"state-{side}")
        if k.where(F.col("key").isNull() | F.exists("key", lambda x: x.isNull())).take(1):
            raise ValueError(f"{side}: an unknown list, or an item without its key")
        if k.groupBy("list", "key").count().where("count > 1").take(1):
            raise ValueError(f"{side}: repeated keys")
        return k.select("list", "key", F.col("item").alias(side))

    both = keyed(old, "old").join(keyed(new, "new"), ["list", "key"], "full")
    draft, field = F.col("list") == "draft_registry", lambda side, f: F.try_element_at(F.col(side), F.lit(f))
    blank = F.lower(F.trim(field("new", "message_id"))).isin(NO_ID)
    kept_id = draft & field("old", "message_id").isNotNull() & (field("old", "message_id") != "") & F.coalesce(blank, F.lit(True))
    clash = draft & (field("old", "message_id") != "") & ~F.coalesce(blank, F.lit(True)) & (field("old", "message_id") != field("new", "message_id"))
    if both.where(clash).take(1):
        raise ValueError("a draft has two message ids")
    kept_state = draft & field("old", "status").isin(SETTLED) & field("new", "status").isin(UNSETTLED)
    counts = lambda f: ~(F.coalesce(kept_id, F.lit(False)) & (f == "message_id")) & ~(F.coalesce(kept_state, F.lit(False)) & (f == "status"))
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("new", none), lambda f, _: counts(f))
    stays = F.map_filter(F.coalesce("old", none), lambda f, _: ~F.map_contains_key(fresh, f))
    return both.select("list", "key", F.map_concat(stays, fresh).alias("item"))

