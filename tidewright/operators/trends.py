"""Monthly demand per cluster: quality flags, changes, seasonal adjustment, robust slope, confidence, signal, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.expr import clamp, pct_change
from tidewright.functions.storage import landed

POSITIVE, NEGATIVE = ["breakout", "emerging", "rapid_growth", "growing"], ["declining", "structural_decline"]
#: Weight of a cluster's coverage state.
COVERAGE = {"gap": 1.0, "partial": 0.8, "covered_content": 0.45, "covered_product": 0.55, "irrelevant": 0.0}


def scan_cluster_series(clusters: DataFrame) -> DataFrame:
    """clusters(cluster_id, series array<struct<date, value, complete>>) -> (cluster_id, month, value, complete), bad rows dropped."""
    rows = clusters.select("cluster_id", F.explode("series").alias("p"))
    month = F.try_to_date(F.col("p.date"), "yyyy-MM")
    return rows.select("cluster_id", month.alias("month"), F.col("p.value").cast("string").try_cast("double").alias("value"), F.col("p.complete").alias("complete")).where("month is not null and value >= 0")


def _months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def series_gap_check(series: DataFrame, run_at: str | None = None) -> DataFrame:
    """(cluster_id, flags): sorted quality flags of each series; series has cluster_id, month, value and maybe complete."""
    w = Window.partitionBy("cluster_id").orderBy("month")
    s = series.withColumn("_lag", F.lag("month").over(w))
    gap = F.when(_months(F.col("_lag"), F.col("month")) > 1, "non_contiguous_history")
    twice = F.when(F.col("_lag") == F.col("month"), "duplicate_month")
    below = F.when(F.col("value") < 0, "negative_value")
    part = F.when(~F.col("complete"), "incomplete_month") if "complete" in series.columns else F.lit(None).cast("string")
    now = F.when(F.trunc(F.lit(run_at).cast("date"), "month") == F.col("month"), "possibly_incomplete_current_month") if run_at else F.lit(None).cast("string")
    return s.select("cluster_id", F.array_compact(F.array(gap, twice, below, part, now)).alias("f")).groupBy("cluster_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("flags"))


def placed(series: DataFrame) -> DataFrame:
    """Valid points with their place from the start (rn) and from the end (rd), and the number of points."""
    w = Window.partitionBy("cluster_id")
    s = series.where("value >= 0").select("cluster_id", "month", "value")
    return s.withColumn("rn", F.row_number().over(w.orderBy("month"))).withColumn("n", F.count("*").over(w)).withColumn("rd", F.col("n") - F.col("rn") + 1)


def trend_changes(series: DataFrame) -> DataFrame:
    """Mean of the last three months, of the three before, and of the same three a year before, with the changes."""
    s = placed(series)
    mean = lambda a, b: F.avg(F.when(F.col("rd").between(a, b), F.col("value")))
    g = s.groupBy("cluster_id").agg(F.max("n").alias("months"), F.count_if(F.col("value") > 0).alias("active_months"), mean(1, 3).alias("current_3m_avg"), mean(4, 6).alias("previous_3m_avg"), mean(13, 15).alias("_year"), mean(25, 27).alias("two_years_ago"))
    return g.withColumn("period", pct_change("current_3m_avg", "previous_3m_avg")).withColumn("yoy", F.when(F.col("months") >= 15, pct_change("current_3m_avg", "_year"))).drop("_year")


def seasonal_adjust(series: DataFrame) -> DataFrame:
    """(cluster_id, month, value, rd, n, adjusted, method): value by month index where 24 active months without gaps and no
    one-way series allow one; an index is the median over years of value by its year's median, held in .25 to 4."""
    s = placed(series)
    w = Window.partitionBy("cluster_id").orderBy("month")
    s = s.withColumn("_prev", F.lag("value").over(w)).withColumn("_pm", F.lag("month").over(w))
    kind = s.groupBy("cluster_id").agg(F.count_if(F.col("value") > 0).alias("_active"), F.coalesce(F.bool_or(_months(F.col("_pm"), F.col("month")) > 1), F.lit(False)).alias("_gap"), F.coalesce(F.bool_and(F.col("value") >= F.col("_prev")), F.lit(True)).alias("_up"), F.coalesce(F.bool_and(F.col("value") <= F.col("_prev")), F.lit(True)).alias("_down"))
    kind = kind.select("cluster_id", F.when((F.col("_active") < 24) | F.col("_gap"), "none").when(F.col("_up") | F.col("_down"), "none_monotonic").otherwise("median_seasonal").alias("method"))
    year = s.groupBy("cluster_id", F.year("month").alias("y")).agg(F.median("value").alias("ym")).withColumn("ym", F.when(F.col("ym") == 0, 1.0).otherwise(F.col("ym")))
    index = s.withColumn("y", F.year("month")).join(year, ["cluster_id", "y"]).groupBy("cluster_id", F.month("month").alias("m")).agg(clamp(F.median(F.col("value") / F.col("ym")), 0.25, 4.0).alias("index"))
    out = s.withColumn("m", F.month("month")).join(index, ["cluster_id", "m"]).join(kind, "cluster_id")
    return out.select("cluster_id", "month", "value", "rd", "n", F.when(F.col("method") == "median_seasonal", F.col("value") / F.col("index")).otherwise(F.col("value")).alias("adjusted"), "method")


def theil_sen_slope(adjusted: DataFrame, points: int = 6) -> DataFrame:
    """(cluster_id, slope): median slope over pairs of the last points, in per cent of their mean."""
    last = adjusted.where(F.col("rd") <= points).select("cluster_id", F.col("rd").alias("i"), F.col("adjusted").alias("a"))
    pairs = last.join(last.select("cluster_id", F.col("i").alias("j"), F.col("a").alias("b")), "cluster_id").where("i > j")  # six rows to a cluster
    slope = pairs.groupBy("cluster_id").agg(F.median((F.col("b") - F.col("a")) / (F.col("i") - F.col("j"))).alias("_s"))
    mean = last.groupBy("cluster_id").agg(F.avg("a").alias("_m"))
    return slope.join(mean, "cluster_id").select("cluster_id", (F.col("_s") / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m")) * 100).alias("slope"))


def momentum_persistence(adjusted: DataFrame) -> DataFrame:
    """Moves beyond 3 per cent up and down among the last three steps."""
    a = adjusted.withColumn("_p", F.lag("adjusted").over(Window.partitionBy("cluster_id").orderBy("month"))).where("rd <= 3")
    move = pct_change("adjusted", "_p")
    return a.groupBy("cluster_id").agg(F.count_if(move > 3).alias("persistence_up"), F.count_if(move < -3).alias("persistence_down"))


def direction_agreement(period: Column, yoy: Column, slope: Column) -> Column:
    """Largest share of one sign among the known changes, +-3 being flat."""
    known = F.array_compact(F.array(period, yoy, slope))
    sign = lambda x: F.when(x > 3, 1).when(x < -3, -1).otherwise(0)
    n = lambda k: F.size(F.filter(known, lambda x: sign(x) == k))
    return F.when(F.size(known) > 0, F.greatest(n(1), n(-1), n(0)) / F.size(known)).otherwise(0.0)


def trend_frame(series: DataFrame, min_volume: float = 30.0, run_at: str | None = None) -> DataFrame:
    """One row per cluster with everything that the signal needs."""
    series = landed(series, "series")  # it is read by each of the parts
    adj, change = seasonal_adjust(series), trend_changes(series)
    spread = adj.groupBy("cluster_id").agg(F.avg("adjusted").alias("_mean"), F.stddev_pop("adjusted").alias("_sd"), F.max("method").alias("method"))
    f = change.join(theil_sen_slope(adj), "cluster_id", "left").join(momentum_persistence(adj), "cluster_id", "left").join(spread, "cluster_id").join(series_gap_check(series, run_at), "cluster_id", "left")
    f = f.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("agreement", direction_agreement(F.col("period"), F.col("yoy"), F.col("slope")))
    history = clamp((F.col("active_months") - 6) / 18, 0, 1)
    volume = clamp(F.log1p("current_3m_avg") / F.log1p(F.lit(float(max(min_volume * 10, 10)))), 0, 1)
    volatility = F.when(F.col("months") > 1, F.col("_sd") / F.when(F.col("_mean") == 0, 1.0).otherwise(F.col("_mean"))).otherwise(1.0)
    score = 0.30 * history + 0.25 * volume + 0.30 * F.col("agreement") + 0.15 * (1 - clamp(volatility / 1.5, 0, 1)) - F.least(F.lit(0.25), 0.05 * F.size("flags"))
    conf = clamp(score, 0, 1)
    f = f.withColumn("confidence", F.when(F.col("active_months") < 18, F.least(conf, F.lit(0.55))).otherwise(conf))
    return f.withColumn("eligible", (F.col("active_months") >= 24) & ~F.array_contains("flags", "non_contiguous_history")).drop("_mean", "_sd")


def trend_signal(frame: DataFrame, min_volume: float = 30.0) -> DataFrame:
    """The ordered decision over trend_frame, with new_demand and structural_decline."""
    c = F.col
    no = F.lit(False)
    is_ = lambda x: F.coalesce(x, no)
    new = (c("previous_3m_avg") <= max(1.0, min_volume * 0.05)) & (c("current_3m_avg") >= min_volume)
    season = c("eligible") & is_(F.abs("period") >= 20) & is_(F.abs("yoy") < 15) & (F.abs("slope") < 2)
    decline = is_(c("yoy") <= -20) & (c("slope") <= -1) & (c("months") >= 27) & is_(c("current_3m_avg") < c("two_years_ago"))
    count = lambda *xs: sum((is_(x).cast("int") for x in xs), F.lit(0))
    up = count(c("period") >= 10, c("yoy") >= 20, c("slope") >= 1, c("persistence_up") >= 2)
    down = count(c("period") <= -10, c("yoy") <= -20, c("slope") <= -1, c("persistence_down") >= 2)
    sure = (
        F.when(is_(c("period") >= 30) & is_(c("yoy") >= 100), "rapid_growth")
        .when(decline, "structural_decline")
        .when((up >= 2) & is_(c("yoy") >= 20), "growing")
        .when((down >= 2) & is_(c("yoy") <= -20) & (c("period").isNull() | (c("period") <= 3)) & (c("slope") <= 0), "declining")
        .when(F.greatest(up, down) >= 2, "watch")
        .otherwise("stable")
    )
    signal = (
        F.when(c("months") < 6, "insufficient_data")
        .when((c("confidence") < 0.45) | (c("current_3m_avg") < min_volume), "watch")
        .when(season, F.when(c("period") > 0, "seasonal_rise").otherwise("seasonal_fall"))
        .when(new, "breakout")
        .when(is_(c("period") > 5000) & (c("confidence") >= 0.55), "breakout")
        .when((c("active_months") < 18) & is_(c("period") >= 50), "emerging")
        .when(c("active_months") < 18, "watch")
        .when(c("confidence") >= 0.60, sure)
        .otherwise("stable")
    )
    return frame.withColumn("new_demand", is_(new)).withColumn("structural_decline", decline).withColumn("signal", signal)


def opportunity_score(signals: DataFrame, min_volume: float = 30.0) -> DataFrame:
    """100 x strength x relevance x coverage x confidence x volume, and the direction; needs business_relevance, coverage_status."""
    c = F.col
    strength = clamp(F.greatest(F.abs(F.coalesce("period", F.lit(0.0))), F.abs(F.coalesce("yoy", F.lit(0.0))), F.abs(c("slope") * 6)) / 100, 0, 1)
    status = F.coalesce("coverage_status", F.lit("gap"))
    weight = F.lit(0.5)
    for k, w in COVERAGE.items():
        weight = F.when(status == k, w).otherwise(weight)
    weight = F.when(c("signal").isin(NEGATIVE) & status.isin("covered_product", "covered_content", "partial"), 1.0).otherwise(weight)
    volume = clamp(F.log1p("current_3m_avg") / F.log1p(F.lit(float(max(min_volume * 100, 100)))), 0, 1)
    score = 100 * strength * clamp(F.coalesce("business_relevance", F.lit(0.5)), 0, 1) * weight * c("confidence") * volume
    direction = F.when(c("confidence") < 0.55, "unknown").when(c("slope") >= 1, "up").when(c("slope") <= -1, "down").otherwise("flat")
    return signals.withColumn("opportunity_score", score).withColumn("direction", direction)


def top_and_rising(changes: DataFrame, n: int = 5) -> DataFrame:
    """Most popular and fastest growing clusters as two lists; growth above 5000 per cent is marked breakout."""
    pop = changes.orderBy(F.col("current_3m_avg").desc(), "cluster_id").limit(n).withColumn("list", F.lit("top"))
    rise = changes.where("period > 0").orderBy(F.col("period").desc(), "cluster_id").limit(n).withColumn("list", F.lit("rising"))
    return pop.unionByName(rise).select("list", "cluster_id", "current_3m_avg", "period", F.coalesce(F.col("period") > 5000, F.lit(False)).alias("breakout"))


def trend_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each cluster against the run before; both have cluster_id, signal, slope, current_3m_avg, current new_demand."""
    old = previous.select("cluster_id", F.col("signal").alias("_sig"), F.coalesce("slope", F.lit(0.0)).alias("_slope"), F.coalesce("current_3m_avg", F.lit(0.0)).alias("_avg"))
    c, slope, avg = F.col, F.coalesce("slope", F.lit(0.0)), F.coalesce("current_3m_avg", F.lit(0.0))
    fresh = F.when(c("new_demand"), "new_demand").when(c("signal").isin(POSITIVE), "new_growth").when(c("signal").isin(NEGATIVE), "new_decline").otherwise("new_cluster")
    known = (
        F.when(~c("_sig").isin(POSITIVE) & c("signal").isin(POSITIVE), "new_growth")
        .when(~c("_sig").isin(NEGATIVE) & c("signal").isin(NEGATIVE), "new_decline")
        .when(c("_sig").isin(NEGATIVE) & (c("signal") == "stable"), "recovered")
        .when((c("_avg") >= avg * 3) & (avg > 0), "lost_materiality")
        .when(slope >= c("_slope") + 2, "accelerating")
        .when(slope <= c("_slope") - 2, "decelerating")
        .otherwise("unchanged")
    )
    return current.join(old, "cluster_id", "left").select("cluster_id", "signal", F.when(c("_sig").isNull(), fresh).otherwise(known).alias("delta"))


def store_observations(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key; rows without a date or a value are skipped."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.where("month is not null and value is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
