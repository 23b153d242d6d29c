"""Landed exports as typed tables, and tables that grow by keys or days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.expr import strict_number
from tidewright.functions.storage import landed
from tidewright.sources.parted import PartedTable


def scan_tsv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated report with a header; blank lines are dropped, a file without rows is empty."""
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, mode="PERMISSIVE")
    return rows.dropna(how="all")


def parse_ledger(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (value) that are not blank."""
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def scan_jsonl_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_ledger(spark.read.text(path), schema)


def scan_named_metrics(payloads: DataFrame, body: str = "value") -> DataFrame:
    """Payloads {query: {dimensions, metrics}, data: [{dimensions: [{name}], metrics}]} -> one map of named values per row;
    a missing name becomes dimension_i or metric_i."""
    p = payloads.select(F.from_json(body, "query struct<dimensions: array<string>, metrics: array<string>>, data array<struct<dimensions: array<struct<name: string>>, metrics: array<double>>>").alias("p"))
    rows = p.select("p.query", F.explode("p.data").alias("d"))
    name = lambda names, kind: lambda x, i: F.coalesce(F.get(names, i), F.concat(F.lit(f"{kind}_"), i.cast("string")))
    dims = F.map_from_arrays(F.transform("d.dimensions", name(F.col("query.dimensions"), "dimension")), F.col("d.dimensions.name"))
    mets = F.map_from_arrays(F.transform("d.metrics", name(F.col("query.metrics"), "metric")), F.col("d.metrics"))
    return rows.select(dims.alias("dimensions"), mets.alias("metrics"))


#: Header names of each column, English and Russian.
ALIASES = {"query": ["query", "Query", "запрос", "Запрос"], "url": ["url", "URL", "page", "Страница"], "impressions": ["impressions", "shows", "Показы", "показы"], "clicks": ["clicks", "Клики", "клики"], "position": ["position", "avg_position", "Позиция", "Средняя позиция"]}


def visibility_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of an export whose header may be any alias; metrics must be finite and not below 0."""
    def of(name: str):
        have = [F.col(f"`{a}`").cast("string") for a in ALIASES[name] if a in raw.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    named = raw.select(F.trim(of("query")).alias("query"), F.trim(of("url")).alias("url"), *[strict_number(of(m)).alias(m) for m in ("impressions", "clicks", "position")])
    ok = F.col("query").isNotNull() & (F.col("query") != "") & F.col("impressions").isNotNull() & F.col("clicks").isNotNull() & F.col("position").isNotNull()
    return named.where(ok), named.where(~ok)


def scan_visibility_export(spark: SparkSession, csv: str | None = None, json: str | None = None) -> DataFrame:
    """One of a CSV or a JSON export; an empty one, or one with rejected rows, is an error."""
    if (csv is None) == (json is None):
        raise ValueError("exactly one of csv and json")
    raw = spark.read.csv(csv, header=True) if csv else spark.read.json(json, multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    good, bad = visibility_rows(raw)
    if bad.take(1):
        raise ValueError("the export has rows without a query or with bad metrics")
    if not good.take(1):
        raise ValueError("the export is empty")
    return good


#: Fields of RSS items and Atom entries, whatever their namespace.
FEED_ITEM = "title string, link string, description string, summary string, encoded string, content string, pubDate string, date string, published string, updated string"
FEED_ENTRY = FEED_ITEM.replace("link string", "link array<struct<_href: string, _rel: string>>").replace("content string", "content struct<_VALUE: string>").replace("summary string", "summary struct<_VALUE: string>").replace("title string", "title struct<_VALUE: string>")


def feed_time(text: Column) -> Column:
    """A moment in the form of RSS or of Atom; null if it is neither."""
    rss = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s+", " ")
    rss = F.regexp_replace(rss, r" (GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(rss, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(rss, F.lit("d MMM yyyy HH:mm xx")), text.try_cast("timestamp"))


def scan_feed_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of landed RSS and Atom files; feed is the folder's (`feed=...`) or the file's name without its ending.

    items: feed, pos (order in the file), title, link, summary, published, updated. rejects: feed, reason, item: elements that are no
    well-formed XML, and items without a title or a link. Behind a tag that is not closed nothing of that file can be read. Namespaces
    are ignored; of an Atom entry's links the alternate one counts.
    """
    def rows(tag: str, schema: str) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("attributePrefix", "_").option("columnNameOfCorruptRecord", "_corrupt")
        raw = reader.schema(f"{schema}, _corrupt string").load(path)
        name = F.col("feed").cast("string") if "feed" in raw.columns else F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
        at = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
        return raw.select(name.alias("feed"), at.alias("_at"), *[c for c in raw.columns if c != "feed"])

    atom = rows("entry", FEED_ENTRY)
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    atom = atom.withColumn("link", link).withColumns({c: F.col(c)["_VALUE"] for c in ("title", "summary", "content")})
    both = rows("item", FEED_ITEM).unionByName(atom)
    given = lambda *cs: F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in map(F.col, cs)])
    found = both.select(
        "feed", "_at", "_corrupt", given("title").alias("title"), given("link").alias("link"), given("summary", "description", "content", "encoded").alias("summary"),
        F.coalesce(feed_time(F.col("published")), feed_time(F.col("pubDate")), feed_time(F.col("date"))).alias("published"), feed_time(F.col("updated")).alias("updated"),
    )
    reason = F.when(F.col("_corrupt").isNotNull(), "not_xml").when(F.col("title").isNull(), "no_title").when(F.col("link").isNull(), "no_link")
    judged = landed(found.withColumn("reason", reason), "feed-items")
    good = judged.where("reason is null")
    pos = F.row_number().over(Window.partitionBy("feed").orderBy("_at")) - 1  # items of one file
    item = F.coalesce("_corrupt", F.to_json(F.struct("title", "link", "summary"))).alias("item")
    return good.withColumn("pos", pos).select("feed", "pos", "title", "link", "summary", "published", "updated"), judged.where("reason is not null").select("feed", "reason", item).distinct()


FACT_PARTS = ["source", "scope", "_month"]
DAY = ["source", "scope", "stat_date"]


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def upsert_fact_partition(facts: DataFrame, path: str) -> None:
    """Replace the facts of each (source, scope, stat_date) that facts holds, all days at once; other days stay.

    A day of facts is small, so a part of the table is a month; what is written follows the months that facts touches.
    """
    table = PartedTable(facts.sparkSession, path, FACT_PARTS)
    new = landed(facts.withColumn("_month", _month(F.col("stat_date"))), "facts")
    touched = {tuple(r) for r in new.select(FACT_PARTS).distinct().collect()}  # months
    old = table.read(lambda p: tuple(p) in touched, new.schema).join(new.select(DAY).distinct(), DAY, "left_anti").select(new.columns)
    table.replace(old.unionByName(new))


def load_fact_range(spark: SparkSession, path: str, source: str, scope: str, start: str, end: str) -> DataFrame:
    """Facts of a source and scope in a day range; a missing Date is the day they stand for. Only those months' files are read."""
    f = PartedTable(spark, path, FACT_PARTS).read(lambda p: p[:2] == [source, scope] and start[:7] <= p[2] <= end[:7])
    f = f.where(F.col("stat_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("_month")
    return f.withColumn("Date", F.coalesce("Date", "stat_date")) if "Date" in f.columns else f.withColumn("Date", F.col("stat_date"))


def invalidate_facts(spark: SparkSession, path: str, start: str, end: str, source: str | None = None, scope: str | None = None) -> int:
    """Let the facts of a day range go, all at once; returns how many (source, scope, day) went. Readers that have begun keep them."""
    table = PartedTable(spark, path, FACT_PARTS)
    meant = lambda p: start[:7] <= p[2] <= end[:7] and source in (None, p[0]) and scope in (None, p[1])
    if not any(meant(p["values"]) for p in table.manifest()["parts"].values()):
        return 0
    inside = F.col("stat_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    months = table.read(meant)
    gone = months.where(inside).select(DAY).distinct().count()
    if gone:
        table.commit(table.write(months.where(~inside)), meant)
    return gone
