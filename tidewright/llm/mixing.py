"""Operator 6 [native]: mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each document gets the exponential key -ln(u) / quality, u being a hash of its id, its text and its number among equal
rows, so reruns agree. Within a source, sorted by key, whole epochs come first (every document once, or twice), and the
rest of the target is filled by the documents with the least keys up to its token budget. Sums over a source are taken
over ranges of the key; the one range in which the budget runs out is cut into ranges again until it holds EDGE_ROWS
documents at most, or until its documents have one key, so a source of any size is nobody's single task. The first document that does not fit gives way to
the one of the documents left whose size comes closest to what is left of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_BLANK, keyed_rows, prepare, stage, staged, unstage, unwrapped, word_count

WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Documents of the range in which a source's budget runs out, at most; ranges that are made of one at once, at most.
EDGE_ROWS, RANGES = 500, 4096
#: Parts in which equal rows are numbered, at least, and rows to a part beyond that.
SALTS, PART = 64, 500_000
#: Weights that a caller gives lie between this and its inverse.
LEAST = 1e-9
#: Sources up to this number are sent to all tasks; beyond it they are joined by name.
SMALL = 10_000
#: Likewise for groups of equal rows, and for equal rows.
FEW_EQUAL = 100_000


def quality_weight(text: Column) -> Column:
    """A weight in [.05, 1] of a text: the product of three shares, each high in running prose: letters and plain marks
    among the characters, words of ordinary length among the words, and lines that end a sentence or are long among the
    lines. A text without words has .05."""
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    words = F.regexp_count(text, F.lit(NOT_BLANK))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D.,;:'’?!-]+", ""))
    usual = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[\p{L}'’-]{1,14}+[.,;:?!]?(?![^\x20\x09-\x0D])"))
    ends = F.regexp_count(text, F.lit(r"(?m)(?:[.?!]['\")”’]?|^.{80,}+)\x20*+$"))
    lines = F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*+[^\x20\x09-\x0D]"))
    weight = F.pow(share(plain, F.length(text)), F.lit(4.0)) * share(usual, words) * (0.5 + 0.5 * F.least(share(ends, lines), F.lit(1.0)))
    return F.least(F.greatest(F.coalesce(weight, F.lit(0.05)), F.lit(0.05)), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> with target: weights repeat over the sources in code-point order, null last; share of
    all sizes is dealt by weight, a target stops at most times its source, and the excess is dealt again by weight.

    The end of that dealing is known: with the sources ordered by most * source_size / weight, all before some place
    are full and the rest get one level times their weight. Only one row per source is sorted.
    """
    every = Window.partitionBy()
    rows = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("w", own).withColumn("full", F.col("source_size") * F.lit(float(most))).withColumn("r", F.col("full") / F.col("w"))
    before = Window.orderBy("r", "place").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rows = rows.withColumn("level", budget / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("level") < F.col("r"), F.struct("r", "place", "level"))).over(every)
    return rows.withColumn("first", first).select("source", "source_size", F.least("full", F.coalesce(F.col("first.level") * F.col("w"), F.col("full"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 1, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, th, source, size, source_size, target, epochs, taken): one row per row of docs, th being the text's hash;
    epochs is how often the document is taken, taken = epochs * size.

    A null text has size 0 and adds no words. A null source is a source of its own, the last. Rows that repeat id, text
    and source are numbered and each drawn by its own key; which of them carries which number is not defined. An empty
    table gives no rows; other columns are not read unless weight (a Column over docs) reads them.
    """
    spark = prepare(docs.sparkSession)
    given = F.least(F.greatest(weight.cast("double"), F.lit(LEAST)), F.lit(1 / LEAST)) if weight is not None else quality_weight(F.col(text_col))
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("th"), word_count(F.col(text_col)).alias("size"), F.coalesce(given, F.lit(0.05)).alias("w"))
    first, docs_path = stage(first.select(F.monotonically_increasing_id().alias("uid"), "*"), "mixing-docs")
    numbers = staged(equal_rows(first, ["doc_id", "th", "source"], "uid").select(F.col("uid").alias("_uid"), "number"), "mixing-equal")
    one = F.coalesce("number", F.lit(0).cast("long"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "th", one), 11) + 1) / F.lit(float(2**53 + 1))
    keyed = first.join(F.broadcast(numbers) if numbers.count() <= FEW_EQUAL else numbers, F.col("uid") == F.col("_uid"), "left")
    keyed = staged(keyed.select("uid", "doc_id", "th", one.alias("number"), "source", "size", "w", (-F.log(u) / F.col("w")).alias("key")), "mixing-keyed")
    unstage(spark, docs_path)

    per_source, path = stage(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("w").alias("rate")), "mixing-sources")
    goal = targets(per_source.select("source", "source_size"), weights, share, most)
    goal = goal.join(per_source.select(F.col("source").alias("_s"), "n", "rate"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
    goal = staged(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mixing-targets")
    few = goal.count() <= SMALL
    unstage(spark, path)

    def beside(d: DataFrame, per: DataFrame, *cols: str, how: str = "left") -> DataFrame:
        """d with columns of a table that has one row per source."""
        right = per.select(F.col("source").alias("_s"), *cols)
        return d.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")

    # place rises with the key from 0 to 1, slowly enough that keys of any weight keep places of their own; edge has a row
    # for each source, whose budget runs out between lo and hi
    x = F.col("key") * F.col("rate")
    row = ["uid", "doc_id", "th", "number", "source", "size", "key", "place"]
    placed = beside(keyed, goal, "rate").withColumn("place", x / (1 + x)).select(row)
    edge = goal.where("rest > 0").select("source", "rest", F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).cast("long").alias("before"), "n")
    wide = None
    while True:
        edge = staged(edge, "mixing-edges")
        left = edge.agg(F.sum(F.when(F.col("n") > EDGE_ROWS, F.col("n")))).first()[0]
        if not left or left == wide:
            break
        wide = left
        inside = beside(placed, edge.where(F.col("n") > EDGE_ROWS), "rest", "lo", "hi", "before", "n", how="inner").where("place > lo and place <= hi")
        least, parts = F.greatest("lo", F.lit(0.0)), F.least(F.ceil(F.col("n") * 4 / EDGE_ROWS), F.lit(RANGES))
        at = F.floor(F.coalesce(F.try_divide(F.col("place") - least, F.col("hi") - least), F.lit(0.0)) * parts)
        sums = inside.groupBy("source", F.greatest(F.least(at, parts - 1), F.lit(0)).alias("at")).agg(
            F.sum("size").alias("s"), F.count("*").alias("n"), F.max("place").alias("hi"),
            F.first("rest").alias("rest"), F.first("before").alias("base"), F.first("lo").alias("lo"),
        )
        order = Window.partitionBy("source").orderBy("at")  # RANGES rows at most
        sums = sums.withColumn("before", F.col("base") + F.sum("s").over(order) - F.col("s")).withColumn("lo", F.coalesce(F.lag("hi").over(order), "lo"))
        narrow = sums.where("before <= rest and before + s > rest").select("source", "rest", "lo", "hi", "before", "n")
        edge = edge.where(F.col("n") <= EDGE_ROWS).unionByName(narrow)

    edged = beside(placed, edge.withColumn("is", F.lit(True)), "is", "lo", "hi", "before")
    edged = beside(edged, goal, "source_size", "target", "epochs", "rest")
    now = F.coalesce(F.col("is") & (F.col("place") > F.col("lo")) & (F.col("place") <= F.col("hi")), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "th", "number").rowsBetween(Window.unboundedPreceding, 0)
    inner = edged.where(now).withColumn("upto", F.col("before") + F.sum("size").over(order))
    inner = staged(inner.withColumn("more", (F.col("upto") <= F.col("rest")).cast("int")), "mixing-inner")
    outer = edged.where(~now).withColumn("more", F.when(F.col("is"), (F.col("place") <= F.col("lo")).cast("int")).otherwise((F.col("rest") > 0).cast("int")))
    columns = ["uid", "doc_id", "th", "number", "source", "size", "key", "source_size", "target", "epochs", "more"]
    chosen = outer.select(columns).unionByName(inner.select(columns))

    used = F.greatest(F.max("before"), F.coalesce(F.max(F.when(F.col("more") == 1, F.col("upto"))), F.lit(0)))
    gap = inner.groupBy("source").agg((F.max("rest") - used).alias("gap"))
    left = beside(chosen.where("more = 0 and size > 0"), gap, "gap")
    off = F.abs(F.col("size") - F.col("gap"))
    extra = left.where((off < F.col("gap")) & (F.col("epochs") < int(most))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "th", "number", "uid")).alias("x"))
    extra = staged(extra.select("source", F.col("x.uid").alias("extra")), "mixing-extra")
    times = F.col("epochs") + F.col("more") + F.coalesce((F.col("uid") == F.col("extra")).cast("int"), F.lit(0))
    out = beside(chosen, extra, "extra").select("doc_id", "th", "source", "size", "source_size", "target", times.alias("epochs"))
    return out.withColumn("taken", F.col("epochs") * F.col("size"))


def _alike(same: list[str]) -> Column:
    """The columns `same` equal those of the other side, whose names begin with a bar."""
    out = F.lit(True)
    for c in same:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def equal_rows(rows: DataFrame, same: list[str], uid: str) -> DataFrame:
    """The rows that share all of `same` with another one, with their number among those from 0 on.

    They are numbered in parts, whose counts are added up, so that a third of a table in one group is no one task.
    """
    other = [F.col(c).alias(f"_{c}") for c in same]
    twice = staged(rows.groupBy(*same).agg(F.count("*").alias("_of")).where("_of > 1").select(*other), "mixing-twice")
    again = staged(rows.join(F.broadcast(twice) if twice.count() <= FEW_EQUAL else twice, _alike(same), "left_semi"), "mixing-again")
    again = again.withColumn("_salt", F.pmod(F.xxhash64(uid), F.lit(max(SALTS, again.count() // PART))))
    counts = again.groupBy(*same, "_salt").agg(F.count("*").alias("_m"))
    before = counts.select(*other, F.col("_salt").alias("_part"), (F.sum("_m").over(Window.partitionBy(*same).orderBy("_salt")) - F.col("_m")).alias("_before"))
    ranked = again.withColumn("_rank", F.row_number().over(Window.partitionBy(*same, "_salt").orderBy(uid)))
    ranked = ranked.join(before, _alike(same) & (F.col("_salt") == F.col("_part")))
    return ranked.withColumn("number", F.col("_before") + F.col("_rank") - 1).select(*rows.columns, "number")


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as mixed (of the same docs) takes it, all columns kept.

    Rows of equal id, text and source share their epochs evenly: as many of them as the remainder come once more, so
    that together they come as often as the mix says. No rows give no rows.
    """
    key = ["doc_id", "th", "source"]
    own = keyed_rows(docs, id_col, text_col).withColumn("source", F.col("row")[source_col])
    times = mixed.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.sum("epochs").alias("sum"), F.count("*").alias("of")).where("sum > 0")
    taken = own.join(times, _alike(key)).select("row", *key, "sum", "of")
    out = taken.where("of = 1").select("row", F.col("sum").alias("times"))
    shared = staged(taken.where("of > 1").withColumn("uid", F.monotonically_increasing_id()), "mixing-shared")
    if shared.take(1):
        more = (F.col("number") < F.col("sum") % F.col("of")).cast("long")
        out = out.unionByName(equal_rows(shared, key, "uid").select("row", (F.floor(F.col("sum") / F.col("of")) + more).alias("times")))
    out = out.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return unwrapped(out, docs)
