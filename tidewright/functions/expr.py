"""Column expressions shared by the operators. Null is never zero: what is unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column | str, dashes: bool = False) -> Column:
    """Lenient number: null, blank and unreadable text count 0; with dashes, so does "--"."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    return F.coalesce(F.when(~text.isin("", *(["--"] if dashes else [])), text.try_cast("double")), F.lit(0.0))


def strict_number(c: Column | str, low: float | None = 0.0) -> Column:
    """Number as it stands, or null if it is a boolean's text, blank, not finite or below low."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.trim(c.cast("string")).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(ok & (v >= low) if low is not None else ok, v)


def ratio(a: Column | str, b: Column | str, times: float = 1.0) -> Column:
    """a / b times a factor; null if either is unknown or b is not above 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a * F.lit(float(times)) / b)


def pct_change(new: Column | str, old: Column | str) -> Column:
    """Change in per cent; null if the old value is not above 0."""
    new, old = (F.col(x) if isinstance(x, str) else x for x in (new, old))
    return F.when(old > 0, (new / old - 1) * 100)


def delta_pct(new: Column | str, old: Column | str) -> Column:
    """Change in per cent of the old value's size; null if it is 0 or unknown."""
    new, old = (F.col(x) if isinstance(x, str) else x for x in (new, old))
    return F.when(old != 0, (new - old) / F.abs(old) * 100)


def sum_or_null(c: Column | str) -> Column:
    """Sum that is null if any member is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def normalize_phrase(c: Column | str) -> Column:
    """Lower case, white space collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def normalize_query(c: Column | str) -> Column:
    """Lower case, yo as ye, only Latin and Cyrillic letters and digits, white space collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), "[^a-zа-я0-9]+", " "))


def normalize_title(c: Column | str) -> Column:
    """Lower case without punctuation, white space collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def spaced_title(c: Column | str) -> Column:
    """Lower case with a blank for each punctuation mark, so that a hyphen parts words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


#: Words that carry no topic.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "may", "might", "must", "can", "could", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between",
    "out", "off", "over", "under", "again", "further", "then", "once", "and", "but", "or", "nor", "not", "so", "yet",
    "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "no",
    "only", "own", "same", "than", "too", "very", "just", "how", "what", "which", "who", "whom", "this", "that",
    "these", "those", "it", "its", "new", "says", "said", "about", "up", "now", "also", "get", "gets", "got", "like",
    "make", "makes", "use", "uses", "using", "used", "и", "в", "на", "с", "по", "для", "из", "к", "о", "от", "за",
    "не", "что", "как", "это", "все", "но", "он", "она", "они", "его", "её", "их", "мы", "вы", "был", "была", "были",
    "будет", "уже", "ещё", "при", "до", "после", "между", "через", "над", "под", "без",
]


def keywords(c: Column | str, stop: list[str] | None = None) -> Column:
    """Distinct words of a normalized title without stop words."""
    words = F.filter(F.split(normalize_title(c), " "), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)]))


def short_sha(*parts: Column, bits: int = 256, size: int = 16) -> Column:
    """First hex digits of a digest over parts joined by a vertical bar."""
    text = F.concat_ws("|", *parts)
    return F.substring(F.sha2(text, 256) if bits == 256 else F.sha1(text), 1, size)


#: Parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid"]


def canonical_url(c: Column | str) -> Column:
    """DOI, then arXiv, then the URL: lower scheme (https if none) and host, no port, login, path parameters or fragment, no
    slash at the end, no tracking parameters, rest sorted."""
    c = F.col(c) if isinstance(c, str) else c
    doi = F.regexp_extract(c, r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi:)(10\.\d{4,}/\S+)", 1)
    arxiv = F.regexp_extract(c, r"(?i)(?:https?://arxiv\.org/abs/|arxiv:)(\d{4}\.\d{4,}(?:v\d+)?)", 1)
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#]*@)?([^/?#:]*)(?::[^/?#]*)?)?([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, query = (F.regexp_extract(c, whole, i) for i in (1, 2, 3, 4))
    path = F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+$", "")
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    rest = F.array_join(F.array_sort(pairs), "&")
    front = F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.when(host == "", ":").otherwise(F.concat(F.lit("://"), F.lower(host))))
    url = F.concat(front, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return F.when(doi != "", F.concat(F.lit("doi:"), F.regexp_replace(doi, r"\.+$", ""))).when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).otherwise(url)


def fingerprint(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """(rows, fingerprint) of a table whatever its order: hashes of rows by bucket, sorted and hashed, then the hash of the
    buckets' digests. A bucket is a few digits of the hash, so no task holds more than its share; many equal rows count as
    one hash and their number."""
    one = rows.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in rows.columns]), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    parts = one.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ","), 256).alias("d"), F.sum("n").alias("n"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("b").cast("string"), 8, "0"), "d"))), ","), 256).alias("fingerprint"))
