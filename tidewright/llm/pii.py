"""Operator 5: personal data and the terms that disclose it.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. A term is a word of three
or more letters anywhere in a document that holds an entity. A term is judged against what the entity is known by: the
entity itself, its class (the mail domain, the network, the card issuer, the calling area) and the words of a mail
address before the @. Over the whole corpus, n(c) documents hold c, n(c, t) hold term t as well, and n(t) hold t at all,
of N documents. The share of c's information that the term gives away is

    PMI(c; t) / IC(c) = log(n(c, t) N / (n(c) n(t))) / log(N / n(c)).

A term discloses c if that reaches DISCLOSES and SUPPORT documents hold both; a word of the address itself needs no
support, since it is part of what it discloses. Disclosing terms are spans at all of their places in each document that
holds c. They are generalised to their first STEM letters if words that begin so are common enough to stay below the
threshold whatever they stand with, and else removed. Terms in documents without an entity are left alone.

All counts are of distinct pairs of id and text, so repeated rows count once. An entity that fewer than SUPPORT documents
hold has no counts of its own worth trusting; its class and its address words are what terms are judged by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, stage, staged, unstage

KINDS = ["email", "ip", "card", "phone", "term"]
SUPPORT, DISCLOSES, STEM = 3, 0.8, 3
#: Bits of the filter that holds all candidate terms; a false hit only adds a counted word.
FILTER_BITS = 1 << 24
#: Documents with terms up to this number are sent to all tasks; beyond it they are joined by key.
SMALL = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The same matches as the plain forms, without going back over a long run of digits.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what stands before each @ back to the last match, and a domain with a dot behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term in lower case, start, end) of the words of letters outside all spans."""
    out, inside = [], sorted((s, e) for _, s, e in spans)
    at, upto = 0, 0  # spans that begin before the word; the furthest end of those
    for m in _TERM.finditer(text):
        while at < len(inside) and inside[at][0] < m.end():
            upto = max(upto, inside[at][1])
            at += 1
        if m.start() >= upto:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def known_by(kind: int, entity: str) -> list[str]:
    """What an entity is known by: itself and its class."""
    if kind == 0:
        group = entity.rpartition("@")[2].lower()
    elif kind == 1:
        group = ".".join(entity.split(".")[:2])
    else:
        digits = re.sub("[^0-9]", "", entity)
        group = digits[:6] if kind == 2 else digits[:4]
    return [f"{kind}={entity}", f"{kind}~{group}"]


def own_words(kind: int, entity: str) -> list[str]:
    """The words of a mail address before the @."""
    return [w.lower() for w in _TERM.findall(entity.rpartition("@")[0])] if kind == 0 else []


@lru_cache(maxsize=1 << 17)
def _hash(word: str) -> int:
    """A signed 64-bit hash."""
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return h - (h >> 63 << 64)


_FOUND = "doc_id long, th long, spans array<struct<kind: int, start: long, end: long>>, keys array<long>, names array<long>, terms array<long>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, text) -> _FOUND: spans, hashes of what the entities are known by, of the words of addresses, and
    of all terms of texts that have spans."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        rows = []
        for t in b.column(2):
            text = t.as_py() or ""
            found = base_spans(text)
            own = [(k, text[s:e]) for k, s, e in found]
            keys = {_hash(x) for o in own for x in known_by(*o)}
            names = {_hash(w) for o in own for w in own_words(*o)}
            rows.append(([{"kind": k, "start": s, "end": e} for k, s, e in found], list(keys), list(names), list({_hash(w) for w, _, _ in terms(text, found)}) if found else []))
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate([span, *[pa.list_(pa.int64())] * 3])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "th", "spans", "keys", "names", "terms"])


#: Documents of a key that one task counts the terms of; terms that are added up at once.
TOGETHER, AT_ONCE = 50_000, 1 << 20


def _joint(support: int):
    """Rows (key, part, parts, terms) in order of key and part -> (key, term, n_ct), added up inside the task. A key that has one
    part gives only the terms that enough of its documents hold."""

    def added(terms: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate(terms), return_inverse=True)
        return values, np.bincount(at, np.concatenate(times)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, terms, times, held = None, 1, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            values, n = added(terms, times)
            if parts == 1:
                values, n = values[n >= support], n[n >= support]
            for lo in range(0, len(values), 100_000):
                some = values[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now[0])), pa.array(some), pa.array(n[lo : lo + 100_000])], names=["key", "term", "n_ct"])

        for b in batches:
            for key, part, of, own in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if (key, part) != now:
                    if terms:
                        yield from out()
                    now, parts, terms, times, held = (key, part), of, [], [], 0
                own = own.values.to_numpy()
                terms.append(own)
                times.append(np.ones(len(own), np.int64))
                held += len(own)
                if held > AT_ONCE:
                    one = added(terms, times)
                    terms, times, held = [one[0]], [one[1]], 0
        if terms:
            yield from out()

    return run


def _frequencies(words: dict[int, bytes], cap: int = 200_000):
    """Rows (text, times) -> (term, stem, n): documents of each term whose hash the filter lets pass, with its stem, and of
    each stem (term null), added up in a task as far as memory allows. times is how often a text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, part in words.items():
            bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(part, np.uint8)
        held, stems, known = Counter(), Counter(), {}

        def passes(w: str) -> tuple[int, str] | None:
            at = (h := _hash(w)) % FILTER_BITS
            return (h, w[:STEM]) if bits[at >> 3] >> (at & 7) & 1 else None

        def out() -> pa.RecordBatch:
            names = [*(stem for _, stem in held), *stems]
            return pa.RecordBatch.from_arrays([pa.array([*(h for h, _ in held), *[None] * len(stems)], pa.int64()), pa.array(names, pa.string()), pa.array([*held.values(), *stems.values()], pa.int64())], names=["term", "stem", "n"])

        for b in batches:
            for t, times in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = {w.lower() for w in set(_TERM.findall(t.as_py() or ""))}
                new = [w for w in own if w not in known]
                if len(known) + len(new) > 4 * cap:
                    known, new = {}, list(own)
                known.update((w, passes(w)) for w in new)
                for w in own:
                    if (h := known[w]) is not None:
                        held[h] += times
                for x in {w[:STEM] for w in own}:
                    stems[x] += times
            if len(held) + len(stems) > cap:
                yield out()
                held, stems = Counter(), Counter()
        if held or stems:
            yield out()

    return run


def _repeats(found: DataFrame) -> DataFrame:
    """(doc_id, th, of) of the pairs of id and text that several rows share."""
    return found.groupBy("doc_id", "th").agg(F.count("*").alias("of")).where("of > 1")


def _share(documents: str, n: int) -> Column:
    """The share of a key's information that a term gives away, by n_ct, n_c and the documents of the term."""
    return F.log(F.col("n_ct") * n / (F.col("n_c") * F.col(documents))) / F.log(n / F.col("n_c"))


def disclosures(found: DataFrame, keyed: DataFrame, support: int, discloses: float) -> tuple[DataFrame, DataFrame, int]:
    """(key, term, stem, share) of the terms that disclose what a key stands for; (stem, n), the documents of each stem; and the
    number of documents.

    found has the rows of _FOUND, keyed those of _keyed. Keys of names are those of the terms themselves.
    """
    spark = found.sparkSession
    repeats = staged(_repeats(found), "pii-repeats")
    surplus, n_repeats = repeats.agg(F.sum(F.col("of") - 1), F.count("*")).first()
    n = found.count() - (surplus or 0)
    held = found.where("size(spans) > 0").select("doc_id", "th", "keys", "names", "terms")
    if n_repeats:
        held = held.dropDuplicates(["doc_id", "th"])
    held = staged(held.withColumn("uid", F.monotonically_increasing_id()), "pii-held")
    # rows (key, document) for the keys that enough documents hold; their terms are added up inside tasks, a key of very many
    # documents in parts
    keys = held.select("uid", F.explode("keys").alias("key"))
    n_c = staged(keys.groupBy("key").agg(F.count("*").alias("n_c")).where((F.col("n_c") >= support) & (F.col("n_c") < n)), "pii-keys")
    parts = F.ceil(F.col("n_c") / TOGETHER).cast("int")
    own = keys.join(n_c, "key").join(held.select("uid", "terms"), "uid").select("key", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), parts.alias("parts"), "terms")
    joint = own.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_joint(support), "key long, term long, n_ct long")
    joint = joint.groupBy("key", "term").agg(F.sum("n_ct").alias("n_ct")).where(F.col("n_ct") >= support)
    joint = joint.join(n_c, "key").select("key", "term", "n_ct", "n_c")
    # a term stands in at least as many documents as hold it beside some entity, so this share is an upper bound
    n_h = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_h"))
    joint = joint.join(n_h, "term").where(_share("n_h", n) >= discloses - 1e-6).drop("n_h")
    named = held.select("terms", F.explode("names").alias("key")).withColumn("both", F.array_contains("terms", F.col("key")).cast("long"))
    named = named.groupBy("key").agg(F.sum("both").alias("n_ct"), F.count("*").alias("n_c")).where((F.col("n_ct") > 0) & (F.col("n_c") < n))
    joint, path = stage(joint.unionByName(named.select("key", F.col("key").alias("term"), "n_ct", "n_c")), "pii-joint")
    marks = joint.select(F.pmod("term", F.lit(FILTER_BITS)).alias("at"))
    made = marks.groupBy(F.floor(F.col("at") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    words = {r["bucket"]: bytes(r["bits"]) for r in made.collect()}  # 2 MB at most
    if not words:
        unstage(spark, path)
        return spark.createDataFrame([], "key long, term long, stem string, share double"), spark.createDataFrame([], "stem string, n long"), n
    every = keyed.select("text", F.lit(1).cast("long").alias("times"))
    if n_repeats:  # what the repeated rows count too much
        again = F.broadcast(repeats) if n_repeats <= SMALL else repeats
        again = keyed.join(again.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "of"), keyed.doc_id.eqNullSafe(F.col("_id")) & (keyed.th == F.col("_th")))
        every = every.unionByName(again.dropDuplicates(["doc_id", "th"]).select("text", (1 - F.col("of")).alias("times")))
    counts = every.mapInArrow(_frequencies(words), "term long, stem string, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))
    counts = staged(counts, "pii-frequencies")
    both = joint.join(counts.where("term is not null").select("term", "stem", F.col("n").alias("n_t")), "term")
    shares = both.select("key", "term", "stem", F.round(_share("n_t", n), 9).alias("share")).where(F.col("share") >= discloses)
    return shares, counts.where("term is null").select("stem", "n"), n


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _disclosing(found: DataFrame, keyed: DataFrame, support: int, discloses: float) -> DataFrame:
    """(doc_id, th, hits, kept): hashes of the terms to be taken out of each text, and of those among them whose stem may stay.

    A stem may stay if it is too common to give away the rarest key that has counts, one of `support` documents, even if it
    stood in all of them.
    """
    shares, stems, n = disclosures(found, keyed, support, discloses)
    bound = n * (support / max(n, 1)) ** discloses
    common = stems.where(F.col("n") > bound).select(F.col("stem").alias("_stem"))
    shares = staged(shares.join(common, F.col("stem") == F.col("_stem"), "left").select("key", "term", F.col("_stem").isNotNull().alias("common")), "pii-shares")
    own = found.where("size(spans) > 0").select("doc_id", "th", "terms", F.explode(F.concat("keys", "names")).alias("key"))
    few = shares.count() <= SMALL
    met = own.select("doc_id", "th", "key").distinct().join(F.broadcast(shares) if few else shares, "key")
    return met.groupBy("doc_id", "th").agg(F.collect_set("term").alias("hits"), F.collect_set(F.when(F.col("common"), F.col("term"))).alias("kept"))


def _with_hits(left: DataFrame, hits: DataFrame, how: str = "left") -> DataFrame:
    """left (with doc_id, th) and the hits of its texts; sent to all tasks only if they are few."""
    right = hits.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "hits", "kept")
    if hits.count() <= SMALL:
        right = F.broadcast(right)
    return left.join(right, left.doc_id.eqNullSafe(F.col("_id")) & (left.th == F.col("_th")), how).drop("_id", "_th")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, text, hits) -> the places of the hits."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    term = KINDS.index("term")
    for b in batches:
        out = []
        for t, h in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            text, hits = t.as_py() or "", set(h)
            out.append([{"kind": term, "start": s, "end": e} for w, s, e in terms(text, base_spans(text)) if _hash(w) in hits])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["_id", "_th", "added"])


def scan(docs: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct<kind, start, end> in code points, by kind, then start; spans holds the
    base ones and the disclosing terms.

    A null text is an empty one. Rows that repeat id and text give a row each and count as one document; a null id is
    kept as null. An empty table gives no rows; other columns of docs are not read.
    """
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    found = staged(keyed.mapInArrow(_find, _FOUND), "pii-found")
    hits = staged(_disclosing(found, keyed, support, discloses), "pii-hits")
    texts = _with_hits(keyed, hits, "inner").select("doc_id", "th", "text", "hits").mapInArrow(_places, "_id long, _th long, added array<struct<kind: int, start: long, end: long>>")
    texts = staged(texts.dropDuplicates(["_id", "_th"]), "pii-places")
    right = F.broadcast(texts) if texts.count() <= SMALL else texts
    out = found.select("doc_id", "th", "spans").join(right, found.doc_id.eqNullSafe(F.col("_id")) & (found.th == F.col("_th")), "left")
    added = F.coalesce("added", F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>"))
    return out.select("doc_id", F.col("spans").alias("base"), F.concat("spans", added).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each (start, end, replacement) replaced; overlapping spans become one with the first's replacement."""
    out, at = [], 0
    for start, end, put in sorted(spans):
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, every row and column, with its text sanitised: entities become [EMAIL], [IP], [CARD] or [PHONE]; disclosing
    terms their stem and a star, or nothing where the stem is rare. Texts without spans, nulls included, stay as they are,
    and so do the columns of whatever name and rows that repeat."""
    prepare(docs.sparkSession)
    columns = docs.columns
    keyed = _keyed(docs, id_col, text_col)
    found = staged(keyed.mapInArrow(_find, _FOUND), "pii-found")
    hits = staged(_disclosing(found, keyed, support, discloses), "pii-hits")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"))
    both = _with_hits(held, hits)

    @F.pandas_udf("string")
    def clean(texts, marks, kept):
        def one(text, more, stems):
            if text is None:
                return None
            base = base_spans(text)
            spans = [(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base]
            if more is not None and len(more):
                taken, common = set(map(int, more)), set(map(int, stems))
                spans += [(s, e, f"{text[s : s + STEM]}*" if _hash(w) in common else "") for w, s, e in terms(text, base) if _hash(w) in taken]
            return redact(text, spans) if spans else text

        return pd.Series([one(*x) for x in zip(texts, marks, kept, strict=True)], dtype="object")

    cleaned = both.select("row", clean(F.col("row")[text_col], F.col("hits"), F.col("kept")).alias("_clean"))
    return cleaned.select(*[F.col("_clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
