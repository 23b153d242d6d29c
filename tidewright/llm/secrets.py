"""Operator 1 [native]: secrets by pattern and by a battery of randomness tests; DataFrame functions only.

Patterns give the base spans: credentials that are assigned, access keys, long hex runs. Beside them, every run of 20 or
more characters of [A-Za-z0-9+/_-] is a candidate, with up to two = behind it; one may begin right behind a =. Its
encoding is inferred from the characters it uses (a UUID, digits, hex, base 32 of capital or small letters, base 26, 36,
52 or 62, base 64 with +/ or with -_, or with all four). Three tests over that alphabet ask whether it can be random:

- chi-squared: are the symbols uniform? Its upper tail, by the Wilson-Hilferty cube root;
- runs (Wald-Wolfowitz) of symbols in the upper and the lower half of the alphabet, two-sided;
- serial correlation at lag 1 of the symbols' indexes, near normal with variance 1/n, two-sided.

Their p-values are combined by Fisher's method; a candidate below ALPHA is not random. Whether it can be text is asked by
a p-value against the corpus's own words. Letters of words follow each other by the corpus's table of letter pairs,
counted over all texts; the likelihood ratio of the inferred alphabet's uniform letters against that table has
expectation 1 over such words, so its reciprocal is a valid p-value. Pairs across a change from a small to a capital
letter, or across digits and signs, where identifiers join their words, do not count. Hex has too few letters for that:
there the changes between letters and digits are counted, of which words and numbers have at most TEXT_CHANGE a step, and
Chernoff's bound exp(-n KL(observed, TEXT_CHANGE)) is the p-value. Digits alone look like any long number and are not
claimed.

A candidate that can be random is claimed as a secret if its p-value against text passes Benjamini-Hochberg at level FDR
among all the corpus's candidates of its own length class (powers of two), so that many short candidates do not loosen
the limit of long ones. Limits come from counts by length class and p-value step, a table whose size is fixed, and go
back into the plan as constants, as do the letter pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, staged

#: The base patterns, and the least length of a match (of group 2 for the first).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run of 32 or more is the same match as that of [0-9a-f]+ which is not dropped.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "random"]
#: A run of fewer characters is too short for the battery.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Candidates that hold a digit: no words.
NO_WORD = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
ALPHA, TEXT_CHANGE, FDR, STEPS = 0.001, 0.08, 0.01, 400
#: Name, characters, symbols in order. The first whose characters suffice is the encoding.
ENCODINGS = [
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base26", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("BASE26", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base52", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower base32", "^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("BASE36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("URL-safe base64", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed base64", "^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 64
_MATCH = "array<struct<start: bigint, end: bigint, text: string, own: string>>"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; an expression that stands in a lambda twice is worked out twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(a: Column) -> Column:
    """Exclusive running sums of a column of arrays of longs, by blocks: each element costs at most a block."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: b * _BLOCK + 1)

    def lifted(sums: Column) -> Column:
        def block(at: Column, i: Column) -> Column:
            own = lambda part: F.transform(part, lambda _, j: total(F.slice(part, 1, j)))
            return let(F.slice(a, at, _BLOCK), lambda part: let(total(F.slice(sums, 1, i)), lambda base: F.transform(own(part), lambda x: x + base)))

        return F.flatten(F.transform(starts, block))

    sums = F.transform(starts, lambda at: total(F.slice(a, at, _BLOCK)))
    return F.when(n > 0, let(sums, lifted)).otherwise(F.array().cast("array<bigint>"))


def with_matches(df: DataFrame, patterns: dict[str, tuple[str, int]], text: str = "t") -> DataFrame:
    """df with a column for each name: array<struct<start, end, text, own>> of the leftmost non-overlapping matches of
    its pattern in code points, own being a group. Each step is a projection of its own, so that no text is searched
    twice; texts without a match are not cut."""
    keep = df.columns
    df = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"{k}_w") for k, (p, _) in patterns.items()])
    cut = [F.when(F.size(f"{k}_w") > 0, F.slice(F.split(text, p, -1), 1, F.size(f"{k}_w"))).alias(f"{k}_p") for k, (p, _) in patterns.items()]
    own = [F.when(F.size(f"{k}_w") > 0, F.regexp_extract_all(text, F.lit(p), F.lit(g))).alias(f"{k}_g") if g else F.col(f"{k}_w").alias(f"{k}_g") for k, (p, g) in patterns.items()]
    df = df.select("*", *cut, *own)
    df = df.select("*", *[F.zip_with(f"{k}_p", f"{k}_w", lambda x, m: (F.length(x) + F.length(m)).cast("long")).alias(f"{k}_s") for k in patterns])
    df = df.select("*", *[F.when(F.col(f"{k}_p").isNotNull(), running_sums(F.col(f"{k}_s"))).alias(f"{k}_b") for k in patterns])
    rows = {}
    for k in patterns:
        zipped = F.arrays_zip(F.col(f"{k}_b").alias("b"), F.col(f"{k}_s").alias("s"), F.col(f"{k}_w").alias("w"), F.col(f"{k}_g").alias("g"))
        row = lambda r: F.struct((r["b"] + r["s"] - F.length(r["w"])).alias("start"), (r["b"] + r["s"]).alias("end"), r["w"].alias("text"), r["g"].alias("own"))
        rows[k] = F.coalesce(F.when(F.col(f"{k}_p").isNotNull(), F.transform(zipped, row)), F.array().cast(_MATCH)).alias(k)
    return df.select(*keep, *rows.values())


def _spans(found: Column, kind: str, least: int) -> Column:
    """Spans of one kind whose match is long enough."""
    long_enough = F.filter(found, lambda m: F.length(m["own"]) >= least)
    return F.transform(long_enough, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (relative error below 1 %)."""
    return F.exp(-z * z / 2) / (1.64 * z + F.sqrt(0.76 * z * z + 4))


def letter_pairs(texts: DataFrame, text: str = "t") -> list[list[float]]:
    """log P(b | a) of the letters a, b of the corpus's words, without case: 26 rows of 26. Each pair counts once more, and
    candidates that hold a digit are left out."""
    words = F.lower(F.regexp_replace(text, NO_WORD, " "))
    pairs = texts.select(F.explode(F.regexp_extract_all(words, F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("p"))
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}  # 676 rows at most
    rows = [[counts.get(a + b, 0) + 1 for b in LETTERS] for a in LETTERS]
    return [[math.log(n / sum(row)) for n in row] for row in rows]


def _battery(m: Column, pairs: Column) -> Column:
    """struct<start, end, step, size_class> of a candidate: step is -10 log10 of the p-value against text, or null if
    it is not random. pairs is a column of 676 logarithms."""

    def tests(v: Column) -> Column:
        token, alphabet, symbols = v["token"], v["alphabet"], v["symbols"]
        n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
        square = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        index = F.transform(symbols, lambda c: F.instr(alphabet, c).cast("double"))
        halves = F.array_join(F.transform(index, lambda x: F.when(x > k / 2, "1").otherwise("0")), "")
        runs = F.length(F.regexp_replace(halves, r"(.)\1*+", "x")).cast("double")
        upper = F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double")
        return F.struct(token.alias("token"), n.alias("n"), k.alias("k"), (square * k / n - n).alias("chi"), _lag(index, n).alias("serial"), runs.alias("runs"), upper.alias("upper"))

    def verdict(v: Column) -> Column:
        n, k = v["n"], v["k"]
        spread = 2.0 / (9.0 * (k - 1))
        z_chi = (F.pow(F.greatest(v["chi"], F.lit(1e-9)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        p_chi = F.when(z_chi >= 0, _tail(z_chi)).otherwise(1.0)
        both = 2 * v["upper"] * (n - v["upper"])
        variance = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(variance > 0, F.abs(v["runs"] - 1 - both / n) / F.sqrt(variance)).otherwise(F.when(v["runs"] == 1, F.sqrt(n)).otherwise(0.0))
        z_serial = F.abs(v["serial"] + 1 / n) * F.sqrt(n)
        three = F.log(p_chi) + F.log(F.least(2 * _tail(z_runs), F.lit(1.0))) + F.log(F.least(2 * _tail(z_serial), F.lit(1.0)))
        random = F.exp(three) * (1 - three + three * three / 2) >= ALPHA
        gain = F.when(k > 16, _against_words(v["token"], pairs)).otherwise(F.when(k == 16, _against_changes(v["token"], n)).otherwise(0.0))
        step = F.greatest(F.least(F.floor(gain * (10 / 2.302585092994046)), F.lit(STEPS)), F.lit(0)).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(random, step).alias("step"), F.floor(F.log2(n)).cast("int").alias("size_class"))

    bare = F.regexp_replace(m["text"], "=+$", "")
    bare = let(bare, lambda t: F.when(t.rlike(UUID), F.lower(F.replace(t, F.lit("-"), F.lit("")))).otherwise(t))
    alphabet = lambda t: F.coalesce(*[F.when(t.rlike(chars), F.lit(a)) for _, chars, a in ENCODINGS])
    symbols = let(bare, lambda t: F.struct(t.alias("token"), alphabet(t).alias("alphabet"), F.split(t, "").alias("symbols")))
    return let(let(symbols, tests), verdict)


def _against_words(token: Column, pairs: Column) -> Column:
    """Log of the likelihood ratio of uniform letters against the corpus's words, over the pairs inside words."""
    inside = F.regexp_extract_all(token, F.lit("(?=([a-z]{2}|[A-Z]{2}|[A-Z][a-z]))"), F.lit(1))
    code = lambda c: F.ascii(c) - 97
    text = lambda p: F.get(pairs, code(F.substring(p, 1, 1)) * 26 + code(F.substring(p, 2, 1)))
    return F.aggregate(F.transform(inside, lambda p: F.lower(p)), F.lit(0.0), lambda s, p: s - F.log(F.lit(26.0)) - text(p))


def _against_changes(token: Column, n: Column) -> Column:
    """Chernoff's exponent of the changes between letters and digits."""
    classes = F.regexp_replace(F.regexp_replace(token, "[0-9]++", "0"), "[A-Fa-f]++", "a")
    rate = F.least(F.greatest((F.length(classes) - 1) / (n - 1), F.lit(TEXT_CHANGE)), F.lit(0.999))
    return (n - 1) * (rate * F.log(rate / TEXT_CHANGE) + (1 - rate) * F.log((1 - rate) / (1 - TEXT_CHANGE)))


def _lag(index: Column, n: Column) -> Column:
    """Serial correlation at lag 1; 1 if all symbols are the same."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def ratio(c: Column) -> Column:
        var = F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
        lagged = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * b)
        return let(var, lambda x: F.when(x > 0, total(lagged) / x).otherwise(1.0))

    centred = let(index, lambda i: let(total(i) / n, lambda mean: F.transform(i, lambda x: x - mean)))
    return let(centred, ratio)


def _limits(found: DataFrame, fdr: float) -> dict[int, int]:
    """Least step of each length class that Benjamini-Hochberg lets pass; at most 31 x STEPS counts come back."""
    counts = found.select(F.explode("candidates").alias("c")).select("c.*").groupBy("size_class", F.coalesce("step", F.lit(0)).alias("step")).agg(F.count("*").alias("n"))
    by_class: dict[int, dict[int, int]] = {}
    for r in counts.collect():
        by_class.setdefault(r["size_class"], {})[r["step"]] = r["n"]
    limits = {}
    for size_class, steps in by_class.items():
        total, above = sum(steps.values()), 0
        for s in sorted(steps, reverse=True):
            above += steps[s]
            if 10 ** (-s / 10) <= fdr * above / total:
                limits[size_class] = s
    return limits


def secret_scan(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, rank, end>, rank being the kind's place in KINDS, in code points
    and sorted by start, then kind; spans holds the base ones and those that the battery adds.

    A candidate inside a base span is not added. A null text is an empty one. Rows are independent but for the
    corpus's letter pairs and limits: repeated rows give a row each, an empty table none, and no other column of docs is read.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pairs = F.array(*[F.lit(x) for row in letter_pairs(d) for x in row])
    found = with_matches(d, {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "m": (CANDIDATE, 0)})
    base = F.array_sort(F.concat(*[_spans(F.col(k), k, LEAST[k]) for k in KINDS[:3]]))
    found = found.select("doc_id", base.alias("base"), "m")
    outside = F.filter("m", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    found = staged(found.select("doc_id", "base", F.transform(outside, lambda m: _battery(m, pairs)).alias("candidates")), "secrets")
    limits = _limits(found, fdr)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<int,int>")
    added = F.transform(F.filter("candidates", lambda c: c["step"] >= F.coalesce(limit[c["size_class"]], F.lit(STEPS + 1))), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
