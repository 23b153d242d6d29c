import base64
import hashlib
import random
import re
import string
import uuid

from pyspark.sql import functions as F

from tidewright.llm import queries, secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def corpus():
    rnd = random.Random(8)
    words = ["the", "internationalization", "some_long_identifier_name", "thonbleerationingandof", "😀", "é", "token", "secret=", "api_key: ", "PassWord = '"]
    made = [
        lambda: hashlib.sha256(rnd.randbytes(4)).hexdigest(),
        lambda: "AKIA" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=rnd.randrange(8, 20))),
        lambda: base64.b64encode(rnd.randbytes(30)).decode(),
        lambda: "".join(rnd.choices("abc012=:'\" ", k=12)),
        lambda: "token=" + rnd.choice(["secret: abcdefgh12", "short", "a.b/c+d-e_f="]),
    ]
    rows = [(i, " ".join(rnd.choice(words) if rnd.random() < 0.8 else rnd.choice(made)() for _ in range(rnd.randrange(60))), "x") for i in range(300)]
    many = " ".join(hashlib.md5(bytes([i % 256, i // 256])).hexdigest() for i in range(700))
    return rows + [(1, rows[1][1], "x"), (901, None, None), (902, "", "x"), (None, "token = abcdefgh", "x"), (903, many, "x"), (904, "a" * 300_000, "x")]


def test_base_spans_and_battery(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secrets.secret_scan(df).collect()
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in out)
    assert got == sorted((str(i), brute(t)) for i, t, _ in rows)
    by = {i: t or "" for i, t, _ in rows}
    added = [by[r.doc_id][s.start : s.end] for r in out for s in r.spans if s.rank == 3]
    found = [(m, t) for _, t, _ in rows for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])", t or "")]
    b64 = sum(not any(s <= m.start() and m.end() <= e for s, _, e in brute(t)) for m, t in found)
    assert b64 > 50 and len(added) > 0.9 * b64
    assert not any(re.fullmatch(r"[a-z_]+", x) for x in added)
    assert all(set(r.base) <= set(r.spans) for r in out)


def test_digest_columns_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(corpus()[:40], "doc_id long, text string, spans string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op1_secret_scan(spark, str(tmp_path)).collect():
        t = brute(df.where(F.col("doc_id") == r.doc_id).first().text)
        names = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in t)
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in t) for i in range(3))
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_value_behind_equals_sign_and_long_blobs(spark):
    rnd = random.Random(11)
    b32 = "abcdefghijklmnopqrstuvwxyz234567"
    made = {
        "name": lambda: "AWS_SECRET_KEY=" + base64.b64encode(rnd.randbytes(30)).decode(),
        "query": lambda: "https://e.org/x?sig=" + base64.urlsafe_b64encode(rnd.randbytes(30)).decode(),
        "standard": lambda: base64.b64encode(rnd.randbytes(1500)).decode(),
        "url": lambda: base64.urlsafe_b64encode(rnd.randbytes(1500)).decode(),
        "lower": lambda: "".join(rnd.choices(b32, k=2000)),
    }
    rows = [(i, f"see {f()} here", name) for i, (name, f) in enumerate((name, f) for name, f in made.items() for _ in range(40))]
    prose = [(len(rows) + i, "get user name from the request and which water under question sets " * 3, "prose") for i in range(100)]
    rows += prose
    out = secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    for name in made:
        hit = 0
        for r in out:
            _, text, own = rows[r.doc_id]
            if own not in made:
                continue
            start = text.index("=") + 1 if own in ("name", "query") else 4
            hit += own == name and (start, 3, len(text) - 5) in [tuple(s) for s in r.spans]
        assert hit >= 36, (name, hit)


PARTS = "get set user name http request response error count value buffer stream socket parse config manager factory service handler thread message default length string number array object table column update delete insert".split()
RND = random.Random(5)
MADE = {
    "base64-24": lambda: base64.b64encode(RND.randbytes(18)).decode(),
    "base62-40": lambda: "".join(RND.choices(string.ascii_letters + string.digits, k=40)),
    "base32-32": lambda: "".join(RND.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=32)),
    "lower-36": lambda: "".join(RND.choices(string.ascii_lowercase, k=36)),
    "base36-25": lambda: "".join(RND.choices(string.ascii_lowercase + string.digits, k=25)),
    "uuid": lambda: str(uuid.UUID(bytes=RND.randbytes(16), version=4)),
    "hex-26": lambda: RND.randbytes(13).hex(),
    "url-safe-43": lambda: base64.urlsafe_b64encode(RND.randbytes(32)).decode().rstrip("="),
}
PLAIN = {
    "camel": lambda: "get" + "".join(w.capitalize() for w in RND.choices(PARTS, k=6)),
    "snake": lambda: "_".join(RND.choices(PARTS, k=6)),
    "joined": lambda: "".join(RND.choices(PARTS, k=7)),
    "upper": lambda: "_".join(w.upper() for w in RND.choices(PARTS, k=6)),
    "path": lambda: "/".join(RND.choices(PARTS, k=6)) + str(RND.randrange(99)),
    "number": lambda: "".join(RND.choices("0123456789", k=30)),
}


def test_recall_and_false_claims_by_encoding(spark):
    rows = [(i, kind, f"see {f()} here") for i, (kind, f) in enumerate((k, f) for k, f in (MADE | PLAIN).items() for _ in range(100))]
    prose = [(10_000 + i, "prose", " ".join(RND.choices([*PARTS, "the", "and", "which", "water", "under", "question"], k=60))) for i in range(200)]
    df = spark.createDataFrame(rows + prose, "doc_id long, kind string, text string")
    claimed = {r.doc_id for r in secrets.secret_scan(df).collect() if any(s["rank"] == 3 for s in r.spans)}
    got = {k: sum(i in claimed for i, kind, _ in rows if kind == k) for k in MADE | PLAIN}
    assert all(got[k] >= 90 for k in MADE), got
    assert sum(got[k] for k in PLAIN) <= 0.01 * sum(got.values()) + 2 and got["number"] == 0, got
