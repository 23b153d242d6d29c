import math
import random
import re

import pytest

from tidewright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(t):
    t = t or ""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_against_plain_patterns():
    rnd = random.Random(1)
    parts = ["a", "@", ".", "-", " ", "1", "23", "255", "4111111111111111", "+", "(", "é", "b.c", "x@y.z", "+1 (743) 555-3824", "1.2.3.4", "4111 1111-1111 1111", "\n", "_", "%"]
    for _ in range(30_000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 400_000, "a" * 400_000 + "@", "+1" + "(" * 400_000, "1." * 200_000):
        pii.base_spans(t)


def corpus(repeats=1):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rnd.choices(vocab, k=30)), "clash") for i in range(200)]
    for i in range(6):  # a name that stands with one address only, and a common word beside it
        rows += [(500 + i, f"Zorblax {vocab[i]} {'1 ' * 300} {vocab[0]} write zorblax@corp.example.com {vocab[3]} now {'; ' * 300} zorblax", "x")] * repeats
    rows += [(600, "ask Quimby about it, quimby.77@mail.example.org knows", "x"), (601, "ask the quimby.77@mail.example.org", "x")]
    for i in range(4):  # a network, and a word that stands with it alone
        rows.append((620 + i, f"host Flumox at 10.20.{i}.7 is {vocab[i + 9]}", "x"))
    return rows + [(1, rows[1][1], "x")] * repeats + [(None, "call +1 743 555 3824", "x"), (700, None, None), (701, "", "x"), (702, "w " * 100_000 + "1.2.3.4", "x")]


def expected_terms(rows):
    """(id, text) -> places of disclosing terms, by counting in memory."""
    docs = {(i, t or "") for i, t, _ in rows}
    n, n_c, n_ct, n_t = len(docs), {}, {}, {}
    known, own = {}, {}
    for d in docs:
        spans = pii.base_spans(d[1])
        own[d] = pii.terms(d[1], spans)
        for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", d[1])}:
            n_t[w] = n_t.get(w, 0) + 1
        known[d] = {x for k, s, e in spans for x in pii.known_by(k, d[1][s:e])} | {("name", w) for k, s, e in spans for w in pii.own_words(k, d[1][s:e])}
        for c in known[d]:
            n_c[c] = n_c.get(c, 0) + 1
            for w in {w for w, _, _ in own[d]}:
                n_ct[c, w] = n_ct.get((c, w), 0) + 1

    def tells(c, w):
        k = n_ct.get((c, w), 0)
        enough = k > 0 and c[1] == w if isinstance(c, tuple) else k >= 3
        return enough and math.log(k * n / (n_c[c] * n_t[w])) / math.log(n / n_c[c]) >= 0.8 - 1e-9

    return {d: [(s, e) for w, s, e in own[d] if any(tells(c, w) for c in known[d])] for d in docs}


@pytest.mark.parametrize("repeats", [1, 20])
def test_scan_and_sanitise(spark, repeats):
    rows = corpus(repeats)
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    want = expected_terms(rows)
    out = pii.scan(df).collect()
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base], [(s.start, s.end) for s in r.spans if s.kind == 4]) for r in out)
    assert got == sorted((str(i), brute(t), want[i, t or ""]) for i, t, _ in rows)
    by = {i: [t[s:e] for s, e in want[i, t or ""]] for i, t, _ in rows if t}
    assert by[500] == ["Zorblax", "write", "now", "zorblax"] and "Quimby" in by[600] and by[601] == [] and "Flumox" in by[620] and by[1] == []
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "orblax" not in clean[500].text and "[EMAIL]" in clean[500].text and "corp" not in clean[500].text
    assert clean[None].text == "call [PHONE]" and clean[700].text is None and clean[701].text == ""
    assert all(clean[i].text == t for i, t, _ in rows if i is not None and i < 200)
    assert pii.sanitise(df).columns == df.columns and pii.sanitise(df).count() == len(rows)


def test_common_stems_are_kept(spark):
    rows = [(i, f"abcde word{'abcdefghij'[i % 10]} here", "x") for i in range(300)] + [(400 + i, f"wordzzz met kim@one.example.com {i}", "x") for i in range(5)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert out[400] == "wor*  [EMAIL] 0" and out[7] == rows[7][1]


@pytest.mark.parametrize("repeats", [1, 3000])
def test_repeated_rows_do_not_move_the_bound(spark, repeats):
    """A stem that is only just common enough to stay does so however often other rows are repeated."""
    rows = [(i, f"plain words of no note {i}", "x") for i in range(260)] + [(300 + i, f"prompt {i}", "x") for i in range(40)]
    rows += [(400 + i, f"prolific writes to ann@zeta.org {i}", "x") for i in range(4)] + [(900, "again and again", "x")] * repeats
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert out[400] == "pro*  to [EMAIL] 0"


def test_keys_counted_in_parts(spark, monkeypatch):
    """A key of many documents is counted in parts, with the result of one."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string, spans string")
    whole = sorted((str(r.doc_id), str(r.spans)) for r in pii.scan(df).collect())
    monkeypatch.setattr(pii, "TOGETHER", 2)
    assert sorted((str(r.doc_id), str(r.spans)) for r in pii.scan(df).collect()) == whole


def test_empty_tables_and_names(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, spans string")
    assert pii.scan(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0
    names = ["row", "_clean", "th", "hits", "_id", "a.b"]
    some = spark.createDataFrame([(1, "write x@y.example.com", *names)], ["doc_id", "text", *names])
    got = pii.sanitise(some).first()
    assert got.text == "write [EMAIL]" and [got[c] for c in names] == names
