"""Conversation repair against a plain search over (row, state), edits tried in order of their initials."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewright.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(kinds):
    """(cost, audit), the least of all edit sequences with up to three insertions in a row."""

    @functools.cache
    def best(i, state, more):
        due = "a" if state == "u" else "u"
        ways = [(0, "")] if i == len(kinds) and state in ("", "a") else []

        def edit(cost, name, rest):
            if rest is not None:
                ways.append((cost + rest[0], name + rest[1]))

        if more:
            edit(2, "I", best(i, due, more - 1))
        if i < len(kinds):
            initial, fault = kinds[i]
            edit(3, "D", best(i + 1, state, 3))
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                edit(2 + cut, "R", best(i + 1, due, 3))
                if initial == due or (initial == "s" and not state):
                    edit(cut, "K", best(i + 1, initial, 3))
        return min(ways, default=None)

    return best(0, "", 3)


def brute(rows, ids):
    by = {i: [] for i in ids}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in rs:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append((role[:1], fault))
            if fault:
                counts[fault] += 1
        known = [r[1] for r in rs if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit = cheapest(tuple(kinds))
        new, i, last = [], 0, ""
        for e in audit:
            due = "assistant" if last == "u" else "user"
            if e == "I":
                new.append((due, ""))
            elif e == "R":
                new.append((due, rs[i][3]))
            elif e == "K":
                new.append(rs[i][2:])
            i += e != "I"
            last = new[-1][0][0] if new else ""
        form = "".join(r[:1] for r, _ in new)
        assert re.fullmatch("(s?(ua)+)?", form), form
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, most, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    rnd, rows = random.Random(seed), []
    for c in range(convs):
        turn = rnd.randrange(3)
        for k in range(rnd.randrange(1, most)):
            turn += rnd.choice([1, 1, 1, 2])
            role = rnd.choice(roles) if rnd.random() < 0.3 else ("user", "assistant")[k % 2]
            rows.append((c, turn, role, rnd.choice(["Yes.", f"Number {turn}!", f"cut {turn}", "  ", None, "What?\n", f"{turn} é."])))
    return rows


def run(spark, rows, extra=False, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumn("part", F.lit(1)).withColumn("audit", F.lit("x")) if extra else df
    reports, new = turns.repair(turns.damaged(df), ids=df, **kw)
    return sorted((tuple(r) for r in reports.collect()), key=str), new


@pytest.mark.parametrize("kw", [{}, {"segment": 3, "fan": 2}])
def test_brute(spark, kw):
    rows = made(1, 60, 14) + [(900, None, "user", "Hi."), (901, None, None, None), (None, 4, "assistant", "So."), (None, 5, "user", "Why?"), (902, 7, "system", "Only this.")]
    rows += [(903, k, ("user", "assistant")[k % 2], f"Long {k // 5}.") for k in range(100)]
    got, _ = run(spark, rows, extra=True, **kw)
    assert got == brute(damage(rows), {r[0] for r in rows})


def test_empty(spark):
    assert run(spark, [])[0] == []


def test_repeated_rows(spark):
    """Rows of one turn stand together; equal ones are one and its copies."""
    rows = [(1, 1, "user", "Same.")] * 9 + [(1, 2, "assistant", "Yes.")]
    for kw in ({}, {"segment": 2, "fan": 2}):
        (report,), _ = run(spark, rows, **kw)
        n = len([r for r in damage(rows) if r[1] == 1])
        assert report[3] == max(0, n - 1) and report[7] == brute(damage(rows), [1])[0][7]


def test_repaired_turns(spark):
    """What is kept is what was hashed, in the wanted form, whether a conversation is cut or not."""
    rows = made(2, 25, 12, roles=("user", "assistant", "system"))
    for kw in ({}, {"segment": 2, "fan": 3}):
        reports, new = run(spark, rows, keep=True, **kw)
        by = {r[0]: [] for r in rows}
        for r in sorted(new.collect(), key=lambda r: (r.conv_id, r.position)):
            assert r.position == len(by[r.conv_id])
            by[r.conv_id].append(f"{r.role}:{r.text}")
        assert {r[0]: hashlib.sha256("\n".join(by[r[0]]).encode()).hexdigest() for r in reports} == {r[0]: r[8] for r in reports}
        assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in ts)) for ts in by.values())


def test_tables_join_like_rows():
    """Crossings of runs of rows are those of the rows themselves, at any cut."""
    rnd = random.Random(3)
    for _ in range(200):
        tables = [turns.TABLES[rnd.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 10])] for _ in range(rnd.randrange(1, 30))]
        cost, end = turns.whole(turns.combined(tables))
        states = turns.crossings(tables, 0, end)
        cuts = sorted({0, len(tables), *(rnd.randrange(len(tables) + 1) for _ in range(4))})
        runs = [turns.combined(tables[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert turns.whole(turns.combined(runs)) == (cost, end)
        assert turns.crossings(runs, 0, end) == [states[c] for c in cuts]
