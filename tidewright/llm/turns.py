"""Operator 11: repair of conversations whose turns are missing, blank, repeated, cut off or spoken by the wrong role.

The wanted form is `(s?(ua)+)?` over role initials, so four states are enough: nothing yet, after system, after user, after
assistant. A row, or any run of rows, is a 4 x 4 table of least costs from state to state, and beside it the order of the
audits (the edits' initials) behind those costs: an audit that consumes the same rows is never the beginning of another, so
orders of parts give the order of wholes. Divide and conquer in the manner of Hirschberg needs no more than two vectors of
four: costs and audit order forward from the front, costs backward from the end; they meet in the middle, the optimal crossing
with the least audit is taken, and both halves recurse.

Rows are dealt by range of (conversation, turn), so a conversation of any size is cut into segments of SEGMENT rows at most.
One that lies within a task is repaired there. Of the others each segment gives its table, FAN tables become one on each
level, crossings come down the same levels, and each segment is repaired between its two states. Only the last step reads a
conversation in order, a segment at a time, since its hash and its audit are one value.

Nulls of role and text are one space; null turns come first; rows of one turn stand by role and a hash of the text. A null
conversation is one of its own. A role without an initial, or of another initial than s, u, a, fits nowhere as it is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, staged

SEGMENT, SEGMENT_BYTES, FAN = 4096, 8 << 20, 1024
BLANKS = " \t\n\v\f\r"
NEVER = 1 << 60

#: State after an inserted or reroled row, and the role it takes; what is inserted behind the last row.
NEXT, DUE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
TAIL = ("", "II", "I", "")
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1


def _edits(initial: str, fault: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, state) of the edits of one row."""
    yield DELETE, "D", state
    if fault < 2:
        if initial == DUE[state][0]:
            yield CUT_OFF * fault, "K", NEXT[state]
        elif initial == "s" and state == 0:
            yield CUT_OFF * fault, "K", 1
        yield REROLE + CUT_OFF * fault, "R", NEXT[state]


def _row_table(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Least (cost, audit) from state to state over one row, up to two insertions before it."""
    best: dict = {}
    for start in range(4):
        state = start
        for inserted in range(3):
            for cost, edit, end in _edits(initial, fault, state):
                found = inserted * INSERT + cost, "I" * inserted + edit
                best[start, end] = min(best.get((start, end), found), found)
            state = NEXT[state]
    return best


#: A row's kind is its initial's place in INITIALS, times three, and its fault: 0 none, 1 cut off, 2 has to go.
INITIALS = "sua-"
ROWS = [_row_table(i, f) for i in INITIALS for f in range(3)]


def _order(audits: list) -> tuple[int, ...]:
    """Place of each among all."""
    by = sorted(range(len(audits)), key=lambda k: audits[k])
    return tuple(by.index(k) for k in range(len(audits)))


#: (costs, orders) of each kind: for every state the costs to each state, and the order of the audits behind them.
TABLES = [
    tuple(zip(*((tuple(t.get((s, e), (NEVER, "~"))[0] for e in range(4)), _order([t.get((s, e), (NEVER, "~"))[1] for e in range(4)])) for s in range(4)), strict=True))
    for t in ROWS
]


@functools.lru_cache(1 << 16)
def forward(vector: tuple, table: tuple) -> tuple[int, tuple]:
    """(least cost, (costs above it, order of audits)) behind a run of rows."""
    (costs, order), (steps, ranks) = vector, table
    out, audits = [], []
    for end in range(4):
        cost, place, start = min((min(NEVER, costs[s] + steps[s][end]), order[s], s) for s in range(4))
        out.append(cost)
        audits.append((cost >= NEVER, place, ranks[start][end]))
    least = min(out)
    return least, (tuple(NEVER if c >= NEVER else c - least for c in out), _order(audits))


@functools.lru_cache(1 << 16)
def backward(costs: tuple, table: tuple) -> tuple:
    """Costs before a run of rows, above the least of them."""
    out = [min(NEVER, *(table[0][s][e] + costs[e] for e in range(4))) for s in range(4)]
    least = min(out)
    return tuple(NEVER if c >= NEVER else c - least for c in out)


def combined(tables: list[tuple]) -> tuple:
    """One table for a run of tables."""
    rows = []
    for start in range(4):
        total, vector = 0, (tuple(0 if s == start else NEVER for s in range(4)), (0, 1, 2, 3))
        for t in tables:
            more, vector = forward(vector, t)
            total += more
        rows.append((tuple(NEVER if c >= NEVER else c + total for c in vector[0]), vector[1]))
    return tuple(zip(*rows, strict=True))


def crossings(tables: list[tuple], start: int, end: int) -> list[int]:
    """States before, between and behind the tables on the cheapest way from start to end with the least audit."""
    states = [start] + [-1] * (len(tables) - 1) + [end]
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        front = (tuple(0 if s == states[lo] else NEVER for s in range(4)), (0, 1, 2, 3))
        for k in range(lo, mid):
            front = forward(front, tables[k])[1]
        back = tuple(0 if s == states[hi] else NEVER for s in range(4))
        for k in range(hi - 1, mid - 1, -1):
            back = backward(back, tables[k])
        states[mid] = min(range(4), key=lambda s: (min(NEVER, front[0][s] + back[s]), front[1][s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def whole(table: tuple) -> tuple[int, int]:
    """(cost, state behind the last row) of a whole conversation."""
    costs, order = table[0][0], table[1][0]
    ways = [(min(NEVER, costs[s] + INSERT * len(TAIL[s])), order[s], s) for s in range(4)]
    return min(ways)[0], min(ways)[2]


# Rows of one segment


def _initial(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else 3


def kinds_of(roles: list[str], texts: list[str], seen: set) -> tuple[bytes, list[int]]:
    """(kind of each row, numbers of blank, repeated and cut off rows). seen is filled with what was said so far."""
    kinds, counts = bytearray(), [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(BLANKS)
        fault = 0
        if not end:
            fault, counts[0] = 2, counts[0] + 1
        elif (role, text) in seen:
            fault, counts[1] = 2, counts[1] + 1
        elif end[-1] not in ".!?":
            fault, counts[2] = 1, counts[2] + 1
        seen.add((role, text))
        kinds.append(3 * _initial(role) + fault)
    return bytes(kinds), counts


def illegal_pairs(kinds: bytes) -> int:
    return sum((a // 3, b // 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:], strict=False))


def edited(kinds: bytes, states: list[int], roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """(audit, roles, texts) of the rows after their edits."""
    audit, new_roles, new_texts = [], [], []
    for k, role, text, state, end in zip(kinds, roles, texts, states, states[1:], strict=False):
        edits = ROWS[k][state, end][1]
        audit.append(edits)
        for e in edits:
            if e != "D":
                new_roles.append(role if e == "K" else DUE[state])
                new_texts.append("" if e == "I" else text)
                state = NEXT[state]  # K of a system row comes last
    return "".join(audit), new_roles, new_texts


def tail(state: int) -> tuple[list[str], list[str]]:
    """Roles and texts inserted behind the last row."""
    roles = []
    for _ in TAIL[state]:
        roles.append(DUE[state])
        state = NEXT[state]
    return roles, [""] * len(roles)


def _digest(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode(errors="surrogatepass")


# Spark

REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CUT = f"conv_id long, open boolean, part int, seg int, {_REPORT}, turns array<long>, roles array<string>, texts array<string>"
_L, _I, _S = pa.int64(), pa.int32(), pa.string()
_CUT = [_L, pa.bool_(), _I, _I, *[_L] * 6, _S, _S, pa.list_(_L), pa.list_(_S), pa.list_(_S)]


def _batch(rows: list[tuple], kinds: list, names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in names.split(", ")])


def _cut(segment: int, keep: bool):
    """Rows in order -> reports of the conversations that begin and end inside, segments of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, out, size, first, now = TaskContext.get().partitionId(), 0, [], 0, True, None
        turns, roles, texts, many = [], [], [], False

        def cut(open_: bool) -> None:
            nonlocal seg
            if open_:
                out.append((now, True, part, seg, *[None] * 8, turns, roles, texts))
            else:
                kinds, counts = kinds_of(roles, texts, set())
                tables = [TABLES[k] for k in kinds]
                cost, end = whole(combined(tables))
                audit, new_roles, new_texts = edited(kinds, crossings(tables, 0, end), roles, texts)
                more_roles, more_texts = tail(end)
                new_roles, new_texts = new_roles + more_roles, new_texts + more_texts
                known = {t for t in turns if t is not None}
                gaps = max(known) - min(known) + 1 - len(known) if known else 0
                sha = hashlib.sha256(_digest(new_roles, new_texts)).hexdigest()
                out.append((now, False, part, seg, gaps, *counts, illegal_pairs(kinds), cost, audit + TAIL[end], sha, None, new_roles if keep else None, new_texts if keep else None))
            seg += 1

        for b in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                full = len(turns) >= segment or size >= SEGMENT_BYTES
                if turns and (conv != now or full):
                    many = many or (conv == now)
                    cut(first or many)
                    if conv != now:
                        first, many = False, False
                    turns, roles, texts, size = [], [], [], 0
                    if len(out) >= 500 or out[-1][1]:
                        yield _batch(out, _CUT, CUT)
                        out = []
                now = conv
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                size += len(text)
        if turns:
            cut(True)
        if out:
            yield _batch(out, _CUT, CUT)

    return run


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open segments -> what each says first: its place in the segment and a hash of role and text."""
    for b in batches:
        for conv, part, seg, roles, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            firsts: dict = {}
            for k, said in enumerate(zip(roles, texts, strict=True)):
                firsts.setdefault(said, k)
            rows = [(conv, part, seg, k, hashlib.blake2b(f"{len(r)}:{r}{t}".encode(errors="surrogatepass"), digest_size=16).digest()) for (r, t), k in firsts.items()]
            yield _batch(rows, [_L, _I, _I, _I, pa.binary()], "conv_id, part, seg, k, said")


FACTS = "conv_id long, part int, seg int, kinds binary, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, n_turns long, costs array<long>, ranks array<int>"
_FACTS = [_L, _I, _I, pa.binary(), *[_L] * 7, pa.list_(_L), pa.list_(_I)]
_NODE = [pa.list_(_L), pa.list_(_I)]


def _flat(table: tuple) -> tuple[list[int], list[int]]:
    return [c for row in table[0] for c in row], [c for row in table[1] for c in row]


def _unflat(costs: list[int], ranks: list[int]) -> tuple:
    return tuple(tuple(costs[k : k + 4]) for k in (0, 4, 8, 12)), tuple(tuple(ranks[k : k + 4]) for k in (0, 4, 8, 12))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, part, seg, turns, roles, texts, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kinds, counts = kinds_of(roles, texts, {(roles[k], texts[k]) for k in again or ()})
            known = [t for t in turns if t is not None]
            rows.append((conv, part, seg, kinds, *counts, illegal_pairs(kinds), known[0] if known else None, known[-1] if known else None, len(set(known)), *_flat(combined([TABLES[k] for k in kinds]))))
        yield _batch(rows, _FACTS, FACTS)


def _up(rows: pa.Table) -> pa.Table:
    """The tables of one group, FAN at most, as one."""
    by = sorted(rows.to_pylist(), key=lambda r: r["at"])
    costs, ranks = _flat(combined([_unflat(r["costs"], r["ranks"]) for r in by]))
    return pa.Table.from_batches([_batch([(by[0]["conv_id"], by[0]["grp"], costs, ranks)], [_L, _L, *_NODE], "conv_id, at, costs, ranks")])


def _down(rows: pa.Table) -> pa.Table:
    """The states between the tables of one group, whose own two are known."""
    by = sorted(rows.to_pylist(), key=lambda r: r["at"])
    states = crossings([_unflat(r["costs"], r["ranks"]) for r in by], by[0]["start"], by[0]["end"])
    out = [(r["conv_id"], r["at"], s, e) for r, s, e in zip(by, states, states[1:], strict=False)]
    return pa.Table.from_batches([_batch(out, [_L, _L, _I, _I], "conv_id, at, start, end")])


def _pieces(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, part, seg, roles, texts, kinds, start, end, is_last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                audit, new_roles, new_texts = edited(kinds, crossings([TABLES[k] for k in kinds], start, end), roles, texts)
                if is_last:
                    more_roles, more_texts = tail(end)
                    audit, new_roles, new_texts = audit + TAIL[end], new_roles + more_roles, new_texts + more_texts
                piece = _digest(new_roles, new_texts) if new_roles else None
                yield _batch([(conv, part, seg, audit, piece, new_roles if keep else None, new_texts if keep else None)], [_L, _I, _I, _S, pa.binary(), pa.list_(_S), pa.list_(_S)], PIECE)

    return run


PIECE = "conv_id long, part int, seg int, audit string, piece binary, roles array<string>, texts array<string>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> audit and hash of each conversation."""
    now, audit, sha = (), [], None
    kinds, names = [_L, _S, _S], "_conv, audit, repaired_sha256"
    for b in batches:
        for conv, text, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (conv,) != now:
                if now:
                    yield _batch([(*now, "".join(audit), (sha or hashlib.sha256()).hexdigest())], kinds, names)
                now, audit, sha = (conv,), [], None
            audit.append(text)
            if piece is not None:
                if sha is None:
                    sha = hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(piece)
    if now:
        yield _batch([(*now, "".join(audit), (sha or hashlib.sha256()).hexdigest())], kinds, names)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _settled(open_: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Of open segments: (conv_id and the report without audit and hash, (part, seg, kinds, start, end, is_last))."""
    said = open_.select("conv_id", "part", "seg", "roles", "texts").mapInArrow(_said, "conv_id long, part int, seg int, k int, said binary")
    place = F.struct("part", "seg")
    again = said.withColumn("first", F.min(place).over(Window.partitionBy("conv_id", "said"))).where(place > F.col("first"))  # a row for each segment
    again = again.groupBy("part", "seg").agg(F.collect_list("k").alias("again"))  # of one segment
    rows = open_.join(again, ["part", "seg"], "left").select("conv_id", "part", "seg", "turns", "roles", "texts", "again")
    order = Window.partitionBy("conv_id").orderBy("part", "seg")  # narrow rows, one for each segment
    initial = F.floor(F.conv(F.hex(F.substring("kinds", 1, 1)), 16, 10).cast("int") / 3)
    final = F.floor(F.conv(F.hex(F.expr("substring(kinds, -1, 1)")), 16, 10).cast("int") / 3)
    facts = rows.mapInArrow(_facts, FACTS).withColumn("initial", initial).withColumn("final", final)
    facts = facts.withColumn("at", F.row_number().over(order).cast("long") - 1).withColumn("is_last", F.lead("seg").over(order).isNull())
    before = F.lag("final").over(order)
    legal = ((before == 0) & (F.col("initial") == 1)) | ((before == 1) & (F.col("initial") == 2)) | ((before == 2) & (F.col("initial") == 1))
    upto = F.last("last_turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    facts = facts.withColumn("joint", F.when(before.isNotNull() & ~legal, 1).otherwise(0)).withColumn("shared", F.when(upto == F.col("first_turn"), 1).otherwise(0))
    facts = staged(facts, "turns-facts")

    levels = [facts.select("conv_id", "at", "costs", "ranks")]
    group = F.expr(f"at div {fan}").alias("grp")
    while levels[-1].where("at > 0").take(1):
        levels.append(staged(levels[-1].withColumn("grp", group).groupBy("conv_id", "grp").applyInArrow(_up, "conv_id long, at long, costs array<long>, ranks array<int>"), "turns-tables"))
    ends = F.udf(lambda c, r: whole(_unflat(c, r)), "cost long, end int")
    top = staged(levels[-1].withColumn("w", ends("costs", "ranks")).select("conv_id", "w.cost", "w.end"), "turns-top")
    states = top.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(0).alias("start"), "end")
    for level in reversed(levels[:-1]):
        known = states.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "start", "end")
        rows = level.withColumn("grp", group).join(known, _same("conv_id", "_conv") & (F.col("grp") == F.col("_at")))
        states = staged(rows.select("conv_id", "grp", "at", "costs", "ranks", "start", "end").groupBy("conv_id", "grp").applyInArrow(_down, "conv_id long, at long, start int, end int"), "turns-states")

    known = states.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "start", "end")
    segments = facts.join(known, _same("conv_id", "_conv") & (F.col("at") == F.col("_at"))).select("part", "seg", "kinds", "start", "end", "is_last")
    total = facts.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns") + F.sum("shared"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("joint")).alias("illegal"),
    )
    cost = top.select(F.col("conv_id").alias("_conv"), "cost")
    return total.join(cost, _same("conv_id", "_conv")).drop("_conv"), segments


def repair(turns: DataFrame, ids: DataFrame | None = None, keep: bool = False, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame | None]:
    """turns (conv_id, turn, role, text) -> (reports, repaired turns if `keep`).

    Reports have a row for each conversation, those of `ids` (conv_id) without turns too: gaps in its turn numbers, rows whose
    first fault is to be blank, repeated or cut off, illegal neighbours, the cost of the cheapest edits, their initials, and the
    sha256 of the repaired conversation. Repaired turns are (conv_id, position, role, text), position counted from 0.
    """
    prepare(turns.sparkSession)
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), *said)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "h", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    cut = staged(rows.mapInArrow(_cut(segment, keep), CUT), "turns-cut")
    reports = cut.where("not open").select("conv_id", *REPORT)
    new = cut.where("not open").select("conv_id", F.lit(0).cast("long").alias("first"), "roles", "texts")
    open_ = cut.where("open").select("conv_id", "part", "seg", "turns", "roles", "texts")
    if open_.take(1):
        totals, states = _settled(open_, fan)
        pieces = open_.join(states, ["part", "seg"]).select("conv_id", "part", "seg", "roles", "texts", "kinds", "start", "end", "is_last").mapInArrow(_pieces(keep), PIECE)
        pieces = staged(pieces, "turns-pieces")
        ends = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").select("conv_id", "audit", "piece").mapInArrow(_joined, "_conv long, audit string, repaired_sha256 string")
        reports = reports.unionByName(totals.join(ends, _same("conv_id", "_conv")).select("conv_id", *REPORT))
        size = F.coalesce(F.size("roles"), F.lit(0))
        place = pieces.select("part", "seg", (F.sum(size).over(Window.partitionBy("conv_id").orderBy("part", "seg")) - size).cast("long").alias("first")) if keep else None
        new = new.unionByName(pieces.join(place, ["part", "seg"]).select("conv_id", "first", "roles", "texts")) if keep else new
    if ids is not None:
        every = ids.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.lit(0).alias("some")).unionByName(turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.lit(1).alias("some")))
        gone = every.groupBy("conv_id").agg(F.max("some").alias("some")).where("some = 0")
        zeros = [F.lit(0).cast("long").alias(c) for c in REPORT[:6]]
        reports = reports.unionByName(gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))
    if not keep:
        return reports, None
    each = new.select("conv_id", "first", F.posexplode(F.arrays_zip("roles", "texts")).alias("k", "t"))
    return reports, each.select("conv_id", (F.col("first") + F.col("k")).alias("position"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with a fault in every fourth row, chosen by crc32 of `conv_id:turn` in twentieths: 0 the row is missing, 1 its text is
    empty, 2 it has no sentence ends, 3 it comes twice, 4 its role is user. Nulls are one space."""
    said = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said["text"], "[.!?]", "")).otherwise(said["text"]).alias("text")
    role = F.when(k == 4, "user").otherwise(said["role"]).alias("role")
    times = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.where(k != 0).select(F.col("`conv_id`").alias("conv_id"), F.col("`turn`").alias("turn"), role, text, times).drop("copy")
