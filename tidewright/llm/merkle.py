"""Operator 13: a Merkle manifest of documents, with a proof for each of them.

A leaf is the hash of a document's fields. Where it stands among its source's leaves is asked of bitmaps, not of a sort:
every task marks the ids it holds in compressed bitmaps of 8,192 ids, the bitmaps of one range are merged, and a directory
of running popcounts gives the number of ids before each range. The rank of an id is the directory's count and the bits
below it. Leaves then go to arrays of 3^7 slots by rank, each array is one row and one task's small work; it reduces seven
levels at once, and the arrays' roots are the nodes of the next array level. So no task holds more than one array, however
large a source is, and the number of rounds is a logarithm of base 2,187.

Null ids come first. Rows that repeat an id within a source stand by leaf; equal leaves are dealt one place each. A null
source is a source of its own and the first. Empty tables have no rows. Documents without an id are not tampered with.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, staged

#: Levels that one array of ARITY ** DEPTH slots reduces.
ARITY, DEPTH = 3, 7
#: Ids of one bitmap; it is kept as an array of 16-bit offsets up to so many ids, and as bits beyond.
RANGE, SPARSE = 1 << 13, 512
#: Range of the rows without an id: before the least of 64-bit ids.
NO_ID = -(1 << 51) - 1
#: Ids that a task marks before it hands its bitmaps on.
HELD = 1 << 20
#: Rows that one row of a repeated leaf is unfolded into at once.
UNFOLD = 100_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(hexes: str) -> str:
    return hashlib.sha256(hexes.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Binary sha256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    text = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256))


# Bitmaps


def pack_bits(lows: np.ndarray) -> bytes:
    """Ascending offsets of a range as a compressed bitmap."""
    if len(lows) <= SPARSE:
        return b"a" + lows.astype("<u2").tobytes()
    marks = np.zeros(RANGE, bool)
    marks[lows] = True
    return b"b" + np.packbits(marks, bitorder="little").tobytes()


def unpack_bits(blob: bytes) -> np.ndarray:
    if blob[:1] == b"a":
        return np.frombuffer(blob, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), bitorder="little"))


def rank_bits(blob: bytes, lows: np.ndarray) -> np.ndarray:
    """Number of marked offsets below each of lows."""
    if blob[:1] == b"a":
        return np.searchsorted(np.frombuffer(blob, "<u2", offset=1), lows)
    words = np.frombuffer(blob, "<u8", offset=1)
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    below = (np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1)
    return directory[lows >> 6] + np.bitwise_count(words[lows >> 6] & below)


def merge_bits(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """One bitmap of several, and (offset, further rows) of the offsets that stand more than once."""
    lows = np.concatenate([unpack_bits(p) for p, _ in parts])
    more = np.concatenate([np.frombuffer(m, "<i8").reshape(-1, 2) for _, m in parts])
    lows, counts = np.unique(lows, return_counts=True)
    np.add.at(counts, np.searchsorted(lows, more[:, 0]), more[:, 1])
    twice = counts > 1
    return pack_bits(lows), np.stack([lows[twice], counts[twice] - 1], 1).astype("<i8").tobytes()


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, range, low) -> bitmaps of this task's ids."""
    held: defaultdict = defaultdict(list)
    n = 0

    def flush() -> pa.RecordBatch:
        done = []
        for (source, span), lows in held.items():
            lows, counts = np.unique(np.concatenate(lows), return_counts=True)
            twice = counts > 1
            done.append((source, span, pack_bits(lows), np.stack([lows[twice], counts[twice] - 1], 1).astype("<i8").tobytes()))
        held.clear()
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["source", "span", "bits", "more"])

    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(0).dictionary_encode()
        source = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        span, low = b.column(1).to_numpy(), b.column(2).to_numpy()
        order = np.lexsort((span, source))
        source, span, low = source[order], span[order], low[order]
        cuts = np.flatnonzero((np.diff(source) != 0) | (np.diff(span) != 0)) + 1
        names = codes.dictionary.to_pylist()
        for lo, hi in zip([0, *cuts], [*cuts, len(low)], strict=True):
            held[names[source[lo]] if source[lo] >= 0 else None, int(span[lo])].append(low[lo:hi])
        n += b.num_rows
        if n >= HELD:
            yield flush()
            n = 0
    if held:
        yield flush()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows whose first `keys` columns agree, in the order they come; one key may come in several stretches."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = list(zip(*(b.column(k).to_pylist() for k in range(keys)), strict=True))
        lo = 0
        for hi in range(1, len(ids) + 1):
            if hi == len(ids) or ids[hi] != ids[lo]:
                yield ids[lo], b.slice(lo, hi - lo)
                lo = hi


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in order of (source, range) -> one each, with the number of its rows and of the source's rows before it here."""
    now, parts, before = None, [], 0

    def done() -> pa.RecordBatch:
        nonlocal before
        bits, more = merge_bits(parts)
        n = len(unpack_bits(bits)) + int(np.frombuffer(more, "<i8")[1::2].sum())
        row = [(now[0], pa.string()), (now[1], pa.int64()), (bits, pa.binary()), (more, pa.binary()), (n, pa.int64()), (before, pa.int64())]
        before += n
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], names=["source", "span", "bits", "more", "n", "before"])

    for key, rows in _runs(batches, 2):
        if key != now:
            if now is not None:
                yield done()
                before = before if key[0] == now[0] else 0
            now, parts = key, []
        parts += zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
    if now is not None:
        yield done()


def directory(leaves: DataFrame) -> tuple[DataFrame, bool]:
    """(source, span, bits, more, base, total): the bitmap of each range of ids, the number of the source's rows before it and
    of all its rows; and whether any id is repeated. Sums run inside the tasks of one range partitioning and over the tasks'
    totals."""
    marks = leaves.select("source", "span", "low").mapInArrow(_mark, "source string, span long, bits binary, more binary")
    marks = marks.repartitionByRange("source", "span").sortWithinPartitions("source", "span")
    merged = marks.mapInArrow(_merge, "source string, span long, bits binary, more binary, n long, before long")
    merged = staged(merged.withColumn("part", F.spark_partition_id()), "merkle-directory")
    whole = Window.partitionBy("source")  # a row for each source and task that holds some of it
    parts = merged.groupBy("source", "part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(whole).alias("total"))
    here = F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    index = merged.join(parts, here).select("source", "span", "bits", "more", (F.col("first") + F.col("before")).alias("base"), "total")
    return index, bool(merged.where(F.length("more") > 0).take(1))


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, its bitmap first, -> the leaves with their rank."""
    bits, more, base, total = b"a", np.zeros((0, 2), np.int64), 0, 0
    for _, rows in _runs(batches, 3):  # source, span, whether a leaf
        if not rows.column(2)[0].as_py():
            bits, base, total = (rows.column(k)[0].as_py() for k in (3, 5, 6))
            more = np.frombuffer(rows.column(4)[0].as_py(), "<i8").reshape(-1, 2)
            continue
        low = rows.column(7).to_numpy()
        at = np.searchsorted(more[:, 0], low)
        rank = base + rank_bits(bits, low) + np.concatenate([[0], np.cumsum(more[:, 1])])[at]
        twice = np.isin(low, more[:, 0])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), *(rows.column(k) for k in (8, 9, 10)), pa.array(rank, pa.int64()), pa.array(np.full(len(low), total), pa.int64()), pa.array(twice)],
            names=["source", "doc_id", "leaf", "changed", "rank", "total", "twice"],
        )


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (source, span, low, doc_id, leaf, changed) with rank, the place among the source's leaves, and total, their number."""
    index, repeated = directory(leaves)
    no = lambda kind: F.lit(None).cast(kind)
    head = index.select("source", "span", F.lit(False).alias("is_leaf"), "bits", "more", "base", "total", F.lit(0).cast("long").alias("low"), no("long").alias("doc_id"), no("binary").alias("leaf"), no("binary").alias("changed"))
    rows = leaves.select("source", "span", F.lit(True).alias("is_leaf"), no("binary").alias("bits"), no("binary").alias("more"), no("long").alias("base"), no("long").alias("total"), "low", "doc_id", "leaf", "changed")
    met = head.unionByName(rows).repartition("source", "span").sortWithinPartitions("source", "span", "is_leaf")
    out = met.mapInArrow(_rank, "source string, doc_id long, leaf binary, changed binary, rank long, total long, twice boolean")
    if not repeated:
        return out.drop("twice")
    # Repeated ids: equal leaves are counted first, each different one knows how many stand before it, and then they unfold.
    same = out.where("twice").groupBy("source", "doc_id", "leaf", "changed", "rank", "total").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "doc_id").orderBy("leaf")) - F.col("n")
    steps = same.withColumn("first", before).withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {UNFOLD}L)"))).repartition("source", "doc_id", "leaf", "at")
    each = steps.withColumn("k", F.explode(F.expr(f"sequence(at, least(at + {UNFOLD - 1}L, n - 1))"))).withColumn("rank", F.col("rank") + F.col("first") + F.col("k"))
    return out.where("not twice").drop("twice").unionByName(each.select("source", "doc_id", "leaf", "changed", "rank", "total"))


# Arrays of slots


def tree(nodes: list[str], total: int, depth: int = DEPTH) -> list[list[str]]:
    """Levels of one array: all `depth`, or up to its root if the array is all there is."""
    levels = [nodes]
    while len(levels[-1]) > 1 or (total > ARITY**depth and len(levels) <= depth):
        below = levels[-1]
        levels.append([_h("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a slot's node on each level, joined."""
    out = []
    for level in levels[:-1]:
        first = slot - slot % ARITY
        out.append(("".join(level[first:slot]), "".join(level[slot + 1 : first + ARITY])))
        slot //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = _h(left + node + right)
    return node


def _text(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}|{right}" for left, right in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(step.split("|")) for step in text.split(",")] if text else []


def _split(nodes: bytes) -> list[str]:
    return [nodes[k : k + 32].hex() for k in range(0, len(nodes), 32)]


def _fill(depth: int):
    """Nodes, those of one array together, -> the array by slot, its root, and what the leaves carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, ids, rows = None, 0, {}, {}

        def done() -> pa.RecordBatch:
            size = len(rows)
            nodes = b"".join(rows[k][0] for k in range(size))
            changed = b"".join(rows[k][1] or rows[k][0] for k in range(size))
            root = tree(_split(nodes), total, depth)[-1][0]
            row = [(now[0], pa.string()), (now[1], pa.int64()), (total, pa.int64()), ([ids[k] for k in range(size)], pa.list_(pa.int64())), (nodes, pa.binary()), (changed, pa.binary()), (bytes.fromhex(root), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], names=["grp", "block", "total", "ids", "nodes", "changed", "root"])

        for key, part in _runs(batches, 2):
            if key != now:
                if now is not None:
                    yield done()
                now, total, ids, rows = key, part.column(3)[0].as_py(), {}, {}
            for slot, i, node, changed in zip(*(part.column(k).to_pylist() for k in (2, 4, 5, 6)), strict=True):
                ids[slot], rows[slot] = i, (node, changed)
        if now is not None:
            yield done()

    return run


def arrays(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes (grp, rank, total, id, node, changed) -> (grp, block, total, ids, nodes, changed, root), staged."""
    block = F.expr(f"rank div {ARITY**depth}").alias("block")
    keyed = nodes.select("grp", block, (F.col("rank") % ARITY**depth).alias("slot"), "total", "id", "node", "changed")
    keyed = keyed.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return staged(keyed.mapInArrow(_fill(depth), "grp string, block long, total long, ids array<long>, nodes binary, changed binary, root binary"), "merkle-arrays")


def levels(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Array levels from the nodes up, and (grp, root) of every group."""
    out, tops, slots = [arrays(nodes, depth)], [], ARITY**depth
    while True:
        last = out[-1]
        tops.append(last.where(F.col("total") <= slots).select("grp", "root"))
        more = last.where(F.col("total") > slots)
        if not more.take(1):
            break
        size = F.expr(f"(total + {slots - 1}) div {slots}")
        out.append(arrays(more.select("grp", F.col("block").alias("rank"), size.alias("total"), F.lit(None).cast("long").alias("id"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("changed")), depth))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return out, roots


def _down(depth: int):
    """Arrays with the path of their root -> (grp, rank, path) of each of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, block, total, nodes, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lv = tree(_split(nodes), total, depth)
                own = [_text(siblings(lv, k)) for k in range(len(lv[0]))]
                paths = [",".join(filter(None, [p, path])) for p in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(own), pa.string()), pa.array([block * ARITY**depth + k for k in range(len(own))], pa.int64()), pa.array(paths, pa.string())],
                    names=["grp", "rank", "path"],
                )

    return run


def paths(tables: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The lowest table's arrays with `path`, the siblings of their roots up to the very top. tops has (grp, path) of groups."""
    known = tops.select("grp", F.lit(0).cast("long").alias("rank"), "path")
    for k in range(len(tables) - 1, -1, -1):
        above = known.select(F.col("grp").alias("_grp"), F.col("rank").alias("_rank"), "path")
        here = tables[k].join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_rank"))).drop("_grp", "_rank")
        if k == 0:
            return here
        # Groups with one array on this level and below have theirs in `tops`; the others get it from the level above.
        known = tops.join(tables[k].select("grp").distinct().withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp")), "left_anti").select("grp", F.lit(0).cast("long").alias("rank"), "path")
        known = known.unionByName(here.select("grp", "block", "total", "nodes", "path").mapInArrow(_down(depth), "grp string, rank long, path string"))
    raise AssertionError("no table")


def _prove(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, ids, nodes, changed, path, subroot, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lv, upper = tree(_split(nodes), total, depth), _path(path)
                end = "".join(left + right for left, right in upper)
                out = []
                for k, (i, leaf, other) in enumerate(zip(ids, lv[0], _split(changed), strict=True)):
                    own = siblings(lv, k)
                    folded = fold(fold(other, own), upper)
                    out.append((i, leaf, subroot.hex(), root.hex(), _h("".join(left + right for left, right in own) + end), folded, folded == root.hex()))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def numbered(groups: DataFrame) -> DataFrame:
    """groups (grp, ...) with rank, their place in order of grp, and total: places inside tasks of a range partitioning and
    the tasks' totals."""
    here = groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    here = staged(here, "merkle-subroots")
    parts = here.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    every = Window.partitionBy(F.lit(0))
    parts = parts.select("part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(every).alias("total"))
    return here.join(parts, "part").withColumn("rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def manifest(docs: DataFrame, changed: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    `changed` is a column of docs that gives a text to verify in place of its own (null: its own): folded_root is recomputed
    from it and the siblings of the manifest, and verified tells whether it still gives the root.
    """
    prepare(docs.sparkSession)
    col = {n: F.col(f"`{n}`") for n in FIELDS}
    fields = [col[n] for n in FIELDS]
    other = F.lit(None).cast("binary") if changed is None else F.when(~changed.eqNullSafe(col["text"]) & changed.isNotNull(), leaf_hash([*fields[:-1], changed]))
    doc_id = col["doc_id"].cast("long")
    leaves = docs.select(
        col["source"].cast("string").alias("source"),
        F.coalesce(F.shiftright(doc_id, 13), F.lit(NO_ID)).alias("span"),
        F.coalesce(doc_id.bitwiseAND(RANGE - 1), F.lit(0)).cast("long").alias("low"),
        doc_id.alias("doc_id"),
        leaf_hash(fields).alias("leaf"),
        other.alias("changed"),
    )
    placed = ranked(staged(leaves, "merkle-leaves")).select(F.col("source").alias("grp"), "rank", "total", F.col("doc_id").alias("id"), F.col("leaf").alias("node"), "changed")
    lower, subroots = levels(placed, depth)
    sources = numbered(subroots)
    one, none = F.lit("").alias("grp"), F.lit(None)
    upper, top = levels(sources.select(one, "rank", "total", none.cast("long").alias("id"), F.col("root").alias("node"), none.cast("binary").alias("changed")), depth)
    over = paths(upper, top.select("grp", F.lit("").alias("path")), depth).select("grp", "block", "total", "nodes", "path").mapInArrow(_down(depth), "grp string, rank long, path string")
    over = over.select(F.col("rank").alias("_rank"), "path")
    root = top.first()  # one row, none if there are no documents
    tops = sources.join(over, F.col("rank") == F.col("_rank")).select("grp", F.col("root").alias("subroot"), "path", F.lit(root and bytes(root["root"])).cast("binary").alias("top"))
    tops = staged(tops, "merkle-tops")
    ends = tops.select(F.col("grp").alias("_grp"), "subroot", "top")
    proven = paths(lower, tops.select("grp", "path"), depth).join(ends, F.col("grp").eqNullSafe(F.col("_grp")))
    return proven.select("total", "ids", "nodes", "changed", "path", "subroot", "top").mapInArrow(_prove(depth), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
