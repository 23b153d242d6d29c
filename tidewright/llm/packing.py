"""Operator 9: packing documents into sequences by non-negative least squares over a histogram of lengths.

Documents are tokenized and cut at every window's end, so a whole window is a piece of its own and only the rest of
each document has to be combined. The histogram of those lengths has at most `window` entries whatever the corpus.
Shallow combinations of up to three lengths that fill a window exactly are enumerated, the repeat counts that
explain the histogram best are solved for by non-negative least squares and rounded down, and what is left is packed
greedily, best fit first, a whole group of equal sequences at a time. The plan maps a length and a rank among the
pieces of that length to a sequence and an offset; ranks come from salted counts, so a very common length is no one
task's work. Ids are stored once, and no sequence is assembled in memory.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, stage, staged
from tidewright.llm.fasttok import encoder

WINDOW = 4096
#: Lengths that combinations of three take their first two members from: the most frequent ones.
FREQUENT = 256
#: Parts in which the pieces of a length are ranked, at least, and pieces to a part beyond that.
SALTS, PART = 64, 500_000
PIECES = "uid long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def combinations(counts: np.ndarray, frequent: int = FREQUENT) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly; counts[l] pieces of length l."""
    w = len(counts) - 1
    have = counts > 0
    a = np.arange(1, w // 2 + 1)
    two = a[have[a] & have[w - a]]
    rows = [np.stack([two, w - two, np.zeros_like(two)], 1)]
    top = np.sort(np.argsort(-counts, kind="stable")[:frequent])
    top = top[(top > 0) & have[top]]
    x, y = (g.ravel() for g in np.meshgrid(top, top, indexing="ij"))
    z = w - x - y
    ok = (x <= y) & (z >= 1)
    ok[ok] &= have[z[ok]]
    rows.append(np.sort(np.stack([x[ok], y[ok], z[ok]], 1), axis=1))
    return np.unique(np.concatenate(rows), axis=0)


def nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |A x - counts| small, A having a column of length counts for each combination: multiplicative
    updates, which never leave the non-negative orthant and never raise the error."""
    b = counts.astype(float)
    x = np.full(len(combos), max(1.0, b.sum() / 3 / max(1, len(combos))))

    def apply(v: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, i], v, len(b)) for i in range(3))
        out[0] = 0
        return out

    def transposed(r: np.ndarray) -> np.ndarray:
        r = np.append(0, r[1:])
        return r[combos].sum(axis=1)

    gain = transposed(b)
    for _ in range(rounds):
        x *= gain / np.maximum(transposed(apply(x)), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, frequent: int = FREQUENT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences of just these) that use every piece of the histogram once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], repeat: int) -> None:
        for length, k in Counter(lengths).items():
            left[length] -= k * repeat
        out.append((lengths, repeat))

    if left[window]:
        use((window,), int(left[window]))
    combos = combinations(left, frequent)
    if len(combos):
        x = nnls(combos, left)
        for j in np.argsort(-x, kind="stable"):
            lengths = tuple(int(v) for v in combos[j][::-1] if v)
            n = min(int(x[j]), min(int(left[v]) // k for v, k in Counter(lengths).items()))
            if n > 0:
                use(lengths, n)
    have = [int(v) for v in np.flatnonzero(left)]
    while have:
        room, lengths, used = window, [], Counter()
        top = len(have)
        while room and top:
            top = bisect.bisect_right(have, room, 0, top)
            while top and used[have[top - 1]] >= left[have[top - 1]]:
                top -= 1
            if top:
                lengths.append(have[top - 1])
                used[have[top - 1]] += 1
                room -= have[top - 1]
        use(tuple(lengths), min(int(left[v]) // k for v, k in used.items()))
        have = [v for v in have if left[v]] if any(left[v] == 0 for v in used) else have
    return out


class Slots:
    """The plan as arrays, by length: rank of the first slot of each group, and where its slots lie."""

    def __init__(self, groups: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, list[int]]]] = {}
        base = 0
        for lengths, repeat in groups:
            at, places = 0, {}
            for v in lengths:
                places.setdefault(v, []).append(at)
                at += v
            for v, offsets in places.items():
                rows.setdefault(v, []).append((base, repeat, offsets))
            base += repeat
        self.sequences = base
        self.by_length = {}
        for v, own in rows.items():
            ends = np.cumsum([r * len(o) for _, r, o in own])
            self.by_length[v] = (ends - np.array([r * len(o) for _, r, o in own]), own)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for v in np.unique(lengths):
            starts, own = self.by_length[int(v)]
            at = np.flatnonzero(lengths == v)
            group = np.searchsorted(starts, ranks[at], "right") - 1
            for g in np.unique(group):
                base, _, offsets = own[g]
                mine = at[group == g]
                q = ranks[mine] - starts[g]
                seq[mine] = base + q // len(offsets)
                off[mine] = np.array(offsets, np.int64)[q % len(offsets)]
        return seq, off


def _pieces(path: str, drops_space: bool, end_id: int, window: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path, drops_space), struct.pack("<I", end_id)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.raw(text.as_py() or "") + last
                n = len(raw) // 4
                for s in range(0, n, window):
                    part = raw[4 * s : 4 * (s + window)]
                    out.append((doc_id, s, len(part) // 4, zlib.crc32(part), n, part if keep else None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = 2, window: int = WINDOW, keep_ids: bool = True, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary,
    little-endian unsigned 32-bit) if keep_ids.

    A null text is an empty one, whose only id is the end id. Every row is a document, so rows that repeat an id are
    each packed; a null id is kept as null. No rows give no pieces. Equal lengths are dealt in the order of a hash.
    """
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES.removeprefix("uid long, ") + (", ids binary" if keep_ids else "")
    pieces = staged(d.mapInArrow(_pieces(tokenizer, drops_space, end_id, window, keep_ids), schema).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    salts = max(SALTS, pieces.count() // PART)
    slim = pieces.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.pmod(F.xxhash64("uid"), F.lit(salts)).alias("salt"))
    counts, _ = stage(slim.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    slots = Slots(plan(histogram, window, frequent))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid"))).join(before, ["length", "salt"])
    ranked = ranked.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = slots.place(b.column(3).to_numpy(zero_copy_only=False), b.column(6).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(seq), pa.array(off)], names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
    if keep_ids:
        out = out.join(pieces.select("uid", "ids"), "uid")
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
