"""Operator 3: SimHash near-duplicates over deletion-variant signatures.

A fingerprint of 64 bits is cut into k // 2 + 1 segments; if two fingerprints differ in at most k bits, one of
their segments differs in at most one. Every distinct fingerprint is indexed under each segment with one bit made
a wildcard, so such pairs share a key; keys are met by one shuffle, and each meeting is verified on all 64 bits.
Equal fingerprints are one node before that, so exact copies cost nothing. A bucket gives a spanning forest of
its links instead of all its pairs. A bucket that outgrows LARGE is cut again in the same way by its free bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import keyed_rows, once, prepare, stage, staged, unstage, unwrapped
from tidewright.llm.components import components

#: Distinct fingerprints of a bucket that are compared in one task (512 KB); larger buckets are indexed again.
LARGE = 1 << 16
#: Buckets up to this size give their linked pairs, larger ones a spanning forest.
SMALL = 8
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; zero if it has no words."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = (text or b"").lower().split()
    if not words:
        return 0
    votes, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for lo in range(0, n, 1 << 15):  # long texts: bounded memory
        part = words[lo : lo + (1 << 15) + shingle - 1]
        if len(part) < shingle:
            grams = [b" ".join(part)]
        elif shingle == 3:
            grams = [b"%b %b %b" % g for g in zip(part, part[1:], part[2:], strict=False)]
        else:
            grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(shingle)), strict=False)]
        h = np.fromiter((h64(g, SEED) for g in grams), np.uint64, len(grams))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp being the fingerprint's 64 bits as a signed long."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return d.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    at = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:], strict=False)]


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def variant_masks(free: int, k: int) -> list[tuple[np.uint64, np.uint64]]:
    """(mask of the fixed bits, mask of those left free) for each one-wildcard segment variant of the free bits."""
    bits = [b for b in range(64) if free >> b & 1]
    return [(_mask([b for b in seg if b != w]), _mask([b for b in bits if b not in seg or b == w])) for seg in _cut(bits, k // 2 + 1) for w in seg]


def _variants(k: int):
    """Rows (bucket, free, fp) -> a row (key, free, fp) for each variant of the bits that are free in the bucket."""
    mix, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for b in batches:
            bucket, free, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for f in np.unique(free):
                own = free == f
                if int(f) not in known:
                    known[int(f)] = variant_masks(int(f), k)
                mine, at = fp[own], bucket[own] * step
                keys, rest = [], []
                for v, (fixed, left) in enumerate(known[int(f)]):
                    x = ((mine & fixed) + at + np.uint64(v + 1) * step) * mix
                    keys.append(x ^ (x >> np.uint64(29)))
                    rest.append(np.full(len(mine), left))
                cols = (np.concatenate(keys), np.concatenate(rest), np.tile(mine, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["key", "free", "fp"])

    return run


def spanning(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links that join all of fps (uint64) which reach each other over steps of at most k bits."""
    left, out = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= k
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                frontier += list(found)
                left = left[~near]
    return out


def _meet(k: int, large: int):
    """Rows (key, free, fp) sorted by key -> links (a, b, free = 0) of each bucket; the rows of a large bucket as
    (a = key, b = fp, free), to be indexed again."""

    def out(a: np.ndarray, b: np.ndarray, free: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64)) for x in (a, b, free)], names=["a", "b", "free"])

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        n, start = np.diff(edge), edge[:-1]
        pairs = [(fps[:0], fps[:0])]
        for d in range(1, min(SMALL, int(n.max()))):  # all small buckets at once, by the distance of two members
            at = np.concatenate([start[(n > i + d) & (n <= SMALL)] + i for i in range(SMALL - d)])
            at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= k]
            pairs.append((fps[at], fps[at + d]))
        more = [e for s, m in zip(start[n > SMALL], n[n > SMALL], strict=True) for e in spanning(fps[s : s + m], k)]
        rest = np.array(more, np.uint64).reshape(-1, 2)
        a, b = np.concatenate([*(x for x, _ in pairs), rest[:, 0]]), np.concatenate([*(y for _, y in pairs), rest[:, 1]])
        return out(a, b, np.zeros(len(a)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64)] * 3
        deferred = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
            if deferred is not None:  # the bucket that goes on is a large one
                m = new[0] == deferred
                if m.any():
                    yield out(new[0][m], new[2][m], new[1][m])
                    new = [x[~m] for x in new]
            held = [np.r_[x, y] for x, y in zip(held, new, strict=True)]
            if len(held[0]) < large:
                continue
            last = held[0] == held[0][-1]
            if not last.all():
                yield linked(held[0][~last], held[2][~last])
                held = [x[last] for x in held]
            if len(held[0]) > large:
                deferred = held[0][0]
                yield out(held[0], held[2], held[1])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield linked(held[0], held[2])

    return run


def links(prints: DataFrame, k: int = 2, large: int = LARGE) -> tuple[DataFrame, list[str]]:
    """prints (fp, distinct) -> (a, b): links that join whatever reaches each other by steps of at most k bits.

    Also returns the paths of the staged tables behind it. Each pass is one shuffle by the variant key; there is
    a second pass only if some bucket holds more than large fingerprints, over the members of such buckets.
    """
    spark = prints.sparkSession
    rows, found, paths = prints.select(F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("free"), "fp"), None, []
    while rows is not None:
        keyed = rows.mapInArrow(_variants(k), "key long, free long, fp long")
        met = keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_meet(k, large), "a long, b long, free long")
        met, path = stage(met, "simhash-links")
        paths.append(path)
        new = met.where("free = 0").select("a", "b")
        found = new if found is None else found.unionByName(new)
        again = met.where("free <> 0").select(F.col("a").alias("bucket"), "free", F.col("b").alias("fp")).distinct()
        rows = again if again.take(1) else None
    return found, paths


def near_duplicates(docs: DataFrame, shingle: int = 3, k: int = 2, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs.

    component_id is the smallest id reachable over links of at most k differing bits, the row's own included.
    Texts that are null or have no words have fingerprint zero and link with each other like any others; texts
    shorter than a shingle are one shingle. Rows that repeat an id give a row each; a null id counts as none, so
    only a group without any id has a null component. Other columns of docs are not read; no rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    distinct, nodes_path = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-nodes")
    found, paths = links(distinct.select("fp"), k, large)
    roots = components(found, "simhash-edges")
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("head").alias("component_id"))
    of_print = staged(grouped.join(heads, "root").select("fp", "component_id"), "simhash-components")
    for p in [nodes_path, *paths]:
        unstage(spark, p)
    return prints.join(of_print, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, k: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 500_000) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row with the smallest id stays, all columns kept.

    Rows that repeat an id are copies only if their texts are near; one row of each id and fingerprint stays.
    Rows with a null id cannot be named as the one that stays, so they are left alone.
    """
    marked = near_duplicates(docs, shingle, k, id_col, text_col)
    gone = staged(marked.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone").withColumnRenamed("doc_id", "_id")
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    kept = keyed_rows(docs, id_col, text_col).join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    twice = keyed_rows(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    return unwrapped(once(kept, staged(twice.select("doc_id", "th"), "simhash-twice")), docs)
