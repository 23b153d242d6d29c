"""Near copies of the pipeline: documents whose sets of shingles have a Jaccard similarity of at least a threshold.

First SimHash, by the fingerprints and links of operator 3: texts whose fingerprints differ in few bits are candidates, and those
that pass the exact check are links. SimHash finds a pair of .8 rarely, so more candidates are added to its own. These meet in one of BANDS buckets, each keyed by ROWS minima of the set of shingles under a hash of its own: a pair of
similarity J shares one with probability 1 - (1 - J^5)^20, .9996 at .8. Four bits of each minimum are the node's sketch;
a pair that meets becomes a row only if its sketches agree as often as those of near sets do (SIGMAS standard deviations
below what is expected, so that one near pair in 50,000 is lost), and then it is verified on the two whole sets of 64-bit
shingle hashes. Texts with the same set are one node before that, so exact copies cost nothing. In a bucket of more than
FULL nodes each is compared with a few pivots, which joins a crowd of near copies at a row a member. What pivots leave apart
is settled exactly: the nodes of large buckets are dealt into tiles of like size, and a pair of tiles has all its sets
intersected in one task, which gives only the links that join something.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import simhash
from tidewright.llm.common import once, prepare, stage, staged, unstage, unwrapped, without
from tidewright.llm.components import components

BANDS, ROWS, SEED = 20, 5, 42
#: Nodes of a bucket that are compared all with all; expected pivots of a larger one in the first round.
FULL, PIVOTS = 16, 4
SIGMAS = 4.2
#: Nodes and shingles of a tile, about; shingles that are looked at together.
TILE, TILE_SHINGLES, COLUMNS = 256, 1 << 16, 4096
#: Longs of a sketch: 16 minima each.
SKETCH = -(-BANDS * ROWS // 16)
_RND = np.random.Generator(np.random.PCG64(SEED))
_FLIP = _RND.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RND.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one UTF-8 text; none if it has no words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))


def band_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the sketch; no keys for an empty set."""
    if not len(h):
        return h, np.zeros(SKETCH, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 2048):  # long texts: bounded memory
        np.minimum(least, ((h[at : at + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for m in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ m) * _MIX
        keys ^= keys >> np.uint64(29)
    four = np.zeros(SKETCH * 16, np.uint64)
    four[: len(least)] = (least * _STEP) >> np.uint64(60)
    sketch = (four.reshape(SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return keys, sketch


def unlike(a: str, b: str) -> Column:
    """Number of minima whose four bits differ in two sketches."""
    total = F.lit(0)
    for i in range(SKETCH):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def most_unlike(threshold: float) -> int:
    """What unlike() is below for near sets, but for one pair in 50,000."""
    n, p = BANDS * ROWS, (1 - threshold) * 15 / 16
    return int(n * p + SIGMAS * (n * p * (1 - p)) ** 0.5) + 1


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            both = [band_keys(h) for h in sets]
            keys, sketch = (pa.array([x[i].view(np.int64) for x in both], pa.list_(pa.int64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(h) for h in sets], pa.int32()), keys, sketch], names=["doc_id", "th", "node", "n", "keys", "sketch"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["node", "h"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of pairs whose sets are near enough."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("h").alias(f"h{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("i") >= threshold * (F.size("ha") + F.size("hb") - F.col("i"))).select("a", "b")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (a, b)), assume_unique=True)
    places = []
    for sets in (a, b):
        all_ = np.concatenate(sets)
        row, at = np.repeat(np.arange(len(sets)), [len(h) for h in sets]), np.searchsorted(both, all_)
        held = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == all_) if len(both) else []
        places.append((row[held], at[held]))
    for lo in range(0, len(both), COLUMNS):  # bounded memory
        cells = []
        for sets, (row, at) in zip((a, b), places, strict=True):
            here = (at >= lo) & (at < lo + COLUMNS)
            cells.append(np.zeros((len(sets), min(COLUMNS, len(both) - lo)), np.float32))
            cells[-1][row[here], at[here] - lo] = 1
        out += cells[0] @ cells[1].T
    return out.astype(np.int64)


def _joining(threshold: float):
    """Pairs of tiles -> (a, b): near pairs that join what neither roots nor earlier ones of the same two tiles have joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (na, ra, ka, ha), (nb, rb, kb, hb) = ([[m[k] for m in side] for k in ("n", "root", "node", "h")] for side in (left, right))
                i = _shared(*([np.array(h, np.int64) for h in x] for x in (ha, hb)))
                near = i >= threshold * (np.array(na)[:, None] + np.array(nb) - i)
                near &= np.array(ra)[:, None] != np.array(rb)
                up, found = {}, []

                def top(x: int) -> int:
                    while x != (above := up.get(x, x)):
                        up[x] = up.get(above, above)
                        x = above
                    return x

                for x, y in np.argwhere(np.triu(near) if same else near).tolist():
                    if (p := top(ra[x])) != (q := top(rb[y])):
                        up[p] = q
                        found.append((min(ka[x], kb[y]), max(ka[x], kb[y])))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _by_tiles(large: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """(a, b) links that join what roots (node, root) leave apart among the nodes of large buckets, and the tables behind them.

    Of a set, all but (1 - threshold) n shingles stand in any near one, so a node goes if more of its own stand in no other set.
    The rest are parted into topics (nodes that common buckets connect), topics by size so that near sets lie in one class
    or two beside each other, and these into tiles. All pairs of tiles of a topic and such classes meet: that work grows with
    the square of a topic, but its rows with that of its tiles, and no near pair of a bucket is lost.
    """
    rows = sets.join(large.select("node").distinct(), "node").select("node", F.size("h").alias("n"), F.explode("h").alias("t"))
    common = rows.groupBy("t").agg(F.count("*").alias("f")).where("f > 1").select("t")
    held = rows.join(common, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list("t")).alias("h"))
    able, able_path = stage(held.where(F.size("h") >= F.col("n") * threshold - 1e-9).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nearcopies-able")
    inside = large.join(able.select("node"), "node").select("key", "node")
    topics = components(inside.join(inside.groupBy("key").agg(F.min("node").alias("least")), "key").select(F.col("node").alias("a"), F.col("least").alias("b")), "nearcopies-topics")
    kind = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - math.log(threshold))).alias("class")  # near sizes differ by one class at most
    each = able.join(topics.withColumnRenamed("root", "topic"), "node").select("topic", kind, "node", "n", "root", "h")
    many = each.groupBy("topic", "class").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.size("h")) / TILE_SHINGLES)).alias("parts"))
    dealt = each.join(many, ["topic", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    members = F.collect_list(F.struct("node", "n", "root", "h")).alias("members")
    whole_of = F.when(F.min("root") == F.max("root"), F.min("root")).alias("one")
    tiles, tiles_path = stage(dealt.groupBy("topic", "class", "block").agg(members, whole_of, F.count("*").alias("size")), "nearcopies-tiles")
    ends = tiles.select("topic", "class", "block", "one", "size")
    a = ends.select("topic", F.explode(F.array("class", F.col("class") + 1)).alias("cb"), F.col("class").alias("ca"), F.col("block").alias("ba"), F.col("one").alias("oa"), F.col("size").alias("na"))
    b = ends.select("topic", F.col("class").alias("cb"), F.col("block").alias("bb"), F.col("one").alias("ob"))
    apart = F.col("oa").isNull() | F.col("ob").isNull() | (F.col("oa") != F.col("ob"))  # else one root holds all of both
    pairs = a.join(b, ["topic", "cb"]).where(apart & ((F.col("ca") < F.col("cb")) | (F.col("ba") <= F.col("bb")))).select("topic", "ca", "ba", "cb", "bb")
    pairs, pairs_path = stage(pairs, "nearcopies-tile-pairs")
    side = lambda x: pairs.join(tiles.select("topic", F.col("class").alias(f"c{x}"), F.col("block").alias(f"b{x}"), F.col("members").alias(x)), ["topic", f"c{x}", f"b{x}"])
    met = side("a").join(side("b"), ["topic", "ca", "ba", "cb", "bb"]).select(((F.col("ca") == F.col("cb")) & (F.col("ba") == F.col("bb"))).alias("same"), "a", "b")
    return met.mapInArrow(_joining(threshold), "a long, b long"), [able_path, tiles_path, pairs_path]


def simhash_links(prints: DataFrame, k: int = 2) -> tuple[DataFrame, list[str]]:
    """(a, b), a < b, of nodes in (node, fp) whose SimHash fingerprints link: each fingerprint's nodes with the least of them, and the
    least ones of two fingerprints that differ in at most k bits. Also the staged tables behind it."""
    heads, path = stage(prints.groupBy("fp").agg(F.min("node").alias("head")), "nearcopies-fingerprints")
    found, paths = simhash.links(heads.select("fp"), k)
    of = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"n{x}"))
    across = found.join(of("a"), "a").join(of("b"), "b").select("na", "nb")
    inside = prints.join(heads, "fp").select("head", "node")
    pairs = across.union(inside).toDF("x", "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, [path, *paths]


def links(nodes: DataFrame, sets_of, threshold: float, first: DataFrame | None = None) -> tuple[DataFrame | None, list[str]]:
    """nodes (node, n, keys, sketch) -> (a, b) of verified links, a < b, and the staged tables behind it. sets_of(nodes) gives the
    (node, h) of some nodes. first: candidates (a, b) of another method; verified, they are links too."""
    paths: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        out, path = stage(df, f"nearcopies-{label}")
        paths.append(path)
        return out

    rows = nodes.select("node", "n", "sketch", F.explode("keys").alias("key"))
    m = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    whole = kept(rows.join(m, "key").withColumn("at", F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)), "buckets")
    known = None
    if first is not None and (first := kept(first, "first")).take(1):
        ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = kept(_verified(first, kept(sets_of(ends), "first-sets"), threshold), "first-links")
    if not whole.take(1):
        return known, paths
    pivot = whole.where((F.col("m") <= FULL) | (F.col("at") * F.col("m") < PIVOTS)).select("key", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("sketch").alias("ps"))
    # below FULL both ends of a pair are pivots, so one order of them is enough
    ordered = F.when(F.col("m") <= FULL, F.col("node") < F.col("p")).otherwise(F.col("node") != F.col("p"))
    near = (F.least("n", "pn") >= threshold * F.greatest("n", "pn")) & (unlike("sketch", "ps") <= most_unlike(threshold))
    met = whole.join(pivot, "key").where(ordered & near)
    pairs = kept(met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "pairs")
    sets = kept(sets_of(whole.select("node").distinct()), "sets")
    found = kept(_verified(pairs, sets, threshold), "links")
    found = found if known is None else kept(found.unionByName(known).distinct(), "links")
    large = whole.where(F.col("m") > FULL)
    if large.take(1):  # what pivots leave apart
        roots = kept(components(found, "nearcopies-first"), "roots")
        more, more_paths = _by_tiles(large, sets, roots, threshold)
        paths += more_paths
        found = found.unionByName(kept(more, "links")).distinct()
    return found, paths


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs without near copies: of each group that verified links join, the row with the smallest id stays.

    A row is named by its id and text, so rows that repeat an id go only if their own text is a copy. Texts without words
    are copies of each other. Rows with a null id cannot be named as the one that stays, so they are left alone.
    """
    spark = prepare(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    prints, prints_path = stage(text.mapInArrow(_prints(shingle), "doc_id long, th long, node long, n int, keys array<long>, sketch array<long>"), "nearcopies-prints")

    def sets_of(nodes: DataFrame) -> DataFrame:
        one = prints.join(nodes, "node").groupBy("node").agg(F.min("th").alias("_th"))
        one = F.broadcast(one) if one.count() <= broadcast_rows else one
        return text.join(one, F.col("th") == F.col("_th")).dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets(shingle), "node long, h array<long>")

    fingerprints, fingerprints_path = stage(simhash.fingerprints(text, shingle, "th", "text").withColumnRenamed("doc_id", "th").distinct(), "nearcopies-simhash")
    first, first_paths = simhash_links(prints.select("th", "node").distinct().join(fingerprints, "th").groupBy("node").agg(F.min("fp").alias("fp")))
    found, paths = links(prints.dropDuplicates(["node"]), sets_of, threshold, first)
    own = prints.where("doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("own"))
    if found is None:
        head = own.withColumnRenamed("own", "head")
    else:
        rooted = staged(own.join(components(found, "nearcopies-edges"), "node", "left").withColumn("root", F.coalesce("root", "node")), "nearcopies-nodes")
        head = rooted.join(rooted.groupBy("root").agg(F.min("own").alias("head")), "root").select("node", "head")
    marked = prints.select("doc_id", "th", "node").join(head, "node").where("doc_id is not null")
    gone = marked.where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("th") != F.col("head.th"))).select("doc_id", "th").distinct()
    kept = without(docs, staged(gone, "nearcopies-gone"), broadcast_rows, id_col, text_col)
    twice = prints.where("doc_id is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th")
    kept = once(kept, staged(twice, "nearcopies-twice"))
    for p in [prints_path, fingerprints_path, *first_paths, *paths]:
        unstage(spark, p)
    return unwrapped(kept, docs)
