"""Operator 8: embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned into the axes of their principal components, so that leading dimensions
hold most of every product. Within a label, equal vectors are one node, named by two hashes; nodes are dealt into tiles by
a grid of their leading coordinates. Unit vectors of cosine c differ by at most sqrt(2 - 2c) in each of these, so only
tiles whose boxes are that close in all of them are paired. A pair of tiles accumulates the leading dimensions first; after each block the rest of a product is bounded
by the product of the suffix norms, and pairs that cannot reach the threshold any more are dropped. Survivors are
checked with the untouched vectors in double precision. A pair of tiles gives counts and a spanning forest, never all
its pairs, so a crowd of near copies costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, stage, staged, unstage
from tidewright.llm.components import components

#: Vectors in a tile, at most about; dimensions that are accumulated before each bound.
TILE, BLOCKS = 1024, (8, 16, 32)
#: Leading coordinates of the grid, and its cells to a reach of sqrt(2 - 2c).
LEADING, CELLS = 3, 2


def unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of a task's unit vectors: a row (dim, i, row) for each dimension and axis."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        groups: dict[int, list] = {}
        for v in b.column(0).to_pylist():
            groups.setdefault(len(v), []).append(v)
        for dim, vs in groups.items():
            x = unit(vs)
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "row"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling variance for each number of dimensions; matrices are summed before they reach the driver."""
    sums = vectors.select("v").mapInArrow(_moments, "dim int, i int, row array<double>")
    flat = sums.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in flat.collect():  # dim x dim numbers
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["x"]
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in out.items()}


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, blocks=BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with cosine(a[i], b[j]) >= threshold for unit rows a and b."""
    p, q, dim = a @ axes, b @ axes, axes.shape[0]
    i = j = done = None
    at = 0
    for end in [*(x for x in blocks if x < dim), dim]:
        part_p, part_q = p[:, at:end], q[:, at:end]
        rest_p, rest_q = np.linalg.norm(p[:, end:], axis=1), np.linalg.norm(q[:, end:], axis=1)
        if i is None:  # the first block as one matrix product
            dots = part_p @ part_q.T
            i, j = np.nonzero(dots + np.outer(rest_p, rest_q) >= threshold - 1e-9)
            done = dots[i, j]
        else:
            done = done + np.einsum("nd,nd->n", part_p[i], part_q[j])
            ok = done + rest_p[i] * rest_q[j] >= threshold - 1e-9
            i, j, done = i[ok], j[ok], done[ok]
        at = end
    ok = np.einsum("nd,nd->n", a[i], b[j]) >= threshold
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its tree) over n nodes and links (i, j), without nodes that are alone."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return [(int(x), int(root[x])) for x in np.flatnonzero(root != np.arange(n))]


def _tiles(axes: dict[int, np.ndarray], threshold: float, step: int = 256):
    """A group holds the rows of one pair of tiles (side 0 and 1) -> per node its links' weight, and its tree's node."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0], group[group.side == 1]
        own = right.empty  # a tile against itself
        right = left if own else right
        if left.empty:
            return pd.DataFrame({"node": [], "n": [], "root": []}).astype("int64")
        a, b = unit(left.v), unit(right.v)
        ax = axes[a.shape[1]]
        nodes = np.r_[left.node.to_numpy(), right.node.to_numpy()] if not own else left.node.to_numpy()
        weight = np.r_[left.n.to_numpy(), right.n.to_numpy()] if not own else left.n.to_numpy()
        order = np.argsort(nodes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        linked, pairs = np.zeros(len(nodes), np.int64), []
        for lo in range(0, len(a), step):
            i, j = compare(a[lo : lo + step], b, ax, threshold)
            i = i + lo
            if own:
                i, j = i[i < j], j[i < j]
            else:
                j = j + len(a)
            np.add.at(linked, i, weight[j])
            np.add.at(linked, j, weight[i])
            pairs += forest(len(nodes), place[i], place[j])  # a few rows instead of the strip's links
        tree = np.array(pairs, np.int64).reshape(-1, 2)
        roots = np.arange(len(nodes))
        for x, r in forest(len(nodes), tree[:, 0], tree[:, 1]):
            roots[x] = r
        hit = np.flatnonzero(linked)
        by_place = nodes[order]
        return pd.DataFrame({"node": nodes[hit], "n": linked[hit], "root": by_place[roots[place[hit]]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id): one row per row of vectors.

    Vectors are compared if their labels are equal and not null and they have as many dimensions. Vectors that are
    null, empty, all zero, or hold null or non-finite components link with nothing. n_links counts the other rows
    linked directly, copies included; component_id is the least id reachable. Rows that repeat an id are rows of
    their own; a null id is no candidate for component_id. An empty table gives no rows; other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull(), F.lit(False))
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(usable, v).alias("v"), F.monotonically_increasing_id().alias("uid")), "embeddings")
    rows = rows.withColumns({f"h{i}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "label", "v")) for i in (1, 2)})
    nodes = rows.where("v is not null").groupBy("label", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("uid").alias("node"), F.min("vec_id").alias("head"))
    nodes, nodes_path = stage(nodes, "embedding-nodes")
    axes = principal_axes(nodes)

    reach = float(np.sqrt(2 - 2 * threshold))
    width = reach / CELLS

    @F.pandas_udf("array<int>")
    def cell(x: pd.Series) -> pd.Series:
        out = np.zeros((len(x), LEADING), np.int32)
        sizes = x.map(len).to_numpy()
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            lead = unit(x.iloc[own]) @ axes[int(dim)][:, :LEADING]
            out[own, : lead.shape[1]] = np.floor((lead + 1) / width)
        return pd.Series(list(out))

    grid = [f"c{i}" for i in range(LEADING)]
    placed = nodes.select("label", F.size("v").alias("dim"), cell("v").alias("cell"), F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("h"), "node", "n", "v")
    placed = staged(placed.select("label", "dim", *[F.col("cell")[i].alias(c) for i, c in enumerate(grid)], "h", "node", "n", "v"), "embedding-cells")
    counts = placed.groupBy("label", "dim", *grid).agg(F.count("*").alias("m"))
    # neighbouring small cells become one tile: a running count within the label, cut at multiples of the tile size
    run = F.sum("m").over(Window.partitionBy("label", "dim").orderBy(*grid))
    counts = staged(counts.withColumn("strip", F.floor((run - 1) / tile).cast("long")), "embedding-counts")
    tiles = counts.groupBy("label", "dim", "strip").agg(F.array(*[F.min(c) for c in grid]).alias("lo"), F.array(*[F.max(c) for c in grid]).alias("hi"), F.sum("m").alias("m"))
    tiles = tiles.withColumn("parts", F.ceil(F.col("m") / tile).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles, tiles_path = stage(tiles, "embedding-tiles")
    one, two = tiles.select("label", "dim", F.col("strip").alias("s1"), F.col("part").alias("p1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), tiles.select("label", "dim", F.col("strip").alias("s2"), F.col("part").alias("p2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = F.struct("s1", "p1") <= F.struct("s2", "p2")
    for i in range(LEADING):
        near = near & (F.col("lo2")[i] - F.col("hi1")[i] <= CELLS) & (F.col("lo1")[i] - F.col("hi2")[i] <= CELLS)
    pairs = one.join(two, ["label", "dim"]).where(near).select("label", "dim", "s1", "p1", "s2", "p2", F.monotonically_increasing_id().alias("pair"))
    pairs, pairs_path = stage(pairs, "embedding-pairs")
    first = pairs.select("label", "dim", F.col("s1").alias("strip"), F.col("p1").alias("part"), "pair", F.lit(0).alias("side"))
    second = pairs.where("s1 <> s2 or p1 <> p2").select("label", "dim", F.col("s2").alias("strip"), F.col("p2").alias("part"), "pair", F.lit(1).alias("side"))
    of_cell = counts.select("label", "dim", *grid, "strip").join(tiles.select("label", "dim", "strip", "parts").distinct(), ["label", "dim", "strip"])
    member = placed.join(of_cell, ["label", "dim", *grid]).withColumn("part", (F.col("h") % F.col("parts")).cast("int"))
    dealt = member.join(first.unionByName(second), ["label", "dim", "strip", "part"]).select("pair", "side", "node", "n", "v")
    met = staged(dealt.groupBy("pair").applyInPandas(_tiles(axes, threshold), "node long, n long, root long"), "embedding-met")
    for p in (tiles_path, pairs_path):
        unstage(spark, p)

    links = met.groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), "embedding-edges")
    full = nodes.join(links, "node", "left").join(roots, "node", "left").select("label", "h1", "h2", "head", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    heads = full.groupBy("root").agg(F.min("head").alias("component_id"))
    known = staged(full.join(heads, "root").select("label", "h1", "h2", "n_links", "component_id"), "embedding-known")
    out = rows.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
