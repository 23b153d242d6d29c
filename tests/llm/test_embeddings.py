import numpy as np
import pytest

from tidewright.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def corpus():
    rnd = np.random.default_rng(4)
    rows = []
    for label in (1, 2, None):
        centres = rnd.normal(size=(12, 16))
        for c in centres:
            for _ in range(15):
                rows.append((len(rows), [float(np.float32(x)) for x in c + rnd.normal(size=16) * 0.25], label, "x"))
    for _ in range(20):
        rows.append((len(rows), rows[3][1], 1, "x"))
    rows += [(3000, [x * 2 for x in rows[3][1]], 1, "x"), (3001, None, 1, "x"), (3002, [0.0] * 16, 1, "x"), (3003, [float("nan")] * 16, 1, "x"), (3004, [None] + [1.0] * 15, 1, "x")]
    rows += [(3005, [float("inf")] + [1.0] * 15, 1, "x"), (3006, rows[3][1][:8], 1, "x"), (3007, [], 1, "x"), (5, rows[5][1], 1, "x"), (None, rows[5][1], 1, "x")]
    return rows


def brute(rows, threshold):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) and lab is not None for _, v, lab, _ in rows]
    comp, n = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    p, q = comp[a], comp[b]
                    comp = [min(p, q) if c in (p, q) else c for c in comp]
    heads = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            heads[c] = min(heads.get(c, r[0]), r[0])
    return sorted(((r[0], k, heads.get(c)) for r, c, k in zip(rows, comp, n, strict=True)), key=str)


@pytest.mark.parametrize(("tile", "threshold"), [(1024, 0.93), (16, 0.85)])
def test_against_brute_force(spark, tile, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = embeddings.near_duplicates(df, threshold, tile=tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows, threshold)


def test_bounds_lose_nothing():
    rnd = np.random.default_rng(5)
    a = embeddings.unit(rnd.normal(size=(300, 64)) + 2 * rnd.normal(size=(1, 64)))
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    for t in (0.5, 0.8, 0.9):
        i, j = embeddings.compare(a, a, axes, t)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(np.einsum("id,jd->ij", a, a) >= t)), strict=True))


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
