import random

import corpus_pipeline
from tidewright.llm import nearcopies

SCHEMA = "doc_id long, text string, source string"


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def pairs(levels=(0.8, 0.85, 0.9, 0.95), each=40, seed=7):
    """Documents 2i and 2i + 1 of equal sizes, their similarity being just at or over the level."""
    rnd, rows, level_of = random.Random(seed), [], {}
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    for level in levels:
        for _ in range(each):
            a = [word() for _ in range(300)]
            b, places = list(a), list(range(300))
            rnd.shuffle(places)
            for at in places:
                c = list(b)
                c[at] = word()
                if jaccard(" ".join(a), " ".join(c)) < level:
                    break
                b = c
            level_of[len(rows) + 1] = level
            rows += [(len(rows), " ".join(a), "x"), (len(rows) + 1, " ".join(b), "x")]
    return rows, level_of


def kept(spark, rows):
    out = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    return [(r.doc_id, r.text) for r in out.collect()]


def test_recall_at_each_level(spark):
    rows, level_of = pairs()
    stay = {i for i, _ in kept(spark, rows)}
    assert all(i in stay for i, _, _ in rows if i % 2 == 0)
    for level in sorted(set(level_of.values())):
        own = [i for i, x in level_of.items() if x == level]
        found = sum(i not in stay for i in own) / len(own)
        print(f"recall at {level}: {found:.3f}")
        assert found >= 0.95


def test_less_similar_texts_stay_and_rows_are_named_by_id_and_text(spark):
    rows, _ = pairs((0.7,), 20)
    assert len(kept(spark, rows)) == 40
    text = rows[0][1]
    more = [(100, "alone " + rows[2][1], "x"), (100, text, "x"), (100, rows[4][1] + " z", "x"), (None, text, "x"), (None, text, "x"), (200, "", "x"), (201, None, "x"), (202, text, "x")]
    got = sorted(kept(spark, [rows[0], *more, more[0]]), key=str)
    assert got == sorted([(0, text), (100, more[0][1]), (100, more[2][1]), (None, text), (None, text), (200, "")], key=str)


def test_large_bucket_of_unlike_and_like_texts(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in rnd.sample(range(200), 90)]
    half = [" ".join(base + [f"u{i}x{j}" for j in range(90)]) for i in range(60)]
    rows = [(i, t, "x") for i, t in enumerate([*near, *half, half[41] + " more", *(h + " end" for h in half[:20])])]
    stay = sorted(i for i, _ in kept(spark, rows))
    assert stay == [0, *range(90, 150)]


def test_recall_inside_large_buckets(spark):
    """A crowd around one text, its members edited more or less, so that links run across groups: of the pairs of .8 and more nearly
    all end in one component, and nothing else does that brute force keeps apart."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        own = list(base)
        for at in rnd.sample(range(300), rnd.choice([2, 5, 8, 11, 14])):
            own[at] = f"n{i}x{at}"
        rows.append((i, " ".join(own), "x"))
    sets = [set(nearcopies.shingles(t.encode()).tolist()) for _, t, _ in rows]
    linked = [(i, j) for i in range(240) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = spark.createDataFrame([(i, i, t.encode()) for i, t, _ in rows], "doc_id long, th long, text binary")
    nodes = prints.mapInArrow(nearcopies._prints(5), "doc_id long, th long, node long, n int, keys array<long>, sketch array<long>").cache()
    of = {r.node: r.doc_id for r in nodes.collect()}
    whole = prints.join(nodes.select("doc_id", "node"), "doc_id").select("node", "text").mapInArrow(nearcopies._sets(5), "node long, h array<long>").cache()
    found, _ = nearcopies.links(nodes, lambda some: whole.join(some, "node"), 0.8)
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = {tuple(sorted((of[r.a], of[r.b]))) for r in found.collect()}
    assert edges <= {(j, i) for i, j in linked}
    for a, b in edges:
        root[find(a)] = find(b)
    joined = sum(find(i) == find(j) for i, j in linked) / len(linked)
    print(f"{len(linked)} near pairs in one crowd, {joined:.3f} of them in one component, {len(edges)} links")
    assert joined >= 0.9


def test_empty_table(spark):
    assert kept(spark, []) == []


def test_columns_with_any_name(spark):
    from tidewright.llm import quality, simhash

    names = ["_gone", "_id", "_th", "_h", "_n", "n", "th", "row", "a.b"]
    rows = [(i, f"text number {i % 3} of many words here", *[f"{c}{i}" for c in names]) for i in range(6)] + [(5, "text number 2 of many words here", *[f"{c}5" for c in names])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for out in (nearcopies.keep_one(df), simhash.keep_one(df), quality.keep_good(df, labels, keep_at=0.0)):
        got = out.collect()
        assert out.columns == df.columns and got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert nearcopies.keep_one(df).count() == 3 and quality.keep_good(df, labels, keep_at=0.0).count() == 7


def test_sketches_keep_near_pairs():
    import numpy as np

    rnd = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        both, one, two = (rnd.integers(0, 1 << 63, n, np.uint64) for n in (160, 20, 20))  # similarity .8
        a, b = (nearcopies.band_keys(np.r_[both, x])[1] for x in (one, two))
        x = a ^ b
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        lost += int(np.bitwise_count(x & np.uint64(0x1111111111111111)).sum()) > nearcopies.most_unlike(0.8)
    assert lost == 0 and nearcopies.most_unlike(0.8) < 40


def test_simhash_of_operator_3_gives_links(spark):
    """Without bands, texts that SimHash brings together still end as one, and only if the exact check agrees."""
    base = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(base), "x"), (2, " ".join([*base, "end"]), "x"), (3, "other " * 3, "x"), (4, " ".join(f"v{i}" for i in range(50)), "x")]
    prints = spark.createDataFrame([(i, i, t.encode()) for i, t, _ in rows], "doc_id long, th long, text binary")
    made = [(i, nearcopies.shingles(t.encode()).view("int64").tolist()) for i, t, _ in rows]
    fps = nearcopies.simhash.fingerprints(prints, 5, "th", "text").withColumnRenamed("doc_id", "node")
    first, _ = nearcopies.simhash_links(fps)
    assert [tuple(r) for r in first.collect()] == [(1, 2)]
    nodes = spark.createDataFrame([(i, len(h), [0] * nearcopies.SKETCH, []) for i, h in made], "node long, n int, sketch array<long>, keys array<long>")
    sets = spark.createDataFrame([(i, h) for i, h in made], "node long, h array<long>")
    wrong = first.unionByName(spark.createDataFrame([(1, 4)], "a long, b long"))
    found, _ = nearcopies.links(nodes, lambda some: sets.join(some, "node"), 0.8, wrong)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def in_one_bucket(spark, sets):
    """(nodes of one common bucket, sets) of {node: shingles}, with the sketches that the stage makes."""
    import numpy as np

    rows = [(k, len(h), [7], nearcopies.band_keys(np.array(sorted(h), np.uint64))[1].view(np.int64).tolist()) for k, h in sets.items()]
    nodes = spark.createDataFrame(rows, "node long, n int, keys array<long>, sketch array<long>")
    return nodes, spark.createDataFrame([(k, sorted(h)) for k, h in sets.items()], "node long, h array<long>")


def test_link_between_groups_of_two_pivots(spark):
    """In a large bucket two groups each have a near pivot, and only two other members of them are near each other."""
    from pyspark.sql import functions as F

    size = 24
    at = {r.id: r.at for r in spark.range(5000).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).collect()}
    pivots, rest = [i for i in at if at[i] * size < 3][:2], [i for i in at if at[i] * size > 5][: size - 2]
    rnd = random.Random(4)
    new = lambda n: {rnd.randrange(1 << 62) for _ in range(n)}
    core, one, two = new(80), new(20), new(20)
    a, b = core | one, core | two  # similarity .67
    one, two = sorted(one), sorted(two)
    between = [core | set(one[:10]) | set(two[:10]), core | set(one[:9]) | set(two[:11])]
    sets = dict(zip(pivots, (a, b), strict=True)) | dict(zip(rest[:2], between, strict=True))
    for k, i in enumerate(rest[2:]):
        sets[i] = (a if k % 2 else b) - {sorted(a if k % 2 else b)[k]} | new(1)
    assert jaccard_of(a, b) < 0.8 <= min(jaccard_of(a, between[0]), jaccard_of(*between), jaccard_of(b, between[1]))
    nodes, all_sets = in_one_bucket(spark, sets)
    found, _ = nearcopies.links(nodes, lambda some: all_sets.join(some, "node"), 0.8)
    assert all(jaccard_of(sets[r.a], sets[r.b]) >= 0.8 for r in found.collect())
    roots = nearcopies.components(found).collect()
    assert len(roots) == size and len({r.root for r in roots}) == 1


def jaccard_of(a, b):
    return len(a & b) / len(a | b)


def test_rows_of_a_crowd_grow_with_its_tiles(spark, monkeypatch):
    """A crowd of 1,000 sets of .6 to .8 makes rows by pairs of tiles, not of members, and brute force finds no other groups."""
    import numpy as np

    made, rnd = {}, np.random.default_rng(6)
    stage = nearcopies.stage

    def counted(df, label):
        out, path = stage(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out, path

    base = rnd.integers(0, 1 << 62, 150)
    sets = {}
    for i in range(1000):
        own = base.copy()
        own[rnd.choice(150, rnd.choice([8, 14, 15, 16]), replace=False)] = rnd.integers(0, 1 << 62)
        sets[i] = {int(x) for x in own} | ({int(x) for x in rnd.integers(0, 1 << 62, 12)} if i % 3 else set())
    universe = {t: k for k, t in enumerate(sorted(set().union(*sets.values())))}
    cells = np.zeros((1000, len(universe)), np.float32)
    for i, h in sets.items():
        cells[i, [universe[t] for t in h]] = 1
    inter, n = cells @ cells.T, cells.sum(axis=1)
    near = inter >= 0.8 * (n[:, None] + n - inter)
    want = np.arange(1000)
    while (step := np.where(near, want, 1000).min(axis=1)).tolist() != want.tolist():
        want = step
    nodes, all_sets = in_one_bucket(spark, sets)
    monkeypatch.setattr(nearcopies, "stage", counted)
    found, _ = nearcopies.links(nodes, lambda some: all_sets.join(some, "node"), 0.8)
    got = np.arange(1000)
    for r in nearcopies.components(found).collect():
        got[r.node] = r.root
    assert got.tolist() == want.tolist() and len(set(got.tolist())) > 1
    assert max(made.values()) < 12_000
