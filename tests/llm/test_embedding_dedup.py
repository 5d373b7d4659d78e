import numpy as np
import pytest

from codeweave.llm import embedding_dedup, queries

from .conftest import CLASHING, components_of


def brute(rows, threshold=0.98):
    ok = [v is not None and l is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v, l in rows]
    links = []
    by = {}
    for i, (_, v, l) in enumerate(rows):
        if ok[i]:
            by.setdefault((l, len(v)), []).append(i)
    for own in by.values():
        x = np.array([rows[i][1] for i in own], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        links += [(own[i], own[j]) for i, j in zip(a, b)]
    root = components_of(len(rows), links)
    degree = np.bincount([i for e in links for i in e], minlength=len(rows))
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], int(degree[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


def frame(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in CLASHING if c != "label")
    data = [(k, None if v is None else [None if x is None else float(x) for x in v], l, *["?"] * (len(CLASHING) - 1)) for k, v, l in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<float>, label int, {extra}")


def run(spark, rows, **more):
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for k, v, l in rows]
    got = embedding_dedup.near_duplicates(frame(spark, rows), "vec_id", "embedding", "label", **more)
    return sorted(tuple(r) for r in got.collect()), brute(rows)


def test_whole_table(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in queries.op7_embedding_dedup(spark, sf01).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0, 0], 0), (4, [1, nan], 0), (5, [1, inf], 0), (6, [1, None], 0), (7, [1, 0], None), (8, [1, 0], 0), (9, [2, 0], 0), (10, [1, 0], 1), (11, [1, 0, 0], 0), (12, [-1, 0], 0), (13, [1, 0], 0), (14, [1, 0.1], 0)]
    got, want = run(spark, rows)
    assert got == want
    assert run(spark, []) == ([], [])


def clusters(n, dim=32, seed=1, groups=60, spread=0.018):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread
    return x.astype(np.float32)


def test_forest_finds_the_links_of_many_clusters(spark):
    x = clusters(2500)
    got, want = run(spark, [(i, v.tolist(), i % 2) for i, v in enumerate(x)], group=300)
    hit = sum(min(a[1], b[1]) for a, b in zip(got, want))
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and hit >= 0.98 * sum(b[1] for b in want)


def test_copies_and_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    dense = (centre + rng.normal(size=(700, 16)) * 0.02).tolist()
    rows = [(i, v, 0) for i, v in enumerate(dense)] + [(1000 + i, [1.0, *[0] * 15], 0) for i in range(900)]
    got, want = run(spark, rows, group=200)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_upper_trees_place_every_row(seed):
    x = embedding_dedup._unit(clusters(500, seed=seed).tolist())
    nodes = embedding_dedup.fit_upper(x[:100], 3, seed, 0.98)
    rows, leaf = embedding_dedup.place(x, nodes, 3)
    assert set(rows) == set(range(500)) and leaf.max() < 8 and len(rows) < 8 * 500


def test_split_shrinks_or_gives_up():
    rng = np.random.default_rng(0)
    assert embedding_dedup.split(np.ones((50, 4)) / 2, rng, 0.1) is None
    low, high = embedding_dedup.split(embedding_dedup._unit(rng.normal(size=(400, 8)).tolist()), rng, 0.05)
    assert set(low) | set(high) == set(range(400)) and max(len(low), len(high)) <= 340


def test_many_lengths_of_vectors(spark):
    """More lengths than are fitted, all of them in labels that need a split."""
    rng = np.random.default_rng(4)
    rows = []
    for dim in range(1, 71):
        one = rng.normal(size=dim)
        rows += [(dim * 100 + i, (one * (i + 1)).tolist() if i < 3 else rng.normal(size=dim).tolist(), 0) for i in range(8)]
    got, want = run(spark, rows, group=2)
    assert got == want


def test_groups_deeper_than_the_fitted_levels(spark, monkeypatch):
    """The levels above the tasks are split by passes over all rows."""
    monkeypatch.setattr(embedding_dedup, "FIT_DEPTH", 1)
    x = clusters(3000, seed=7)
    got, want = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], group=250)
    hit = sum(min(a[1], b[1]) for a, b in zip(got, want))
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and hit >= 0.98 * sum(b[1] for b in want)


def test_upper_trees_over_many_vectors(spark):
    """100000 vectors of one label in small clusters: fitted levels with spill, recall against brute force."""
    x = clusters(100_000, dim=16, seed=11, groups=20_000, spread=0.02)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").selectExpr("*", "0 as label")
    got = embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label", group=4096).toPandas().sort_values("vec_id")
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), 2000):
        links[at : at + 2000] = (unit[at : at + 2000] @ unit.T >= 0.98).sum(axis=1) - 1
    found = got["n_links"].to_numpy()
    assert links.sum() > 100_000 and (found <= links).all() and found.sum() >= 0.99 * links.sum()
