import random

import numpy as np
import pyarrow as pa
import pytest

from codeweave.llm import minhash_dedup as md
from codeweave.llm import queries, shingles
from codeweave.llm.components import components

from .conftest import components_of, frame, messy_rows, shingles_of


def brute(rows, percent=85):
    """(id, set size, least id of the group, whether it is the row's own) of every row."""
    sets = [shingles_of(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    firsts, links = {}, []
    for i, s in enumerate(sets):
        if s:
            links.append((firsts.setdefault(s, i), i))
    reps = sorted(firsts.values())
    for a in reps:
        met = {}
        for x in sets[a]:
            for b in holders[x]:
                if b < a and firsts[sets[b]] == b:
                    met[b] = met.get(b, 0) + 1
        links += [(a, b) for b, n in met.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = components_of(len(rows), links)
    order = lambda k: (k is not None, k or 0)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0], key=order)
    return sorted(((k, len(sets[i]), least[root[i]], k == least[root[i]]) for i, (k, _) in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, sf01):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(queries.op10_minhash_dedup(spark, sf01))
    assert got == brute(docs) and any(not r[3] for r in got)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_messy(messy, percent):
    assert rows_of(md.near_duplicate_table(messy, "doc_id", "text", percent)) == brute(messy_rows(), percent)


def variants(n, base_words, edits, seed, start=0):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(edits(rng)):
            w[rng.randrange(base_words)] = f"e{rng.randrange(10**9)}"
        out.append((start + i, " ".join(w)))
    return out


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """More members than a node or a block holds, some linked and some not."""
    monkeypatch.setattr(md, "BLOCK", 20_000)
    rows = variants(500, 200, lambda r: r.randrange(6), 1) + variants(200, 100, lambda r: r.randrange(9), 2, 1000) + [(5000 + i, "same text of some words here") for i in range(400)]
    assert rows_of(md.near_duplicate_table(frame(spark, rows).repartition(4), "doc_id", "text")) == brute(rows)


def test_chains_link_what_is_not_similar_itself(spark):
    rng = random.Random(6)
    w = [f"c{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(w)))
        at = (i * 6) % 145
        w[at : at + 3] = [f"n{i}a", f"n{i}b", f"n{i}c"]
    got = rows_of(md.near_duplicate_table(frame(spark, rows), "doc_id", "text"))
    want = brute(rows)
    assert got == want and {r[2] for r in want} == {0}


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold meet in some tree."""
    rows = []
    for i in range(400):
        rows += [(2 * i + k, t) for k, (_, t) in enumerate(variants(2, 130, lambda r: 1, 100 + i))]
    want = brute(rows)
    linked = sum(not r[3] for r in want)
    got = rows_of(md.near_duplicate_table(frame(spark, rows).repartition(4), "doc_id", "text"))
    assert linked > 300 and sum(not r[3] for r in got) >= linked - 1 and all(g[3] or not w[3] for g, w in zip(got, want))


def test_keep_one(messy, nothing):
    got = sorted(((r["doc_id"], r["text"] and len(r["text"])) for r in md.keep_one(messy, "doc_id", "text", 80).collect()), key=repr)
    rows = messy_rows()
    seen, want = set(), []
    table = {}
    for k, n, c, _ in brute(rows, 80):
        table[(k, n)] = c
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        n = len(shingles_of(t))
        group = table[(k, n)]
        if n == 0 or (group, n > 0) not in seen:
            want.append((k, t and len(t)))
            if n:
                seen.add((group, True))
    assert got == sorted(want, key=repr)
    assert md.keep_one(messy, "doc_id", "text", 80).columns == messy.columns
    assert md.keep_one(nothing, "doc_id", "text", 80).count() == 0
    assert md.near_duplicate_table(nothing, "doc_id", "text").count() == 0


def test_shingles_are_those_of_the_words():
    texts = [t for _, t in messy_rows()] + ["a b c d e", "A B C D E", "a b c d", "abcd"]
    flat, off = shingles.shingle_sets(pa.array(texts, pa.string()))
    sets = [frozenset(flat[a:b].tolist()) for a, b in zip(off, off[1:])]
    want = [shingles_of(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("percent, trees, rate", [(85, md.TREES, 1e-4), (80, 9, 8e-5)])
def test_trees_miss_as_few_pairs_as_stated(percent, trees, rate):
    """20000 pairs of sets of 200 just above the threshold; a rate of 1e-3 would miss about 20."""
    rng = np.random.default_rng(5)
    size, missed = 200, 0
    both = -(-2 * size * percent // (100 + percent))
    for _ in range(20):
        shared = rng.integers(0, 1 << 63, (1000, both), dtype=np.uint64)
        sets = [np.concatenate((shared, rng.integers(0, 1 << 63, (1000, size - both), dtype=np.uint64)), axis=1) for _ in range(2)]
        a, b = (shingles.minima(s.ravel(), np.arange(1001) * size, md.POOL * trees, 10) for s in sets)
        near = (a == b).mean(axis=1)
        assert near.min() >= md.least_near(percent, md.POOL * trees)
        met = np.zeros(1000, dtype=bool)
        for root in md._roots(trees):
            x, y = (md.descend(s, np.full(1000, root), md.BRANCHES) for s in (a, b))
            met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
        missed += int((~met).sum())
    assert missed <= 20_000 * rate * 4 + 1, missed


def test_estimates_of_minima_are_unbiased():
    rng = np.random.default_rng(9)
    for both in (20, 60, 95):
        shared = rng.integers(0, 1 << 63, (2000, both), dtype=np.uint64)
        a, b = (np.concatenate((shared, rng.integers(0, 1 << 63, (2000, 100 - both), dtype=np.uint64)), axis=1) for _ in range(2))
        near = [shingles.minima(x.ravel(), np.arange(2001) * 100, 96, 3) for x in (a, b)]
        assert (near[0] == near[1]).mean() == pytest.approx(both / (200 - both), abs=0.006)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    root = components_of(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: nodes[root[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """1000 nodes in order: the tables of edges written are counted."""
    from codeweave import runtime

    made = []
    stage = runtime.stage
    monkeypatch.setattr(runtime, "stage", lambda df, name, *more, **named: made.append(name) or stage(df, name, *more, **named))
    rng = random.Random(1)
    shuffled = list(range(1000))
    rng.shuffle(shuffled)
    for nodes in (list(range(1000)), shuffled):
        made.clear()
        edges = [(nodes[i + 1], nodes[i]) for i in range(999)]
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(2))
        assert {r["root"] for r in got.collect()} == {0} and got.count() == 1000
        assert made.count("edges") - 1 <= 12 and len(made) <= 40
