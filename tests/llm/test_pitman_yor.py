import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import pitman_yor as py
from codeweave.llm import queries

from .conftest import frame, messy_rows, words_of


def counted(docs):
    """Exact columns of every document by brute force."""
    toks = [[*words_of(t), None] for _, t in docs]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (k, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (k, _), ws, h in zip(docs, toks, held)
    ]


def compare(rows, docs):
    got = sorted((tuple(r)[:5] + (r["base_score"],) for r in rows), key=repr)
    want = sorted(counted(docs), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-9)


def test_whole_table(spark, sf01):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_pitman_yor(spark, sf01).collect()
    compare(rows, docs)
    assert all(r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    per = lambda rs, c: sum(r[c] for r in rs) / sum(r["n_tokens"] for r in rs)
    # Perplexity on unseen documents is below that of word frequencies alone.
    assert per(held, "score") > per(held, "base_score") + 0.05
    assert per([r for r in rows if not r["held_out"]], "score") > per(held, "score")


def test_messy_and_empty(messy, nothing):
    rows = py.score_table(messy, "doc_id", "text").collect()
    compare(rows, messy_rows())
    assert all(math.isfinite(r["score"]) for r in rows)
    assert py.score_table(nothing, "doc_id", "text").count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = py.score_table(frame(spark, [(i, "some words") for i in held]), "doc_id", "text").collect()
    assert {(r["n_known"], r["train_tokens"]) for r in rows} == {(0, 0)} and all(math.isfinite(r["score"]) for r in rows)


def test_contexts_are_learnt(spark):
    """The same words in an order that training had and in one that it had not."""
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a b c d " * 20 if i % 2 else "c d a b " * 20) for i in range(80)] + [(held[0], "a b c d " * 15), (held[1], "a d c b " * 15)]
    got = {r["doc_id"]: r["score"] for r in py.score_table(frame(spark, rows), "doc_id", "text").collect()}
    assert got[held[0]] > got[held[1]] + 30


def test_a_hot_word(spark):
    """One word makes up half of all tokens and is divided over buckets."""
    rows = [(i, " ".join(f"hot w{(i * 31 + j) % 500}" for j in range(50))) for i in range(300)]
    compare(py.score_table(frame(spark, rows), "doc_id", "text").collect(), rows)


@pytest.mark.parametrize("most", [0, 255, 256, 70_000, 2**32, 2**63])
def test_messages_come_back_as_they_were(most):
    rng = np.random.default_rng(1)
    sent = [np.zeros(0, np.int64), np.array([most], np.uint64), (rng.random(1000) * most).astype(np.uint64)]
    got = [py._wide(x, np.uint64) for x in py._planes(py._press(*sent))]
    assert len(got) == 3 and all(np.array_equal(a, b) for a, b in zip(sent, got))


def test_order_of_keys_that_fit_no_word():
    """Chunks of very long texts sort by several keys instead of one of 64 bits."""
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 9, 500) for _ in range(3))
    for n in (9, 1 << 30):
        at = py._order((a, n), (b, n), (c, n))
        assert sorted(at) == list(range(500)) and list(zip(a[at], b[at], c[at])) == sorted(zip(a, b, c))


def every_pair(v=30, seed=3):
    """All types of 30 words in six pairs of previous words, most of them unseen."""
    rng = np.random.default_rng(seed)
    c1 = np.array([0, 0, 1, 1, 2, 3])
    c2, w = np.repeat(np.arange(6), v), np.tile(np.arange(v), 6)
    group, g = np.unique(c1[c2] * v + w, return_inverse=True)
    c = rng.poisson(0.7, 6 * v) * rng.integers(1, 20, 6 * v)
    c[:3] = 3
    none = np.full(6, -1)
    return py.Types(np.arange(v), none[:4], none, group % v, group // v, g, c2, c), np.bincount(w, weights=c)


def test_probabilities_of_a_context_add_up_to_one():
    types, learnt = every_pair()
    v, none, rng = int((learnt > 0).sum()), np.zeros(0, np.int64), np.random.default_rng(1)
    t2, t1 = py.first_tables(types)
    for turn in range(3):
        k0 = np.bincount(types.gw, weights=t1).astype(np.int64)
        t0 = (k0 > 0).astype(np.int64) if turn == 0 else py.seat(k0, np.full(len(k0), own.floor()), 0.3, rng)
        k1 = types.customers(t2)
        upper = py.Upper(k0, t0, none, none)
        own = py.Shared(py._totals(types, t2, k1, t1, int(t0.sum()), int(k0.sum())), (0.3, 0.5, 0.7), v)
        p = py.predict(types, t2, k1, t1, own, upper)
        d0, d1, d2 = own.discounts
        root = (py.STRENGTH + d0 * own.t0) / (v + 1) / (py.STRENGTH + own.c0)
        for c2, c1 in enumerate([0, 0, 1, 1, 2, 3]):
            near = (py.STRENGTH + d1 * own.t1[c1]) * root / (py.STRENGTH + own.c1[c1])
            unknown = (py.STRENGTH + d2 * own.t2[c2]) * near / (py.STRENGTH + own.c2[c2])
            known = learnt[types.word[types.gw[types.g]]] > 0
            assert p[(types.c2 == c2) & known].sum() + unknown == pytest.approx(1, abs=1e-9), (turn, c2)
        t2, k1, t1 = py.lower(types, own, upper, t2, t1, rng)


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(5)
    base, d, n = 0.8, 0.4, 40_000
    t = py.seat(np.full(n, 2), np.full(n, base), d, rng)
    assert set(t) == {1, 2} and (t == 2).mean() == pytest.approx(base / (base + 1 - d), abs=0.01)
    assert (py.seat(np.array([0, 1, 0, 1]), np.ones(4), d, rng) == [0, 1, 0, 1]).all()
    for c in (5, py.EXACT, py.EXACT + 1, 100, py.STIRLING, py.STIRLING + 1, 10**6):
        for base, d in ((0.8, 0.4), (0.1, 0.8), (5.0, 0.4)):
            t = py.seat(np.full(4000, c), np.full(4000, base), d, rng, sweeps=4)
            assert t.min() >= 1 and t.max() <= c
            want = mean_tables(c, base, d) if c <= py.STIRLING else 1 + base / d
            assert t.mean() == pytest.approx(want, rel=0.06), (c, base, d)


def mean_tables(n, base, d):
    """The mean of P(t) ~ base^t S(n, t), S the generalised Stirling numbers, in logarithms."""
    s = np.full(n + 2, -np.inf)
    s[1] = 0
    t = np.arange(n + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for m in range(1, n):
            grow = np.where(m - d * t > 0, np.log(np.maximum(m - d * t, 1e-300)) + s, -np.inf)
            s = np.logaddexp(grow, np.concatenate(([-np.inf], s[:-1])))
    p = s + t * np.log(base)
    p = np.exp(p - p.max())
    return (p * t).sum() / p.sum()


def test_scores_do_not_depend_on_the_partitioning(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").where(F.length("text") < 500)
    a = {r["doc_id"]: r["n_known"] for r in py.score_table(docs.repartition(5), "doc_id", "text").collect()}
    b = {r["doc_id"]: r["n_known"] for r in py.score_table(docs.coalesce(1), "doc_id", "text").collect()}
    assert a == b


def test_small_buckets_and_chunks_change_little(spark, sf01):
    """Counts and base are the same in many small buckets and chunks; the scores differ by the draws alone."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet").where(F.length("text") < 3000).repartition(3, "doc_id").cache()
    few = sorted(tuple(r) for r in py.score_table(docs, "doc_id", "text").collect())
    many = sorted(tuple(r) for r in py.score_table(docs, "doc_id", "text", bucket_tokens=5_000, hot_tokens=1_500, chunk_tokens=40_000).collect())
    assert [r[:5] for r in few] == [r[:5] for r in many]
    assert np.allclose([r[5] for r in few], [r[5] for r in many], rtol=1e-9)
    a, b = (sum(r[6] for r in x) / sum(r[2] for r in x) for x in (few, many))
    assert a == pytest.approx(b, abs=0.005)
    assert np.allclose([r[6] for r in few], [r[6] for r in many], rtol=0.1, atol=1)


def one_table(train, held, floor=0.05):
    """Held-out log10 probability a token of the same hierarchy with one table for every word of a restaurant."""
    streams = lambda docs: (z for d in docs for z in zip(d, ["<", *d], ["<", "<", *d]))
    c2 = Counter((w, v, u) for w, v, u in streams(train))
    c1 = Counter((w, v) for w, v, _ in c2)
    c0 = Counter(w for w, _ in c1)
    ones = lambda c: min(0.95, max(floor, sum(x == 1 for x in c.values()) / (sum(x == 1 for x in c.values()) + 2 * sum(x == 2 for x in c.values()))))
    d2, d1, d0 = ones(c2), ones(c1), ones(c0)
    n2, t2, n1, t1 = Counter(), Counter(), Counter(), Counter()
    for (_, v, u), n in c2.items():
        n2[v, u] += n
        t2[v, u] += 1
    for (_, v), n in c1.items():
        n1[v] += n
        t1[v] += 1
    n0, v0, s = sum(c0.values()), len(c0), py.STRENGTH
    total = many = 0
    for w, v, u in streams(held):
        p = (max(c0[w] - d0, 0) + (s + d0 * v0) / (v0 + 1)) / (s + n0)
        p = (max(c1[w, v] - d1, 0) + (s + d1 * t1[v]) * p) / (s + n1[v])
        p = (max(c2[w, v, u] - d2, 0) + (s + d2 * t2[v, u]) * p) / (s + n2[v, u])
        total += math.log10(p)
        many += 1
    return total / many


def test_held_out_score_is_that_of_true_contexts(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    fold = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs]
    toks = [[*words_of(r["text"]), None] for r in docs]
    want = one_table([t for t, h in zip(toks, fold) if not h], [t for t, h in zip(toks, fold) if h])
    rows = [r for r in queries.op6_pitman_yor(spark, sf01).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows) > want - 0.005


def test_a_frequent_word_is_dealt_over_buckets():
    """A previous word of a 200th of all tokens: no bucket takes more of it than two sections and its share of the rest."""
    rng = np.random.default_rng(2)
    n, often = 200_000, 4
    code = rng.integers(0, 20_000, n)
    code[::200] = 7
    count = np.full(200, 1000)
    times = np.bincount(code, minlength=20_001)
    chunk = py.Chunk(code, count, 20_000, np.arange(20_001) * 8 + 3, times)
    most = int(times[7]) // often
    hot = py.Hot(np.array([7 * 8 + 3]), np.zeros(0, np.uint64), most)
    order, first, bucket, v, u, w = chunk.arrange(hot, 64)
    own = np.bincount(bucket[v == 7 * 8 + 3], minlength=64)
    assert times[7] - 5 <= own.sum() <= times[7] and own.max() <= 2 * most + 40
    whole = py.Chunk(code, count, 20_000, np.arange(20_001) * 8 + 3, times).arrange(py.Hot(np.zeros(0, np.int64), np.zeros(0, np.uint64), n), 64)
    assert sorted(zip(v, u, w)) == sorted(zip(*whole[3:])) and sorted(order) == list(range(n)) and (np.diff(bucket) >= 0).all()


def test_every_context_has_a_restaurant_of_its_own(spark):
    """24000 words that each have one follower: contexts that shared a restaurant would blur it."""
    n = 24_000
    pairs = lambda i: f"p{i * 7919 % n} q{i * 7919 % n}"
    learnt = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][:2400]
    held = next(i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(k, " ".join(pairs(at * 40 + j) for j in range(40))) for at, k in enumerate(learnt)]
    right = " ".join(f"p{i} q{i}" for i in range(0, 2000, 10))
    wrong = " ".join(f"p{i} q{i + 10}" for i in range(0, 2000, 10))
    rows += [(held, right), (held, wrong)]
    got = sorted(r["score"] for r in py.score_table(frame(spark, rows), "doc_id", "text").collect() if r["doc_id"] == held)
    # Every q costs several powers of ten less after its own p.
    assert got[1] > got[0] + 200 * 2.5, got


def test_hot_contexts_are_divided_without_loss(spark):
    """A hot word and a hot pair, divided over buckets, score as they do in one bucket."""
    rows = [(i, " ".join(f"hot pair w{(i * 31 + j) % 50} hot w{(i * 17 + j) % 90}" for j in range(30))) for i in range(300)]
    docs = frame(spark, rows)
    divided = {r["doc_id"]: r["score"] for r in py.score_table(docs, "doc_id", "text", hot_tokens=2_000, bucket_tokens=8_000).collect()}
    undivided = {r["doc_id"]: r["score"] for r in py.score_table(docs, "doc_id", "text").collect()}
    a, b = (sum(x.values()) for x in (divided, undivided))
    assert a == pytest.approx(b, rel=0.02)
