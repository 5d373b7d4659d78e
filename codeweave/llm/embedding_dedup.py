"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors (by a 128-bit hash of label and components) are one representative with a weight.
Every tree splits recursively at the median of a random projection, with points near the median
going both ways (spill overlap); vectors are compared exactly within leaves, and each leaf reports
only a spanning forest of its links.  Components are the union over the trees.  Links exist only
within components, so the links of each vector are then counted exactly, block by block, within its
component.

The upper levels of a tree are fitted on at most ``FIT_ROWS`` representatives (those of least hash) of each of
the ``FIT_DIMS`` commonest vector lengths and place every row; they are only as deep as is needed for groups of about
``GROUP`` vectors, and not deeper than that sample tells apart.  Groups that are still too large are split further, a
level a pass, at medians counted in Spark on all of their rows.  The lower levels are fitted by the task that holds a
group, on all of it.  A node that its random splits do not shrink (a dense cluster) is compared whole, in blocks;
of a group that no pass shrinks, every member is compared with one, and with those of its block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, have no links and are components of their own; vectors of different lengths never
link; copies link with each other; repeated ids are rows of their own, and a component's id is the
least id in it; ids are integers (others are an error of the cast), and a null one is never the least; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm.components import components

TREES = 5
LEAF = 192
GROUP = 8_192
FIT_ROWS, FIT_DIMS, FIT_DEPTH = 16_384, 8, 10
BLOCK = 2_048


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spill_for(threshold: float, dim: int) -> float:
    """Half the overlap of a split: linked vectors' projections differ by d / sqrt(dim) as a rule,
    d their distance; 1.3 times that on each side of the median parts few of them."""
    return 1.3 * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def split(x: np.ndarray, rng: np.random.Generator, spill: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions on each side of a random split; None where three directions fail to shrink it."""
    for _ in range(3):
        d = rng.normal(size=x.shape[1])
        p = x @ (d / np.linalg.norm(d))
        m = np.median(p)
        low, high = np.flatnonzero(p <= m + spill), np.flatnonzero(p > m - spill)
        if max(len(low), len(high)) <= 0.85 * len(x):
            return low, high
    return None


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge pairs into ``parent`` (least position wins), as a vectorised fixed point."""
    while True:
        ra, rb = parent[a], parent[b]
        if np.array_equal(ra, rb):
            return
        low = np.minimum(ra, rb)
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def tree_links(x: np.ndarray, threshold: float, seed: int, leaf: int = LEAF) -> np.ndarray:
    """Root position of every row after one tree over ``x`` (unit rows): its links' components."""
    parent = np.arange(len(x))
    rng = np.random.default_rng(seed)
    spill = spill_for(threshold, x.shape[1])
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        sides = split(x[own], rng, spill) if len(own) > leaf else None
        if sides:
            todo += [own[s] for s in sides]
            continue
        for at in range(0, len(own), 1024):
            rows = own[at : at + 1024]
            i, j = np.nonzero(x[rows] @ x[own[at:]].T >= threshold)
            off = i != j
            _union(parent, rows[i[off]], own[at:][j[off]])
    return parent


def fit_upper(sample: np.ndarray, depth: int, seed: int, threshold: float) -> list[tuple[np.ndarray, float, float]]:
    """Directions, medians and overlaps of the upper 2^depth - 1 splits, in heap order."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.ndarray, float, float]] = []
    held = [np.arange(len(sample))]
    for level in range(depth):
        below = []
        for own in held:
            d = rng.normal(size=sample.shape[1])
            d /= np.linalg.norm(d)
            p = sample[own] @ d if len(own) else np.zeros(1)
            m = float(np.median(p))
            # In a dense node the overlap is a tenth of its rows on each side, so that it shrinks.
            spill = min(spill_for(threshold, sample.shape[1]), float(np.quantile(np.abs(p - m), 0.2)))
            nodes.append((d, m, spill))
            below += [own[p <= m], own[p > m]] if len(own) else [own, own]
        held = below
    return nodes


def place(x: np.ndarray, nodes: list[tuple[np.ndarray, float, float]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs of all rows in an upper tree; rows near a median are in both leaves."""
    rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for level in range(depth):
        d = np.array([nodes[(1 << level) - 1 + k][0] for k in range(1 << level)])
        m = np.array([nodes[(1 << level) - 1 + k][1] for k in range(1 << level)])
        s = np.array([nodes[(1 << level) - 1 + k][2] for k in range(1 << level)])
        p = np.einsum("ij,ij->i", x[rows], d[at])
        low, high = p <= m[at] + s[at], p > m[at] - s[at]
        rows, at = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * at[low], 2 * at[high] + 1])
    return rows, at


def near_duplicates(
    df: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, trees: int = TREES, group: int = GROUP
) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    since = runtime.staged()
    v = df[vector]
    valid = (
        v.isNotNull() & df[label].isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        & F.exists(v, lambda e: e != 0)
    )
    rows = df.select(
        df[key].alias("k"), F.coalesce(valid, F.lit(False)).alias("valid"), df[label].cast("string").alias("label"),
        v.cast("array<double>").alias("v"),
    ).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit("vector"), "label", "v")})
    narrow = runtime.stage(rows.select("k", "valid", "h1", "h2"), "vector-rows")
    reps = rows.where("valid").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("k").alias("least")
    )
    reps = runtime.stage(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")

    links = runtime.stage(_forest(reps, threshold, trees, group), "links")
    roots = components(links, "rid", "root").select(F.col("node").alias("rid"), "root")
    joined = reps.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    joined = runtime.stage(joined, "rooted")
    counts = _degrees(joined, threshold)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    per = joined.join(counts, "rid", "left").join(least, "root").select(
        "h1", "h2", (F.coalesce("degree", "weight") - 1).alias("n_links"), "component_id"
    )
    out = narrow.where("valid").join(per, ["h1", "h2"]).select("k", "n_links", "component_id")
    alone = narrow.where("not valid").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    every = out.unionByName(alone).select(
        F.col("k").alias(key), F.col("n_links").cast("long"), F.col("component_id").cast("long"),
        F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
    return runtime.settle(every, "vector-groups", since)


_GROUP = ["tree", "leaf", "label", "dim"]
_PLACED = "tree int, leaf long, label string, dim int, rid long, v array<double>"


def _forest(reps: DataFrame, threshold: float, trees: int, group: int) -> DataFrame:
    """(rid, root) links: a spanning forest of every group of every tree."""
    spark = reps.sparkSession
    reps = reps.select("h1", "h2", "rid", "label", "v", F.size("v").alias("dim"))
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    large = sizes.where(F.col("most") > group).orderBy(F.desc("n"), "dim").limit(FIT_DIMS).collect()
    depths = {r["dim"]: min(FIT_DEPTH, int(np.ceil(np.log2(r["most"] / group)))) for r in large}
    upper: dict[tuple[int, int], list] = {}
    if depths:
        rank = F.row_number().over(Window.partitionBy("dim").orderBy("h1", "h2"))
        some = reps.where(F.col("dim").isin(*depths)).withColumn("rank", rank).where(F.col("rank") <= FIT_ROWS // len(depths))
        for dim, own in some.select("dim", "v").toPandas().groupby("dim"):
            for t in range(trees):
                upper[t, int(dim)] = fit_upper(_unit(own["v"].tolist()), depths[int(dim)], 1000 + t, threshold)
    shipped = spark.sparkContext.broadcast(upper)
    # Labels that need no group split, or a shallower tree, are placed by fewer of its levels.
    per_label = reps.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(group)))).cast("int").alias("depth"))
    sized = reps.join(per_label, ["label", "dim"], "left").select("rid", "label", "dim", "v", "depth")

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (dim, depth), own in frame.groupby(["dim", "depth"]):
                x, depth = _unit(own["v"].tolist()), min(int(depth), depths.get(int(dim), 0))
                for t in range(trees):
                    at, leaf = place(x, shipped.value[t, int(dim)], depth) if depth else (np.arange(len(x)), np.zeros(len(x), np.int64))
                    got = own.iloc[at]
                    yield pd.DataFrame({"tree": t, "leaf": leaf, "label": got["label"].values, "dim": int(dim), "rid": got["rid"].values, "v": got["v"].values})

    placed = sized.mapInPandas(leaves, _PLACED)
    found = []
    if large:
        placed, stuck = _deepen(placed, threshold, 2 * group)
        found.append(stuck)

    def link(own: pd.DataFrame) -> pd.DataFrame:
        x = _unit(own["v"].tolist())
        root = tree_links(x, threshold, int(own["tree"].iloc[0]) + 31)
        rid = own["rid"].to_numpy()
        at = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"rid": rid[at], "root": rid[root[at]]})

    out = placed.groupBy(*_GROUP).applyInPandas(link, "rid long, root long")
    for more in found:
        out = out.unionByName(more)
    return out


def _deepen(placed: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose groups have at most ``most`` vectors, links of what no pass could split).

    Every pass splits the larger groups once, at the median of a projection that is the group's own.
    """
    done: DataFrame | None = None
    before, passes = None, 0
    while True:
        placed = runtime.stage(placed, "placed")
        sizes = placed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
        small = placed.join(sizes.where(F.col("n") <= most).drop("n"), _GROUP, "left_semi")
        done = small if done is None else done.unionByName(small)
        over = sizes.where(F.col("n") > most)
        left = over.agg(F.max("n")).first()[0]
        if left is None or before is not None and left > 0.95 * before and passes > 3:
            break
        passes = passes + 1 if before is not None and left > 0.95 * before else 0
        before = left
        placed = _split_once(placed.join(over.drop("n"), _GROUP, "left_semi"), threshold)
    rest = placed.join(over.drop("n"), _GROUP, "left_semi")
    leader = rest.groupBy(*_GROUP).agg(F.min_by(F.struct("rid", "v"), "rid").alias("one"))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby("dim"):
                at = np.flatnonzero((_unit(own["v"].tolist()) * _unit(own["u"].tolist())).sum(axis=1) >= threshold)
                yield pd.DataFrame({"rid": own["rid"].to_numpy()[at], "root": own["root"].to_numpy()[at]})

    # A third of the rows may be one such group, so the join to its leader is dealt anew.
    star = rest.join(leader, _GROUP).select("dim", "rid", "v", F.col("one.rid").alias("root"), F.col("one.v").alias("u"))
    stuck = star.where("rid <> root").mapInPandas(near, "rid long, root long")
    blocks = rest.withColumn("leaf", F.xxhash64("leaf", F.pmod(F.xxhash64("rid"), F.ceil(F.lit(left or 1) / F.lit(most)))))
    return done.unionByName(blocks), stuck


def _split_once(placed: DataFrame, threshold: float) -> DataFrame:
    """Every group's rows on the sides of its median; those near it on both."""

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (t, leaf, dim), own in frame.groupby(["tree", "leaf", "dim"]):
                d = np.random.default_rng((int(t), int(leaf) & (1 << 63) - 1, int(dim))).normal(size=int(dim))
                yield own.assign(p=_unit(own["v"].tolist()) @ (d / np.linalg.norm(d)))

    at = runtime.stage(placed.mapInPandas(project, _PLACED + ", p double"), "projected")
    cuts = at.groupBy(*_GROUP).agg(F.percentile_approx("p", [0.4, 0.5, 0.6], 1000).alias("q"))
    cuts = cuts.select(*_GROUP, F.col("q")[1].alias("m"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"))
    wide = F.lit(1.3 * float(np.sqrt(max(0.0, 2 - 2 * threshold)))) / F.sqrt("dim")
    spill = F.least(wide, (F.col("high") - F.col("low")) / 2)
    both = at.join(cuts, _GROUP).withColumn("side", F.array_compact(F.array(
        F.when(F.col("p") <= F.col("m") + spill, F.lit(0)), F.when(F.col("p") > F.col("m") - spill, F.lit(1))
    )))
    one = both.withColumn("side", F.explode("side"))
    return one.select("tree", F.xxhash64("leaf", "side").alias("leaf"), "label", "dim", "rid", "v")


def _degrees(rooted: DataFrame, threshold: float) -> DataFrame:
    """(rid, degree): the weight of all representatives within reach of each, itself included."""
    size = rooted.groupBy("root").count().where("count > 1").withColumn("nb", F.ceil(F.col("count") / BLOCK).cast("int"))
    own = rooted.join(size, "root").select("root", "rid", "v", "weight", "nb", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int").alias("block"))
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    # Every block meets every block of its component, so a task holds two blocks whatever its size.
    targets = own.select("root", F.col("block").alias("tb"), others.alias("sb"), "rid", "v", "weight", F.lit(True).alias("target"))
    sources = own.select("root", others.alias("tb"), F.col("block").alias("sb"), "rid", "v", "weight", F.lit(False).alias("target"))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        t, s = frame[frame["target"]], frame[~frame["target"]]
        if not len(t) or not len(s):
            return pd.DataFrame({"rid": np.empty(0, np.int64), "near": np.empty(0, np.int64)})
        same = t["rid"].to_numpy()[:, None] == s["rid"].to_numpy()[None, :]
        near = (_unit(t["v"].tolist()) @ _unit(s["v"].tolist()).T >= threshold) | same
        return pd.DataFrame({"rid": t["rid"].to_numpy(), "near": near @ s["weight"].to_numpy()})

    # Dealt by pairs of blocks: a large component's own partition would hold all of them.
    dealt = targets.unionByName(sources).repartition("root", "tb", "sb")
    met = dealt.groupBy("root", "tb", "sb").applyInPandas(count, "rid long, near long")
    return met.groupBy("rid").agg(F.sum("near").alias("degree"))
