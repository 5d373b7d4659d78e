"""Near-duplicate documents by a Chosen-Path set similarity join.

Documents with equal shingle sets are one representative.  Each representative has a signature of
minwise hashes, ``POOL`` of its own for every tree.  In each of several independent trees a representative walks
down from the root: a node chooses (by a hash of the path so far) one or two positions of the tree's values, and the
values there name the children to enter.  Similar documents choose the same children with a probability equal to
their similarity at each step, so they meet in some leaf of some tree, while others part.  In nodes
that are still large, members are compared with one of them, the leader; those that resemble it
join its candidates, and those that are not close to it branch further.  Small nodes are compared exhaustively on
signatures, which leaves a spanning forest of likely links; what it connects is a candidate cluster, and links are
confirmed within clusters on the full shingle sets.

Confirmation never holds an unbounded group: a large cluster is cut into blocks by shingle count.
Blocks are resolved by themselves, then some members of every block's components are compared with
those of other blocks, and every member outside the cluster's largest component so far is finally
compared with all members of the other blocks.

Two texts at the threshold of 0.85 fail to meet in a tree with a probability of 0.22 and in all six
``TREES`` with 1e-4; at 0.80 with 0.35, and in nine trees with 8e-5 (the recursion over the branches, averaged over
the values of a tree; a test measures both).  Pairs whose estimated similarity is ``SIGMAS`` standard deviations below the
threshold are not compared, which loses a link with a probability below 1e-6.

Defined cases: a text of fewer words than a shingle has its whole word sequence as its only
shingle; null, empty and blank texts have none and link with nothing; repeated rows are documents
of their own; ids are integers, or text that holds one (others are an error of the cast), and a null id sorts
before all others; an empty table gives no rows; other columns are
carried by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import shingles, tokens
from codeweave.llm.components import components

#: Minwise values of each tree.
POOL = 24
TREES = 6
BRANCHES = (2, 1, 2, 1, 2, 1, 1, 1)
DEEPER = (2, 1, 2, 1)
NODE = 64
#: Estimated similarity with the leader of a large node from which a member joins its candidate cluster.
STAR = 0.35
SIGMAS = 5.0
#: Shingles of a block of a cluster; a task holds two blocks.
BLOCK = 100_000
#: Bytes of shingle sets to a task.
TASK_BYTES = 2 << 20
#: Minwise values that are compared within a block.
WITHIN = 128
LEADERS = 8
NULL_ID = -(1 << 63)
#: A node's lowest bits are those of its tree.
_TREE = np.uint64(15)


def close_enough(percent: int) -> float:
    """The estimated similarity with a leader from which a member need not branch further: by the triangle of
    distances all that it may be linked with are in the leader's candidate cluster, with a tenth to spare."""
    return STAR + (1 - percent / 100) + 0.1


def least_near(percent: int, values: int) -> float:
    """The estimated similarity, over so many minwise values, below which a pair is not compared."""
    j = percent / 100
    return j - SIGMAS * float(np.sqrt(j * (1 - j) / values))


def descend(sig: np.ndarray, nodes: np.ndarray, branches: tuple[int, ...], level: int = 0) -> np.ndarray:
    """All nodes that each row of ``sig`` reaches from its node in ``nodes``: rows x leaves."""
    at = nodes[:, None]
    tree = at & _TREE
    first = tree.astype(np.int64) * POOL
    rows = np.arange(len(sig))[:, None]
    for step, width in enumerate(branches):
        below = []
        for b in range(width):
            pick = shingles.mix(at + np.uint64(((level + step) * 8 + b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            position = first + (pick >> np.uint64(32)).astype(np.int64) % POOL
            below.append(shingles.mix(pick ^ sig[rows, position].astype(np.uint64)) & ~_TREE | tree)
        at = np.concatenate(below, axis=1)
    return at


def _roots(trees: int) -> np.ndarray:
    each = np.arange(trees, dtype=np.uint64)
    return shingles.mix((each + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) & ~_TREE | each


def _unpack(column: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), -1)


def link_sets(flat: np.ndarray, off: np.ndarray, percent: int, groups: np.ndarray | None = None) -> np.ndarray:
    """Root position of every set under links of Jaccard >= percent / 100, counted on the sets.

    Every set in turn is compared with the later ones that are not yet connected with it and that
    size and signature (``least_near``) allow; with ``groups``, only with sets of another group.
    """
    n = len(off) - 1
    parent = np.arange(n)
    size = np.diff(off)
    sig, slack = shingles.minima(flat, off, WITHIN, 11), least_near(percent, WITHIN)
    for i in range(n):
        if size[i] == 0:
            continue
        j = np.flatnonzero(parent[i + 1 :] != parent[i]) + i + 1
        j = j[(np.minimum(size[j], size[i]) * 100 >= percent * np.maximum(size[j], size[i])) & (size[j] > 0)]
        if groups is not None and len(j):
            j = j[groups[j] != groups[i]]
        if len(j):
            j = j[(sig[j] == sig[i]).mean(axis=1) >= slack]
        for at in range(0, len(j), 256):
            some = j[at : at + 256]
            own = flat[off[i] : off[i + 1]]
            parts = [flat[off[x] : off[x + 1]] for x in some]
            them = np.concatenate(parts)
            where = np.minimum(np.searchsorted(own, them), len(own) - 1)
            cuts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
            both = np.add.reduceat((own[where] == them).astype(np.int64), cuts)
            for x in some[both * 100 >= percent * (size[some] + size[i] - both)]:
                a, b = parent[i], parent[x]
                if a != b:
                    parent[parent == max(a, b)] = min(a, b)
    return parent


def sketches(df: DataFrame, key: str, text: str, width: int = 5, trees: int = TREES) -> DataFrame:
    """Per row: k, th (hash of the text), n, s1, s2 (digest of its shingle set), sig."""
    if trees > int(_TREE) + 1:
        raise ValueError("at most 16 trees")
    rows = df.select(F.coalesce(df[key].cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(df[text]).alias("th"), df[text].alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "t", 512 << 10):
            flat, off = shingles.shingle_sets(batch.column("t"), width)
            run = np.zeros((2, len(flat) + 1), dtype=np.uint64)
            for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                np.cumsum(shingles.mix(flat ^ np.uint64(salt)), out=run[j, 1:])
            digest = (run[:, off[1:]] - run[:, off[:-1]]).astype(np.uint64).view(np.int64)
            sig = shingles.minima(flat, off, POOL * trees, 10).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), batch.column("th"), pa.array(np.diff(off)), pa.array(digest[0]), pa.array(digest[1]),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["k", "th", "n", "s1", "s2", "sig"],
            )

    return rows.mapInArrow(sketch, "k long, th long, n long, s1 long, s2 long, sig binary")


def _walk(reps: DataFrame, trees: int) -> DataFrame:
    """(node, rid) for every leaf of every tree that a representative reaches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column("sig").to_pylist())
            rid = batch.column("rid").to_numpy()
            leaves = [descend(sig, np.full(len(sig), root), BRANCHES) for root in _roots(trees)]
            nodes = np.concatenate(leaves, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(rid, nodes.shape[1]))], names=["node", "rid"]
            )

    return reps.select("rid", "sig").mapInArrow(walk, "node long, rid long")


def _branch_further(entries: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column("sig").to_pylist())
            nodes = descend(sig, batch.column("node").to_numpy().view(np.uint64), DEEPER, level)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rid").to_numpy(), nodes.shape[1]))],
                names=["node", "rid"],
            )

    return entries.join(reps.select("rid", "sig"), "rid").select("node", "rid", "sig").mapInArrow(walk, "node long, rid long")


def _sized(entries: DataFrame) -> DataFrame:
    """Nodes of two members at least: node, members, and a digest of the set of members."""
    return (
        entries.groupBy("node")
        .agg(F.count(F.lit(1)).alias("members"), F.sum(F.shiftright(F.xxhash64("rid"), 24)).alias("digest"), F.min("rid").alias("leader"))
        .where("members > 1")
    )


def _candidates(reps: DataFrame, trees: int, percent: int) -> DataFrame:
    """(rid, root): a spanning forest of the likely links of every node."""
    found: list[DataFrame] = []
    entries = runtime.stage(_walk(reps, trees), "paths")
    level = len(BRANCHES)
    for last in (False, False, True):
        sized = runtime.stage(_sized(entries), "nodes")
        # Trees often gather the same members; one node of each such set is enough.
        small = sized.where(F.col("members") <= NODE).groupBy("digest", "members", "leader").agg(F.min("node").alias("node"))
        own = entries.join(small.select("node"), "node").join(reps.select("rid", "sig"), "rid").select("node", "rid", "sig")
        found.append(_compare_nodes(own, percent))
        large = sized.where(F.col("members") > NODE).groupBy("digest", "members").agg(F.min_by(F.struct("node", "leader"), "node").alias("x")).select("x.node", "x.leader")
        if large.isEmpty():
            break
        rest = runtime.stage(entries.join(large, "node"), "large-nodes")
        if last:  # what is still large: its members are one candidate cluster
            found.append(rest.select("rid", F.col("leader").alias("root")).distinct())
            break
        # Nodes share leaders, so a member is compared with each once, whatever the nodes where they meet.
        near = runtime.stage(_near_leader(rest.select("rid", "leader").distinct(), reps), "near-leader")
        found.append(near.where(F.col("near") >= STAR).select("rid", F.col("leader").alias("root")))
        apart = near.where(F.col("near") < close_enough(percent)).select("rid", "leader")
        entries = runtime.stage(_branch_further(rest.join(apart, ["rid", "leader"], "left_semi").select("node", "rid"), reps, level).distinct(), "paths")
        level += len(DEEPER)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _near_leader(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rid, leader, near): each member's estimated similarity with the leader of a large node."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_unpack(batch.column("sig").to_pylist()) == _unpack(batch.column("led").to_pylist())).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "leader")), pa.array(near)], names=["rid", "leader", "near"])

    both = pairs.join(reps.select("rid", "sig"), "rid").join(reps.select(F.col("rid").alias("leader"), F.col("sig").alias("led")), "leader")
    return both.select("rid", "leader", "sig", "led").mapInArrow(compare, "rid long, leader long, near double")


def _compare_nodes(own: DataFrame, percent: int) -> DataFrame:
    """Compare every pair of a small node on signatures; report what connects them."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sig, rid = _unpack(frame["sig"].tolist()), frame["rid"].to_numpy()
        near = (sig[:, None, :] == sig[None, :, :]).mean(axis=2) >= least_near(percent, sig.shape[1])
        root = np.arange(len(rid))
        while True:
            low = np.where(near, root[None, :], len(rid)).min(axis=1)
            if np.array_equal(low, root):
                break
            root = low
        at = np.flatnonzero(root != np.arange(len(rid)))
        return pd.DataFrame({"rid": rid[at], "root": rid[root[at]]})

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in batches:
            held = frame if held is None else pd.concat([held, frame])
            last = held["node"].iloc[-1]
            ready, held = held[held["node"] != last], held[held["node"] == last]
            out = [compare(g) for _, g in ready.groupby("node", sort=False)]
            if out:
                yield pd.concat(out)
        if held is not None and len(held):
            yield compare(held)

    spread = own.repartition("node").sortWithinPartitions("node")
    return spread.mapInPandas(nodes, "rid long, root long").distinct()


def _sets(df: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(cluster, rid, n, set) of the wanted representatives, shingled again from one row's text each."""
    rows = df.select(F.coalesce(df[key].cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(df[text]).alias("th"), df[text].alias("t"))
    one = rows.join(wanted, ["k", "th"]).groupBy("rid", "cluster").agg(F.min("t").alias("t"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "t", 512 << 10):
            flat, off = shingles.shingle_sets(batch.column("t"), width)
            sets = [flat[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), batch.column("rid"), pa.array(np.diff(off)), pa.array(sets, pa.binary())],
                names=["cluster", "rid", "n", "set"],
            )

    return one.select("cluster", "rid", "t").mapInArrow(shingle, "cluster long, rid long, n long, set binary")


def _load(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(frame["n"].to_numpy())))
    return np.frombuffer(b"".join(frame["set"]), dtype=np.uint64), off


def _confirm(sets: DataFrame, percent: int) -> DataFrame:
    """(rid, root): confirmed links that connect every true component within its cluster."""
    size = sets.groupBy("cluster").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK)).cast("int")
    keyed = sets.join(size.select("cluster", blocks.alias("nb")), "cluster")
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    keyed = runtime.stage(keyed, "sets")

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rid")
        flat, off = _load(frame)
        root, rid = link_sets(flat, off, percent), frame["rid"].to_numpy()
        return pd.DataFrame({"rid": rid, "root": rid[root]})

    # A fixed number of partitions: comparing costs far more than its bytes tell.
    dealt = keyed.repartition(runtime.parts_for(keyed, TASK_BYTES), "cluster", "block")
    first = runtime.stage(dealt.groupBy("cluster", "block").applyInPandas(within, "rid long, root long"), "within")
    edges = first.where("rid <> root")
    large = keyed.where("nb > 1")
    if large.isEmpty():
        return edges

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rid")
        flat, off = _load(frame)
        root, rid = link_sets(flat, off, percent, frame["part"].to_numpy()), frame["rid"].to_numpy()
        at = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"rid": rid[at], "root": rid[root[at]]})

    # A few members of every block's components against those of the other blocks, in groups of blocks.
    held = large.join(first, "rid")
    rank = F.row_number().over(Window.partitionBy("cluster", "block", "root").orderBy("rid"))
    leaders = held.withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    by_pair = _pairs_of_blocks(leaders, leaders)
    met = runtime.stage(by_pair.groupBy("cluster", "tb", "sb").applyInPandas(across, "rid long, root long"), "leaders")
    so_far = components(edges.unionByName(met), "rid", "root").withColumnRenamed("node", "rid").withColumnRenamed("root", "comp")
    held = held.join(so_far, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    weight = held.groupBy("cluster", "comp").count()
    main = weight.groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rest = held.join(main, "cluster").where("comp <> main").drop("main")
    by_pair = _pairs_of_blocks(rest, held)
    met = met.unionByName(runtime.stage(by_pair.groupBy("cluster", "tb", "sb").applyInPandas(across, "rid long, root long"), "rest"))
    return edges.unionByName(met)


def _pairs_of_blocks(some: DataFrame, every: DataFrame) -> DataFrame:
    """``some`` sent to all blocks of its cluster, ``every`` kept in its own; by block pair."""
    cols = ["cluster", "rid", "n", "set"]
    to = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("sb")
    sent = some.select(*cols, F.col("block").alias("tb"), to, F.lit(0).alias("part"))
    stay = every.select(*cols, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("tb"), F.col("block").alias("sb"), F.lit(1).alias("part"))
    busy = some.select("cluster", F.col("block").alias("tb")).distinct()
    stay = stay.join(busy, ["cluster", "tb"], "left_semi")
    # Dealt by pairs of blocks: a large cluster's own partition would hold all of them.
    return sent.unionByName(stay.select(sent.columns)).where("tb <> sb").repartition("cluster", "tb", "sb")


def near_duplicates(
    df: DataFrame, key: str, text: str, percent: int = 85, width: int = 5, trees: int = TREES
) -> DataFrame:
    """Per row: k (id, NULL_ID for null), th (hash of the text), n_shingles, root (names the group; null
    without words), component (least k of the group)."""
    spark, since = df.sparkSession, runtime.staged()
    with tokens.bounded_batches(spark), runtime.tidy(spark):
        return _grouped(df, key, text, percent, width, trees, since)


def _grouped(df: DataFrame, key: str, text: str, percent: int, width: int, trees: int, since: frozenset[str]) -> DataFrame:
    rows = runtime.stage(sketches(df, key, text, width, trees), "sketches")
    reps = (
        rows.where("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min(F.struct("k", "th")).alias("one"), F.first("sig").alias("sig"), F.first("n").alias("n"))
        .select("s1", "s2", "one.k", "one.th", "sig", "n")
    )
    reps = runtime.stage(reps.withColumn("rid", F.monotonically_increasing_id()), "representatives")
    clusters = components(_candidates(reps, trees, percent), "rid", "root").withColumnRenamed("node", "rid").withColumnRenamed("root", "cluster")
    wanted = reps.select("rid", "k", "th").join(clusters, "rid")
    links = _confirm(_sets(df, key, text, wanted, width), percent)
    roots = components(links, "rid", "root").withColumnRenamed("node", "rid")
    rooted = runtime.stage(
        reps.select("rid", "s1", "s2", "k").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "rooted"
    )
    least = rooted.groupBy("root").agg(F.min("k").alias("component"))
    found = rooted.join(least, "root").select("s1", "s2", "root", "component")
    linked = rows.where("n > 0").join(found, ["s1", "s2"]).select("k", "th", F.col("n").alias("n_shingles"), "root", "component")
    alone = rows.where("n = 0").select("k", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("k").alias("component"))
    return runtime.settle(linked.unionByName(alone), "groups", since)


def near_duplicate_table(df: DataFrame, key: str, text: str, percent: int = 85, width: int = 5) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept."""
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return near_duplicates(df, key, text, percent, width).select(
        real("k").alias(key), "n_shingles", real("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept")
    )


def keep_one(df: DataFrame, key: str, text: str, percent: int = 80, width: int = 5, trees: int = TREES) -> DataFrame:
    """The rows of ``df``, one of each group of near-duplicates: that of the least id, and of rows that
    share this id the one of least text hash.  Rows without words all stay."""
    groups = near_duplicates(df, key, text, percent, width, trees)
    first = groups.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("k", "th")).alias("one")).select("one.k", "one.th")
    stay = first.unionByName(groups.where("n_shingles = 0").select("k", "th").distinct())
    stay = stay.select(F.col("k").alias("_k"), F.col("th").alias("_th"))
    rows = df.select(
        F.struct("*").alias("row"), F.coalesce(df[key].cast("long"), F.lit(NULL_ID)).alias("_k"), F.xxhash64(df[text]).alias("_th"),
        (F.length(F.regexp_replace(F.coalesce(df[text], F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", "")) == 0).alias("_blank"),
    )
    rows = rows.join(stay, ["_k", "_th"], "left_semi")
    each = F.when(F.col("_blank"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    one = rows.withColumn("_each", each).groupBy("_k", "_th", "_each").agg(F.first("row").alias("row"))
    return one.select("row.*")
