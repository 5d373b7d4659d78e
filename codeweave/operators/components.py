"""Connected components of an edge table by repeated contraction.

In a round every node takes the least of itself and its neighbours as its parent.  Parents are then
replaced by their own parents until nothing moves, so every node has the root of its tree after as many
steps as the depth has binary digits, and the edges are rewritten to the roots.  Every node that still has an
edge shares its tree with another, so each round at least halves the nodes; stars and ordered chains, the
usual cases here, vanish in one.  Tables are staged in the shared folder and deleted once they are used, nothing
is collected, and minima are combined before the shuffle.

Defined cases: loops and repeated edges change nothing; an edge with a null end is left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import runtime


def _jump(parent: DataFrame) -> DataFrame:
    """(node, root, moved): every node's root replaced by the root of that."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return parent.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("root") != F.col("higher")).alias("moved"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the least node reachable."""
    edges = runtime.stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = runtime.stage(_jump(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))), "parents")
        while not parent.where("moved").isEmpty():
            before, parent = parent, runtime.stage(_jump(parent), "parents")
            runtime.discard(before)
        pa = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        before, edges = edges, runtime.stage(moved.distinct(), "edges")
        runtime.discard(before)
        if labels is None:
            labels = parent
            continue
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        before, labels = labels, runtime.stage(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "labels")
        runtime.discard(before, parent)
    runtime.discard(edges)
    return labels.select("node", "root")
