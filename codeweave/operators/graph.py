"""Dependency graphs as edge tables (src, dst): adjacency, reversal, closure, contraction, order, depth.

Nodes without edges are rows of a node table, as an edge table cannot hold them.  Fixpoints run as
frontier loops; every round is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  A round joins the frontier with the edges on the node id; only
the frontier and the edges it touches are shuffled, and nothing is collected but counts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import runtime


class CycleError(ValueError):
    """The graph has no topological order."""


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, deps): the sorted targets of every node, repeats kept; nodes without edges get []."""
    lists = edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_list("dst")).alias("deps"))
    return nodes.select("path").join(lists, "path", "left").select("path", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reverse_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, deps) of the reversed graph; targets that are no nodes get rows too."""
    every = nodes.select("path").unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    return adjacency(every, reverse(edges))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) reached from the seeds (column ``node``), the seeds included; safe on cycles."""
    step = runtime.stage(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    frontier = runtime.stage(seeds.select("node").where("node is not null").distinct(), "reached")
    rounds = [frontier]
    while not frontier.isEmpty():
        found = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        for old in rounds:
            found = found.join(old, "node", "left_anti")
        frontier = runtime.stage(found, "reached")
        rounds.append(frontier)
        if len(rounds) > 8:  # merge what is known, so that a deep graph does not add a join a round
            known = rounds[0]
            for more in rounds[1:]:
                known = known.unionByName(more)
            rounds = [runtime.stage(known, "reached")]
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def module_files(modules: DataFrame) -> DataFrame:
    """(module_id, pos, path, file_pos) of a plan."""
    return modules.select(F.col("id").alias("module_id"), "pos", F.posexplode("files").alias("file_pos", "path"))


def owner_of(files: DataFrame) -> DataFrame:
    """(path, module_id): of several modules with the same file the last in plan order owns it."""
    return files.groupBy("path").agg(F.max_by("module_id", F.struct("pos", "file_pos")).alias("module_id"))


def owning_modules(changes: DataFrame, files: DataFrame, include_old_path: bool = False) -> DataFrame:
    """(module_id) of the changed files; files in no module are left out.  Only new paths count
    unless ``include_old_path``."""
    paths = changes.select("path")
    if include_old_path:
        paths = paths.unionByName(changes.where("old_path <> ''").select(F.col("old_path").alias("path")))
    return paths.join(owner_of(files), "path").select("module_id").distinct()


def affected(changes: DataFrame, modules: DataFrame, edges: DataFrame, include_old_path: bool = False) -> DataFrame:
    """The rows of ``modules`` that a change reaches, by id.

    Seeds are all files of the modules that own a changed file; from there the closure runs over the
    reversed file edges, through files of no module too, and every owner met is affected.
    """
    files = module_files(modules)
    hit = owning_modules(changes, files, include_old_path)
    seeds = files.join(hit, "module_id", "left_semi").select(F.col("path").alias("node"))
    reached = reachable(reverse(edges), seeds)
    owners = reached.join(owner_of(files), reached["node"] == F.col("path")).select("module_id")
    ids = owners.unionByName(hit).distinct().withColumnRenamed("module_id", "id")
    return modules.join(ids, "id", "left_semi").orderBy("id")


def contract(edges: DataFrame, modules: DataFrame, only_shared: bool = True) -> DataFrame:
    """Distinct module edges (src, dst) that file edges induce between different modules."""
    kept = modules.where("shared") if only_shared else modules
    owned = owner_of(module_files(kept))
    a = owned.select(F.col("path").alias("src"), F.col("module_id").alias("a"))
    b = owned.select(F.col("path").alias("dst"), F.col("module_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def topological_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Dependencies first; of all nodes that are ready the bytewise least comes next.

    Inherently one step after another, so it takes a contracted module graph on the driver.  An edge
    (a, b) says that a depends on b; a dependency that is no node is never ready.
    """
    waiting = {n: 0 for n in nodes}
    users: dict[str, list[str]] = {}
    for a, b in edges:
        waiting[a] += 1
        users.setdefault(b, []).append(a)
    ready = [(n.encode(), n) for n, k in waiting.items() if k == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, n = heapq.heappop(ready)
        out.append(n)
        for user in users.get(n, ()):
            waiting[user] -= 1
            if waiting[user] == 0:
                heapq.heappush(ready, (user.encode(), user))
    if len(out) < len(waiting):
        stuck = sorted((n for n, k in waiting.items() if k > 0), key=str.encode)
        raise CycleError("dependency cycle among " + ", ".join(stuck))
    return out


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes without dependencies, else one more than the deepest dependency.

    The distributed counterpart of ``topological_order``: levels are barriers, and (level, node) is a
    valid order, though not the same one.  Nodes on a cycle, or above one, get no row.
    """
    nodes = nodes.select("node").distinct()
    left = runtime.stage(edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi"), "edges")
    ready = runtime.stage(nodes.join(left.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)), "ready")
    out = ready
    level = 0
    while not ready.isEmpty():
        level += 1
        met = ready.select(F.col("node").alias("dst"))
        freed = left.join(met, "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        left = runtime.stage(left.join(met, "dst", "left_anti"), "edges")
        # A node is ready when its last edge has gone.
        ready = freed.join(left.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(level))
        ready = runtime.stage(ready, "ready")
        out = out.unionByName(ready)
    return out.select("node", "level")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path from the node; entering a node that is already on the
    path counts one edge and ends it.

    Acyclic parts take one round a level.  Nodes on or above a cycle are expanded path by path, which
    is exponential in the cycle's density, as the definition is.
    """
    every = nodes.select("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    flat = runtime.stage(topological_levels(every, edges).withColumnRenamed("level", "depth"), "depths")
    rest = runtime.stage(every.join(flat, "node", "left_anti"), "cyclic")
    if rest.isEmpty():
        return flat
    step = edges.select("src", "dst").distinct()
    paths = rest.select("node", F.array("node").alias("path"))
    best = []
    while True:
        last = F.element_at("path", -1)
        grown = paths.join(step, last == step["src"]).join(flat.withColumnRenamed("node", "dst").withColumnRenamed("depth", "below"), "dst", "left")
        ends = F.col("below").isNotNull() | F.array_contains("path", F.col("dst"))
        grown = runtime.stage(grown.select("node", "path", "dst", F.coalesce("below", F.lit(0)).alias("below"), ends.alias("ends")), "paths")
        best.append(grown.select("node", (F.size("path") + F.col("below")).alias("depth")))
        paths = grown.where("not ends").select("node", F.concat("path", F.array("dst")).alias("path"))
        if paths.isEmpty():
            break
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    return flat.unionByName(found.groupBy("node").agg(F.max("depth").cast("int").alias("depth")))


def users_of(edges: DataFrame, threshold: int) -> DataFrame:
    """(node, users): nodes with at least ``threshold`` distinct users; the rule for sharing a module."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("users")).where(F.col("users") >= threshold)
