"""Summaries of shared modules, level by level.

A module's prompt holds the summaries of its direct dependencies, so a topological level is a
barrier; within a level all modules are asked in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.functions import prompts
from codeweave.functions.strict_json import ReplyError, replies
from codeweave.operators import changes, fanout, graph, schema, skeleton, symbols
from codeweave.sources.client import Client

_SHAPE = {"summary": str, "key_types": [str], "key_functions": [{"name": str, "signature": str, "ref": str}], "source_refs": [str]}


def module_skeletons(modules: DataFrame, index: DataFrame, budget: int) -> DataFrame:
    """(module_id, skeleton) of every module."""
    scopes = modules.select(F.col("id").alias("scope"), F.explode("files").alias("path"))
    got = skeleton.skeletons(skeleton.scoped_lines(index, scopes), budget).select(F.col("scope").alias("module_id"), "skeleton")
    return modules.select(F.col("id").alias("module_id")).join(got, "module_id", "left").select("module_id", F.coalesce("skeleton", F.lit("")).alias("skeleton"))


def _parsed(results: DataFrame) -> DataFrame:
    kind = f"struct<summary:string,key_types:array<string>,key_functions:array<{schema.KEY_FUNCTION}>,source_refs:array<string>>"
    got = runtime.stage(replies(results, "module_id", "content", _SHAPE, kind), "replies")
    bad = got.where("problem is not null").orderBy("module_id").first()
    if bad:
        raise ReplyError(f"module {bad['module_id']}: {bad['problem']}")
    return got.select("module_id", "value.*")


def summarise(
    modules: DataFrame, index: DataFrame, edges: DataFrame, client: Client, budget: int, request: dict, concurrency: int = 4,
    affected: DataFrame | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    """The shared context of a plan; with ``affected`` (module_id), rows of ``existing`` that nothing
    touched are carried over and only the rest is asked for.  The first failure raises."""
    spark = modules.sparkSession
    shared = modules.where("shared").select(F.col("id").alias("module_id"))
    module_edges = runtime.stage(graph.contract(edges, modules), "module-edges")
    order = graph.topological_order([r[0] for r in shared.toLocalIterator()], [tuple(r) for r in module_edges.toLocalIterator()])
    context = spark.createDataFrame([], schema.SHARED_CONTEXT)
    if not order:
        return context
    todo = shared
    if affected is not None:
        reuse, todo = changes.carry_over(existing if existing is not None else context, shared, affected)
        context = reuse.select(context.columns)
    todo = runtime.stage(todo, "to-summarise")
    levels = graph.topological_levels(shared.withColumnRenamed("module_id", "node"), module_edges).withColumnRenamed("node", "module_id")
    levels = runtime.stage(levels.join(todo, "module_id", "left_semi"), "levels")
    texts = runtime.stage(module_skeletons(modules.where("shared"), index, budget), "skeletons")
    files = graph.module_files(modules).select("module_id", "path")
    for (level,) in levels.select("level").distinct().orderBy("level").toLocalIterator():
        own = levels.where(F.col("level") == level).select("module_id")
        told = module_edges.join(context.select(F.col("module_id").alias("dst"), "summary"), "dst").groupBy(F.col("src").alias("module_id"))
        told = told.agg(F.collect_list(F.struct(F.col("dst").alias("id"), "summary")).alias("deps"))
        none = F.array().cast("array<struct<id:string,summary:string>>")
        asked = own.join(texts, "module_id").join(told, "module_id", "left").select(
            "module_id", F.lit(request.get("model", "")).alias("model"), F.lit("").alias("system"),
            prompts.shared_summary(F.col("module_id"), F.col("skeleton"), F.coalesce("deps", none)).alias("user"),
            F.lit(request.get("max_tokens", 0)).alias("max_tokens"), F.lit(request.get("temperature", 0.0)).cast("float").alias("temperature"),
        )
        got = fanout.run(asked, client, concurrency)
        fanout.raise_failures(got)
        context = runtime.stage(context.unionByName(symbols.ground_summaries(_parsed(got), index, files)), "shared-context")
    return context
