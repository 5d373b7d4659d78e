"""Module plans: asked of a completion service and checked, or computed from the file graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import prompts, text
from codeweave.functions.strict_json import ReplyError, parse_reply
from codeweave.operators import graph, integrity, skeleton
from codeweave.operators.schema import AGENT, PREPROCESSOR
from codeweave.sources.artifacts import modules_frame
from codeweave.sources.client import Client, Request

ATTEMPTS = 3
_SHAPE = {"modules": [{"id": str, "files": [str], "shared": bool, "owner": str, "depends_on_shared": [str], "referenced_by": [str]}]}


class PlanError(ValueError):
    """No attempt gave a usable plan; the message has every attempt's problem."""


def full_skeleton(index: DataFrame, budget: int) -> str:
    scopes = index.select(F.lit("all").alias("scope"), "path")
    row = skeleton.skeletons(skeleton.scoped_lines(index, scopes), budget).first()
    return row["skeleton"] if row else ""


def ask_plan(index: DataFrame, client: Client, budget: int, threshold: int, **request) -> list[dict]:
    """The first reply of at most three that parses and violates nothing; each problem is told to the
    next attempt.  A transport error ends it at once."""
    prompt, found = prompts.planner(full_skeleton(index, budget), threshold), []
    for attempt in range(ATTEMPTS):
        reply = client.complete(Request(prompt, **request))
        try:
            modules = parse_reply(reply, _SHAPE)["modules"]
            bad = integrity.first_violation(integrity.violations(modules_frame(index.sparkSession, modules), index)).first()
            if bad is None:
                return modules
            problem = integrity.message(bad)
        except ReplyError as e:
            problem = f"not the JSON asked for: {e}"
        found.append(f"attempt {attempt + 1}: {problem}")
        prompt = prompts.retry_note(prompt, problem)
    raise PlanError("; ".join(found))


def computed_plan(index: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """A deterministic plan: a module per directory, shared where ``threshold`` others use it.

    ``depends_on_shared`` and ``referenced_by`` come from the file graph.
    """
    owned = index.select(text.dirname(F.col("path")).alias("id"), "path")
    lists = owned.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("files"))
    a = owned.select(F.col("path").alias("src"), F.col("id").alias("a"))
    b = owned.select(F.col("path").alias("dst"), F.col("id").alias("b"))
    uses = edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    shared = graph.users_of(uses, threshold).select(F.col("node").alias("id"), F.lit(True).alias("shared"))
    by = uses.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("referenced_by"))
    on = uses.join(shared.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("depends_on_shared"))
    none = F.array().cast("array<string>")
    joined = lists.join(shared, "id", "left").join(by, "id", "left").join(on, "id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return joined.select(
        F.replace("id", F.lit("/"), F.lit("-")).alias("id"), "files", "shared",
        F.when(F.col("shared"), PREPROCESSOR).otherwise(AGENT).alias("owner"),
        F.transform(F.coalesce("depends_on_shared", none), lambda x: F.replace(x, F.lit("/"), F.lit("-"))).alias("depends_on_shared"),
        F.transform(F.coalesce("referenced_by", none), lambda x: F.replace(x, F.lit("/"), F.lit("-"))).alias("referenced_by"),
    )
