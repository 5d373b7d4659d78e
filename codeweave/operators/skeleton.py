"""Code skeletons: one line per declaration, fitted to a token budget.

A scope is what one prompt is about (a module, a repository, a document).  Lines that are always
kept are admitted first whatever the budget; the others are tried in order, and one that does not
fit is skipped without using any budget, so a later, shorter one may still fit.  What is then over
the budget is cut to its longest prefix within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.functions import text


def lines_of(index: DataFrame) -> DataFrame:
    """(path, part, ord, line, always) of every file: a header, then functions, then types."""
    head = index.select("path", F.lit(0).alias("part"), F.lit(0).alias("ord"), text.header_line(F.col("path")).alias("line"), F.lit(True).alias("always"))
    f, t = index.select("path", F.posexplode("functions").alias("ord", "d")), index.select("path", F.posexplode("types").alias("ord", "d"))
    f = f.select("path", F.lit(1).alias("part"), "ord", text.function_line(F.col("d.signature"), F.col("path"), F.col("d.line_start")).alias("line"), F.col("d.exported").alias("always"))
    t = t.select("path", F.lit(2).alias("part"), "ord", text.type_line(F.col("d.name"), F.col("d.kind"), F.col("path"), F.col("d.line_start")).alias("line"), F.col("d.exported").alias("always"))
    return head.unionByName(f).unionByName(t)


def scoped_lines(index: DataFrame, scopes: DataFrame) -> DataFrame:
    """Lines of the files of each scope (scope, path); files that are not indexed are left out."""
    return scopes.select("scope", "path").distinct().join(lines_of(index), "path").select("scope", F.struct("path", "part", "ord").alias("pos"), "line", "always")


def _after(size: Column, more: Column) -> Column:
    """Estimate of a text of ``size`` bytes with a further line of ``more`` bytes."""
    return text.tokens_of(F.when(size > 0, size + 1 + more).otherwise(more))


def fill(lines: DataFrame, budget: int) -> DataFrame:
    """``lines`` (scope, pos, line, always) with ``kept``.

    What is left of a budget only shrinks, so of the optional lines of one size a prefix is taken, and no more
    than the budget holds: only these, and as sizes, not texts, come together in one row of a scope.  (Lines
    without any text do, all of them, as they cost nothing where nothing is before them.)
    """
    size = F.octet_length("line").cast("long")
    sized = lines.select("scope", "pos", "always", size.alias("size"))
    must = sized.groupBy("scope").agg(F.sum(F.when(F.col("always"), F.col("size") + 1)).alias("must"))
    nth = F.row_number().over(Window.partitionBy("scope", "size").orderBy("pos"))
    few = sized.where("not always and size > 0").withColumn("nth", nth).where(F.col("nth") <= 4 * budget + 4)
    few = few.where(F.col("nth") * (F.col("size") + 1) <= 4 * budget + 4).select("scope", "pos", "size")
    few = few.unionByName(sized.where("not always and size = 0").select("scope", "pos", "size"))
    per = few.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("may")).join(must, "scope")
    start = F.struct(F.greatest(F.coalesce("must", F.lit(0)) - 1, F.lit(0)).cast("long").alias("size"), F.slice("may", F.lit(1), F.lit(0)).alias("in"))

    def step(acc: Column, x: Column) -> Column:
        fits = _after(acc["size"], x["size"]) <= budget
        grown = F.when(acc["size"] > 0, acc["size"] + 1 + x["size"]).otherwise(x["size"])
        return F.when(fits, F.struct(grown.alias("size"), F.concat(acc["in"], F.array(x)).alias("in"))).otherwise(acc)

    taken = F.aggregate("may", start, step)["in"]
    chosen = per.select("scope", F.explode(F.transform(taken, lambda x: x["pos"])).alias("pos")).withColumn("hit", F.lit(True))
    return lines.join(chosen, ["scope", "pos"], "left").withColumn("kept", F.col("always") | F.coalesce("hit", F.lit(False))).drop("hit")


def cut(lines: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The longest prefix of each scope whose estimate is within the budget; a line takes a byte at least,
    so only so many lines of a scope come together."""
    w = Window.partitionBy("scope").orderBy(*order)
    first = lines.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= 4 * budget + 5).drop("_nth")
    run = F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("estimate", text.tokens_of(run - 1)).where(F.col("estimate") <= budget)


def skeletons(lines: DataFrame, budget: int) -> DataFrame:
    """(scope, skeleton, lines, bytes, estimate, dropped): the text of each scope, kept lines always-ones first."""
    kept = fill(lines, budget)
    gone = kept.groupBy("scope").agg(F.sum((~F.col("kept")).cast("int")).alias("dropped"))
    ordered = kept.where("kept").select("scope", (~F.col("always")).alias("late"), "pos", "line")
    body = cut(ordered, budget, ["late", "pos"]).groupBy("scope").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("late", "pos", "line"))), lambda x: x["line"]), "\n").alias("skeleton"),
        F.count(F.lit(1)).cast("int").alias("lines"),
    )
    out = gone.join(body, "scope", "left").select("scope", F.coalesce("skeleton", F.lit("")).alias("skeleton"), F.coalesce("lines", F.lit(0)).alias("lines"), "dropped")
    return out.withColumn("bytes", F.octet_length("skeleton")).withColumn("estimate", text.token_estimate(F.col("skeleton")))
