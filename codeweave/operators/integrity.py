"""Checks of a module plan against the file index, as one table of violations.

Columns: module_pos, check_pos, file_pos, kind, module_id, path.  ``first_violation`` takes the least
(module_pos, check_pos, file_pos), so a plan fails by one deterministic message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave.operators.graph import module_files
from codeweave.operators.schema import OWNERS, PREPROCESSOR

#: Kinds in the order in which one module, then its files, then the whole plan are checked.
KINDS = ("empty module id", "duplicate module id", "invalid owner", "not found in file index", "duplicate file assignment", "missing file assignment")
INCONSISTENT = "owner and shared disagree"
AFTER_ALL = 2**31 - 1


def _rows(df: DataFrame, kind: int, file_pos="0", path="cast(null as string)") -> DataFrame:
    # Both file checks run file by file, so they share a place and the file decides.
    place = min(kind, 3)
    within = F.expr(f"{file_pos} * 2 + {max(kind - 3, 0)}")
    return df.select("module_pos", F.lit(place).alias("check_pos"), within.cast("int").alias("file_pos"), F.lit(KINDS[kind]).alias("kind"), "module_id", F.expr(path).alias("path"))


def violations(modules: DataFrame, index: DataFrame, consistency: bool = False) -> DataFrame:
    """All violations of a plan.  ``modules``: id, pos, files, shared, owner; ``index``: path."""
    plan = modules.select(F.col("id").alias("module_id"), F.col("pos").alias("module_pos"), "owner", "shared")
    files = module_files(modules).withColumnRenamed("pos", "module_pos")
    indexed = index.select("path").distinct()
    again = F.row_number().over(Window.partitionBy("module_id").orderBy("module_pos"))
    repeat = F.row_number().over(Window.partitionBy("path").orderBy("module_pos", "file_pos"))
    out = [
        _rows(plan.where("module_id = ''"), 0),
        _rows(plan.withColumn("nth", again).where("nth > 1"), 1),
        _rows(plan.where(~F.coalesce(F.col("owner").isin(*OWNERS), F.lit(False))), 2),
        _rows(files.join(indexed, "path", "left_anti"), 3, "file_pos", "path"),
        _rows(files.withColumn("nth", repeat).where("nth > 1"), 4, "file_pos", "path"),
    ]
    absent = indexed.join(files, "path", "left_anti").select("path", F.lit(AFTER_ALL).alias("module_pos"), F.lit(None).cast("string").alias("module_id"))
    out.append(absent.select("module_pos", F.lit(5).alias("check_pos"), F.lit(0).alias("file_pos"), F.lit(KINDS[5]).alias("kind"), "module_id", "path"))
    if consistency:
        odd = plan.where(F.col("shared") != (F.col("owner") == PREPROCESSOR))
        out.append(odd.select("module_pos", F.lit(6).alias("check_pos"), F.lit(0).alias("file_pos"), F.lit(INCONSISTENT).alias("kind"), "module_id", F.lit(None).cast("string").alias("path")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def first_violation(found: DataFrame) -> DataFrame:
    """The violation that is reported: at most one row; a top-1, not a sort of all."""
    order = F.struct("module_pos", "check_pos", "file_pos", F.coalesce("path", F.lit("")))
    best = found.agg(F.min_by(F.struct(*found.columns), order).alias("v"))
    return best.where("v is not null").select("v.*")


def message(row) -> str:
    """One line for a violation row."""
    named = [x for x in (row["path"] and f"file {row['path']!r}", row["module_id"] is not None and f"module {row['module_id']!r}") if x]
    return f"{row['kind']}" + (f": {', '.join(named)}" if named else "")
