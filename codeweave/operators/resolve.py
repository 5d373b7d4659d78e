"""Imports to files, and the file graph that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import text


class UnresolvedImport(ValueError):
    """An internal import names no directory with a source file."""


def representatives(listing: DataFrame, suffix: str = ".go") -> DataFrame:
    """(dir, rep): the bytewise first source file directly in each directory of an unfiltered listing."""
    files = listing.where(F.endswith("path", F.lit(suffix)))
    return files.groupBy(text.dirname(F.col("path")).alias("dir")).agg(F.min("path").alias("rep"))


def resolve_imports(index: DataFrame, listing: DataFrame, module: str, strict_prefix: bool = True, suffix: str = ".go") -> DataFrame:
    """``index`` with ``internal`` and ``resolved_path`` of every import filled in.

    An import is internal if it starts with the module's name, at an element boundary unless
    ``strict_prefix`` is off.  It resolves to one file: ``<dir><suffix>`` if the listing has it, else
    the first file of the directory; '' where there is none (``check_resolved`` raises for those).
    """
    name = F.lit(module)
    under = F.startswith(F.col("i.path"), F.concat(name, F.lit("/"))) if strict_prefix else F.startswith(F.col("i.path"), name)
    inside = (F.col("i.path") == name) | under
    rest = F.regexp_replace(text.trim_prefix(F.col("i.path"), name), "^/", "")
    flat = index.select("path", F.posexplode("imports").alias("n", "i")).select(
        "path", "n", F.col("i.path").alias("import"), inside.alias("internal"), F.when(rest == "", F.lit(".")).otherwise(rest).alias("dir")
    )
    exact = listing.select(F.col("path").alias("exact")).distinct()
    found = (
        flat.join(exact, F.concat("dir", F.lit(suffix)) == F.col("exact"), "left")
        .join(representatives(listing, suffix), "dir", "left")
        .select("path", "n", "import", "internal", F.when(F.col("internal"), F.coalesce("exact", "rep", F.lit(""))).otherwise(F.lit("")).alias("resolved"))
    )
    one = F.struct("n", F.struct(F.col("import").alias("path"), "internal", F.col("resolved").alias("resolved_path")).alias("i"))
    lists = found.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("got"))
    kept = [c for c in index.columns if c != "imports"]
    return index.select(*kept).join(lists, "path", "left").select(
        *kept, F.coalesce(F.transform("got", lambda x: x["i"]), F.array().cast(index.schema["imports"].dataType)).alias("imports")
    )


def check_resolved(index: DataFrame) -> DataFrame:
    """``index``, or an error that names the first internal import that resolves to nothing."""
    bad = index.select("path", F.explode("imports").alias("i")).where("i.internal and i.resolved_path = ''")
    first = bad.orderBy("path", "i.path").select("path", "i.path").first()
    if first:
        raise UnresolvedImport(f"{first[0]}: import {first[1]} has no source file")
    return index


def edges_of(index: DataFrame, package_edges: DataFrame | None = None) -> DataFrame:
    """(src, dst), one row per internal resolved import, repeats kept.

    With a listing as ``package_edges``, an import leads to all indexed files of the directory instead
    of its one representative.
    """
    edges = index.select(F.col("path").alias("src"), F.explode("imports").alias("i")).where("i.internal and i.resolved_path <> ''")
    edges = edges.select("src", F.col("i.resolved_path").alias("dst"))
    if package_edges is None:
        return edges
    mates = package_edges.select(text.dirname(F.col("path")).alias("dir"), F.col("path").alias("mate"))
    return edges.join(mates, text.dirname(F.col("dst")) == F.col("dir")).select("src", F.col("mate").alias("dst"))


def stored(index: DataFrame) -> DataFrame:
    """The persisted projection: imports without their resolved paths."""
    return index.withColumn("imports", F.transform("imports", lambda i: F.struct(i["path"].alias("path"), i["internal"].alias("internal"))))
