"""Symbols of the file index: canonical references, citations in prose, grounding of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import text


def declarations(index: DataFrame) -> DataFrame:
    """(name, path, kind_ord, line_start, exported): functions and types in one namespace."""
    f = index.select("path", F.explode("functions").alias("d")).select(F.col("d.name").alias("name"), "path", F.lit(0).alias("kind_ord"), F.col("d.line_start").alias("line_start"), F.col("d.exported").alias("exported"))
    t = index.select("path", F.explode("types").alias("d")).select(F.col("d.name").alias("name"), "path", F.lit(1).alias("kind_ord"), F.col("d.line_start").alias("line_start"), F.col("d.exported").alias("exported"))
    return f.unionByName(t)


def symbol_map(declared: DataFrame) -> DataFrame:
    """(name, ref): for each exported name the declaration of the least (path, functions first, line)."""
    best = F.min_by(text.ref(F.col("path"), F.col("line_start")), F.struct("path", "kind_ord", "line_start"))
    return declared.where("exported").groupBy("name").agg(best.alias("ref"))


def inject_citations(docs: DataFrame, key: str, body: str, symbols: DataFrame) -> DataFrame:
    """``docs`` with every known backticked name of ``body`` made a link to its reference.

    Only the distinct names of each text meet the symbol table; a text without a backtick is not
    shuffled.  ``key`` is unique.
    """
    names = F.transform(F.regexp_extract_all(F.col(body), F.lit(text.CITED), F.lit(0)), lambda m: F.substring(m, 2, F.length(m) - 2))
    used = docs.where(F.contains(body, F.lit("`"))).select(F.col(key).alias("_k"), F.explode(F.array_distinct(names)).alias("name"))
    found = used.join(symbols, "name").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("name", "ref"))).alias("_refs"))
    joined = docs.join(found, docs[key] == found["_k"], "left")
    gaps = F.split(F.col(body), text.CITED)
    links = F.transform(
        F.transform(names, lambda n: F.struct(n.alias("n"), F.try_element_at("_refs", n).alias("r"))),
        lambda x: F.when(x["r"].isNull(), F.concat(F.lit("`"), x["n"], F.lit("`"))).otherwise(F.concat(F.lit("["), x["n"], F.lit("]("), x["r"], F.lit(")"))),
    )
    woven = F.array_join(F.transform(F.arrays_zip(gaps.alias("a"), links.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    cited = F.when(F.col("_refs").isNull(), F.col(body)).otherwise(woven)
    return joined.select(*[cited.alias(c) if c == body else docs[c].alias(c) for c in docs.columns])


def ground(claims: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """``claims`` (module_id, ord, name, signature, ref) with ``ref`` set to the declared function that
    matches by name and, unless the claim has none, by signature; first by (path, ord).

    ``declared``: path, ord, name, signature, line_start; ``files``: module_id, path.  A claim without
    a match keeps its reference, and ``grounded`` is false.
    """
    own = declared.join(files.select("module_id", "path").distinct(), "path").select(
        "module_id", "name", "signature", F.struct("path", F.col("ord").alias("at")).alias("place"), text.ref(F.col("path"), F.col("line_start")).alias("found")
    )
    # The first declaration of each signature, then of each name, so a claim meets one row of either, not all of its name.
    exact = own.groupBy("module_id", "name", "signature").agg(F.min_by(F.struct("place", "found"), "place").alias("one"))
    named = exact.groupBy("module_id", "name").agg(F.min_by("one.found", "one.place").alias("_named"))
    exact = exact.select("module_id", "name", "signature", F.col("one.found").alias("_exact"))
    out = claims.join(named, ["module_id", "name"], "left").join(exact, ["module_id", "name", "signature"], "left")
    found = F.when(F.coalesce(F.col("signature"), F.lit("")) == "", F.col("_named")).otherwise(F.col("_exact"))
    return out.select(*[F.coalesce(found, "ref").alias("ref") if c == "ref" else F.col(c) for c in claims.columns], found.isNotNull().alias("grounded"))


def declared_functions(index: DataFrame) -> DataFrame:
    d = index.select("path", F.posexplode("functions").alias("ord", "d"))
    return d.select("path", "ord", F.col("d.name").alias("name"), F.col("d.signature").alias("signature"), F.col("d.line_start").alias("line_start"))


def ground_summaries(context: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """Shared summaries with their key functions grounded and ``source_refs`` rebuilt: sorted, repeats kept."""
    claims = context.select("module_id", F.posexplode("key_functions").alias("ord", "f")).select("module_id", "ord", "f.name", "f.signature", "f.ref")
    done = ground(claims, declared_functions(index), files)
    entry = F.struct("ord", F.struct("name", "signature", "ref").alias("f"))
    lists = done.groupBy("module_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["f"]).alias("fs"))
    kinds = {c: context.schema[c].dataType for c in ("key_functions", "source_refs")}
    return context.drop("key_functions", "source_refs").join(lists, "module_id", "left").select(
        "module_id", "summary", "key_types",
        F.coalesce("fs", F.array().cast(kinds["key_functions"])).alias("key_functions"),
        F.coalesce(F.sort_array(F.transform("fs", lambda f: f["ref"])), F.array().cast(kinds["source_refs"])).alias("source_refs"),
    )
