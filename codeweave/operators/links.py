"""Link validation of a document tree: scan, extract, resolve, anti-join, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import text


def internal_links(docs: DataFrame) -> DataFrame:
    """(source_file, link_text, link_target) of all links of Markdown files (path, content) that do not leave the tree."""
    found = docs.where(F.endswith("path", F.lit(".md"))).select(F.col("path").alias("source_file"), F.explode(text.markdown_links(F.col("content"))).alias("l"))
    return found.select("source_file", "l.link_text", "l.link_target").where(~text.is_external(F.col("link_target")))


def existing_paths(paths: DataFrame) -> DataFrame:
    """(path): the files and every directory above them, '.' included."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select(F.explode(F.concat(F.array(F.lit(".")), above)).alias("path")).distinct()


def broken(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Links whose target, without its fragment and taken from the file's folder, does not exist; line is always 0."""
    target = text.join_path(text.dirname(F.col("source_file")), text.cut_fragment(F.col("link_target")))
    resolved = links.withColumn("_to", target)
    gone = resolved.join(existing.select(F.col("path").alias("_to")), "_to", "left_anti")
    return gone.select("source_file", "link_text", "link_target", F.lit(0).alias("line"))


def report(docs: DataFrame, extra_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(broken links, one row of totals: total_files, total_links, broken) of a document tree (path, content)."""
    paths = docs.select("path") if extra_paths is None else docs.select("path").unionByName(extra_paths.select("path"))
    links = internal_links(docs)
    gone = broken(links, existing_paths(paths))
    totals = (
        docs.agg(F.count_if(F.endswith("path", F.lit(".md"))).alias("total_files"))
        .join(links.agg(F.count(F.lit(1)).alias("total_links")))
        .join(gone.agg(F.count(F.lit(1)).alias("broken")))
    )
    return gone, totals


def with_kind(gone: DataFrame) -> DataFrame:
    """Broken links with ``kind``: references into source files apart from dead pages."""
    return gone.withColumn("kind", F.when(F.rlike("link_target", F.lit(r"#L\d+$")), F.lit("source_ref")).otherwise(F.lit("link")))
