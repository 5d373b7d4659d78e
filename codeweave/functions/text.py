"""Scalar text functions as native column expressions.

All are null-safe in Spark's usual sense (null in, null out) and none starts a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of the Markdown dialect.
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
CITED = r"`[A-Z][A-Za-z0-9]*`"
EXTERNAL = ("http://", "https://", "#")


def trim_space(s: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips only spaces)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def lines(s: Column) -> Column:
    """Split at line feeds; a trailing empty element and carriage returns stay."""
    return F.split(s, "\n")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; '.' for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """From the last dot of the last element, dot included; '' without one."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def trim_prefix(s: Column, prefix: Column) -> Column:
    return F.when(F.startswith(s, prefix), F.substring(s, F.char_length(prefix) + 1, F.char_length(s))).otherwise(s)


def strip_quotes(s: Column) -> Column:
    return F.btrim(s, F.lit('"'))


def clean_path(path: Column) -> Column:
    """Lexical path cleaning: '.', '..', '//' resolved; '' becomes '.'; the result of '..' above a root is the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(path, F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        top = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(".."))
        pops = (p == "..") & (top != "..")
        return (
            F.when(pops, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when((p == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(p)))
        )

    body = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def join_path(folder: Column, target: Column) -> Column:
    """Join and clean; a leading slash of ``target`` does not restart at the root."""
    return clean_path(F.concat_ws("/", folder, target))


def cut_fragment(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def is_external(target: Column) -> Column:
    out = F.lit(False)
    for prefix in EXTERNAL:
        out = out | F.startswith(target, F.lit(prefix))
    return out


def slug(heading: Column) -> Column:
    """Anchor of a heading: lower case, [a-z0-9- ] only, spaces to dashes, dashes trimmed and collapsed."""
    kept = F.regexp_replace(F.lower(heading), r"[^a-z0-9\- ]+", "")
    dashed = F.btrim(F.replace(kept, F.lit(" "), F.lit("-")), F.lit("-"))
    return F.regexp_replace(dashed, "-{2,}", "-")


def toc_entries(text: Column) -> Column:
    """Array of list lines for all level 2 and 3 headings, in order; code fences are not recognised."""
    headed = F.filter(lines(text), lambda x: F.startswith(x, F.lit("## ")) | F.startswith(x, F.lit("### ")))

    def entry(x: Column) -> Column:
        title = trim_space(F.regexp_replace(x, "^#{2,3} ", ""))
        indent = F.when(F.startswith(x, F.lit("### ")), F.lit("  - [")).otherwise(F.lit("- ["))
        return F.concat(indent, title, F.lit("](#"), slug(title), F.lit(")"))

    return F.transform(headed, entry)


def with_toc(text: Column) -> Column:
    """Insert a contents block after the first level 1 heading, else in front; no headings, no change."""
    entries, all_lines = toc_entries(text), lines(text)
    block = F.concat(F.lit("## Contents\n\n"), F.array_join(entries, "\n"), F.lit("\n\n"))
    at = F.array_position(F.transform(all_lines, lambda x: F.startswith(x, F.lit("# "))), True).cast("int")
    head = F.array_join(F.slice(all_lines, F.lit(1), at), "\n")
    rest = F.array_join(F.slice(all_lines, at + 1, F.size(all_lines)), "\n")
    return (
        F.when(F.size(entries) == 0, text)
        .when(at > 0, F.concat(head, F.lit("\n\n"), block, rest))
        .otherwise(F.concat(block, text))
    )


def markdown_links(text: Column) -> Column:
    """Array of (link_text, link_target); images count as links."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("link_text"),
        F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("link_target"),
    )


def ref(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit("#L"), line.cast("string"))


def tokens_of(size: Column) -> Column:
    """Token estimate of a number of bytes."""
    return F.floor(size / 4).cast("long")


def token_estimate(s: Column) -> Column:
    """Bytes over four, rounded down."""
    return tokens_of(F.octet_length(s))


def token_estimate_up(s: Column) -> Column:
    """Bytes over four, rounded up."""
    return tokens_of(F.octet_length(s) + 3)


def is_exported(name: Column) -> Column:
    """First code point is an upper-case letter of any script."""
    return F.coalesce(F.rlike(name, F.lit(r"^\p{Lu}")), F.lit(False))


def signature_of(source: Column) -> Column:
    """Declaration text before the first ' {'; trimmed only where there is none."""
    cut = F.substring_index(source, " {", 1)
    return F.when(F.contains(source, F.lit(" {")), cut).otherwise(trim_space(source))


def header_line(path: Column) -> Column:
    return F.concat(F.lit("// === "), path, F.lit(" ==="))


def function_line(signature: Column, path: Column, line: Column) -> Column:
    return F.concat(signature, F.lit("  // "), path, F.lit(":"), line.cast("string"))


def type_line(name: Column, kind: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("type "), name, F.lit(" "), kind, F.lit("  // "), path, F.lit(":"), line.cast("string"))
