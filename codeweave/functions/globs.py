"""Path globs as anchored regular expressions, for native filters and for directory pruning.

``*`` and ``?`` stay within a path element, ``**`` as a whole element spans any number of elements,
``[...]`` and ``{a,b}`` work as usual, a backslash quotes.  A malformed pattern matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweave.functions.text import basename

_QUOTE = set(".^$+{}()[]|\\*?&~#-")


class Malformed(ValueError):
    pass


def _class(glob: str, i: int) -> tuple[str, int]:
    """The class that starts at ``glob[i] == '['`` and the position after it."""
    j = i + 1
    negated = j < len(glob) and glob[j] in "!^"
    j += negated
    body, first = "", True
    while True:
        if j >= len(glob):
            raise Malformed(glob)
        c = glob[j]
        if c == "]" and not first:
            break
        first = False
        if c == "\\":
            j += 1
            if j >= len(glob):
                raise Malformed(glob)
            c = "\\" + glob[j]
        elif c in "[&~^":
            c = "\\" + c
        body, j = body + c, j + 1
    return f"(?!/)[{'^' if negated else ''}{body}]", j + 1


def _element(glob: str) -> str:
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            piece, i = _class(glob, i)
            out += piece
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "\\":
            if i + 1 >= len(glob):
                raise Malformed(glob)
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + ("\\" + c if c in _QUOTE else c), i + 1
    if depth:
        raise Malformed(glob)
    return out


def _elements(glob: str) -> list[str]:
    """Split at slashes outside braces and classes."""
    out, depth, held, i = [""], 0, False, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out[-1] += glob[i : i + 2]
            i += 2
            continue
        held = True if c == "[" and not held else False if c == "]" else held
        depth += (c == "{") - (c == "}") if not held else 0
        if c == "/" and not depth and not held:
            out.append("")
        else:
            out[-1] += c
        i += 1
    return out


def to_regex(glob: str) -> str | None:
    """An unanchored regular expression for a whole path, or None if the glob is malformed."""
    try:
        parts = _elements(glob)
        out = ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                if last:
                    out = out[:-1] + "(?:/.*)?" if out.endswith("/") else out + ".*"
                else:
                    out += "(?:[^/]+/)*"
            else:
                out += _element(part) + ("" if last else "/")
        re.compile(out)
        return out
    except (Malformed, re.error):
        return None


def matches(path: Column, globs: Sequence[str]) -> Column:
    """True where the path or its base name matches one of the globs."""
    found = [r for r in map(to_regex, globs) if r is not None]
    if not found:
        return F.lit(False)
    whole = F.lit("^(?s:" + "|".join(f"(?:{r})" for r in found) + ")$")
    return F.rlike(path, whole) | F.rlike(basename(path), whole)


def excluder(globs: Sequence[str]):
    """The same test on the driver or in a data source reader: (path) -> bool."""
    found = [re.compile(r) for r in map(to_regex, globs) if r is not None]

    def excluded(path: str) -> bool:
        name = path.rpartition("/")[2]
        return any(r.fullmatch(path) or r.fullmatch(name) for r in found)

    return excluded


def pruned_dirs(globs: Sequence[str]) -> list[re.Pattern]:
    """Directories of which nothing can be kept: those that a glob ending in ``/**`` covers whole."""
    heads = [g[:-3] for g in globs if g.endswith("/**") and g != "/**"]
    return [re.compile(r) for r in map(to_regex, heads) if r is not None]
