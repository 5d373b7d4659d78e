"""Symbols of Go source files: a tokenizer and a reader of declarations.

The reader accepts a file if its tokens are well formed and ``go_syntax`` finds the language's grammar in
them.  Methods and functions come from the top level; type specifications count at any depth; imports only
with an interpreted string.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from codeweave.sources import go_syntax

_TOKEN = re.compile(
    r"""
    (?P<space>[ \t\r]+)
  | (?P<newline>\n)
  | (?P<comment>//[^\n]*|/\*.*?\*/)
  | (?P<string>"(?:[^"\\\n]|\\[^\n])*")
  | (?P<raw>`[^`]*`)
  | (?P<rune>'(?:[^'\\\n]|\\[^\n]+?)')
  | (?P<number>(?:0[xXbBoO][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|\.?[0-9](?:[eE][+-]|[0-9_.eE])*)i?)
  | (?P<name>[^\W\d]\w*)
  | (?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])
    """,
    re.VERBOSE | re.DOTALL,
)
#: Fixed values of the language: keywords, and what lets a line end close a statement.
KEYWORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range "
    "return select struct switch type var".split()
)
ENDS_STATEMENT = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_CLOSES = {")": "(", "]": "[", "}": "{"}


class SyntaxProblem(ValueError):
    """The file is not accepted."""


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


def tokenize(source: str) -> list[Token]:
    """Tokens with the semicolons that line ends imply; raises on anything that is no token."""
    out: list[Token] = []
    at, line = 0, 1

    def close(pos: int) -> None:
        if out and (out[-1].kind in ("string", "raw", "rune", "number") or out[-1].kind == "name" and out[-1].text not in KEYWORDS or out[-1].text in ENDS_STATEMENT):
            out.append(Token("op", ";", pos, pos, out[-1].line))

    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise SyntaxProblem(f"line {line}: unexpected character {source[at]!r}")
        kind, text = m.lastgroup, m.group()
        breaks = text.count("\n")
        if kind == "newline" or kind == "comment" and breaks:
            close(at)
        elif kind not in ("space", "comment"):
            out.append(Token(kind, text, at, m.end(), line))
        line += breaks
        at = m.end()
    close(at)
    return out


def _match(tokens: list[Token]) -> dict[int, int]:
    """Position of the closing bracket of every opening one."""
    open_at: list[int] = []
    pairs: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in "([{":
            open_at.append(i)
        elif t.kind == "op" and t.text in _CLOSES:
            if not open_at or tokens[open_at[-1]].text != _CLOSES[t.text]:
                raise SyntaxProblem(f"line {t.line}: unmatched {t.text}")
            pairs[open_at.pop()] = i
    if open_at:
        raise SyntaxProblem(f"line {tokens[open_at[-1]].line}: {tokens[open_at[-1]].text} is not closed")
    return pairs


class Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tokens = tokenize(source)
        self.pairs = _match(self.tokens)
        self.functions: list[dict] = []
        self.types: list[dict] = []
        self.imports: list[str] = []

    def text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def need(self, i: int, what: str) -> int:
        ok = i < len(self.tokens) and (self.tokens[i].kind == "name" and self.text(i) not in KEYWORDS if what == "name" else self.text(i) == what)
        if not ok:
            line = self.tokens[min(i, len(self.tokens) - 1)].line if self.tokens else 1
            raise SyntaxProblem(f"line {line}: expected {what}")
        return i

    def end_of(self, i: int) -> int:
        """Position of the semicolon, or of the bracket from outside, that ends what starts at ``i``."""
        while i < len(self.tokens) and self.text(i) not in (";", ")", "]", "}"):
            i = self.pairs.get(i, i) + 1
        return i

    def last_line(self, i: int) -> int:
        t = self.tokens[i]
        return t.line + t.text.count("\n")

    def read(self) -> None:
        i = 0
        if self.tokens:
            while self.text(i) == ";":
                i += 1
            self.need(i, "package")
            self.need(i + 1, "name")
            i = self.finish(i + 2)
        while i < len(self.tokens):
            word = self.text(i)
            if word == ";":
                i += 1
            elif word == "import":
                i = self.finish(self.group(i + 1, self.import_spec))
            elif word == "func":
                i = self.finish(self.function(i))
            elif word == "type":
                i = self.finish(self.group(i + 1, self.type_spec))
            elif word in ("var", "const"):
                self.need(i + 1, "(" if self.text(i + 1) == "(" else "name")
                stop = self.end_of(i + 1)
                self.inner(i + 1, stop)
                i = self.finish(stop)
            else:
                raise SyntaxProblem(f"line {self.tokens[i].line}: {word!r} starts no declaration")

    def finish(self, i: int) -> int:
        return i if i >= len(self.tokens) else self.need(i, ";") + 1

    def group(self, i: int, spec) -> int:
        if self.text(i) != "(":
            return spec(i)
        stop, i = self.pairs[i], i + 1
        while i < stop:
            if self.text(i) == ";":
                i += 1
                continue
            i = spec(i)
            if i < stop:
                self.need(i, ";")
        return stop + 1

    def import_spec(self, i: int) -> int:
        if self.text(i) == "." or self.tokens[i].kind == "name":
            i += 1
        if i >= len(self.tokens) or self.tokens[i].kind not in ("string", "raw"):
            raise SyntaxProblem("an import needs a path")
        if self.tokens[i].kind == "string":
            self.imports.append(self.text(i).strip('"'))
        return i + 1

    def function(self, i: int) -> int:
        first = i
        i += 1
        if self.text(i) == "(":
            i = self.pairs[i] + 1
        name = self.text(self.need(i, "name"))
        i += 1
        if self.text(i) == "[":
            i = self.pairs[i] + 1
        i = self.pairs[self.need(i, "(")] + 1
        while i < len(self.tokens) and self.text(i) not in (";", "{"):
            # Braces of struct and interface results belong to the results, not to a body.
            if self.text(i) in ("struct", "interface") and self.text(i + 1) == "{":
                i += 1
            i = self.pairs.get(i, i) + 1
        if self.text(i) == "{":
            self.inner(i + 1, self.pairs[i])
            i = self.pairs[i] + 1
        self.declared(self.functions, first, i - 1, name=name, signature=self.signature(first, i - 1))
        return i

    def signature(self, first: int, last: int) -> str:
        whole = self.source[self.tokens[first].start : self.tokens[last].end]
        head, brace, _ = whole.partition(" {")
        return head if brace else whole.strip()

    def type_spec(self, i: int) -> int:
        first = self.need(i, "name")
        i += 1
        alias = False
        if self.text(i) == "[" and self.is_parameters(i):
            i = self.pairs[i] + 1
        if self.text(i) == "=":
            alias, i = True, i + 1
        stop = self.end_of(i)
        if stop == i:
            raise SyntaxProblem(f"line {self.tokens[first].line}: the type has no definition")
        word = self.text(i)
        kind = word if word in ("struct", "interface") and not alias and self.pairs.get(i + 1, -1) == stop - 1 else "alias"
        self.declared(self.types, first, stop - 1, name=self.text(first), kind=kind)
        self.inner(i, stop)
        return stop

    def is_parameters(self, i: int) -> bool:
        """Type parameters have a constraint after the first name; array lengths do not."""
        after = self.tokens[i + 2] if self.pairs[i] > i + 2 else None
        named = self.tokens[i + 1].kind == "name" and self.text(i + 1) not in KEYWORDS
        return bool(named and after and (after.kind == "name" or after.text in (",", "~", "[")))

    def inner(self, i: int, stop: int) -> None:
        """Type specifications inside a body."""
        while i < stop:
            if self.text(i) == "type" and self.text(i + 1) != ")":
                i = self.group(i + 1, self.type_spec)
            else:
                i += 1

    def declared(self, into: list[dict], first: int, last: int, **own) -> None:
        exported = own["name"][:1].isupper()
        into.append({**own, "line_start": self.tokens[first].line, "line_end": self.last_line(last), "exported": exported})


def parse(content: bytes) -> dict:
    """The nested row of a file; raises ``SyntaxProblem`` if it is not accepted.  Lists are never null."""
    try:
        reader = Reader(content.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise SyntaxProblem(str(e)) from e
    go_syntax.check(reader.tokens, KEYWORDS, SyntaxProblem)
    reader.read()
    # Nested types follow the type that holds them, all by their place in the file.
    return {
        "language": "go",
        "content_hash": hashlib.sha256(content).hexdigest(),
        "functions": reader.functions,
        "types": sorted(reader.types, key=lambda t: t["line_start"]),
        "imports": [{"path": p, "internal": False, "resolved_path": ""} for p in reader.imports],
    }
