"""Whether tokens are a Go source file: a recursive descent over the published grammar of the language.

It decides about syntax alone.  Types and expressions share one form where only their meaning tells them
apart, so it takes a type wherever an operand may stand.  Where the grammar needs to look ahead (a parameter
that is a name or a type, a field that is embedded or named), one reading is tried and then the other.
"""

from __future__ import annotations

from collections.abc import Callable

#: Fixed values of the language.
BINARY = set("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = set("= := += -= |= ^= *= /= %= <<= >>= &= &^=".split())
UNARY = set("+ - ! ^ * & <-".split())
TYPE_WORDS = {"func", "interface", "struct", "map", "chan"}
LITERALS = ("number", "string", "raw", "rune")


class Checker:
    """Walks the tokens (kind, text, ..., line); ``fail`` makes the error to raise."""

    def __init__(self, tokens: list, keywords: set[str], fail: Callable[[str], Exception]) -> None:
        self.tokens, self.keywords, self.fail = tokens, keywords, fail
        self.i = 0
        self.open = 0  # below 0 in the head of a statement, where a brace starts its block

    @property
    def word(self) -> str:
        return self.tokens[self.i].text if self.i < len(self.tokens) else ""

    @property
    def kind(self) -> str:
        if self.i >= len(self.tokens):
            return "end"
        kind = self.tokens[self.i].kind
        return "keyword" if kind == "name" and self.word in self.keywords else kind

    def is_op(self, *texts: str) -> bool:
        return self.kind in ("op", "keyword") and self.word in texts

    def refuse(self, wanted: str) -> Exception:
        line = self.tokens[min(self.i, len(self.tokens) - 1)].line if self.tokens else 1
        return self.fail(f"line {line}: expected {wanted}, found {self.word or 'the end'!r}")

    def take(self, *texts: str) -> bool:
        if self.is_op(*texts):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.take(text):
            raise self.refuse(repr(text))

    def name(self) -> None:
        if self.kind != "name":
            raise self.refuse("a name")
        self.i += 1

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def either(self, *ways: Callable[[], None]) -> None:
        """The first of the readings that fits."""
        at, open_ = self.i, self.open
        for way in ways[:-1]:
            try:
                return way()
            except type(self.fail("")):
                self.i, self.open = at, open_
        return ways[-1]()

    def inside(self, what: Callable[[], None]) -> None:
        held, self.open = self.open, 0
        what()
        self.open = held

    def listed(self, item: Callable[[], None], end: str) -> None:
        """Items with commas up to ``end``; a comma may follow the last."""
        while not self.is_op(end):
            item()
            if not self.take(","):
                break
        self.expect(end)

    # -- declarations -------------------------------------------------------------------------

    def file(self) -> None:
        while self.take(";"):
            pass
        if self.kind == "end":
            return
        self.expect("package")
        self.name()
        self.close()
        while self.kind != "end":
            if self.take(";"):
                continue
            if self.is_op("func"):
                self.function()
            elif self.is_op("import", "const", "var", "type"):
                self.declaration()
            else:
                raise self.refuse("a declaration")
            self.close()

    def close(self) -> None:
        if self.kind != "end":
            self.expect(";")

    def declaration(self) -> None:
        spec = {"import": self.import_spec, "const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[self.word]
        self.i += 1
        if not self.take("("):
            return spec()
        while not self.is_op(")"):
            spec()
            if not self.is_op(")"):
                self.expect(";")
        self.i += 1

    def import_spec(self) -> None:
        if self.kind == "name" or self.is_op("."):
            self.i += 1
        if self.kind not in ("string", "raw"):
            raise self.refuse("a path")
        self.i += 1

    def const_spec(self) -> None:
        self.names()
        if self.starts_type():
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.take("="):
            return self.expressions()
        self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()

        def generic() -> None:
            self.type_parameters()
            self.take("=")
            self.type()

        def plain() -> None:
            self.take("=")
            self.type()

        self.either(generic, plain) if self.is_op("[") else plain()

    def function(self) -> None:
        self.expect("func")
        if self.is_op("("):
            self.parameters()
        self.name()
        if self.is_op("["):
            self.type_parameters()
        self.signature()
        if self.is_op("{"):
            self.block()

    def type_parameters(self) -> None:
        def one() -> None:
            self.names_of_parameters()
            self.union()

        self.expect("[")
        if self.is_op("]"):
            raise self.refuse("a type parameter")
        self.listed(one, "]")

    def names_of_parameters(self) -> None:
        self.name()
        while self.is_op(","):
            self.i += 1
            self.name()

    def union(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def signature(self) -> None:
        self.parameters()
        if self.is_op("("):
            self.parameters()
        elif self.starts_type():
            self.type()

    def parameters(self) -> None:
        def named() -> None:
            self.name()
            self.take("...")
            self.type()

        def unnamed() -> None:
            self.take("...")
            self.type()

        self.expect("(")
        self.inside(lambda: self.listed(lambda: self.either(named, unnamed), ")"))

    # -- types --------------------------------------------------------------------------------

    def starts_type(self) -> bool:
        return self.kind == "name" or self.is_op("*", "[", "(", "<-", *TYPE_WORDS)

    def type(self) -> None:
        if self.kind == "name":
            self.i += 1
            if self.take("."):
                self.name()
            if self.is_op("[") and not (self.i + 1 < len(self.tokens) and self.tokens[self.i + 1].text == "]"):
                self.i += 1
                self.inside(lambda: self.listed(self.type, "]"))
        elif self.take("("):
            self.inside(self.type)
            self.expect(")")
        elif self.take("*"):
            self.type()
        elif self.take("["):
            if not self.take("..."):
                if not self.is_op("]"):
                    self.inside(self.expression)
            self.expect("]")
            self.type()
        elif self.take("func"):
            self.signature()
        elif self.take("interface"):
            self.members(self.element)
        elif self.take("struct"):
            self.members(self.field)
        elif self.take("map"):
            self.expect("[")
            self.inside(self.type)
            self.expect("]")
            self.type()
        elif self.take("chan"):
            self.take("<-")
            self.type()
        elif self.take("<-"):
            self.expect("chan")
            self.type()
        else:
            raise self.refuse("a type")

    def members(self, one: Callable[[], None]) -> None:
        self.expect("{")
        held, self.open = self.open, 0
        while not self.is_op("}"):
            one()
            if not self.is_op("}"):
                self.expect(";")
        self.open = held
        self.i += 1

    def element(self) -> None:
        def method() -> None:
            self.name()
            self.signature()

        self.either(method, self.union)

    def field(self) -> None:
        def named() -> None:
            self.names()
            self.type()
            self.tag()

        def embedded() -> None:
            self.take("*")
            self.type()
            self.tag()

        self.either(named, embedded)

    def tag(self) -> None:
        if self.kind in ("string", "raw"):
            self.i += 1
        if not self.is_op(";", "}"):
            raise self.refuse("the end of a field")

    # -- statements ---------------------------------------------------------------------------

    def block(self) -> None:
        self.expect("{")
        held, self.open = self.open, 0
        self.statements()
        self.open = held
        self.expect("}")

    def statements(self) -> None:
        while not self.is_op("}", "case", "default") and self.kind != "end":
            if self.take(";"):
                continue
            self.statement()
            if not self.is_op("}"):
                self.expect(";")

    def statement(self) -> None:
        word = self.word if self.kind == "keyword" else ""
        if word in ("var", "const", "type"):
            self.declaration()
        elif self.is_op("{"):
            self.block()
        elif word == "if":
            self.if_()
        elif word == "for":
            self.for_()
        elif word == "switch":
            self.i += 1
            self.head(optional=True)
            self.clauses(lambda: self.expressions())
        elif word == "select":
            self.i += 1
            self.clauses(self.simple)
        elif word == "return":
            self.i += 1
            if not self.is_op(";", "}"):
                self.expressions()
        elif word in ("break", "continue", "goto"):
            self.i += 1
            if self.kind == "name" or word == "goto":
                self.name()
        elif word == "fallthrough":
            self.i += 1
        elif word in ("go", "defer"):
            self.i += 1
            self.expression()
        elif self.kind == "name" and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1].text == ":":
            self.i += 2
            if not self.is_op("}", "case", "default"):
                self.statement() if not self.is_op(";") else None
        else:
            self.simple()

    def simple(self) -> None:
        self.expressions()
        if self.kind == "op" and self.word in ASSIGN:
            self.i += 1
            self.take("range") if self.open < 0 else None
            self.expressions()
        elif self.take("<-"):
            self.expression()
        else:
            self.take("++", "--")

    def head(self, optional: bool) -> None:
        """[statement ;] [statement] before a block."""
        held, self.open = self.open, -1
        if not self.is_op("{", ";"):
            self.simple()
        elif not optional and self.is_op("{"):
            raise self.refuse("a condition")
        if self.take(";"):
            if not self.is_op("{"):
                self.simple()
            elif not optional:
                raise self.refuse("a condition")
        self.open = held

    def if_(self) -> None:
        while True:
            self.expect("if")
            self.head(optional=False)
            self.block()
            if not self.take("else"):
                return
            if not self.is_op("if"):
                return self.block()

    def for_(self) -> None:
        self.expect("for")
        held, self.open = self.open, -1
        if self.take("range"):
            self.expression()
        elif not self.is_op("{"):
            if not self.is_op(";"):
                self.simple()
            if self.take(";"):
                if not self.is_op(";"):
                    self.expression()
                self.expect(";")
                if not self.is_op("{"):
                    self.simple()
        self.open = held
        self.block()

    def clauses(self, guard: Callable[[], None]) -> None:
        self.expect("{")
        held, self.open = self.open, 0
        while not self.is_op("}"):
            if self.take("case"):
                guard()
            elif not self.take("default"):
                raise self.refuse("a case")
            self.expect(":")
            self.statements()
        self.open = held
        self.i += 1

    # -- expressions --------------------------------------------------------------------------

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.kind == "op" and self.word in BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.kind == "op" and self.word in UNARY:
            if self.is_op("<-") and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1].text == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        literal = False  # a type that can only start a literal or a conversion
        if self.kind in LITERALS:
            self.i += 1
            named = False
        elif self.kind == "name":
            self.i += 1
            named = True
        elif self.take("("):
            self.inside(self.expression)
            self.expect(")")
            named = False
        elif self.take("func"):
            self.signature()
            if self.is_op("{"):
                self.block()
            named = False
        elif self.is_op("[", "<-", *TYPE_WORDS):
            self.type()
            named, literal = False, True
        else:
            raise self.refuse("an expression")
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.inside(self.type)
                    self.expect(")")
                    named = False
                else:
                    self.name()
            elif self.take("["):
                self.inside(self.index)
            elif self.take("("):
                self.inside(lambda: self.listed(self.argument, ")"))
                named = literal = False
            elif self.is_op("{") and (literal or named and self.open >= 0):
                self.value()
                named = literal = False
            else:
                return

    def argument(self) -> None:
        self.expression()
        self.take("...")

    def index(self) -> None:
        """One index, parts of a slice, or type arguments."""
        parts = 0
        while True:
            if not self.is_op(":", "]"):
                self.expression()
                parts += 1
            if self.take(":"):
                parts += 1
                continue
            if not (self.take(",") and not self.is_op("]")):
                break
        if not parts:
            raise self.refuse("an index")
        self.expect("]")

    def value(self) -> None:
        """The braces of a composite literal."""

        def part() -> None:
            self.value() if self.is_op("{") else self.expression()

        def item() -> None:
            part()
            if self.take(":"):
                part()

        self.expect("{")
        self.inside(lambda: self.listed(item, "}"))


def check(tokens: list, keywords: set[str], fail: Callable[[str], Exception]) -> None:
    """Raise what ``fail`` makes if the tokens, with their implied semicolons, are no source file."""
    try:
        Checker(tokens, keywords, fail).file()
    except RecursionError:
        raise fail("nested too deeply") from None
