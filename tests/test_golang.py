import hashlib

import pytest

from codeweave.sources import golang, registry

FIRST = b'package sample\n\nimport "fmt"\n\ntype Gadget struct{}\n\nfunc Shown(name string) string {\n\treturn fmt.Sprint(name)\n}\n\nfunc hidden() {}\n'
SECOND = b"""package sample

import (
	"context"
	f "fmt"
	_ `raw/path`
)

type Service interface {
	Run(context.Context) error
}

type Alias = string

type Gadget struct{}

func (g *Gadget) Run(ctx context.Context) error {
	_ = ctx
	return nil
}

func Build(name string) (string, error) {
	return f.Sprintf("hi %s {", name), nil
}
"""


def names(rows, *keys):
    return [tuple(r[k] for k in keys) for r in rows]


def test_functions_types_and_imports():
    got = golang.parse(FIRST)
    assert names(got["functions"], "name", "signature", "line_start", "line_end", "exported") == [("Shown", "func Shown(name string) string", 7, 9, True), ("hidden", "func hidden()", 11, 11, False)]
    assert names(got["types"], "name", "kind", "line_start", "line_end", "exported") == [("Gadget", "struct", 5, 5, True)]
    assert names(got["imports"], "path", "internal") == [("fmt", False)]
    assert got["content_hash"] == hashlib.sha256(FIRST).hexdigest()


def test_methods_aliases_and_grouped_imports():
    got = golang.parse(SECOND)
    assert names(got["functions"], "name", "signature", "line_start", "line_end") == [
        ("Run", "func (g *Gadget) Run(ctx context.Context) error", 17, 20),
        ("Build", "func Build(name string) (string, error)", 22, 24),
    ]
    assert names(got["types"], "name", "kind", "line_start", "line_end") == [("Service", "interface", 9, 11), ("Alias", "alias", 13, 13), ("Gadget", "struct", 15, 15)]
    assert [i["path"] for i in got["imports"]] == ["context", "fmt"]


def test_more_of_the_language():
    got = golang.parse(
        b"""package p // a comment
/* block
comment */ type (
	A[T any, K comparable] struct { x map[K][]T }
	B [4]struct{}
	C int
	D interface{ ~int | ~string }
)
var x = func() int { type local struct{ y rune }; return len("a\\"b") + int('\\'') }
const ( one = iota; two )
func G[T any](a T, fs ...func(T) error) (r struct{ n int }, err error) { switch v := any(a).(type) { case int: _ = v }; return }
func external(a int) int
func H(m map[string]interface {}) chan<- int { return nil }
"""
    )
    assert names(got["types"], "name", "kind") == [("A", "struct"), ("B", "alias"), ("C", "alias"), ("D", "interface"), ("local", "struct")]
    assert names(got["functions"], "name", "signature") == [
        ("G", "func G[T any](a T, fs ...func(T) error) (r struct{ n int }, err error)"),
        ("external", "func external(a int) int"),
        ("H", "func H(m map[string]interface"),
    ]


@pytest.mark.parametrize(
    "bad",
    ["package p\n\nfunc Broken( {\n", "package p\nfunc () {}", "func f() {}", "package p\nx := 1", 'package p\nvar s = "open', "package p\nfunc f() { ( }", "package p\ntype T\n", "package p\nimport fmt", "package p\nvar a = 'x", "package p; @"],
)
def test_rejected(bad):
    with pytest.raises(golang.SyntaxProblem):
        golang.parse(bad.encode())


VALID = [
    "func f() { for range 3 { } ; for i := range xs { _ = i } ; for k, v = range m { } ; for ; ; { } ; for x < 3 { } ; for i := 0; ; i++ { break } }",
    "func f() { if v, ok := m[k]; ok && (T{}) == v { } else if x { } else { } }",
    "func f() { switch { case x > 1: fallthrough; default: }; switch x := v.(type) { case []int, map[string]T, func(int) bool, *T, chan<- int, nil: _ = x } }",
    "func f() { select { case c <- 1: case v, ok := <-c: _ = v; default: return } }",
    "func f() { L: for { continue L }; goto L; go func() { }(); defer close(<-ch); ch <- <-in }",
    "var a = [...]string{2: \"b\", \"c\"}\nvar b = map[string]struct{ X, Y int }{\"p\": {1, 2}}\nvar c = []*T{{A: 1}, {}}\nvar d = struct{}{}",
    "var s, t = xs[:], xs[1:2:3]\nvar u = f[int, []string](x...)\nvar p = Pair[K, V]{k, v}\nvar q = (*T).M\nvar r = <-chan int(nil)",
    "type G[K comparable, V ~int | ~[]string] struct { *Base; pkg.Other `x:\"y\"`; K, L K; m map[K][]V; f func(K) (V, error); List[K] }",
    "type I interface { ~int | pkg.T; M(x int, _ ...string) (n int, err error); fmt.Stringer }\ntype A [N]int\ntype B [N * 2]*T\ntype C = func(a, b int, c [4]T) <-chan T",
    "const (\n\tA, B T = iota, 1 << iota\n\tC, D\n)\nvar (\n\tx int\n\ty, z = 1i, 0x1p-2\n)",
    "func (r *R[T]) m(T, ...int) (T, error) { return *new(T), nil }\nfunc g() func() { return func() { } }\nfunc h(x T[int], y pkg.U[K])",
    "func f() { x, y := a.(T), -b&^+c<<2; x.y[0].z(1, []int{1}, func(i int) { })++; *p = !q; var w = `raw\n`; const k = 'k'; type t int; { } }",
    "func f() {\n\treturn T{\n\t\tA: 1,\n\t}.\n\t\tDo(\n\t\t\tx,\n\t\t)\n}",
]
INVALID = [
    "func f() { x = }", "func f() { x := }", "func f() { return 1 + }", "func f() { if { } }", "func f() { if x; { } }", "func f() { for i := 0; i < 3 { } }", "func f() { x y }",
    "func f() { f(a b) }", "func f() { switch x { x = 1 } }", "func f() { case 1: }", "func f() { else { } }", "func f() { a[] }", "func f() { T{1 2} }",
    "func f() { T{\n1\n} }", "func f() { x. }", "func f() { if x\n{ } }", "func f(a int b int) { }", "func f() { var }", "func f() { go }", "type S struct { a b c }",
    "type S struct { a int b int }", "type I interface { M( }", "var x = [3]", "var m map[string", "var x = func", "func f() { select { x: } }", "const = 1", "func f() { 1 := }", "func f[]() { }",
]


@pytest.mark.parametrize("body", VALID)
def test_grammar_takes(body):
    golang.parse(f"package p\n\n{body}\n".encode())


@pytest.mark.parametrize("body", INVALID)
def test_grammar_refuses(body):
    with pytest.raises(golang.SyntaxProblem):
        golang.parse(f"package p\n\n{body}\n".encode())


def test_grammar_refuses_deep_nesting_as_a_problem():
    with pytest.raises(golang.SyntaxProblem):
        golang.parse(("package p\nvar x = " + "(" * 100_000 + "1" + ")" * 100_000 + "\n").encode())


def test_empty_file_has_empty_lists():
    got = golang.parse(b"")
    assert (got["functions"], got["types"], got["imports"]) == ([], [], [])


def test_registry_refuses_a_second_parser():
    r = registry.default_registry()
    with pytest.raises(ValueError):
        r.register(".go", golang.parse)
    assert r.lookup(".py") is None and r.lookup(".GO") is None


def test_parse_files_keeps_errors_as_rows(spark):
    files = spark.createDataFrame([("a.go", FIRST), ("b.go", b"package p\nfunc X( {"), ("c.GO", FIRST), ("d.py", b"x"), ("e.go", None)], "path string, content binary")
    parsed = registry.parse_files(files).cache()
    assert registry.skipped(parsed) == 1
    assert sorted(r["path"] for r in registry.index_of(parsed).collect()) == ["a.go", "e.go"]
