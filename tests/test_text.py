import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave.functions import globs, text
from codeweave.functions.strict_json import ReplyError, parse_reply


@pytest.mark.parametrize("title, want", [("Key Functions", "key-functions"), ("HTTP Handler", "http-handler"), ("  a -- b ", "a-b"), ("Über", "ber"), ("", ""), ("-x-", "x")])
def test_slug(value, title, want):
    assert value(text.slug, title) == want


def test_toc_goes_after_the_first_title(value):
    page = "intro\n# T\nx\n## Key Functions\n### HTTP Handler\n#### no\n```\n## in fence\n```"
    got = value(text.with_toc, page)
    block = "## Contents\n\n- [Key Functions](#key-functions)\n  - [HTTP Handler](#http-handler)\n- [in fence](#in-fence)\n\n"
    assert got == "intro\n# T\n\n" + block + "x\n## Key Functions\n### HTTP Handler\n#### no\n```\n## in fence\n```"
    assert value(text.with_toc, "## A\nb") == "## Contents\n\n- [A](#a)\n\n## A\nb"
    assert value(text.with_toc, "plain\n# only") == "plain\n# only"
    assert value(text.with_toc, "# T\n## A") == "# T\n\n## Contents\n\n- [A](#a)\n\n## A"


@pytest.mark.parametrize("path", ["a/b", "a//b", "./a", "a/../b", "../a", "a/../../b", "/a/../../b", "", "/", ".", "a/./b/", "../../x/../y", "a/b/../../.."])
def test_clean_path(value, path):
    want = posixpath.normpath(path) if path else "."
    assert value(text.clean_path, path) == want.replace("//", "/")


def test_join_keeps_rooted_targets_below_the_folder(value):
    assert value(text.join_path, "docs/x", "/y.md") == "docs/x/y.md"
    assert value(text.join_path, ".", "../y.md") == "../y.md"


@pytest.mark.parametrize("path, ext, base, folder", [("a/b.tar.gz", ".gz", "b.tar.gz", "a"), (".go", ".go", ".go", "."), ("x/y", "", "y", "x"), ("a.b/c", "", "c", "a.b")])
def test_path_parts(value, path, ext, base, folder):
    assert (value(text.extension, path), value(text.basename, path), value(text.dirname, path)) == (ext, base, folder)


def test_token_estimates_count_bytes(value):
    assert value(text.token_estimate, "12345678") == 2
    assert value(text.token_estimate, "ééé") == 1
    assert value(text.token_estimate_up, "12345") == 2
    assert value(text.token_estimate_up, "") == 0


@pytest.mark.parametrize("name, want", [("Éa", True), ("éa", False), ("A", True), ("_A", False), ("", False), (None, False)])
def test_exported(value, name, want):
    assert value(text.is_exported, name) is want


def test_small_scalars(value):
    assert value(text.signature_of, "func F(x interface {}) {") == "func F(x interface"
    assert value(text.signature_of, " func F() ") == "func F()"
    assert value(text.trim_space, " \t a b \n ") == "a b"
    assert value(text.strip_quotes, '"fmt"') == "fmt"
    assert value(lambda a, b: text.trim_prefix(a, b), "mod/x", "mod") == "/x"
    assert value(lambda a: text.lines(a), "a\r\nb\n") == ["a\r", "b", ""]
    assert value(text.cut_fragment, "a.md#x#y") == "a.md"
    assert value(lambda a: text.ref(a, F.lit(7)), "p.go") == "p.go#L7"
    assert value(text.header_line, "p.go") == "// === p.go ==="
    assert value(lambda a: text.function_line(a, F.lit("p.go"), F.lit(3)), "func F()") == "func F()  // p.go:3"
    assert value(lambda a: text.type_line(a, F.lit("struct"), F.lit("p.go"), F.lit(3)), "T") == "type T struct  // p.go:3"


def test_links_include_images(value):
    got = value(text.markdown_links, "[a](b.md) ![i](c.png) [](x) [y]()")
    assert [(x["link_text"], x["link_target"]) for x in got] == [("a", "b.md"), ("i", "c.png")]


@pytest.mark.parametrize(
    "glob, path, want",
    [
        ("*_test.go", "a/b_test.go", True), ("*_test.go", "a/b.go", False), ("vendor/**", "vendor/x/y.go", True), ("vendor/**", "a/vendor/y.go", False),
        ("**/*.pb.go", "x.pb.go", True), ("**/*.pb.go", "a/b/x.pb.go", True), ("a/*", "a/b/c", False), ("a/**/c", "a/c", True), ("a/**/c", "a/b/b/c", True),
        ("[a-c]?.go", "bx.go", True), ("[!a]x", "ax", False), ("{foo,b*}.go", "bar.go", True), ("{foo,b*}.go", "x.go", False), ("a\\*", "a*", True), ("a\\*", "ab", False),
        ("[", "[", False), ("{a", "{a", False), ("a.b", "axb", False),
    ],
)
def test_globs(value, glob, path, want):
    assert globs.excluder([glob])(path) is want
    assert value(lambda p: globs.matches(p, [glob]), path) is want


def test_pruned_directories():
    (only,) = globs.pruned_dirs(["vendor/**", "*.go", "a/*"])
    assert only.fullmatch("vendor") and not only.fullmatch("x/vendor")


@settings(max_examples=60, deadline=None)
@given(st.text("ab*?/[]{},\\!-", max_size=10), st.text("ab/-", max_size=8))
def test_no_glob_raises(glob, path):
    assert globs.excluder([glob])(path) in (True, False)


SHAPE = {"id": str, "n": int, "on": bool, "l": [str]}


def test_replies_are_strict_but_for_unknown_keys_and_case():
    assert parse_reply('x ```json\n{"ID": "a", "extra": 1, "l": ["q"]}\n``` y', SHAPE) == {"id": "a", "n": 0, "on": False, "l": ["q"]}
    assert parse_reply('{"id": null, "n": 2, "l": null}', SHAPE) == {"id": "", "n": 2, "on": False, "l": []}
    for bad in ("", "no", '{"id": 1}', '{"n": true}', '{"l": "x"}', '{"id": "a"} tail', "[1]", '{"id": '):
        with pytest.raises(ReplyError):
            parse_reply(bad, SHAPE)
