import pytest

from strataq.frontend.gofacts import canonical_code, clip, go_facts, unquote
from strataq.frontend.golexer import GoSyntaxError
from strataq.frontend.goparser import parse, parses_as_body
from strataq.frontend.scriptfacts import arity_at, record_shapes


def unit(body, head="func f(a, b, c bool) int"):
    facts = go_facts(f"package p\n\n{head} {{\n{body}\n}}\n")
    assert facts["error"] is None, facts["error"]
    return dict(zip("element line tokens params complexity loc mccabe has_body".split(), facts["units"][0]))


@pytest.mark.parametrize("body, n", [("if a && b && c {}", 4), ("switch a { case true: case false: default: }", 3), ("select { case <-c: default: }", 2), ("for a { for range x { } }", 3), ("", 1)])
def test_mccabe(body, n):
    assert unit(body)["mccabe"] == n


@pytest.mark.parametrize(
    "body, n",
    [
        ("if a { if b { } }", 3), ("if a { } else if b { } else { }", 3), ("if a && b && c {}", 2), ("if a && b || c {}", 3), ("if a && (b || c) {}", 3), ("L: for { break L }", 2),
        ("f(a)", 1), ("x.f(a)", 1), ("go func() { if a { } }()", 2), ("switch { case a: if b { } }", 3), ("if x := f(); a { }", 1), ("", 0),
    ],
)
def test_cognitive(body, n):
    assert unit(body)["complexity"] == n


@pytest.mark.parametrize("head, n", [("func (r *T) f(a, b, c int)", 3), ("func f(a, b int, c string, d ...int)", 4), ("func f(int, string)", 2), ("func f()", 0), ("func f[K comparable, V any](m map[K]V)", 1)])
def test_params(head, n):
    assert unit("", head)["params"] == n


def test_names_of_units():
    assert unit("", "func (r *Tree[K, V]) f()")["element"] == "(*Tree[K, V]).f"
    assert unit("", "func (Tree) f()")["element"] == "(Tree).f"


def test_tokens_and_lines_leave_out_comments_and_implied_semicolons():
    u = unit("\t// nothing\n\tx := `a\nb\nc`\n\t_ = x; return 1")
    assert (u["tokens"], u["loc"]) == (12 + 3 + 4 + 2 + 1, 4)


def test_a_function_without_a_body():
    facts = go_facts("package p\nfunc f(a int)\n")
    assert facts["units"][0][4:] == (0, 1, 0, False)


def test_grammar():
    parse(
        """package p
import ("fmt"; x "a/b"; . "c"; _ "d")
type S[T any] struct { A, B int `json:"a"`; *C; D.E; f func(int) (string, error) }
type Arr [N]int
type I interface { M(x int) string; ~int | string }
type Alias = map[string]chan<- int
const ( A = iota; B )
var v, w = 1, "s"
func F[T ~[]E, E comparable](a, b T, c ...int) (n int, err error) {
L:
	for i, v := range a { if x, ok := v.(int); ok && i > 0 { continue L } else if y == (Z{1}) {} else { go func() { ch <- 1 }() } }
	switch t := x.(type) { case int, string: foo(t); default: }
	select { case v := <-ch: _ = v; case ch <- 2: default: }
	m := map[string][]int{"a": {1, 2}, "b": nil}; p := &S[int]{A: 1}; q := []struct{a int}{{1}}; z := a[1:2:3]; w := F[int, string](x)
	for ;; { break }; for x < 3 { x++ }; for range 10 {}; defer f(); var e error; const c = 1 << 3
	if f := func(a int) bool { return a > 1 }; f(2) { }
	return
}
"""
    )


@pytest.mark.parametrize("text", ["", "func f() {}", "package p\nfunc f( {", "package p\nx := 1", 'package p\nvar s = "open', "package p\nfunc f() { if }"])
def test_what_is_no_go_file(text):
    with pytest.raises(GoSyntaxError):
        parse(text)
    assert go_facts(text)["error"] and go_facts(text)["units"] == []


def test_null_text():
    assert go_facts(None)["error"]


def test_code_in_comments():
    assert parses_as_body("x := f(1)\nreturn x") and not parses_as_body("the quick brown fox")
    facts = go_facts("package p\n// x := compute(1)\n// return x\n\n// Plain words about it.\n// if only it were so\nfunc f() {}\n")
    assert [c[6] for c in facts["comments"]] == ["x := compute(1) return x", None, None, None]
    assert not any(c[5] for c in facts["comments"])


def test_comment_groups():
    facts = go_facts("package p\n\nvar a = 1 // beside\n// own\n// two\n\n/* three */\n// four\nfunc f() {}\n")
    assert [c[0] for c in facts["comments"]] == [0, 1, 1, 2, 2]


def test_literals_leave_out_imports_and_tags():
    facts = go_facts('package p\nimport "fmt"\ntype T struct { A int `json:"a"` }\nvar v = "top"\nfunc (t T) f() { fmt.Println("in\\n", `raw`) }\n')
    assert [(e, v) for e, _, v in facts["literals"]] == [(None, "top"), ("(T).f", "in\n"), ("(T).f", "raw")]


def test_text_helpers():
    assert unquote(r'"a\x41é\"\101"') == 'aAé"A'
    assert clip("é" * 60).encode().__len__() <= 90 and clip("short") == "short"


def test_canonical_code_ignores_comments_but_not_directives():
    a = "package p\n// one\nfunc f() { return }\n"
    assert canonical_code(a) == canonical_code("package p\n\nfunc f() {\n\treturn // two\n}\n")
    assert canonical_code(a) != canonical_code("package p\n//go:noinline\nfunc f() { return }\n")
    assert canonical_code(a) != canonical_code("package p\nfunc g() { return }\n")


def test_script_extractions():
    assert record_shapes("interface A { a: string; b?: { x: number, y: number }, readonly c: number\n d: string }") == [("A", ["a", "b", "c", "d"])]
    assert record_shapes("type B = { a: 1 }\ntype C = 'x' | 'y'") == [("B", ["a"])] and record_shapes(None) == []
    assert arity_at("func a() {}\nfunc b(x, y int, f func(a, b int)) {}\nfunc c[M ~map[string]V, V any](m M) {}\nfunc (t T) d(x int) {}\nfunc E(x int) {}\nfunc g(x int") == [("a", 0), ("b", 3), ("c", 1), ("g", None)]
