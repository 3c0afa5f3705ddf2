"""Every rule fires on a bad module, and none on what only looks like it."""

import pytest
from pyspark.sql import functions as F

from strataq import dims
from strataq.config import Config
from strataq.operators import coupling, review
from strataq.operators.facts import fact, parse_go, register
from strataq.operators.rules import run_rules
from strataq.sources.tree import directory, go_sources

M = "example.com/m"


def tree(spark, files):
    rows = [(M, rel, body) for rel, body in files.items()]
    return spark.createDataFrame(rows, "module string, rel string, body string").withColumn("dir", directory(F.col("rel")))


BIG = "\n".join(f"\tx{i} := a + b*{i}" for i in range(60)) + "\n" + "\tif a > b && b > 1 {\n" + "".join("\t" * (i + 2) + f"if a > {i} {{\n" for i in range(6)) + "}" * 7
BAD = {
    "a/one.go": f"""package a

import (
	"fmt"
	"{M}/b/deep"
)

type Shown struct{{}}

func Wide(a, b, c, d, e int) {{
{BIG}
	fmt.Println(deep.B)
}}
""",
    "b/deep/two.go": f"""package deep

import "{M}/a"

// Copyright 2020 Somebody

// B is a name.
var B = a.Shown{{}}

// TODO: tidy
const url = "https://service.corp.dev/x"

var path = "/etc/app.conf"

// F does.
func F(db Conn, xs []int) {{
	s := ""
	for _, x := range xs {{
		for range xs {{
			s += "x"
		}}
		db.Exec("q", x)
	}}
	if s == "" {{
	}}
	switch s {{
	case "a":
	}}
	// y := compute(1)
	_ = s //nolint
}}
""",
    "c/vol.go": f'package c\n\nimport "{M}/a"\n\n// V uses.\nfunc V() {{\n' + "\n".join("\t_ = a.Shown{}" for _ in range(120)) + "\n}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = dict(BAD)
    files["c/span.go"] = "package c\n\nimport (\n" + "\n".join(f'\tp{i} "ext/p{i}"' for i in range(24)) + "\n)\n\n// S spans.\nfunc S() {\n" + "\n".join(f"\tp{i}.Do()" for i in range(24)) + "\n}\n"
    return run_rules(parse_go(tree(spark, files), strict=True)).cache()


def test_every_rule_is_alive(found):
    assert {r["rule"] for r in found.select("rule").distinct().collect()} == set(dims.RULES)


def test_findings_carry_place_and_words(found):
    row = found.where("rule = 'HARDCODED_URL'").first()
    assert (row["element"], row["description"], row["file"], row["severity"]) == ("two.go", "https://service.corp.dev/x", "b/deep/two.go", "finding")
    row = found.where("rule = 'PARAMETER_RISK'").first()
    assert row["description"] == "parameters: 5 (high risk, [5 - 6])" and row["value"] == 5
    row = found.where("rule = 'CYCLIC_REFERENCE'").orderBy("file").first()
    assert row["description"] == "import is part of a 2-directory reference cycle: a <-> b" and row["value"] == 2
    row = found.where("rule = 'SQL_IN_LOOP'").first()
    assert row["description"] == "database call Exec() inside a loop; one round trip per iteration"


def test_disabled_rules_and_order(spark, found):
    few = run_rules(parse_go(tree(spark, BAD)), Config(disabled_rules=["MISSING_DOC_COMMENT", "DEBUG_STATEMENT"]))
    assert few.where("rule IN ('MISSING_DOC_COMMENT', 'DEBUG_STATEMENT')").count() == 0
    rules = [r["rule"] for r in review.ordered(found).select("rule").collect()]
    assert rules == sorted(rules, key=dims.RULES.index)
    counts = {r["rule"]: r["findings"] for r in review.counts(few).collect()}
    assert len(counts) == len(dims.RULES) and counts["DEBUG_STATEMENT"] == 0


FINE = {
    "x/ok.go": """package x

import "log"

// Rows drains a query made outside the loop; the text may say copyright without being a notice.
func Rows(rows *R, db *D, keep []string) (out string) {
	for rows.Next() {
		rows.Scan(&out)
	}
	for _, k := range keep {
		db.Where(k)
		n := 0
		n += 1
		func() {
			for range keep {
			}
		}()
	}
	switch f(out) {
	case 1:
	}
	switch out {
	case "a":
		// handled by the caller
	}
	switch {
	case out == "":
	}
	if out == "" {
	} else {
		out = "https://sub.example.com/y and http://www.w3.org/z"
	}
	return "application/json"
}

type hidden struct{}

func (h hidden) Shown() { log := h; log.Printf("x") }
""",
    "cmd/main.go": 'package main\n\nimport "fmt"\n\nfunc main() { fmt.Println("shown to the user") }\n',
}


def test_lookalikes_do_not_fire(spark):
    got = {(r["rule"], r["description"]) for r in run_rules(parse_go(tree(spark, FINE), strict=True)).collect()}
    assert {r for r, _ in got} <= {"DEBUG_STATEMENT"}, got


def test_references_shadowing_and_keys(spark):
    files = {
        "p/a.go": f'package p\n\nimport "{M}/q"\n\nfunc A() {{\n\tB()\n\tq.X()\n\tq.X()\n\tq.Unknown()\n\text := T{{B: 1}}\n\t_ = ext\n}}\n',
        "p/b.go": "package p\n\ntype T struct{ B int }\n\nfunc B() {}\n",
        "p/c.go": f'package p\n\nimport "{M}/q"\n\nfunc C(B int, q T) {{ _ = B; q.X() }}\n',
        "q/x.go": "package q\n\nfunc X() {}\n",
    }
    parsed = parse_go(tree(spark, files))
    refs = coupling.resolved_references(parsed)
    got = {(r["rel"], r["target"]): r["refs"] for r in refs.collect()}
    assert got == {("p/a.go", "p/b.go"): 2, ("p/a.go", "q/x.go"): 2, ("p/a.go", f"{M}/q"): 1, ("p/c.go", "p/b.go"): 1}
    deps = {r["rel"]: (r["volume"], r["volume_local"], r["volume_cross"], r["span"]) for r in coupling.file_dependencies(parsed, refs).collect()}
    assert deps["p/a.go"] == (5, 2, 3, 2) and deps["p/b.go"] == (0, 0, 0, 0)
    fine = {r["rel"]: r["span"] for r in coupling.file_dependencies(parsed, refs, "file").collect()}
    assert fine["p/a.go"] == 3
    inside = coupling.module_dependencies(refs, parsed.select("module", "rel"))
    assert {(r["source"], r["target"], r["refs"]) for r in inside.collect()} == {("p/a.go", "p/b.go", 2), ("p/a.go", "q/x.go", 2), ("p/c.go", "p/b.go", 1)}
    fan = {r["target"]: (r["in_modules"], r["in_refs"]) for r in coupling.fan_in(inside, "source", "target", "refs").collect()}
    assert fan == {"p/b.go": (2, 3), "q/x.go": (1, 2)}


def test_what_is_scanned(spark):
    gen = "// Code generated by x. DO NOT EDIT.\npackage p\n"
    files = {"a.go": "package a\n", "a_test.go": "package a\n", "vendor/b.go": "package b\n", "x/vendor/c.go": "package c\n", ".hid/d.go": "package d\n", "gen.go": gen, "late.go": "package p\n" + gen, "r.md": "text"}
    names = lambda **k: {r["rel"] for r in go_sources(tree(spark, files), **k).collect()}
    assert names() == {"a.go", "x/vendor/c.go", "late.go"}
    assert names(include_tests=True, skip_generated=False) == {"a.go", "a_test.go", "x/vendor/c.go", "gen.go", "late.go"}


def test_strict_and_empty(spark):
    with pytest.raises(Exception, match="x.go"):
        parse_go(tree(spark, {"x.go": "nonsense"}), strict=True).count()
    none = parse_go(tree(spark, {"a.go": "package a\n"}).where("false"))
    assert run_rules(none).count() == 0


def test_front_end_from_sql(spark):
    register(spark)
    tree(spark, {"a.go": "package a\nfunc f(x int) { g() }\n"}).createOrReplaceTempView("go_texts")
    assert spark.sql("SELECT u.element, u.params FROM go_texts t, LATERAL parse_units(t.body) u").collect() == [("f", 1)]
    assert fact(parse_go(spark.table("go_texts")), "units").count() == 1
