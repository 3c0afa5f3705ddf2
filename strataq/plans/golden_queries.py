"""Queries over small fixed inputs whose results are written out by hand: every rule fires once, and every kind of
cycle, declaration and change has its row. They hold for any data, so the given tables are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import changes, coupling, graph, rules
from strataq.operators import declarations as decl
from strataq.operators.facts import fact, parse_go
from strataq.sources.tree import directory, go_sources, script_sources

_M = "example.com/m"
_GO = {
    "shop/cart.go": f"""package shop

import (
	"fmt"
	"{_M}/stock"
)

// Copyright 2021 Someone

// Total adds the prices up.
func Total(a, b, c, d, e int) int {{
	sum := ""
	for i := 0; i < a; i++ {{
		for j := 0; j < b; j++ {{
			sum += "x"
		}}
		db.Exec("insert", i)
	}}
	if a > 1 {{
	}}
	switch a {{
	case 1:
	}}
	fmt.Println(sum)
	// x := build(1)
	stock.Put(a) //nolint
	return b
}}

type Cart struct{{}}

// TODO: tidy up
const home = "https://shop.corp.dev/x"

var path = "/etc/shop.conf"
""",
    "stock/put.go": f'package stock\n\nimport "{_M}/shop"\n\n// Put keeps a thing.\nfunc Put(n int) {{ _ = shop.Cart{{}} }}\n',
    "wide/wide.go": "package wide\n\nimport (\n" + "".join(f'\tp{i} "ext/p{i}"\n' for i in range(24)) + ")\n\n// Wide calls all of them.\nfunc Wide() {\n" + "".join(f"\tp{i}.Do()\n" for i in range(24)) * 5 + "}\n",
    "deep/deep.go": "package deep\n\n// Deep looks down.\nfunc Deep(a int) {\n" + "".join("\t" * (i + 1) + f"if a > {i} {{\n" for i in range(6)) + "\t\t\t\t\t\t\ta++\n" + "".join("\t" * (6 - i) + "}\n" for i in range(6)) + "}\n",
    "deep/fine_test.go": "package deep\n\nfunc Untested(a, b, c, d, e int) {}\n",
    "vendor/x/x.go": "package x\n\nfunc Vendored(a, b, c, d, e int) {}\n",
}
_SHADOW = {
    "p/a.go": f'package p\n\nimport "{_M}/q"\n\nfunc A() {{\n\tB()\n\tq.X()\n\tq.X()\n\tq.Unknown()\n\text := T{{B: 1}}\n\t_ = ext\n}}\n',
    "p/b.go": "package p\n\ntype T struct{ B int }\n\nfunc B() {}\n",
    "p/c.go": f'package p\n\nimport "{_M}/q"\n\nfunc C(B int, q T) {{ _ = B; q.X() }}\n',
    "q/x.go": "package q\n\nfunc X() {}\n",
}
_SCRIPTS = {
    "web/utils/a.ts": "export const load = 1\nexport const KIND = 'shipment'\nexport type State = 'open' | 'held' | 'shut'\nexport interface Row { id: string; name: string; price: number; unit: string }\n",
    "web/server/b.ts": "export function load() {}\nconst OTHER = 'shipment'\ntype Mode = 'shut' | 'held' | 'open'\ntype rowState = 'open' | 'held' | 'shut' | 'lost'\ninterface Line { name: string; id: string; unit: string; price: number }\n",
    "web/a.test.ts": "export const load = 2\n",
    **{f"go/p{i}/h.go": f"package p{i}\n\nfunc clamp(a int{', b int' if i == 3 else ''}) int {{ return a }}\n" for i in range(4)},
}
_BEFORE = {"a.go": "package a\n\n// Old words.\nfunc F() { g(1) }\n", "b.go": "package b\n\nfunc F() { g(1) }\n", "c.go": "package c\n\n//go:noinline\nfunc F() {}\n", "d.go": "package d\n", "e.txt": "one\n"}
_AFTER = {"a.go": "package a\n\n// New words.\nfunc F() {\n\tg(1)\n}\n", "b.go": "package b\n\nfunc F() { g(2) }\n", "c.go": "package c\n\nfunc F() {}\n", "d.go": "package d\n\nnonsense\n", "e.txt": "two\n"}
_EDGES = [
    *[("mutual", *e) for e in (("A", "B", 1), ("B", "A", 10))],
    *[("tie", *e) for e in (("A", "B", 4), ("B", "A", 4), ("A", "C", 9), ("C", "B", 9))],
    *[("ring", *e) for e in (("A", "B", 10), ("B", "C", 15), ("C", "D", 3), ("D", "A", 8))],
    *[("bypass", *e) for e in (("B", "C", 18), ("C", "D", 14), ("B", "D", 1), ("D", "X", 5))],
    *[("leaf", *e) for e in (("B", "C", 18), ("C", "E", 14), ("B", "E", 1))],
    *[("heavy", *e) for e in (("B", "C", 4), ("C", "D", 4), ("B", "D", 20), ("D", "X", 5))],
]


def _tree(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    rows = [(_M, rel, body) for rel, body in files.items()]
    return spark.createDataFrame(rows, "module string, rel string, body string").withColumn("dir", directory(F.col("rel")))


def golden_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_rules(parse_go(go_sources(_tree(spark, _GO)), strict=True)).drop("module")


def golden_references(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_go(_tree(spark, _SHADOW))
    return coupling.file_dependencies(parsed, coupling.met_references(parsed)).select("rel", "volume", "volume_local", "volume_cross", "span", F.array_join("targets", " ").alias("targets"))


def golden_import_cycles(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_go(go_sources(_tree(spark, _GO)))
    found = graph.directory_cycles(graph.import_edges(fact(parsed, "imports"), parsed.select("module", "dir")))
    return found.select("depth", F.array_join("members", " ").alias("members"), "from_dir", "to_dir", "rel", "line")


def golden_violations(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame(_EDGES, "language string, `from` string, `to` string, weight int")
    return graph.violations(edges, "language").select("language", "kind", "from", "to", "weight")


def golden_declarations(spark: SparkSession, d: str) -> DataFrame:
    files = decl.script_facts(script_sources(_tree(spark, _SCRIPTS)))
    typed = files.where(~F.col("rel").endswith(".go"))
    out = decl.ranked(decl.duplicate_exports(typed), decl.duplicate_values(typed), decl.duplicate_unions(typed), decl.union_subsets(typed), decl.duplicate_shapes(typed), decl.duplicate_helpers(decl.go_helpers(files)))
    return out.select("check", "title", F.array_join(F.transform("sites", lambda s: F.concat(s["file"], F.lit(":"), s["name"])), " ").alias("sites"), "score", "level")


def golden_changes(spark: SparkSession, d: str) -> DataFrame:
    sides = [spark.createDataFrame(list(x.items()), "path string, body string") for x in (_BEFORE, _AFTER)]
    status = spark.createDataFrame([("M", p) for p in _AFTER] + [("A", "new.go")], "status string, path string")
    return changes.partition_changes(status, *sides)


QUERIES = {f.__name__: f for f in (golden_findings, golden_references, golden_import_cycles, golden_violations, golden_declarations, golden_changes)}


def _values(columns: str, rows: list[tuple], where: str = "") -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({columns})"


_F, _H, _V = "finding", "high risk", "very high risk"
_CART = "shop/cart.go"
#: Expected values, worked out by hand from the texts above.
SQL = {
    "golden_findings": _values(
        "rule, element, description, file, line, severity, value",
        [
            ("CYCLIC_REFERENCE", "stock", "import is part of a 2-directory reference cycle: shop <-> stock", _CART, 5, _F, 2),
            ("CYCLIC_REFERENCE", "shop", "import is part of a 2-directory reference cycle: shop <-> stock", "stock/put.go", 3, _F, 2),
            ("FUNCTION_SIZE_RISK", "Wide", "function size in tokens: 606 (very high risk, [> 500])", "wide/wide.go", 31, _V, 606),
            ("PARAMETER_RISK", "Total", "parameters: 5 (high risk, [5 - 6])", _CART, 11, _H, 5),
            ("FUNCTION_COMPLEXITY_RISK", "Deep", "cognitive complexity: 21 (high risk, [21 - 40])", "deep/deep.go", 4, _H, 21),
            ("DEPENDENCY_VOLUME_RISK", "wide.go", "dependency volume: 120 (high risk, [111 - 200])", "wide/wide.go", 1, _H, 120),
            ("DEPENDENCY_SPAN_RISK", "wide.go", "dependency span: 24 (high risk, [24 - 33])", "wide/wide.go", 1, _H, 24),
            ("HARDCODED_URL", "cart.go", "https://shop.corp.dev/x", _CART, 33, _F, 0),
            ("HARDCODED_PATH", "cart.go", "/etc/shop.conf", _CART, 35, _F, 0),
            ("COPYRIGHT_OR_LICENSE_NOTICE", "cart.go", "Copyright 2021 Someone", _CART, 8, _F, 0),
            ("SQL_IN_LOOP", "Total", "database call Exec() inside a loop; one round trip per iteration", _CART, 17, _F, 0),
            ("STRING_CONCAT_IN_LOOP", "Total", "string sum rebuilt by concatenation inside a loop; use strings.Builder", _CART, 15, _F, 0),
            ("NESTED_LOOP", "Total", "loop nested 2 deep; the work inside runs the product of both counts", _CART, 14, _F, 0),
            ("EMPTY_BRANCH", "Total", "if statement with an empty body and no else; the condition is tested and then ignored", _CART, 19, _F, 0),
            ("SWITCH_WITHOUT_DEFAULT", "Total", "switch has no default clause; an unhandled value passes through silently", _CART, 21, _F, 0),
            ("DEBUG_STATEMENT", "Total", "fmt.Println() writes to stdout instead of the logger", _CART, 24, _F, 0),
            ("COMMENTED_OUT_CODE", "Total", "commented-out code: x := build(1)", _CART, 25, _F, 0),
            ("UNFINISHED_WORK", "cart.go", "TODO: tidy up", _CART, 32, _F, 0),
            ("SUPPRESSED_WARNING", "Total", "lint suppression: nolint", _CART, 26, _F, 0),
            ("MISSING_DOC_COMMENT", "Cart", "exported type Cart in cart.go has no doc comment", _CART, 30, _F, 0),
        ],
    ),
    # a.go: B and T of its sibling, X twice and the unknown name of the package; a key and a bound name are none
    "golden_references": _values("rel, volume, volume_local, volume_cross, span, targets", [("p/a.go", 5, 2, 3, 2, f"{_M}/q p/b.go"), ("p/b.go", 0, 0, 0, 0, ""), ("p/c.go", 1, 1, 0, 1, "p/b.go"), ("q/x.go", 0, 0, 0, 0, "")]),
    "golden_import_cycles": _values("depth, members, from_dir, to_dir, rel, line", [(1, "shop stock", "shop", "stock", _CART, 5), (1, "shop stock", "stock", "shop", "stock/put.go", 3)]),
    "golden_violations": _values('language, kind, "from", "to", weight', [("mutual", "cyclic", "A", "B", 1), ("tie", "cyclic", "A", "B", 4), ("ring", "indirect cyclic", "C", "D", 3), ("bypass", "transitive", "B", "D", 1)]),
    # points: name 3, auto-import 3, parts apart 2; value 6, parts apart 2; union and shape 2, parts apart 2; subset 3, parts apart 2 (of one file less 2); helpers 3, arities differ 2, four copies 2
    "golden_declarations": _values(
        '"check", title, sites, score, level',
        [
            ("name", "load", "web/server/b.ts:load web/utils/a.ts:load", 8, "HIGH"),
            ("value", '{"value":"shipment"}', "web/server/b.ts:OTHER web/utils/a.ts:KIND", 8, "HIGH"),
            ("union", "3 members: held | open | shut", "web/server/b.ts:Mode web/utils/a.ts:State", 4, "MEDIUM"),
            ("subset", "missing lost", "web/server/b.ts:Mode (narrower) web/utils/a.ts:State (narrower) web/server/b.ts:rowState (wider)", 5, "MEDIUM"),
            ("shape", "{id, name, price, unit}", "web/server/b.ts:Line web/utils/a.ts:Row", 4, "MEDIUM"),
            ("godecl", "clamp — declared in 4 packages", "go/p0/h.go:clamp go/p1/h.go:clamp go/p2/h.go:clamp go/p3/h.go:clamp", 7, "HIGH"),
        ],
    ),
    "golden_changes": _values("status, path, exempt", [("M", "a.go", True), ("M", "b.go", False), ("M", "c.go", False), ("M", "d.go", False), ("M", "e.txt", False), ("A", "new.go", False)]),
}
