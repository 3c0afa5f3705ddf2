import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataq.operators import declarations as d
from strataq.sinks import render


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_ts", ".ts").replace("_go", ".go"), v) for k, v in texts.items()], "rel string, text string")


def test_exports(spark):
    df = files(spark, a_ts="export const A = 1, B = 2\nexport async function go1() {}\n  export type T = 1\nconst no = 1\nexport const c = f(1), D = 2\n", b_ts="export class A {}\nexport let B = 3\nexport const D = 1\n")
    assert {r["name"]: r["files"] for r in d.duplicate_exports(df).collect()} == {"A": ["a.ts", "b.ts"], "B": ["a.ts", "b.ts"]}


def test_values(spark):
    df = files(spark, a_ts="const A = 'same value'\nconst s = 'abc'\nconst t = `x${y}zzz`\nexport const Q: string = \"it's\"\n", b_ts="export const B = `same value`\nconst Q = \"it's\"\nconst t = `x${y}zzz`\nconst s = 'abc'\n")
    assert {r["value"]: [s["name"] for s in r["sites"]] for r in d.duplicate_values(df).collect()} == {"same value": ["A", "B"], "it's": ["Q", "Q"]}
    twice = files(spark, a_ts="const A = 'same'\nconst A = 'same'\n")
    assert d.duplicate_values(twice).count() == 0


def test_a_very_long_text(spark):
    df = files(spark, a_ts="export const A = '" + "\\\\x" * 200_000 + "'\ntype U = " + " | ".join(f"'m{i}'" for i in range(20_000)) + "\nexport const B = 1" + ", c = 2" * 20_000 + "\n")
    assert d.string_constants(df).count() == 1 and d.union_sites(df).count() == 1 and d.exported_names(df).count() == 3


def test_unions_and_subsets(spark):
    df = files(spark, a_ts="type Tone = 'a' | 'b' | 'c'\nprop?: 'c' | 'b' | 'a'\n", b_ts='type Tone = "a" | "b" | "c" | "d"\ntype Two = "a" | "b"\n')
    assert [r["members"] for r in d.duplicate_unions(df).collect()] == [["a", "b", "c"]]
    sub = d.union_subsets(df).first()
    assert sub["missing"] == ["d"] and {s["name"] for s in sub["smaller_sites"]} == {"Tone", "prop"}


def test_contained_sets_against_all_pairs(spark):
    import random

    r = random.Random(1)
    sets = {f"s{i}": r.sample("abcdefg", r.randrange(1, 6)) for i in range(40)}
    got = {(x["smaller"], x["larger"]): set(x["missing"]) for x in d.contained_sets(spark.createDataFrame(list(sets.items()), "k string, m array<string>"), "k", "m").collect()}
    want = {(a, b): set(y) - set(x) for a, x in sets.items() for b, y in sets.items() if set(x) < set(y)}
    assert got == want


def test_shapes_and_helpers(spark):
    df = files(spark, a_ts="interface A { a: 1; b: 2; c: 3; d: 4 }", b_ts="type B = { d: 1, c: 2, b: 3, a: 4 }\ninterface C { a: 1; b: 2; c: 3 }")
    assert [r["fields"] for r in d.duplicate_shapes(df).collect()] == [["a", "b", "c", "d"]]
    go = files(spark, **{f"p{i}__x_go": f"package p\nfunc help({'a int' if i else 'a, b int'}) {{}}\nfunc (t T) m() {{}}\n" for i in range(4)}, root_go="func help(a int) {}")
    r = d.duplicate_helpers(d.go_helpers(go)).first()
    assert (r["name"], r["packages"], r["reimplemented"]) == ("help", 5, True)
    assert d.duplicate_helpers(d.go_helpers(go), 6).count() == 0


def row(check, sites, missing=None, again=False, shared=None):
    return (check, "t", [(f, n) for f, n in sites], missing, again, shared)


@pytest.mark.parametrize(
    "r, score, level",
    [
        (row("value", [("a.ts", "A"), ("b.ts", "B")]), 6, "MEDIUM"),
        (row("value", [("a.ts", "A"), ("a.ts", "B")]), 4, "MEDIUM"),
        (row("value", [("server/a.ts", "A"), ("shared/b.ts", "B")]), 9, "HIGH"),
        (row("name", [("utils/a.ts", "A"), ("b.ts", "A")]), 6, "MEDIUM"),
        (row("name", [("utils/x/a.ts", "A"), ("b.ts", "A")]), 3, "LOW"),
        (row("subset", [("a.ts", "x"), ("b.ts", "y")], ["d"], shared=["toneOf"]), 6, "MEDIUM"),
        (row("subset", [("a.ts", "x"), ("b.ts", "y")], ["d"], shared=[]), 3, "LOW"),
        (row("godecl", [(f"p{i}/a.go", "h") for i in range(8)], again=True), 9, "HIGH"),
        (row("union", [("a.ts", "x"), ("b.ts", "x"), ("types/c.ts", "x")]), 3, "LOW"),
        (row("shape", [("a/types/a.ts", "x"), ("b.ts", "x")]), 3, "LOW"),
    ],
)
def test_scores(spark, r, score, level):
    df = spark.createDataFrame([r], "check string, title string, sites array<struct<file:string,name:string>>, missing array<string>, reimplemented boolean, shared array<string>")
    got = d.scored(df).first()
    assert (got["score"], got["level"]) == (score, level) and len(got["why"]) >= 1


def test_ranking_of_all_kinds(spark):
    df = files(spark, utils__a_ts="export const A = 'one value'\ntype U = 'p' | 'q' | 'r'\ninterface I { a: 1; b: 2; c: 3; d: 4 }", server__b_ts="export const A = 'one value'\ntype U = 'p' | 'q' | 'r'\ntype W = 'p' | 'q' | 'r' | 's'\ninterface J { a: 1; b: 2; c: 3; d: 4 }", **{f"p{i}__x_go": "func help() {}" for i in range(4)})
    ranked = d.ranked(d.duplicate_exports(df), d.duplicate_values(df), d.duplicate_unions(df), d.union_subsets(df), d.duplicate_shapes(df), d.duplicate_helpers(d.go_helpers(df)))
    rows = d.in_rank(ranked).collect()
    assert {r["check"] for r in rows} == {"value", "godecl", "subset", "name", "union", "shape"}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert json.loads(render.declarations_report(ranked, 6, True))["scanned"] == 6
    assert "HIGH" in render.declarations_report(ranked, 6)


FOUND = "module string, rule string, element string, description string, file string, line int, severity string, value long"


@pytest.fixture(scope="module")
def found(spark):
    rows = [("m", "FUNCTION_SIZE_RISK", f"F{i}", "big | one", f"p{i % 3}/f.go", i, "very high risk" if i % 2 else "high risk", 200 + i) for i in range(40)] + [("m", "NESTED_LOOP", "G", "loop", "top.go", 1, "finding", 0)]
    return spark.createDataFrame(rows, FOUND)


def test_finding_reports(found, tmp_path):
    text = render.findings_text(found.withColumn("accepted", F.col("rule") == "NESTED_LOOP"))
    assert len(text.splitlines()) == 20
    assert next(x for x in text.splitlines() if x.startswith("NESTED_LOOP")).split() == ["NESTED_LOOP", "0", "0", "0", "1"]
    assert next(x for x in text.splitlines() if x.startswith("FUNCTION_SIZE")).split()[1:] == ["40", "20", "20", "-"]
    csv = render.findings_csv(found)
    assert csv.count("id,element,description") == 19 and '\n1,F39,"big | one"' not in csv and "\n1,F39,big | one,p0/f.go,39,very high risk\n" in csv
    rows = json.loads(render.findings_json(found))
    assert rows[0]["value"] == 239 and "value" not in rows[-1] and json.loads(render.findings_json(found.where("false"))) == []
    issues = render.issues(found)
    assert [i["rule"] for i in issues] == ["FUNCTION_SIZE_RISK", "NESTED_LOOP"] and "and 15 more" in issues[0]["body"] and "big \\| one" in issues[0]["body"]
    assert issues[1]["labels"] == ["quality", "review"] and render.issues_markdown(issues).count("# ") == 2
    paths = render.write_issue_files(issues, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["01-function-size-risk.md", "02-nested-loop.md"]
    assert render.fail_on(found, "very high risk") == render.FAILURE and render.fail_on(found, "none") == render.PASSED


def test_profile_reports(spark):
    from strataq.operators import profile

    units = spark.createDataFrame([("go", 100, 1, 0), ("go", 10, 1, 0), ("ts", None, 1, 1)], "language string, loc int, mccabe int, params int")
    totals = profile.language_totals(units, "language")
    dev = spark.createDataFrame([("go", "unit_size", "> 60", "2031", "", "known")], "language string, property string, tail string, decided string, ref string, summary string")
    tails = profile.with_deviations(profile.tail_shares(units, "language"), "language", dev)
    text = render.profile_markdown(totals, tails, "language", volume=profile.volume(totals, "language"))
    assert "known (decided 2031)" in text and "Not measured." in text and "| unit_size | > 60 | 1 | 100 | 90.9 | 8.3 | over by 91 lines |" in text and "not rated" in text
    assert "| go | 6 | 2 | 1 | no |" in render.standing_markdown(profile.standing(tails, "language"), profile.distances(tails, "language"), "language")
    audit = render.units_audit(units).collect()
    assert [(r["unit_size_category"], r["unit_complexity_category"]) for r in audit] == [("very high", "low"), ("low", "low"), ("none", "low")]
    moves = spark.createDataFrame([("go", "a", "moved", 66.8, 29.3), ("go", "b", "new", None, 0.06)], "language string, measure string, kind string, then double, now double")
    text = render.movement_markdown(moves, "language")
    assert "| 66.8 | 29.3 | -37.5 |" in text and "| 0.06 | new |" in text
    snap = spark.createDataFrame([("go", 1, 2, {"x > 1": 2.5}, None)], "language string, files_scanned int, unit_loc int, measures map<string,double>, entanglement map<string,double>")
    assert '"x > 1": 2.5' in render.snapshot_json(snap, "t", "r") and "entanglement" not in render.snapshot_json(snap, "t", "r")


def test_gates(spark, tmp_path):
    scores = spark.createDataFrame([("go", "unit_size", 3, 1, 0.75), ("go", "unit_complexity", 0, 0, None)], "language string, property string, good long, bad long, score double")
    assert render.delta_report(scores, "language", 0.5)[1] == render.PASSED
    text, code = render.delta_report(scores, "language", 0.8, "json")
    assert code == render.GATE and json.loads(text)[0]["score"] is None
    assert "no change" in render.delta_report(scores, "language", 0.8, "markdown")[0]
    verdict = spark.createDataFrame([(10, 5, 3, 50.0, True, 0, 3, None)], "statements long, covered long, generated_statements long, pct double, breached boolean, headroom long, shortfall long, raise_to double")
    packages = spark.createDataFrame([("a", 1, 90.0), ("b", 4, 10.0)], "package string, uncovered long, pct double")
    text, code = render.coverage_report(packages, verdict, 80.0, worst=1)
    assert code == render.GATE and "3 statements short" in text and " b\n" in text and " a\n" not in text
    render.append_summary(str(tmp_path / "s.md"), text)
    render.append_summary(str(tmp_path / "s.md"), text)
    assert (tmp_path / "s.md").read_text() == text * 2
    stale = spark.createDataFrame([("R", "f", "e", 3, 1)], "rule string, file string, element string, count int, matched long")
    assert "claims 3, matched 1" in render.stale_text(stale) and render.stale_text(stale.where("false")) == ""
    assert render.thousands(1234567) == "1,234,567" and render.plural(1, "file") == "1 file"


def test_entry_points():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_nothing_in_the_core_needs_the_llm_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "strataq"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "strataq.llm" not in p.read_text()
