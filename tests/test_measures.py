"""Profiles, duplication, review, change, coverage, agreement."""

import random

import pytest
from pyspark.sql import functions as F

from strataq import dims
from strataq.operators import agreement, coupling, coverage, delta, duplication, profile, review, snapshots
from strataq.sources.records import parse_coverage


def units(spark, rows):
    return spark.createDataFrame(rows, "language string, loc int, mccabe int, params int")


def tail(spark, rows, prop, label, lang="go"):
    got = profile.tail_shares(units(spark, rows), "language").where((F.col("property") == prop) & (F.col("tail") == label) & (F.col("language") == lang)).first()
    return got


def test_categories_and_tails_line_up():
    for _, bands, tails in [*dims.UNIT_PROPERTIES.values(), *dims.MODULE_PROPERTIES.values()]:
        assert all(a[2] + 1 == b[1] for a, b in zip(bands, bands[1:]))
        assert [t if inclusive else t + 1 for t, inclusive, _ in tails] == [b[1] for b in bands[1:]]
    for p, (_, most) in dims.DELTA_PROPERTIES.items():
        assert dims.UNIT_PROPERTIES[p][1][0][2] == most


@pytest.mark.parametrize("over, total, passes, at_cap", [(83, 1000, True, True), (84, 1000, False, False), (831, 10000, False, True)])
def test_verdicts_are_not_rounded(spark, over, total, passes, at_cap):
    r = tail(spark, [("go", over, 1, 0), ("go", 1, 1, 0)] + [("go", 1, 1, 0)] * 0 + [("go", 50, 1, 0)] * ((total - over - 1) // 50) + [("go", (total - over - 1) % 50, 1, 0)], "unit_size", "> 60")
    assert (r["loc"], r["total"], r["pass"], r["at_cap"]) == (over, total, passes, at_cap)
    assert r["excess_loc"] == (0 if passes else 1)


def test_lines_weigh_and_tails_nest(spark):
    rows = [("go", 1, 1, 0)] * 40 + [("go", 400, 30, 3), ("ts", 10, 6, 7), ("ts", None, 3, 1)]
    r = tail(spark, rows, "unit_size", "> 15")
    assert (r["loc"], r["total"], r["pct"]) == (400, 440, pytest.approx(400 / 440 * 100))
    assert [tail(spark, rows, "unit_complexity", f"> {t}")["loc"] for t in (5, 10, 25)] == [400, 400, 400]
    assert tail(spark, rows, "unit_interfacing", ">= 3")["loc"] == 400
    assert tail(spark, rows, "unit_size", "> 15", profile.COMBINED)["total"] == 450
    shares = profile.category_shares(units(spark, rows), "language").where("language = 'go' AND property = 'unit_size'").collect()
    assert {r["category"]: r["loc"] for r in shares} == {"low": 40, "moderate": 0, "high": 0, "very high": 400}


def test_nothing_measured_gives_no_verdict(spark):
    none = units(spark, [("go", None, 1, 1)])
    assert profile.tail_shares(none, "language").count() == 0
    totals = profile.language_totals(units(spark, [("go", 0, 1, 1), ("ts", 5, 1, 1)]), "language")
    assert [r["language"] for r in profile.unmeasured(totals, "language").collect()] == ["go"]


def test_standing_distances_and_deviations(spark):
    tails = profile.tail_shares(units(spark, [("go", 100, 1, 0), ("go", 10, 1, 0)]), "language")
    dev = spark.createDataFrame([("go", "unit_size", "> 60", "2031", "", "known")], "language string, property string, tail string, decided string, ref string, summary string")
    joined = profile.with_deviations(tails, "language", dev)
    s = profile.standing(joined, "language").first()
    assert (s["within"], s["over"], s["deviated"], s["eligible"]) == (6, 2, 1, False)
    d = profile.distances(tails, "language").first()
    assert d["excess_loc"] == tails.agg(F.max("excess_loc")).first()[0]


def test_volume(spark):
    totals = profile.language_totals(units(spark, [("TypeScript", 31600, 1, 0), ("go", 5, 1, 0)]), "language")
    assert {r["language"]: r["years"] for r in profile.volume(totals, "language").collect()} == {"TypeScript": pytest.approx(3.9), "go": None}


def test_claims_that_all_sets_make(spark):
    sets = spark.createDataFrame([("go", ["coupling", "duplication"]), ("ts", ["duplication", "duplication"])], "language string, module_metrics array<string>")
    assert profile.claimed_by_all(sets).first()["module_metrics"] == ["duplication"]


def test_snapshot_figures_and_movement(spark):
    now = spark.createDataFrame([("go", {"a": 1.0, "b": 2.0})], "language string, measures map<string,double>")
    then = spark.createDataFrame([("go", {"a": 1.5, "c": 3.0}), ("ts", {"a": 1.0})], "language string, measures map<string,double>")
    got = {(r["language"], r["measure"]): r["kind"] for r in snapshots.movement(now, then, "language").collect()}
    assert got == {("go", "a"): "moved", ("go", "b"): "new", ("go", "c"): "gone", ("ts", "a"): "gone"}
    assert snapshots.movement(now, None, "language").count() == 0
    tails = spark.createDataFrame([("go", "p", "> 5", 8.25)], "language string, property string, tail string, pct double")
    assert snapshots.tail_measures(tails, "language").first()["measures"] == {"p > 5": 8.3}


def dup_lines(spark, files):
    return spark.createDataFrame([(f, i, t) for f, ls in files.items() for i, t in enumerate(ls)], "f string, i int, line_text string")


@pytest.mark.parametrize(
    "files, n",
    [
        ({"a": list("abcde"), "b": list("abcde")}, 0), ({"a": list("abcdef"), "b": list("abcdef")}, 6), ({k: list("abcdef") for k in "xyz"}, 12), ({k: list("abcdefghijkl") for k in "xy"}, 12),
        ({k: list("abcdef") for k in "wxyz"}, 18), ({"a": list("aaaaaaaa")}, 7), ({"a": list("abcdef") + ["-"] + list("abcdef")}, 6), ({}, 0),
    ],
)
def test_redundant_lines(spark, files, n):
    assert duplication.redundant_lines(dup_lines(spark, files), ["f"]).count() == n


def test_duplication_summary(spark):
    d = duplication.duplication(dup_lines(spark, {k: list("abcdef") for k in "xy"}), ["f"]).first()
    assert (d["redundant_loc"], d["total_loc"], d["pass"], d["excess_loc"]) == (6, 12, False, 6)
    assert duplication.duplication(dup_lines(spark, {}), ["f"]).count() == 0
    texts = spark.createDataFrame([(1, "a  b\n\n \tc\r\n"), (2, None), (3, "")], "id long, text string")
    assert [(r["id"], r["i"], r["line_text"]) for r in duplication.text_lines(texts, "id", "text").collect()] == [(1, 0, "a b"), (1, 1, "c")]


def test_acceptances_are_bounded_by_count(spark):
    r = random.Random(5)
    found = [(r.choice(["R", "S"]), r.choice(["f", "g", None]), "e", i) for i in range(300)]
    acc = [("R", "f", "e", 3, "d", "why", "ref"), ("R", "f", "e", 2, "d", "too", ""), ("S", "g", "e", 500, "d", "all", ""), ("S", "none", "e", 1, "d", "gone", "")]
    findings = spark.createDataFrame(found, "rule string, file string, element string, line int")
    accs = spark.createDataFrame(acc, "rule string, file string, element string, count int, reviewed string, reason string, ref string")
    key = ["rule", "file", "element"]
    rows = review.apply_acceptances(findings, accs, key, ["line"])
    got = sorted((x["rule"], x["file"] or "", x["line"]) for x in rows.where("accepted").collect())
    want = sorted([(a, b, i) for a, b, _, i in found if (a, b) == ("R", "f")][:5] + [(a, b, i) for a, b, _, i in found if (a, b) == ("S", "g")])
    assert got == want and rows.count() == 300
    stale = {(x["rule"], x["file"]): x["matched"] for x in review.stale_acceptances(findings, accs, key).collect()}
    assert stale == {("S", "g"): sum(1 for f in found if f[:2] == ("S", "g")), ("S", "none"): 0}
    summary = {x["rule"]: (x["accepted"], x["reasons"], x["refs"]) for x in review.accepted_summary(rows, accs, key).collect()}
    assert summary["R"] == (5, ["too", "why"], ["ref"])
    assert review.apply_acceptances(findings, accs.where("false"), key, ["line"]).where("accepted").count() == 0


def test_issue_actions(spark):
    new = spark.createDataFrame([("<!-- A -->", "t", "<!-- A --> x"), ("<!-- B -->", "t", "<!-- B --> x"), ("<!-- C -->", "t", "c")], "marker string, title string, body string")
    old = spark.createDataFrame([(4, "t", "<!-- A --> x"), (3, "t", "<!-- B --> old"), (9, "t", "<!-- B --> x")], "number long, title string, body string")
    assert {r["marker"]: (r["action"], r["number"]) for r in review.issue_actions(new, old).collect()} == {"<!-- A -->": ("skip", 4), "<!-- B -->": ("update", 3), "<!-- C -->": ("create", None)}


def side(spark, rows):
    return spark.createDataFrame(rows, "language string, file string, loc int, mccabe int, params int")


def test_delta(spark):
    a = side(spark, [("go", "f", 90, 1, 0), ("go", "same", 5, 1, 0), ("go", "old", 7, 1, 0)])
    b = side(spark, [("go", "f", 10, 1, 0), ("go", "f", 10, 1, 0), ("go", "f", 10, 1, 0), ("go", "same", 5, 1, 0), ("go", "new", 100, 9, 9)])
    files = delta.delta_files(a, b)
    f = {r["file"]: r for r in files.collect()}
    assert (f["f"]["good_unit_size"], f["f"]["bad_unit_size"]) == (120, 0)
    assert (f["old"]["good_unit_size"], f["old"]["bad_unit_size"], f["old"]["removed"]) == (0, 7, True)
    assert (f["new"]["good_unit_complexity"], f["new"]["bad_unit_complexity"], f["new"]["added"]) == (0, 100, True)
    scores = {r["property"]: r for r in delta.delta_scores(files).collect()}
    assert (scores["unit_size"]["files_touched"], scores["unit_size"]["files_added"], scores["unit_size"]["files_removed"]) == (3, 1, 1)
    still = delta.delta_scores(delta.delta_files(a, a))
    assert [r["score"] for r in still.collect()] == [None] * 3 and delta.breaches(still, 1.0).count() == 0


PROFILE = "mode: set\nm/a.go:1.2,3.4 2 0\nm/a.go:5.1,6.2 3 1\n\nm/a.go:1.2,3.4 2 1\nm/b/c.go:1.1,2.2 4 0\nm/gen.go:1.1,2.2 9 0\n"


def test_coverage(spark):
    lines = spark.createDataFrame(list(enumerate(PROFILE.split("\n"))), "ordinal int, value string")
    files = coverage.covered_files(parse_coverage(lines))
    assert {r["file"]: (r["statements"], r["covered"]) for r in files.collect()} == {"m/a.go": (5, 5), "m/b/c.go": (4, 0), "m/gen.go": (9, 0)}
    known = spark.createDataFrame([("m/a.go", False), ("m/b/c.go", False), ("m/gen.go", True)], "file string, generated boolean")
    own = coverage.classified(files, known)
    assert {r["package"]: r["uncovered"] for r in coverage.packages(own).collect()} == {"m": 0, "m/b": 4}
    v = coverage.verdict(own, 60.0).first()
    assert (v["statements"], v["covered"], v["generated_statements"], v["breached"], v["shortfall"]) == (9, 5, 9, True, 1)
    w = coverage.verdict(own, 50.0).first()
    assert (w["headroom"], w["raise_to"]) == (1, pytest.approx(55.3))
    with pytest.raises(Exception, match="no source for"):
        coverage.classified(files, known.limit(1)).collect()
    with pytest.raises(Exception, match="no coverage block"):
        parse_coverage(spark.createDataFrame([(0, "mode: set"), (1, "mode: set")], "ordinal int, value string")).collect()


def test_agreement(spark):
    ours = spark.createDataFrame([("f", 1, 10, 1), ("f", 1, 12, 2), ("f", 2, 5, 3), ("f", 3, 0, 4), ("f", 4, 8, 5), ("f", 9, 1, 6)], "file string, line int, loc int, ordinal long")
    theirs = spark.createDataFrame([("f", 1, 6, 1), ("f", 2, 5, 2), ("f", 3, 4, 3), ("f", 4, 0, 4)], "file string, line int, loc int, ordinal long")
    pairs = agreement.matched(ours, theirs, ["file", "line"], ["loc"], "ordinal")
    s = agreement.agreement_stats(pairs).first()
    assert (s["matched"], s["equal"], s["outside"], s["median_ratio"]) == (4, 1, 2, 1.0)
    assert [r["line"] for r in agreement.worst_divergence(pairs, 5).collect()] == [3, 1]


def test_owners_and_independence(spark):
    comps = spark.createDataFrame([("store", "internal/store"), ("shared", "internal"), ("one", "main.go")], "component string, path string")
    files = spark.createDataFrame([("internal/storedouble/x.go",), ("internal/store/a.go",), ("main.go",), ("main.go/x",), ("other.go",)], "f string")
    assert {r["f"]: r["component"] for r in coupling.owners(files, "f", comps).collect()} == {"internal/storedouble/x.go": "shared", "internal/store/a.go": "store", "main.go": "one", "main.go/x": "one", "other.go": None}
    mods = spark.createDataFrame([("a", 90, 0), ("b", 10, 2)], "component string, loc int, in_cross_component int")
    r = coupling.independence(mods, 93.7).first()
    assert (r["hidden_loc"], r["pass"], r["exposed_loc"]) == (90, False, 3)
    assert coupling.independence(mods.where("false"), 93.7).count() == 0
