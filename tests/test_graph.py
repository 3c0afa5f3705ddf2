import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import graph


def edges(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "language string, `from` string, `to` string, weight int")


def kinds(spark, rows):
    return [(r["kind"], r["from"], r["to"], r["weight"]) for r in graph.violations(edges(spark, rows), "language").collect()]


def test_mutual_lines(spark):
    rows = [("A", "B", 1), ("B", "A", 10)]
    assert kinds(spark, rows) == [("cyclic", "A", "B", 1)]
    e = graph.entanglement(edges(spark, rows), "language").first()
    assert (e["lines"], e["connected"], e["density"], e["violation_degree"]) == (2, 2, 1.0, pytest.approx(1 / 11))


def test_equal_mutual_lines_are_both_out_so_that_no_bypass_counts_twice(spark):
    assert kinds(spark, [("A", "B", 4), ("B", "A", 4), ("A", "C", 9), ("C", "B", 9)]) == [("cyclic", "A", "B", 4)]


def test_a_longer_cycle_loses_its_lightest_line(spark):
    assert kinds(spark, [("A", "B", 10), ("B", "C", 15), ("C", "D", 3), ("D", "A", 8)]) == [("indirect cyclic", "C", "D", 3)]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("B", "C", 18), ("C", "D", 14), ("B", "D", 1), ("D", "X", 5)], [("transitive", "B", "D", 1)]),
        ([("B", "C", 18), ("C", "E", 14), ("B", "E", 1)], []),  # a leaf
        ([("B", "C", 4), ("C", "D", 4), ("B", "D", 20), ("D", "X", 5)], []),  # the heavier way
    ],
)
def test_bypasses(spark, rows, want):
    assert kinds(spark, rows) == want


def test_no_lines_no_figures(spark):
    assert graph.entanglement(edges(spark, []), "language").count() == 0


def reach(rows):
    out = {}
    for g in {r[0] for r in rows}:
        es = [(a, b) for q, a, b in rows if q == g]
        nodes = {x for e in es for x in e}
        ways = {n: {b for a, b in es if a == n} for n in nodes}
        for n in nodes:
            seen, todo = set(), [n]
            while todo:
                for b in ways[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            out[g, n] = seen
    return out


@pytest.mark.parametrize("seed, most", [(1, 500_000), (2, 500_000), (3, 500_000), (4, 500_000), (1, 0), (2, 15)])
def test_strong_components_against_reachability(spark, seed, most):
    r = random.Random(seed)
    rows = [(g, f"n{r.randrange(12)}", f"n{r.randrange(12)}") for g in ("x", "y") for _ in range(16)]
    got = {}
    for row in graph.strong_components(spark.createDataFrame(rows, "g string, a string, b string"), "g", "a", "b", most).collect():
        got[row["g"], row["node"]] = row["component"]
    far = reach(rows)
    want = {}
    for (g, n), seen in far.items():
        mates = {m for m in seen if n in far[g, m] and m != n}
        if mates:
            want[g, n] = max(mates | {n})
    assert got == want


def test_strong_components_of_none(spark):
    none = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "d", "d")], "g string, a string, b string")
    assert graph.strong_components(none, "g", "a", "b").count() == 0


def test_direct_cycles_once_each(spark):
    got = graph.direct_cycles(edges(spark, [("A", "B", 5), ("B", "A", 2), ("A", "C", 1)])).collect()
    assert [(r["a"], r["b"], r["weight"], r["lighter_from"]) for r in got] == [("A", "B", 2, "B")]


def test_the_shallowest_cycle_claims(spark):
    rows = [("m", "a/x", "b/y", "a/x/1.go", 3), ("m", "b/z", "a/w", "b/z/2.go", 4), ("m", "a/x", "a/w", "a/x/1.go", 5), ("m", "a/w", "a/x", "a/w/3.go", 6)]
    found = graph.directory_cycles(spark.createDataFrame(rows, "module string, from_dir string, to_dir string, rel string, line int"))
    got = {(r["from_dir"], r["to_dir"]): (r["depth"], r["members"]) for r in found.collect()}
    assert got == {("a/x", "b/y"): (1, ["a", "b"]), ("b/z", "a/w"): (1, ["a", "b"]), ("a/x", "a/w"): (2, ["a/w", "a/x"]), ("a/w", "a/x"): (2, ["a/w", "a/x"])}
    assert found.where(F.size("members") > 2).count() == 0
