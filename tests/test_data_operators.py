"""Percentiles, snapshot changes and reconciliation against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.common import salted_rank
from strataq.functions.modular import P, mulmod, rational, roots, segment_products, value
from strataq.operators import percentiles as pc
from strataq.operators.inventories import last_units, unit_differences
from strataq.operators.reconcile import differences
from strataq.operators.snapshot_diff import snapshot_changes

METRICS = "metric_id long, scan_day date, module_path string, v long, received_at long, value string, n string"


def metric_rows(seed, n=400):
    r = random.Random(seed)
    import datetime as dt

    rows = []
    for i in range(n):
        module = r.choice(["hot"] * 5 + ["a", "b", None])
        v = r.choice([None, 0, 5, 5, 5, r.randrange(2000), r.randrange(10**9)])
        day = dt.date(2031, 1, 1 + r.randrange(9))
        rows.append((i, day, module, v, 1, "x", "y"))
        if r.random() < 0.2:  # received again, later
            rows.append((i, day, module, v if v is None else v + 1, 2, None, "z"))
    return rows


def binned(v, bits=pc.BITS):
    if v < 1 << bits:
        return v
    s = v.bit_length() - bits
    return (v >> s << s) + (1 << s - 1)


def test_percentiles_against_sorting(spark):
    rows = metric_rows(1)
    df = spark.createDataFrame(rows, METRICS)
    once = pc.count_once(df, "metric_id", "received_at", ["scan_day", "module_path", "v"])
    daily = pc.daily_counts(once, "module_path", "scan_day", ["v"])
    got = {r["module_path"]: r for r in pc.percentiles(pc.combine(daily, "module_path", "scan_day"), ["module_path"], [("p50", 0.5), ("p99", 0.99)]).collect()}
    last = {}
    for i, _, m, v, at, *_ in rows:
        if i not in last or at > last[i][2]:
            last[i] = (m, v, at)
    groups = defaultdict(list)
    for m, v, _ in last.values():
        if v is not None:
            groups[m].append(v)
    assert got.keys() == groups.keys()
    for m, vs in groups.items():
        vs.sort()
        assert got[m]["n"] == len(vs)
        for name, q in (("p50", 0.5), ("p99", 0.99)):
            exact = vs[math.ceil(q * len(vs)) - 1]
            assert got[m][name] == binned(exact) and abs(got[m][name] - exact) <= exact / 2**pc.BITS


def test_day_results_combine_into_ranges(spark):
    df = spark.createDataFrame(metric_rows(2), METRICS)
    daily = pc.daily_counts(df, "module_path", "scan_day", ["v"])
    part = pc.combine(daily, "module_path", "scan_day", "2031-01-02", "2031-01-04")
    direct = pc.daily_counts(df.where("scan_day BETWEEN '2031-01-02' AND '2031-01-04'"), "module_path", "scan_day", ["v"])
    assert part.agg(F.sum("n")).first()[0] == direct.agg(F.sum("n")).first()[0]


def test_percentiles_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, None, "m", None, 1, "", ""), (None, None, "m", 7, 1, "", ""), (None, None, "m", 7, 1, "", "")], METRICS)
    once = pc.count_once(df, "metric_id", "received_at", ["scan_day", "module_path", "v"])
    assert once.count() == 3  # rows without an id are not taken for one another
    counts = pc.combine(pc.daily_counts(once, "module_path", "scan_day", ["v"]), "module_path", "scan_day")
    assert [(r["module_path"], r["n"], r["p"]) for r in pc.percentiles(counts, ["module_path"], [("p", 0.5)]).collect()] == [("m", 2, 7)]
    assert pc.percentiles(counts.where("false"), ["module_path"], [("p", 0.5)]).count() == 0


def test_percentiles_of_fractions_keep_the_bound(spark):
    r = random.Random(5)
    vs = [0.0, -0.75, float("inf"), 0.001, 1e-300, 1e300] + [r.uniform(-3, 3) for _ in range(300)] + [10 ** r.uniform(-9, 12) for _ in range(300)]
    df = spark.createDataFrame([("m", None, v) for v in vs] + [("m", None, float("nan")), ("m", None, None)], "module_path string, scan_day date, x double")
    probs = [(f"q{i}", q) for i, q in enumerate((0.01, 0.2, 0.4, 0.5, 0.9, 0.99, 1.0))]
    got = pc.percentiles(pc.combine(pc.daily_counts(df, "module_path", "scan_day", ["x"]), "module_path", "scan_day"), ["module_path"], probs).first()
    assert got["n"] == len(vs)
    for name, q in probs:
        exact = sorted(vs)[math.ceil(q * len(vs)) - 1]
        assert got[name] == exact or abs(got[name] - exact) <= abs(exact) / 2**pc.BITS


def test_ranges_never_fall(spark):
    r = random.Random(6)
    whole = sorted({0, 1, -1, 1023, 1024, 1025, 2**40, -(2**40)} | {r.randrange(-(10**12), 10**12) for _ in range(500)} | {r.randrange(-3000, 3000) for _ in range(500)})
    got = [x["s"] for x in spark.createDataFrame([(v,) for v in whole], "v long").select("v", pc.value_range(F.col("v")).alias("s")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 3
    parts = sorted({0.0, 1e-320, -1e-320, float("inf"), float("-inf")} | {r.uniform(-1, 1) * 10 ** r.uniform(-20, 20) for _ in range(800)})
    got = [x["s"] for x in spark.createDataFrame([(v,) for v in parts], "v double").select("v", pc.value_range(F.col("v"), fractional=True).alias("s")).orderBy("v").collect()]
    assert got == sorted(got)


def test_day_results_combine_into_each_range(spark):
    df = spark.createDataFrame(metric_rows(3), METRICS)
    each = pc.combine_each(pc.daily_counts(df, "module_path", "scan_day", ["v"]), "module_path", "scan_day")
    got = {(r["day_range"], r["starts"], r["module_path"]): r["n"] for r in pc.percentiles(each, ["module_path", "day_range", "starts"], [("p", 0.5)]).collect()}
    want = Counter()
    for r in df.where("v IS NOT NULL").collect():
        day = r["scan_day"]
        for key in (("day", day), ("week", day - __import__("datetime").timedelta(days=day.weekday())), ("all", None)):
            want[(*key, r["module_path"])] += 1
    assert got == dict(want)


@pytest.mark.parametrize("vs", [[1.0, 2.0, 4.0], [1.0, 2.0], [3.5], [2.0, 2.0, 2.0, 9.0]])
def test_median(spark, vs):
    import statistics

    df = spark.createDataFrame([("m", v) for v in vs] + [("m", None)], "k string, x double")
    assert pc.exact_median(df, ["k"], "x").first()["median"] == statistics.median(vs)


def test_salted_rank_is_gapless(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(500)], "g string, i long")
    got = defaultdict(list)
    for r in salted_rank(df, ["g"], 1, ["i"], "rank", 7).collect():
        got[r["g"]].append(r["rank"])
    assert {g: sorted(v) for g, v in got.items()} == {g: list(range(1, n + 1)) for g, n in (("hot", 333), (None, 167))}


SNAP = "root_path string, taken string, code_language string, measures map<string,double>, entanglement map<string,double>, delivered_at long, figure string, kind string"


def snap(*rows):
    return [(*r, "clash", "clash") for r in rows]


def test_snapshot_changes(spark):
    nan = float("nan")
    rows = snap(
        ("r", "2031-01-01", " Go", {"a": 1.04, "b": 2.0, "gone": 3.0, "n": nan}, {"density": 0.314, "lines": 4.4}, 1),
        ("r", "2031-01-01", "GO", {"a": 9.0}, None, 0),  # an earlier delivery
        ("r", "2031-01-05", "go", {"a": 1.0, "b": 2.06, "new": 5.0, "n": 1.0, "gone": None}, {"density": 0.316, "lines": 3.6}, 1),
        ("r", "2031-01-05", "go", {"a": 1.0, "b": 2.06, "new": 5.0, "n": 1.0, "gone": None}, {"density": 0.316, "lines": 3.6}, 1),
        ("r", "2031-01-05", "vue", {"x": 0.0}, {}, 1),
        ("r", "2031-01-09", "go", None, None, 1),
        ("alone", "2031-01-05", "go", {"a": 1.0}, None, 1),
        ("r", "2031-01-05", None, {"u": 1.0}, None, 1),
    )
    got = {(r["taken"], r["code_language"], r["measure_name"]): (r["kind"], r["then_figure"], r["now_figure"]) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    five, nine = "2031-01-05", "2031-01-09"
    assert got == {
        (five, "go", "b"): ("moved", 2.0, 2.1),
        (five, "go", "gone"): ("gone", 3.0, None),
        (five, "go", "new"): ("new", None, 5.0),
        (five, "go", "n"): ("new", None, 1.0),
        (five, "go", "entanglement density"): ("moved", 0.31, 0.32),
        (five, "vue", "x"): ("new", None, 0.0),
        (five, None, "u"): ("new", None, 1.0),
        (nine, "go", "a"): ("gone", 1.0, None),
        (nine, "go", "b"): ("gone", 2.1, None),
        (nine, "go", "new"): ("gone", 5.0, None),
        (nine, "go", "n"): ("gone", 1.0, None),
        (nine, "go", "entanglement density"): ("gone", 0.32, None),
        (nine, "go", "entanglement lines"): ("gone", 4.0, None),
        (nine, "vue", "x"): ("gone", 0.0, None),
        (nine, None, "u"): ("gone", 1.0, None),
    }
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


def test_arithmetic_in_the_field():
    import numpy as np

    r = random.Random(3)
    a, b = ([r.randrange(P) for _ in range(300)] + [0, 1, P - 1] for _ in range(2))
    assert mulmod(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % P for x, y in zip(a, b)]
    keys = [r.randrange(9) for _ in range(200)]
    vals = [[r.randrange(P)] for _ in keys]
    names, got = segment_products(np.array(keys), np.array(vals, np.uint64))
    assert {k: int(v[0]) for k, v in zip(names, got)} == {k: math.prod(v[0] for q, v in zip(keys, vals) if q == k) % P for k in set(keys)}


def test_rational_interpolation_and_roots():
    r = random.Random(4)
    for na, nb, slack in ((0, 0, 2), (3, 1, 0), (2, 5, 2), (6, 6, 4)):
        ra, rb = ([r.randrange(1 << 60) for _ in range(n)] for n in (na, nb))
        poly = lambda rs, z: math.prod(z - x for x in rs) % P
        zs = [(1 << 60) + 7 * i for i in range(na + nb + 2 * slack)]
        f, g = rational(zs, [poly(ra, z) * pow(poly(rb, z), P - 2, P) % P for z in zs], na + slack, nb + slack)
        assert sorted(roots(f)) == sorted(ra) and sorted(roots(g)) == sorted(rb)
        assert value(f, zs[0]) == poly(ra, zs[0])
    assert roots([1, 0, 1]) is None or len(roots([1, 0, 1])) == 2
    assert roots([25, P - 10, 1]) is None  # a double root is no set


def brute(a, b, key, fields):
    out = Counter()
    for k in a.keys() | b.keys():
        if k not in b or k not in a:
            out[(*k, "only_l" if k in a else "only_r", "")] += 1
        else:
            out.update((*k, "differs", f) for f, x, y in zip(fields, a[k], b[k]) if x != y)
    return out


@pytest.mark.parametrize("seed, change", [(1, 0.0), (2, 0.03), (3, 0.5), (4, 1.0)])
def test_differences_against_dictionaries(spark, seed, change):
    r = random.Random(seed)
    a = {(f"r{r.randrange(3)}" if r.random() < 0.9 else None, str(i)): (r.choice(["x", None, ""]), r.choice(["1", "2"])) for i in range(300)}
    b = {k: v for k, v in a.items() if r.random() >= change / 3}
    b = {k: (v[0], "9") if r.random() < change / 3 else v for k, v in b.items()} | {("n", str(i)): ("q", None) for i in range(int(60 * change))}
    schema = "k string, i string, f string, kind string"
    left, right = (spark.createDataFrame([(*k, *v) for k, v in d.items()], schema) for d in (a, b))
    got = differences(left.withColumnRenamed("kind", "g"), right.withColumnRenamed("kind", "g"), ["k", "i"], ["f", "g"], ("l", "r"))
    assert Counter((x["k"], x["i"], x["kind"], x["field_name"]) for x in got.collect()) == brute(a, b, ["k", "i"], ["f", "g"])


def test_differences_of_empty_tables(spark):
    some = spark.createDataFrame([("a", "1")], "k string, f string")
    none = some.where("false")
    run = lambda x, y: [(r["k"], r["kind"]) for r in differences(x, y, ["k"], ["f"], ("l", "r")).collect()]
    assert run(none, none) == [] and run(some, none) == [("a", "only_l")] and run(none, some) == [("a", "only_r")]


UNITS = "root_path string, code_language string, file_name string, element_name string, line_no int, loc {n}, mccabe {n}, params {n}, exported_at long, kind string, bucket string, hash string"


def test_units_are_known_by_their_meaning(spark):
    left = [
        ("r", "Go", "./a\\b.go", " F ", 1, 7, 1, 0, 1, "", "", ""),
        ("r", "Go", "a/b.go", "Old", 1, 3, 1, 0, 0, "", "", ""),  # an earlier export
        ("r", "Go", "a/c.go", "G", 2, None, 2, 1, 1, "", "", ""),
        ("r", "Go", "a/d.go", "H", 3, 10, 2, 1, 1, "", "", ""),
        ("r", "Go", "A/d.go", "H", 3, 10, 2, 1, 1, "", "", ""),
    ]
    right = [
        ("r", "x", "a/b.go", "F", 1, "7.0", " 1", "0\t", 5, "", "", ""),
        ("r", "x", ".\\a/c.go", "g", 2, " ", "2", "", 5, "", "", ""),
        ("r", "x", "a/d.go", "H", 3, "100", "2", "1", 5, "", "", ""),
        (None, "x", "a/d.go", "H", 3, "100", "2", "1", 5, "", "", ""),
    ]
    a, b = spark.createDataFrame(left, UNITS.format(n="int")), spark.createDataFrame(right, UNITS.format(n="string"))
    got = {(r["root_path"], r["file_name"], r["line_no"], r["kind"], r["field_name"], r["left_value"], r["right_value"]) for r in unit_differences(a, b).collect()}
    assert got == {
        ("r", "a/c.go", 2, "differs", "element_name", "G", "g"),
        ("r", "a/c.go", 2, "differs", "params", "1", None),
        ("r", "a/d.go", 3, "differs", "loc", "10", "100"),
        ("r", "A/d.go", 3, "only_units", "", None, None),
        (None, "a/d.go", 3, "only_copy", "", None, None),
    }
    assert last_units(a).count() == 4
