import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.llm.containers import best_fit, fill_containers, fill_report
from strataq.llm.mixing import fit_budget, knapsack, largest_size, mix, shares
from strataq.llm.sizes import encoding, TOKENIZER, token_count

DOCS = "doc_id long, text string, source string, rank int, copies int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, (t, s) in enumerate(rows)], DOCS)


def tokens(t):
    return len(encoding(TOKENIZER).encode_ordinary(t))


def test_token_counts(spark):
    df = docs(spark, ("hello world", "a"), ("", "a"), (None, "a"), ("<|endoftext|>", "a"), ("x" * 300_000, "a"))
    got = [r[0] for r in df.orderBy("doc_id").select(token_count(F.col("text"))).collect()]
    assert got == [2, 0, None, tokens("<|endoftext|>"), tokens("x" * 300_000)] and got[3] > 1


def expand(plan):
    """(container, length) of every item a plan places."""
    out = []
    for length, lo, hi, first, each in plan:
        out += [(first + (r - lo) // each, length, r) for r in range(lo, hi + 1)]
    return out


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_over_counts_is_as_good_as_over_items(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 512])
    lengths = [min(capacity, max(1, int(r.expovariate(4 / capacity)))) for _ in range(r.choice([1, 50, 700]))]
    plan, used = best_fit(Counter(lengths), capacity)
    placed = expand(plan)
    assert Counter(x for _, x, _ in placed) == Counter(lengths)
    assert len({(x, k) for _, x, k in placed}) == len(lengths)  # every rank once
    room = defaultdict(int)
    for c, x, _ in placed:
        room[c] += x
    assert max(room.values()) <= capacity and set(room) == set(range(used))
    assert used <= best_fit_decreasing(lengths, capacity) + 1


def test_plan_size_does_not_follow_the_number_of_items():
    small, large = ({k: 37 * n for k in range(1, 65)} for n in (1, 1000))
    assert len(best_fit(large, 512)[0]) < 3 * len(best_fit(small, 512)[0])


def test_containers(spark):
    texts = [(" word" * n, "s") for n in (1, 5, 5, 5, 9, 12, 25, 20, 3)] + [("", "s"), (None, "s"), (" word" * 5, "s")]
    kinds = spark.createDataFrame([("small", 10), ("big", 100), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    rows = fill_containers(docs(spark, *texts), kinds).collect()
    for kind, cap in (("small", 10), ("big", 100)):
        mine = [r for r in rows if r["container_kind"] == kind]
        per, room = defaultdict(list), defaultdict(int)
        for r in mine:
            per[r["doc_id"]].append((r["piece_no"], r["first_token"], r["item_tokens"]))
            room[r["container_no"]] += r["item_tokens"]
        assert max(room.values()) <= cap
        for i, (t, _) in enumerate(texts):
            n = tokens(t) if t else 0
            pieces = sorted(per.get(i, []))
            assert sum(p[2] for p in pieces) == n and len(pieces) == -(-n // cap)
            assert [p[1] for p in pieces] == [cap * k for k in range(len(pieces))]
    assert {r["container_kind"] for r in rows} == {"small", "big"}
    report = {r["container_kind"]: r for r in fill_report(fill_containers(docs(spark, *texts), kinds), kinds).collect()}
    assert report["big"]["containers"] == 1 and report["small"]["containers"] <= report["small"]["least_containers"] + 2
    assert fill_containers(docs(spark, ("x", "s")).where("false"), kinds).count() == 0
    assert fill_containers(docs(spark, ("x", "s")), kinds.where("false")).count() == 0


def test_blocks_of_one_length(spark, monkeypatch):
    """A length of many items is joined in blocks; the containers are the same."""
    from strataq.llm import containers

    texts = [(" word" * (5 if i % 3 else 9), "s") for i in range(90)]
    kinds = spark.createDataFrame([("small", 23)], "container_kind string, capacity_tokens int")
    whole = sorted(map(tuple, fill_containers(docs(spark, *texts), kinds).collect()))
    monkeypatch.setattr(containers, "ITEMS_PER_SALT", 7)
    split = fill_containers(docs(spark, *texts), kinds).collect()
    assert len(split) == len(whole) == 90 and max(r["container_no"] for r in split) == max(r[1] for r in whole)
    room = defaultdict(int)
    for r in split:
        room[r["container_no"]] += r["item_tokens"]
    assert max(room.values()) <= 23


def reachable(counts, budget):
    best = {0}
    for x, n in counts.items():
        best = {s + x * k for s in best for k in range(n + 1) if s + x * k <= budget}
    return max(best)


@pytest.mark.parametrize("seed", range(10))
def test_knapsack_is_optimal(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(5)}
    budget = r.randrange(0, 150)
    got = knapsack(counts, budget)
    assert all(0 < n <= counts[x] for x, n in got.items())
    assert sum(x * n for x, n in got.items()) == reachable(counts, budget)


@pytest.mark.parametrize("budget", [0, 1, 999, 123_456, 5_000_000, 10**12])
def test_budgets_are_met(budget):
    r = random.Random(budget)
    counts = {k: r.randrange(1, 200) for k in range(1, 900)}
    total = sum(k * n for k, n in counts.items())
    got = fit_budget(counts, budget)
    assert all(0 < n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == min(budget, total)


@pytest.mark.parametrize("counts, budget", [({300_000: 1, 200_000: 1, 50_000: 1}, 310_000), ({300_000: 2, 200_000: 1, 70_001: 3}, 510_001), ({90_000: 3, 80_000: 3, 70_000: 3}, 500_000)])
def test_budgets_of_long_texts_are_met_as_nearly_as_any_choice_does(counts, budget):
    got = fit_budget(counts, budget)
    assert all(0 < n <= counts[k] for k, n in got.items()) and abs(sum(k * n for k, n in got.items()) - budget) <= budget - reachable(counts, budget)
    assert fit_budget({300_000: 1, 700_000: 1}, 310_000) == {300_000: 1}


def test_mix(spark):
    r = random.Random(1)
    rows = [(f"text {i} " + " word" * r.randrange(1, 60), "big") for i in range(300)] + [(f"rare {i}", "small") for i in range(12)] + [("again and again", "small")] * 5 + [("no target", "other"), ("null source", None), (None, "big"), ("", "big")]
    targets = spark.createDataFrame([("big", 6.0, 1), ("small", 2.0, 3), ("absent", 2.0, 9)], "source string, target_weight double, max_repeats int")
    d = docs(spark, *rows)
    drawn = mix(d, targets, shortfall=0)
    got = drawn.collect()
    assert all(r["copies"] <= {"big": 1, "small": 3}[r["source"]] for r in got)
    assert sum(1 for r in got if rows[r["doc_id"]][0] == "again and again") <= 1  # one text, whatever its ids
    s = {r["source"]: r for r in shares(drawn, targets).collect()}
    assert s["absent"]["tokens"] == 0 and abs(s["big"]["share"] - 0.75) < 0.01 and abs(s["small"]["share"] - 0.25) < 0.01
    assert s["small"]["most_uses"] == 3
    assert sorted(map(tuple, mix(d, targets, shortfall=0).collect())) == sorted(map(tuple, got))  # seeded
    assert {r["doc_id"] for r in mix(d, targets, shortfall=0, seed=8).where("source = 'big'").collect()} != {r["doc_id"] for r in got if r["source"] == "big"}
    short = {r["source"]: r for r in shares(mix(d, targets, total_tokens=10**9), targets).collect()}
    assert short["small"]["uses"] == 3 * 13 and short["big"]["uses"] == 300
    assert mix(d.where("false"), targets).count() == 0 and mix(d, targets.where("false")).count() == 0


def test_the_mix_of_all_is_registered(spark):
    from strataq.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    size = lambda name: QUERIES[name](spark, d).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert size("p7_mix_of_all") >= size("p7_mix") >= size("p7_mix_balanced") > 0


@pytest.mark.parametrize("seed", range(20))
def test_largest_size(seed):
    r = random.Random(seed)
    weights = [r.random() for _ in range(r.randrange(1, 7))]
    limits = [(w / sum(weights), r.randrange(1, 10**6)) for w in weights]
    missed = lambda x: sum(max(0.0, share - tokens / x) for share, tokens in limits)
    for shortfall in (0.0, 0.05, 0.3):
        x = largest_size(limits, shortfall)
        assert missed(x) <= shortfall + 1e-9 and missed(x * 1.001) > shortfall
    assert largest_size([], 0.05) == 0


@pytest.mark.parametrize("seed", range(10))
def test_budgets_are_met_from_either_side(seed):
    r = random.Random(seed)
    counts = {r.randrange(10, 400): r.randrange(1, 3) for _ in range(4)}
    total = sum(k * n for k, n in counts.items())
    sums = {0}
    for k, n in counts.items():
        sums = {a + k * i for a in sums for i in range(n + 1)}
    for budget in range(1, total, 37):
        got = sum(k * n for k, n in fit_budget(counts, budget).items())
        assert abs(got - budget) == min(abs(x - budget) for x in sums)
