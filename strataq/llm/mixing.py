"""Texts of several sources in target shares of all tokens.

Each source gets a token budget. Whole passes over a source fill most of it;
the rest is a subset sum over the source's counts of texts by exact length:
every length gives its proportional part, and a bounded knapsack closes what
is left. Which texts of a length are taken is decided by a seeded rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.common import salted_rank, spread, stash
from strataq.llm.sizes import TOKENIZER, token_count

#: Tokens to which the rest of a budget is brought before dynamic programming closes it; bits of all its layers (64 MB) up to which it chooses anew.
KNAPSACK_TOKENS = 1 << 16
KNAPSACK_BITS = 1 << 29
ITEMS_PER_SALT = 500_000
#: Part of all weight that sources too small for theirs may miss, so that one of a few texts does not set the size of all.
SHORTFALL = 0.05


def knapsack(counts: dict[int, int], budget: int, over: int = 0) -> dict[int, int]:
    """How many of each length, so that the sum comes as near the budget as any choice up to `over` above it does; of two
    as near the smaller."""
    most = budget + over
    parts: list[tuple[int, int]] = []  # (length, how many at once): binary split of each count
    for length in sorted(counts):
        n, k = min(counts[length], most // length if length else 0), 1
        while n > 0:
            parts.append((length, min(k, n)))
            n, k = n - k, k * 2
    mask = (1 << (most + 1)) - 1
    layers, reach = [], 1
    used: list[tuple[int, int]] = []
    for length, k in parts:
        if reach >> budget & 1:
            break
        more = (reach | reach << (length * k)) & mask
        if more != reach:
            layers.append(reach)
            used.append((length, k))
            reach = more
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    at, out = below, {}
    if above and (step := (above & -above).bit_length()) < budget - below:
        at = budget + step
    for (length, k), before in zip(reversed(used), reversed(layers)):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def _bits(counts: dict[int, int], budget: int) -> int:
    """What the layers of knapsack() take at most."""
    return budget * sum(min(n, budget // k).bit_length() for k, n in counts.items() if k)


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many texts of each length make up a budget below the sum of all, as nearly as may be on either side.

    Every length gives its proportional part, the longest one more while room
    is left, and a knapsack closes the rest. Where that misses the budget, the
    knapsack chooses anew from the proportional part on, then from nothing, each
    up to KNAPSACK_BITS, and then so that less is passed than was missed. Beyond,
    less than the longest text and KNAPSACK_TOKENS / 2 can be missed.
    """
    total = sum(length * n for length, n in counts.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    part = {length: n * budget // total for length, n in counts.items()}
    more, rest = dict(part), budget - sum(length * n for length, n in part.items())
    for length in sorted(counts, reverse=True):
        if rest <= KNAPSACK_TOKENS:
            break
        if more[length] < counts[length] and length <= rest - KNAPSACK_TOKENS // 2:
            more[length] += 1
            rest -= length
    best, missed = {}, budget
    for above in (False, True):
        for take in (more, part, dict.fromkeys(counts, 0)):
            over = missed - 1 if above else 0
            left = budget - sum(length * n for length, n in take.items())
            free = {k: n - take[k] for k, n in counts.items() if 0 < k <= left + over and n > take[k]}
            if (above or take is not more) and _bits(free, left + over) > KNAPSACK_BITS:
                continue
            got = Counter(take) + Counter(knapsack(free, left, over))
            off = abs(sum(length * n for length, n in got.items()) - budget)
            if off < missed:
                best, missed = dict(got), off
            if not missed:
                return best
    return best


def sized_texts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, text_hash), one row per source and different text (the least id of its copies): a text
    delivered under several ids is one text, so that the cap on repeats holds for it. An id with two texts gives both."""
    texts = spread(documents.select("doc_id", "source", "text")).where(F.col("source").isNotNull() & (F.length("text") > 0))
    sized = texts.select("doc_id", "source", F.sha2("text", 256).alias("text_hash"), token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return sized.groupBy("source", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).select("doc_id", "source", "n_tokens", "text_hash")


def largest_size(limits: list[tuple[float, float]], shortfall: float) -> float:
    """The largest size at which no more than `shortfall` of all weight is missed by sources that reach their cap.

    limits are (share wanted, tokens a source may give at most). What is missed
    at size x is the sum of share - tokens / x over the sources below their
    share; it grows with x, so the last piece that holds the bound is found by
    adding sources in the order in which they reach their caps.
    """
    order = sorted((tokens / share, share, tokens) for share, tokens in limits if share > 0)
    wanted = given = 0.0
    for i, (_, share, tokens) in enumerate(order):
        wanted, given = wanted + share, given + tokens
        if wanted > shortfall:
            size = given / (wanted - shortfall)
            if i + 1 == len(order) or size <= order[i + 1][0]:
                return size
    return order[-1][0] if order else 0.0


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, shortfall: float = SHORTFALL, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the texts drawn and how often each is used.

    Without total_tokens the mix is the largest in which sources that reach
    their cap miss at most `shortfall` of all weight; with 0 every source that
    has texts reaches its weight, and the smallest bounds the size. With it ("all"
    is what all targeted texts have) a source whose cap is too low gives all it
    may, and the shares fall short accordingly; shares() reports them. Weights are
    relative to the sources that have texts. Sources without a target, null
    sources and texts without tokens are not drawn; a null cap means once.
    targets is a small fixed table (its size is checked).
    """
    spark = documents.sparkSession
    few = targets.groupBy("source").agg(F.max("target_weight").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).where("source IS NOT NULL AND w > 0 AND r > 0").limit(10_001).collect()
    if len(few) > 10_000:
        raise ValueError("more than 10000 targets")
    sized = stash(sized_texts(documents, tokenizer).where("n_tokens > 0"), "sized")
    counts = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    have = {r["source"]: (r["t"], r["n"]) for r in counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    goal = {r["source"]: (r["w"], r["r"]) for r in few if r["source"] in have}
    weight = sum(w for w, _ in goal.values())
    if total_tokens == "all":
        size = sum(have[s][0] for s in goal)
    elif total_tokens is not None:
        size = total_tokens
    else:
        size = largest_size([(w / weight, r * have[s][0]) for s, (w, r) in goal.items()], shortfall)
    budgets = {s: min(int(size * w / weight), r * have[s][0]) for s, (w, r) in goal.items()}
    caps = {s: r for s, (_, r) in goal.items()}

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source"].iloc[0]
        by_length = dict(zip(rows["n_tokens"].tolist(), rows["n"].tolist()))
        total = sum(k * n for k, n in by_length.items())
        budget = budgets.get(source, 0)
        passes = min(budget // total, caps.get(source, 0))
        more = fit_budget(by_length, budget - passes * total) if passes < caps.get(source, 0) else {}
        return pd.DataFrame({"source": source, "n_tokens": list(by_length), "passes": passes, "more": [more.get(k, 0) for k in by_length]})

    # a group holds one row per distinct length of a source: at most the square root of twice its tokens
    plans = counts.where(F.col("source").isin(list(goal))).groupBy("source").applyInPandas(plan, "source string, n_tokens long, passes long, more long")
    ranked = salted_rank(sized, ["source", "n_tokens"], seed, ["doc_id", "text_hash"], "rank", max(4, sum(n for _, n in have.values()) // ITEMS_PER_SALT))
    return (
        ranked.join(plans, ["source", "n_tokens"])
        .select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)).cast("int").alias("copies"))
        .where("copies > 0")
    )


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share wanted, the texts used, their tokens with repeats, and the share reached."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    goal = targets.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    both = goal.join(got, "source", "left").fillna(0, ["texts", "uses", "most_uses", "tokens"])
    whole = Window.partitionBy(F.lit(1))  # one row per target
    return both.select(
        "source", "target_weight", (F.col("target_weight") / F.sum("target_weight").over(whole)).alias("target_share"), "max_repeats", "texts", "uses", "most_uses", "tokens",
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)).alias("share"),
    )
