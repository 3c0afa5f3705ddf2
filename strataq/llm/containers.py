"""Items of varying length into containers of fixed capacity.

The plan is made over the histogram of lengths, by best fit in falling order of
length: its size depends on the capacity, not on the number of documents. Each
plan row is a range of ranks within one length and the run of containers those
ranks go to; documents find their container by joining on their rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strataq.common import salted_rank, spread, stash
from strataq.llm.sizes import TOKENIZER, token_count

#: Plan rows up to which the plan is broadcast (about 40 bytes a row); beyond it the join shuffles.
BROADCAST_PLAN_ROWS = 200_000
#: Items a rank range holds at most, about; more items make more ranges.
ITEMS_PER_SALT = 500_000

PlanRow = tuple[int, int, int, int, int]  # length, first rank, last rank, first container, items a container


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[PlanRow], int]:
    """Plan rows and the number of containers. Containers alike are handled together as one run."""
    room: dict[int, list[tuple[int, int]]] = {}  # residual -> runs (first container, how many)
    residuals: list[int] = []
    plan: list[PlanRow] = []
    used = 0

    def keep(residual: int, first: int, n: int) -> None:
        if residual > 0 and n > 0:
            if residual not in room:
                room[residual] = []
                insort(residuals, residual)
            room[residual].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 1
        while left > 0:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, n = room[residual].pop()
                if not room[residual]:
                    del room[residual]
                    residuals.pop(at)
            else:
                residual, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            each = residual // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each))
                keep(residual - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                plan.append((length, rank, rank + left - 1, first + full, left))
                keep(residual - left * length, first + full, 1)
                left, full = 0, full + 1
            keep(residual, first + full, n - full)
    return plan, used


_PLAN = StructType(
    [StructField("container_kind", StringType()), StructField("item_tokens", LongType())]
    + [StructField(c, LongType()) for c in ("rank_from", "rank_to", "container_from")]
    + [StructField("items_each", LongType()), StructField("block", LongType())]
)


_FILLED = "container_kind string, container_no long, doc_id long, piece_no int, first_token long, item_tokens long"


def items_of(sized: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """(container_kind, doc_id, piece_no, first_token, item_tokens). Only a text above the capacity is cut,
    into full pieces and a rest. Texts without tokens (null, empty) need no room and give no item."""
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacity.items())])
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("long")))
    return (
        sized.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.inline(kinds))
        .select("container_kind", "doc_id", "n_tokens", "capacity", pieces.alias("piece_no"))
        .select(
            "container_kind",
            "doc_id",
            F.col("piece_no").cast(IntegerType()).alias("piece_no"),
            (F.col("piece_no") * F.col("capacity")).alias("first_token"),
            F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("item_tokens"),
        )
    )


def fill_containers(documents: DataFrame, kinds: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_kind, container_no, doc_id, piece_no, first_token, item_tokens), one row per item.

    kinds is a small fixed table (a few rows; its size is checked). Equal texts
    and repeated ids are items of their own; an empty table gives no rows.
    """
    spark = documents.sparkSession
    few = kinds.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens")).limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("more than 1000 container kinds")
    capacity = {r["container_kind"]: r["capacity_tokens"] for r in few}
    if not capacity:
        return spark.createDataFrame([], _FILLED)
    sized = stash(spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), tokenizer).alias("n_tokens")), "sized")
    items = items_of(sized, capacity)
    # at most one row per kind and length up to the capacity
    histogram: dict[str, dict[int, int]] = {}
    for r in items.groupBy("container_kind", "item_tokens").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        histogram.setdefault(r["container_kind"], {})[r["item_tokens"]] = r["n"]
    # a length's ranks are joined in blocks, so that one length of a third of all items is many keys
    rows = [(kind, *row, block) for kind, h in histogram.items() for row in best_fit(h, capacity[kind])[0] for block in range(row[1] // ITEMS_PER_SALT, row[2] // ITEMS_PER_SALT + 1)]
    plan = spark.createDataFrame(rows, _PLAN)
    total = sum(n for h in histogram.values() for n in h.values())
    ranked = salted_rank(items, ["container_kind", "item_tokens"], 6, ["doc_id", "piece_no"], "rank", max(4, total // ITEMS_PER_SALT))
    if len(rows) <= BROADCAST_PLAN_ROWS:
        plan = F.broadcast(plan)
    return (
        ranked.withColumn("block", F.floor(F.col("rank") / ITEMS_PER_SALT))
        .join(plan, ["container_kind", "item_tokens", "block"])
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") <= F.col("rank_to")))
        .select(
            "container_kind",
            (F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("items_each"))).alias("container_no"),
            "doc_id",
            "piece_no",
            "first_token",
            "item_tokens",
        )
    )


def fill_report(filled: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least number of containers any packing needs, the share of room used."""
    per = filled.groupBy("container_kind").agg(F.countDistinct("container_no").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("item_tokens").alias("tokens"))
    cap = F.col("capacity_tokens").cast("long")
    return per.join(F.broadcast(kinds.select("container_kind", "capacity_tokens").distinct()), "container_kind").select(
        "container_kind", "capacity_tokens", "containers", "items", "tokens", F.ceil(F.col("tokens") / cap).alias("least_containers"), (F.col("tokens") / (F.col("containers") * cap)).alias("used_share")
    )
