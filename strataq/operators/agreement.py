"""How far two tools' measurements of the same functions agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.percentiles import exact_median

LOW, HIGH = 0.75, 1.33


def matched(ours: DataFrame, theirs: DataFrame, key: list[str], measures: list[str], ordinal: str) -> DataFrame:
    """(key, measure, ours, theirs, ratio): functions both sides have; of rows with one key the last holds. The ratio to 0 is null."""
    sides = []
    for d, mark in ((ours, "ours"), (theirs, "theirs")):
        last = d.groupBy(*key).agg(F.max(F.struct(ordinal, *measures)).alias("r"))
        sides.append(last.select(*key, *[F.col(f"r.{m}").alias(f"{mark}_{m}") for m in measures]))
    both = sides[0].join(sides[1], key)
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"ours_{m}").cast("double").alias("ours"), F.col(f"theirs_{m}").cast("double").alias("theirs")) for m in measures])
    return both.select(*key, F.inline(rows)).where("ours IS NOT NULL AND theirs IS NOT NULL").withColumn("ratio", F.try_divide("ours", "theirs"))


def agreement_stats(pairs: DataFrame) -> DataFrame:
    """(measure, matched, equal, median_ratio, outside): a ratio to 0 stays out of the distribution but counts towards equality."""
    counted = pairs.groupBy("measure").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("ours") == F.col("theirs")).alias("equal"), F.count_if((F.col("ratio") < LOW) | (F.col("ratio") > HIGH)).alias("outside"))
    middle = exact_median(pairs, ["measure"], "ratio").select("measure", F.col("median").alias("median_ratio"))
    return counted.join(middle, "measure", "left")


def worst_divergence(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs whose ratio is farthest from 1, by the logarithm; a ratio of 0 comes first."""
    far = F.when(F.col("ratio") == 0, F.lit(float("inf"))).otherwise(F.abs(F.ln("ratio")))
    return pairs.where(F.col("ratio").isNotNull() & (F.col("ratio") != 1)).withColumn("distance", far).orderBy(F.col("distance").desc(), *[c for c in pairs.columns]).limit(n)
