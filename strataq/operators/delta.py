"""Change between two inventories: good and bad churn of low-risk and high-risk lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq import dims


def file_profiles(units: DataFrame, language: str = "language", file: str = "file") -> DataFrame:
    """(language, file, one low_ and one high_ column per property): lines of units at low risk and above. Null lines count as none, a null measure as 0."""
    loc = F.coalesce(F.col("loc").cast("long"), F.lit(0))
    sums = []
    for p, (c, most) in dims.DELTA_PROPERTIES.items():
        low = F.coalesce(F.col(c).cast("long"), F.lit(0)) <= most
        sums += [F.sum(F.when(low, loc).otherwise(0)).alias(f"low_{p}"), F.sum(F.when(low, 0).otherwise(loc)).alias(f"high_{p}")]
    return units.groupBy(language, file).agg(*sums)


def delta_files(before: DataFrame, after: DataFrame, language: str = "language", file: str = "file") -> DataFrame:
    """(language, file, added, removed, touched, good_ and bad_ per property). A file on one side only counts in full."""
    a, b = file_profiles(before, language, file), file_profiles(after, language, file)
    sides = []
    for d, mark in ((a, "a"), (b, "b")):
        sides.append(d.select(F.col(language).alias(f"{mark}_l"), F.col(file).alias(f"{mark}_f"), *[F.col(c).alias(f"{mark}_{c}") for c in d.columns[2:]], F.lit(True).alias(f"{mark}_here")))
    j = sides[0].join(sides[1], F.col("a_l").eqNullSafe(F.col("b_l")) & F.col("a_f").eqNullSafe(F.col("b_f")), "full_outer")
    out, touched = [], F.lit(False)
    for p in dims.DELTA_PROPERTIES:
        d = {k: F.coalesce(f"b_{k}_{p}", F.lit(0)) - F.coalesce(f"a_{k}_{p}", F.lit(0)) for k in ("low", "high")}
        zero = F.lit(0)
        out += [(F.greatest(d["low"], zero) + F.greatest(-d["high"], zero)).alias(f"good_{p}"), (F.greatest(-d["low"], zero) + F.greatest(d["high"], zero)).alias(f"bad_{p}")]
        touched = touched | (d["low"] != 0) | (d["high"] != 0)
    gone, new = F.col("b_here").isNull(), F.col("a_here").isNull()
    return j.select(F.when(new, F.col("b_l")).otherwise(F.col("a_l")).alias(language), F.when(new, F.col("b_f")).otherwise(F.col("a_f")).alias(file), new.alias("added"), gone.alias("removed"), touched.alias("touched"), *out)


def delta_scores(files: DataFrame, language: str = "language") -> DataFrame:
    """(language, property, good, bad, score, files_touched, files_added, files_removed); the score of no churn is null, never 0."""
    cols = F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"good_{p}").alias("good"), F.col(f"bad_{p}").alias("bad")) for p in dims.DELTA_PROPERTIES])
    per = files.select(language, "added", "removed", "touched", F.inline(cols)).groupBy(language, "property").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count_if("touched").alias("files_touched"), F.count_if("added").alias("files_added"), F.count_if("removed").alias("files_removed"))
    return per.withColumn("score", F.try_divide(F.col("good").cast("double"), F.col("good") + F.col("bad")))


def breaches(scores: DataFrame, floor: float) -> DataFrame:
    """Scores that were measured and lie below the floor."""
    return scores.where(F.col("score").isNotNull() & (F.col("score") < floor))
