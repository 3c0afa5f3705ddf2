"""Snapshots of a profile's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import rounded


def tail_measures(tails: DataFrame, group: str) -> DataFrame:
    """(group, measures): each tail's share, rounded to one decimal, under "property tail"."""
    entry = F.struct(F.concat_ws(" ", "property", "tail").alias("key"), rounded(F.col("pct"), 1).alias("value"))
    return tails.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("measures"))


def entanglement_measures(figures: DataFrame, group: str) -> DataFrame:
    """(group, entanglement): density to two decimals, degree to three, counts as they are."""
    pairs = [("density", rounded(F.col("density"), 2)), ("violation_degree", rounded(F.col("violation_degree"), 3)), ("lines", F.col("lines").cast("double")), ("violations", F.col("violations").cast("double"))]
    return figures.select(group, F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).alias("entanglement"))


def movement(now: DataFrame, baseline: DataFrame | None, group: str) -> DataFrame:
    """(group, measure, kind, then, now) of two snapshots' measures (group, measures): new, gone, moved. No baseline, no rows."""
    long = lambda d, name: d.select(F.col(group).alias(f"_{name}"), F.explode("measures").alias(f"m_{name}", name))
    if baseline is None:
        baseline = now.limit(0)
        now = now.limit(0)
    j = long(now, "now").join(long(baseline, "then"), (F.col("_now") == F.col("_then")) & (F.col("m_now") == F.col("m_then")), "full_outer")
    kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("moved")
    return j.where(~F.col("now").eqNullSafe(F.col("then"))).select(F.coalesce("_now", "_then").alias(group), F.coalesce("m_now", "m_then").alias("measure"), kind.alias("kind"), "then", "now")
