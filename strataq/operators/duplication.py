"""Lines that repeat a fragment seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq import dims
from strataq.functions.text import share


def text_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line_text): non-blank lines with blanks collapsed, counted from 0. Null and blank texts give none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))), lambda x: x != "")
    return rows.select(key, F.posexplode(lines).alias("i", "line_text"))


def redundant_lines(lines: DataFrame, order: list[str], size: int = dims.DUPLICATION_LINES) -> DataFrame:
    """(order..., i): the lines inside a fragment of `size` lines that occurred before, in the order of files and lines.

    order names the columns that identify and sort a file. Fragments are known
    by two 64-bit hashes of their joined text. The first occurrence comes from a
    minimum, combined before the shuffle; only fragments that occur twice join
    back, so that a fragment in a third of all files is no single task's sort.
    """
    w = Window.partitionBy(*order).orderBy("i").rowsBetween(0, size - 1)
    frames = lines.select(*order, "i", F.collect_list("line_text").over(w).alias("_w")).where(F.size("_w") == size)
    text = F.array_join("_w", "\n")
    frames = frames.select(*order, "i", F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), F.reverse(text)).alias("_k"))
    at = F.struct(*order, "i")
    first = frames.groupBy("_h", "_k").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h", "_k", "_first")
    again = frames.join(first, ["_h", "_k"]).where(at != F.col("_first"))
    return again.select(*order, F.explode(F.sequence(F.col("i"), F.col("i") + size - 1)).alias("i")).distinct()


def duplication(lines: DataFrame, order: list[str], cap: float = dims.DUPLICATION_CAP) -> DataFrame:
    """One row: redundant and total lines, share, pass, at cap, lines too many. No lines, no row."""
    totals = lines.agg(F.count(F.lit(1)).alias("total_loc")).withColumn("one", F.lit(1))
    found = redundant_lines(lines, order).agg(F.count(F.lit(1)).alias("redundant_loc")).withColumn("one", F.lit(1))
    pct = share(F.col("redundant_loc"), F.col("total_loc"))
    excess = F.floor(F.col("redundant_loc") - F.lit(cap) / 100 * F.col("total_loc") + 0.999999).cast("long")
    return totals.join(found, "one").where("total_loc > 0").select("redundant_loc", "total_loc", pct.alias("pct"), (pct <= cap).alias("pass"), (F.abs(pct - cap) <= dims.AT_CAP_MARGIN).alias("at_cap"), F.when(pct <= cap, F.lit(0).cast("long")).otherwise(excess).alias("excess_loc"))


def module_duplication(lines: DataFrame, order: list[str]) -> DataFrame:
    """(order..., loc, redundant_loc, pct) of the files with redundant lines."""
    loc = lines.groupBy(*order).agg(F.count(F.lit(1)).alias("loc"))
    bad = redundant_lines(lines, order).groupBy(*order).agg(F.count(F.lit(1)).alias("redundant_loc"))
    return loc.join(bad, order).withColumn("pct", share(F.col("redundant_loc"), F.col("loc")))
