"""Unit inventories: one spelling of paths, numbers and names, the last export of each unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.common import outer_trim
from strataq.operators.reconcile import differences

KEY = ["root_path", "file_name", "line_no"]
FIELDS = ["element_name", "loc", "mccabe", "params"]


def normal_path(c: Column) -> Column:
    """Forward separators, no leading ./"""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def number_text(c: Column) -> Column:
    """A number by value: 7, '7.0' and ' 7' are one; blank is null; what is no number stays as its text."""
    text = outer_trim(c.cast("string"))
    number = text.try_cast("decimal(38,9)")
    return F.when(text == "", F.lit(None)).otherwise(F.coalesce(F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), text))


def last_units(units: DataFrame) -> DataFrame:
    """One row per (root, file, line), the last export (ties: the greatest row); maxima before the shuffle."""
    name = outer_trim(F.col("element_name"))
    rows = units.select(
        "root_path",
        normal_path(F.col("file_name")).alias("file_name"),
        "line_no",
        "exported_at",
        F.when(name == "", F.lit(None)).otherwise(name).alias("element_name"),
        *[number_text(F.col(c)).alias(c) for c in FIELDS[1:]],
    )
    return rows.groupBy(*KEY).agg(F.max(F.struct("exported_at", *FIELDS)).alias("last")).select(*KEY, *[F.col(f"last.{c}").alias(c) for c in FIELDS])


def unit_differences(units: DataFrame, copy: DataFrame) -> DataFrame:
    rows = max(units.count(), copy.count())  # with what was delivered again: buckets come out a little smaller
    return differences(last_units(units), last_units(copy), KEY, FIELDS, ("units", "copy"), rows)
