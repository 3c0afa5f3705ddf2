"""Versions that tools report, against what a project wants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import at_least_version, same_version

#: How each tool words its version, and whether it has to equal the pin or reach a floor.
REPORTED = {
    "golangci-lint": (r"version v?(\d+(?:\.\d+)+)", "equal"),
    "actionlint": (r"(?m)^v?(\d+(?:\.\d+)+)", "equal"),
    "govulncheck": (r"(?m)^Go: go(\d+(?:\.\d+)*)", "floor"),
}
GO_DIRECTIVE = r"(?m)^go (\d+(?:\.\d+)*)\s*$"


def tool_verdicts(reports: DataFrame) -> DataFrame:
    """(tool, wanted, version, verdict) of (tool, output, wanted): ok, mismatch, or error where no version can be read."""
    version, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for tool, (pattern, how) in REPORTED.items():
        found = F.regexp_extract("output", pattern, 1)
        version = F.when(F.col("tool") == tool, F.when(found != "", found)).otherwise(version)
        kind = F.when(F.col("tool") == tool, how).otherwise(kind)
    good = F.when(kind == "floor", at_least_version(F.col("version"), F.col("wanted"))).otherwise(same_version(F.col("version"), F.col("wanted")))
    unread = F.col("version").isNull() | F.col("wanted").isNull() | ~F.col("wanted").rlike(r"\d")
    return reports.withColumn("version", version).select("tool", "wanted", "version", F.when(unread, "error").when(good, "ok").otherwise("mismatch").alias("verdict"))
