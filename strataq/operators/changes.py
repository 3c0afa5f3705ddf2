"""Changed files whose code did not change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strataq.frontend.golexer import GoSyntaxError
from strataq.frontend.gofacts import canonical_code


@F.pandas_udf(BooleanType())
def same_code(before: pd.Series, after: pd.Series) -> pd.Series:
    """Whether two Go texts have the same tokens and the same directives. A text that is missing or does not parse is never the same."""

    def one(a: str | None, b: str | None) -> bool:
        if a is None or b is None:
            return False
        try:
            return canonical_code(a) == canonical_code(b)
        except (GoSyntaxError, RecursionError):
            return False

    return pd.Series([one(a, b) for a, b in zip(before, after)])


def partition_changes(changes: DataFrame, base: DataFrame, work: DataFrame) -> DataFrame:
    """(status, path, exempt): a modified Go file whose two versions differ in comments and layout only is exempt; everything else stays."""
    j = changes.join(base.select("path", F.col("body").alias("_a")), "path", "left").join(work.select("path", F.col("body").alias("_b")), "path", "left")
    modified = (F.col("status") == "M") & F.col("path").endswith(".go")
    return j.withColumn("_same", same_code("_a", "_b")).select("status", "path", (modified & F.col("_same")).alias("exempt"))
