"""Statement coverage: blocks once, generated files apart, per package and against a floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import share
from strataq.sources.tree import directory


def covered_files(blocks: DataFrame) -> DataFrame:
    """(file, statements, covered): each block once, hit if any run hit it; its statements are those of the line that came first."""
    once = blocks.groupBy("file", "block").agg(F.min_by("statements", "ordinal").alias("statements"), F.max("hits").alias("hits"))
    return once.groupBy("file").agg(F.sum("statements").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("statements")).otherwise(0)).alias("covered"))


def classified(files: DataFrame, generated: DataFrame) -> DataFrame:
    """files with their generated flag; a measured file that is not among the sources is an error."""
    joined = files.join(generated.select("file", "generated", F.lit(True).alias("_known")), "file", "left")
    known = F.when(F.col("_known").isNotNull(), F.coalesce("generated", F.lit(False))).otherwise(F.raise_error(F.concat(F.lit("no source for "), F.col("file"))).cast("boolean"))
    return joined.select("file", "statements", "covered", known.alias("generated"))


def packages(files: DataFrame) -> DataFrame:
    """(package, files, statements, covered, uncovered, pct) over files that are not generated."""
    own = files.where(~F.col("generated")).withColumn("package", directory(F.col("file")))
    per = own.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum("statements").alias("statements"), F.sum("covered").alias("covered"))
    return per.select("*", (F.col("statements") - F.col("covered")).alias("uncovered"), share(F.col("covered"), F.col("statements")).alias("pct"))


def verdict(files: DataFrame, floor: float) -> DataFrame:
    """One row: statements, covered, generated statements, share, breached, headroom, shortfall, raise_to."""
    own = lambda c: F.sum(F.when(F.col("generated"), 0).otherwise(F.col(c)))
    one = files.agg(F.coalesce(own("statements"), F.lit(0)).alias("statements"), F.coalesce(own("covered"), F.lit(0)).alias("covered"), F.coalesce(F.sum(F.when(F.col("generated"), F.col("statements")).otherwise(0)), F.lit(0)).alias("generated_statements"))
    pct = share(F.col("covered"), F.col("statements"))
    return one.select("*", pct.alias("pct"), (pct < floor).alias("breached"), headroom(floor).alias("headroom"), shortfall(floor).alias("shortfall"), raise_to(pct, floor).alias("raise_to"))


def headroom(floor: float) -> Column:
    """New statements without tests that the floor still bears."""
    if floor <= 0:
        return F.lit(0).cast("long")
    return F.greatest(F.floor(F.col("covered") * 100 / floor) - F.col("statements"), F.lit(0).cast("long"))


def shortfall(floor: float) -> Column:
    """Statements to cover until the floor holds."""
    return F.greatest(F.ceil(F.lit(floor) / 100 * F.col("statements")) - F.col("covered"), F.lit(0).cast("long"))


def raise_to(pct: Column, floor: float) -> Column:
    """A floor a fifth of a point below the share, in tenths, when that is a point or more above the floor; else null."""
    to = F.floor((pct - 0.2) * 10) / 10
    return F.when(to - floor >= 1, to)
