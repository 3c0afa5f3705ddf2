"""Findings against reviewed acceptances, bounded by count; sections and tops of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq import dims
from strataq.common import stash

SALTS = 16


def apply_acceptances(findings: DataFrame, acceptances: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """findings with accepted: true for as many of each key as its acceptances count, in report order.

    Findings without an acceptance are not ranked at all. For the others each
    key is first ranked within salted parts, where what lies beyond the budget
    is open for certain; only the rest, at most the budget per part, is ranked
    as a whole. order has to be total within a key.
    """
    budget = acceptances.groupBy(*key).agg(F.sum("count").alias("_budget"))
    rows = findings.join(budget, key, "left")
    plain = rows.where("_budget IS NULL").drop("_budget").withColumn("accepted", F.lit(False))
    salted = rows.where("_budget IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = Window.partitionBy(*key, "_salt").orderBy(*order)
    near = salted.withColumn("_r", F.row_number().over(part))
    far = near.where("_r > _budget").withColumn("accepted", F.lit(False))
    whole = Window.partitionBy(*key).orderBy(*order)
    close = near.where("_r <= _budget").withColumn("_r", F.row_number().over(whole)).withColumn("accepted", F.col("_r") <= F.col("_budget"))
    return plain.unionByName(far.unionByName(close).drop("_r", "_salt", "_budget"))


def stale_acceptances(findings: DataFrame, acceptances: DataFrame, key: list[str]) -> DataFrame:
    """Acceptances whose key has fewer findings than they count together, with how many matched; a gate wants none."""
    matched = findings.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    budget = acceptances.groupBy(*key).agg(F.sum("count").alias("_budget"))
    left = budget.join(matched, key, "left").withColumn("matched", F.least(F.coalesce("_n", F.lit(0)), "_budget")).where("matched < _budget").select(*key, "matched")
    return acceptances.join(left, key)


def accepted_summary(findings: DataFrame, acceptances: DataFrame, key: list[str]) -> DataFrame:
    """(rule, accepted, reasons, refs) of the rules with accepted findings; findings from apply_acceptances."""
    used = findings.where("accepted").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    per = used.groupBy("rule").agg(F.sum("_n").alias("accepted"))
    named = acceptances.join(used, key, "left_semi")
    texts = named.groupBy("rule").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set(F.when(F.col("ref") != "", F.col("ref")))).alias("refs"))
    return per.join(texts, "rule")


def rule_rank() -> Column:
    order = F.create_map(*[x for i, r in enumerate(dims.RULES) for x in (F.lit(r), F.lit(i))])
    return F.try_element_at(order, F.col("rule"))


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: rule, value from the top, file, line."""
    return findings.orderBy(rule_rank(), F.col("value").desc(), "file", "line", "element", "description")


def sectioned(findings: DataFrame, order: list) -> DataFrame:
    """Findings numbered 1, 2, ... within their rule; a rule without findings has one row with nulls, so that its section shows.

    Rules are few and may be hot, so the findings are sorted by ranges of rule and
    order; a number is the place in the range plus the rule's rows in the ranges before.
    """
    spark = findings.sparkSession
    rules = spark.createDataFrame([(r, i) for i, r in enumerate(dims.RULES)], "rule string, rank int")
    ranged = stash(findings.repartitionByRange("rule", *order).withColumn("_part", F.spark_partition_id()), "sections")
    in_part = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part", "rule").orderBy(*order)))
    sizes = ranged.groupBy(F.col("_part").alias("_p"), F.col("rule").alias("_rule")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_rule").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", "_rule", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = in_part.join(offsets, (F.col("_part") == F.col("_p")) & F.col("rule").eqNullSafe(F.col("_rule")))
    numbered = placed.withColumn("id", (F.col("_place") + F.col("_before")).cast("int")).drop("_part", "_place", "_p", "_rule", "_before")
    return F.broadcast(rules).join(numbered, "rule", "left")


def top(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group, with how many more there are. Each group is cut down within salted parts first, so that
    at most n rows a part are ranked as a whole; its size is counted apart."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(SALTS)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    first = near.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n).drop("_r", "_salt")
    sizes = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_size"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return first.join(sizes, on).withColumn("more", F.greatest(F.col("_size") - n, F.lit(0))).drop("_size", *[f"_g_{g}" for g in group])


def counts(findings: DataFrame) -> DataFrame:
    """(rule, findings, high, very_high, files), every rule with a row."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(r,) for r in dims.RULES], "rule string")
    per = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "high risk").alias("high"), F.count_if(F.col("severity") == "very high risk").alias("very_high"), F.countDistinct("file").alias("files"))
    return rules.join(per, "rule", "left").fillna(0)


def issue_actions(issues: DataFrame, existing: DataFrame) -> DataFrame:
    """(marker, title, action, number): what publishing would do. issues has marker, title, body; existing number, title, body.

    A marker is a token <!-- name --> in an issue's body; it is taken out there
    and joined by equality. The issue with the least number holds.
    """
    marks = existing.select("number", F.col("title").alias("_title"), F.col("body").alias("_body"), F.explode(F.regexp_extract_all("body", F.lit(r"<!--\s*\S+\s*-->"), F.lit(0))).alias("marker"))
    first = marks.groupBy("marker").agg(F.min_by(F.struct("number", "_title", "_body"), "number").alias("e"))
    both = issues.join(first, "marker", "left")
    same = (F.col("e._title") == F.col("title")) & (F.col("e._body") == F.col("body"))
    return both.select("marker", "title", F.when(F.col("e").isNull(), "create").when(same, "skip").otherwise("update").alias("action"), F.col("e.number").alias("number"))
