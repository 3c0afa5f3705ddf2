"""Volume-weighted risk profiles: categories, nested tails, roll-up, standing, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import dims
from strataq.functions.text import share

COMBINED = "combined"


def category_of(value: Column, bands: list[tuple[str, int, int]]) -> Column:
    """The band a value lies in; none below the lowest."""
    out = F.lit("none")
    for name, low, high in bands:
        out = F.when(value.between(low, high), name).otherwise(out)
    return out


def tail_label(threshold: int, inclusive: bool) -> str:
    return f"{'>=' if inclusive else '>'} {threshold}"


def _rolled(rows: DataFrame, group: str, keys: list[str], *sums: Column) -> DataFrame:
    """Per group and over all groups (labelled combined), in one pass over the group sums."""
    return rows.withColumn(group, F.explode(F.array(F.col(group), F.lit(COMBINED)))).groupBy(group, *keys).agg(*sums)


def _summed(units: DataFrame, group: str, conditions: list[Column]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Group sums of units and lines for every condition, from one reading of the units without multiplying a row;
    and, per condition, the columns of its two sums. Units without lines weigh nothing."""
    loc = F.col("loc").cast("long")
    aggs, names = [F.sum(loc).alias("total")], ["total"]
    for i, c in enumerate(conditions):
        aggs += [F.count_if(c).alias(f"_n{i}"), F.sum(F.when(c, loc).otherwise(0)).alias(f"_l{i}")]
        names += [f"_n{i}", f"_l{i}"]
    per = units.where(F.col("loc").isNotNull()).groupBy(group).agg(*aggs)
    rolled = _rolled(per, group, [], *[F.sum(n).alias(n) for n in names]).where("total > 0")
    return rolled, [(F.col(f"_n{i}"), F.col(f"_l{i}")) for i in range(len(conditions))]


def category_shares(units: DataFrame, group: str, properties: dict = dims.UNIT_PROPERTIES) -> DataFrame:
    """(group, property, category, elements, loc, pct), with the roll-up over all groups. Every category of a measured group has a row."""
    labels = [(p, name, c, low, high) for p, (c, bands, _) in properties.items() for name, low, high in bands]
    sums, columns = _summed(units, group, [F.coalesce(F.col(c).between(low, high), F.lit(False)) for _, _, c, low, high in labels])
    rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(name).alias("category"), n.alias("elements"), loc.alias("loc")) for (p, name, *_), (n, loc) in zip(labels, columns)])
    return sums.select(group, "total", F.inline(rows)).select(group, "property", "category", "elements", "loc", share(F.col("loc"), F.col("total")).alias("pct"))


def tail_shares(units: DataFrame, group: str, properties: dict = dims.UNIT_PROPERTIES) -> DataFrame:
    """(group, property, tail, cap_pct, elements, loc, total, pct, pass, at_cap, excess_loc), roll-up included. Tails nest: a value counts in every tail it exceeds."""
    labels = [(p, tail_label(t, inclusive), cap, F.col(c) >= t if inclusive else F.col(c) > t) for p, (c, _, tails) in properties.items() for t, inclusive, cap in tails]
    sums, columns = _summed(units, group, [F.coalesce(held, F.lit(False)) for *_, held in labels])
    rows = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(tail).alias("tail"), F.lit(cap).alias("cap_pct"), n.alias("elements"), loc.alias("loc")) for (p, tail, cap, _), (n, loc) in zip(labels, columns)])
    stacked = sums.select(group, "total", F.inline(rows))
    pct = share(F.col("loc"), F.col("total"))
    excess = F.ceil(F.col("loc") - F.col("cap_pct") / 100 * F.col("total"))
    return stacked.select(group, "property", "tail", "cap_pct", "elements", "loc", "total", pct.alias("pct"), (pct <= F.col("cap_pct")).alias("pass"), (F.abs(pct - F.col("cap_pct")) <= dims.AT_CAP_MARGIN).alias("at_cap"), F.when(pct <= F.col("cap_pct"), F.lit(0).cast("long")).otherwise(excess).alias("excess_loc"))


def language_totals(units: DataFrame, group: str, non_unit: DataFrame | None = None) -> DataFrame:
    """(group, units, unit_loc, non_unit_loc, non_unit_pct, measured), roll-up included."""
    per = units.groupBy(group).agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.col("loc").cast("long")), F.lit(0)).alias("unit_loc"))
    if non_unit is not None:
        per = per.join(non_unit.groupBy(group).agg(F.sum("non_unit_loc").alias("non_unit_loc")), group, "full_outer").fillna(0)
    else:
        per = per.withColumn("non_unit_loc", F.lit(0).cast("long"))
    rolled = _rolled(per, group, [], *[F.sum(c).alias(c) for c in ("units", "unit_loc", "non_unit_loc")])
    return rolled.select("*", share(F.col("non_unit_loc"), F.col("unit_loc") + F.col("non_unit_loc")).alias("non_unit_pct"), ((F.col("units") > 0) & (F.col("unit_loc") > 0)).alias("measured"))


def non_unit_lines(files: DataFrame, units: DataFrame) -> DataFrame:
    """(file keys, non_unit_loc): a file's lines outside its functions, never below 0. Both have module, rel and loc."""
    inside = units.where("has_body").groupBy("module", "rel").agg(F.sum("loc").alias("_in"))
    return files.join(inside, ["module", "rel"], "left").select("module", "rel", F.greatest(F.col("loc") - F.coalesce("_in", F.lit(0)), F.lit(0)).alias("non_unit_loc"))


def claimed_by_all(sets: DataFrame) -> DataFrame:
    """One row: the module metrics that every language's set claims."""
    n = sets.agg(F.count(F.lit(1)).alias("sets")).withColumn("one", F.lit(1))
    claims = sets.select(F.explode(F.array_distinct("module_metrics")).alias("metric")).groupBy("metric").count().withColumn("one", F.lit(1))
    return claims.join(n, "one").where("count = sets").agg(F.array_sort(F.collect_list("metric")).alias("module_metrics"))


def unmeasured(totals: DataFrame, group: str) -> DataFrame:
    """Languages without units; a run fails on any, after its report is written."""
    return totals.where((~F.col("measured")) & (F.col(group) != COMBINED)).select(group)


def with_deviations(tails: DataFrame, group: str, deviations: DataFrame) -> DataFrame:
    """Tails beside the deviation recorded for them, if any."""
    d = deviations.select(F.col("language").alias(group), "property", "tail", "decided", "ref", "summary")
    return tails.join(d, [group, "property", "tail"], "left")


def standing(tails: DataFrame, group: str) -> DataFrame:
    """(group, within, over, deviated, eligible): tails inside their cap, outside, outside with a recorded deviation. tails from with_deviations."""
    over = ~F.col("pass")
    decided = F.col("decided").isNotNull()
    return tails.where(F.col(group) != COMBINED).groupBy(group).agg(F.count_if(F.col("pass")).alias("within"), F.count_if(over & ~decided).alias("over"), F.count_if(over & decided).alias("deviated"), F.bool_and("pass").alias("eligible"))


def distances(tails: DataFrame, group: str) -> DataFrame:
    """(group, property, excess_loc): the largest excess among a property's tails, since mending that one mends the nested ones."""
    return tails.where(F.col(group) != COMBINED).groupBy(group, "property").agg(F.max("excess_loc").alias("excess_loc")).where("excess_loc > 0")


def volume(totals: DataFrame, group: str) -> DataFrame:
    """(group, loc, lines_per_budget, years); a language without a factor has null years."""
    factors = F.create_map(*[x for k, v in dims.LINES_PER_BUDGET.items() for x in (F.lit(k.lower()), F.lit(v))])
    factor = F.try_element_at(factors, F.lower(F.col(group)))
    loc = F.col("unit_loc") + F.col("non_unit_loc")
    return totals.where(F.col(group) != COMBINED).select(group, loc.alias("loc"), factor.alias("lines_per_budget"), (loc / factor * dims.BUDGET_YEARS).alias("years"))
