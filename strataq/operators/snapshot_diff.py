"""What changed between consecutive full snapshots of figures held in maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.common import outer_trim

#: Digits a figure is printed with.
DIGITS = {"density": 2, "violation_degree": 3, "lines": 0, "violations": 0}
MEASURE_DIGITS = 1


def _printed(value: Column, scale: Column) -> Column:
    """The printed figure as a whole number of its last digit, halves away from zero."""
    x = value * scale
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def snapshot_figures(snapshots: DataFrame) -> DataFrame:
    """(root_path, taken, code_language, measure_name, figure, scale), one row per measured figure.

    The last delivery of a root, date and language holds; of deliveries at one
    moment the one with the greatest row text. Null and NaN figures, null maps
    and empty maps give no rows. A null language is a language of its own.
    """
    rows = snapshots.select("root_path", "taken", F.lower(outer_trim(F.col("code_language"))).alias("code_language"), "delivered_at", "measures", "entanglement")
    lists = [F.array_sort(F.map_entries(c)) for c in ("measures", "entanglement")]
    last = (
        rows.groupBy("root_path", "taken", "code_language")
        .agg(F.max(F.struct("delivered_at", lists[0].alias("m"), lists[1].alias("e"))).alias("last"))
    )
    scales = F.create_map(*[x for k, d in DIGITS.items() for x in (F.lit(k), F.lit(float(10**d)))])
    named = F.concat(
        F.transform(F.coalesce("last.m", F.array()), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"), F.lit(float(10**MEASURE_DIGITS)).alias("scale"))),
        F.transform(
            F.coalesce("last.e", F.array()),
            lambda e: F.struct(F.concat(F.lit("entanglement "), e["key"]).alias("name"), e["value"].alias("v"), F.coalesce(F.element_at(scales, e["key"]), F.lit(float(10**MEASURE_DIGITS))).alias("scale")),
        ),
    )
    return (
        last.select("root_path", "taken", "code_language", F.explode(named).alias("f"))
        .where(F.col("f.v").isNotNull() & ~F.isnan("f.v"))
        .select("root_path", "taken", "code_language", F.col("f.name").alias("measure_name"), _printed(F.col("f.v"), F.col("f.scale")).alias("figure"), F.col("f.scale").alias("scale"))
    )


def consecutive_dates(snapshots: DataFrame) -> DataFrame:
    """(root_path, then_taken, taken): each date of a root with the one before it."""
    dates = snapshots.select("root_path", "taken").distinct()
    w = Window.partitionBy("root_path").orderBy("taken")
    return dates.withColumn("then_taken", F.lag("taken").over(w)).where(F.col("then_taken").isNotNull())


def except_all(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """left EXCEPT ALL right; equal rows cancel one for one."""
    return left.select(*columns).exceptAll(right.select(*columns))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(root_path, taken, code_language, measure_name, kind, then_figure, now_figure).

    Each date's figures meet the figures of the root's date before, moved to
    the later date. EXCEPT ALL both ways leaves what differs; a full join of the
    two residues by key tells new, gone and moved. A root's first date gives
    nothing, a repeated row nothing, an empty table no rows.
    """
    figures = snapshot_figures(snapshots)
    pairs = consecutive_dates(snapshots)
    key = ["root_path", "taken", "code_language", "measure_name"]
    columns = [*key, "figure", "scale"]
    now = figures.join(pairs.select("root_path", "taken"), ["root_path", "taken"], "left_semi")
    p = pairs.select(F.col("root_path").alias("_r"), "then_taken", F.col("taken").alias("_t"))
    then = figures.join(p, (F.col("root_path") == F.col("_r")) & (F.col("taken") == F.col("then_taken"))).withColumn("taken", F.col("_t")).select(*columns)
    a = except_all(now, then, columns).select(*[F.col(c).alias(f"n_{c}") for c in columns])
    b = except_all(then, now, columns).select(*[F.col(c).alias(f"t_{c}") for c in columns])
    on = [F.col(f"n_{c}").eqNullSafe(F.col(f"t_{c}")) for c in key]
    joined = a.join(b, on[0] & on[1] & on[2] & on[3], "full_outer")
    fresh, lost = F.col("t_figure").isNull(), F.col("n_figure").isNull()
    return joined.select(
        *[F.coalesce(f"n_{c}", f"t_{c}").alias(c) for c in key],
        F.when(fresh, "new").when(lost, "gone").otherwise("moved").alias("kind"),
        (F.col("t_figure") / F.col("t_scale")).alias("then_figure"),
        (F.col("n_figure") / F.col("n_scale")).alias("now_figure"),
    )
