"""Percentiles per group from mergeable per-day value counts.

The day result is an exact histogram over quantised values, so any range of
days combines by adding counts. Ranks come from cumulative frequencies: the
group-value counts are sorted by value ranges, each range's running sums get
the sizes of the ranges before it, and the first value to reach a target rank
is the percentile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from strataq.common import stash

#: Significant bits kept of a value. Whole values below 2**BITS are exact, others are
#: off by at most a 2**-BITS part of themselves.
BITS = 10
#: log2 of the bins in one range of values: a task never sorts more of one group at once.
RANGE_BITS = 12
#: Smallest exponent of a double, so that bin numbers of fractions stay positive.
_LEAST_EXPONENT = 1080


def _shift(v: Column, bits: int) -> Column:
    """Bits a whole number loses."""
    return F.greatest(F.length(F.bin(v)) - F.lit(bits), F.lit(0))


def _step(v: Column, bits: int) -> Column:
    """Width of a fraction's bin."""
    return F.pow(F.lit(2.0), F.floor(F.log2(v)) - F.lit(bits - 1))


def quantise(value: Column, bits: int = BITS, fractional: bool = False) -> Column:
    """The value's bin, as the middle of the bin. Whole numbers below 2**bits are their own bin; of
    fractions, those with no more than `bits` significant bits, zero and the infinities."""
    if fractional:
        v = F.abs(value.cast("double"))
        low = F.floor(v / _step(v, bits)) * _step(v, bits)
        own = (v == 0) | (v == float("inf")) | (low == v)
        return F.when(own, value.cast("double")).otherwise((low + _step(v, bits) / 2) * F.signum(value.cast("double")))
    v = F.abs(value.cast("long"))
    shift = _shift(v, bits)
    low = F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)
    mid = low + F.call_function("shiftleft", F.lit(1).cast("long"), shift - 1)
    return F.when(v < (1 << bits), value.cast("long")).otherwise(mid * F.signum(value).cast("long"))


def value_range(value: Column, bits: int = BITS, fractional: bool = False) -> Column:
    """A number that never falls as the value grows; values of one number share 2**RANGE_BITS bins."""
    if fractional:
        v = F.abs(value.cast("double"))
        at = (F.floor(F.log2(v)) + F.lit(_LEAST_EXPONENT)) * F.lit(1 << (bits - 1)) + F.floor(v / _step(v, bits))
        at = F.when(v == 0, F.lit(0)).when(v == float("inf"), F.lit(2 * _LEAST_EXPONENT << (bits - 1))).otherwise(at)
    else:
        v = F.abs(value.cast("long"))
        shift = _shift(v, bits)
        at = shift.cast("long") * F.lit(1 << (bits - 1)) + F.call_function("shiftright", v, shift)
    return F.shiftright((at * F.signum(value)).cast("long"), RANGE_BITS)


def count_once(df: DataFrame, key: str, arrived: str, keep: Sequence[str]) -> DataFrame:
    """One row per key, the last to arrive (ties: the greatest row). Rows without a key have nothing to
    be recognised by and all stay. Partial maxima are taken before the shuffle, so a key repeated in a
    third of all rows moves one row per input partition."""
    latest = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(arrived), *keep)).alias("_last"))
        .select(*[F.col(f"_last.{c}").alias(c) for c in keep])
    )
    return latest.unionByName(df.where(F.col(key).isNull()).select(*keep))


def _is_fractional(df: DataFrame, column: str) -> bool:
    t = df.schema[column].dataType
    return isinstance(t, (DoubleType, FloatType)) or isinstance(t, DecimalType) and t.scale > 0


def daily_counts(df: DataFrame, group: str, day: str, measures: Sequence[str], bits: int = BITS) -> DataFrame:
    """(measure_name, group, day, value, n): what a day leaves behind. Null measures and NaN do not count.

    value is a long where all measures are whole numbers, else a double.
    """
    fractional = any(_is_fractional(df, m) for m in measures)
    kind = "double" if fractional else "long"
    stacked = df.select(group, day, F.explode(F.array(*[F.struct(F.lit(m).alias("measure_name"), F.col(m).cast(kind).alias("value")) for m in measures])).alias("m"))
    counts = F.col("value").isNotNull() & ~F.isnan("value") if fractional else F.col("value").isNotNull()
    return (
        stacked.select("m.measure_name", group, day, "m.value")
        .where(counts)
        .groupBy("measure_name", group, day, quantise(F.col("value"), bits, fractional).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def combine(daily: DataFrame, group: str, day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Counts of a range of days (both ends included) from the day results."""
    if since is not None:
        daily = daily.where(F.col(day) >= F.lit(since).cast("date"))
    if until is not None:
        daily = daily.where(F.col(day) <= F.lit(until).cast("date"))
    return daily.groupBy("measure_name", group, "value").agg(F.sum("n").alias("n"))


#: Ranges of days every report covers: the day, its week (from Monday), all days.
DAY_RANGES = ("day", "week", "all")


def combine_each(daily: DataFrame, group: str, day: str) -> DataFrame:
    """(measure_name, group, day_range, starts, value, n): each day result under every one of DAY_RANGES, for
    percentiles() to add up. starts is the first day of the range, null for all days. Rows without a day count towards
    all days only."""
    dates = {"day": F.col(day).cast("date"), "week": F.date_trunc("week", day).cast("date"), "all": F.lit(None).cast("date")}
    each = [F.struct(F.lit(k).alias("day_range"), dates[k].alias("starts")) for k in DAY_RANGES]
    # no lambda here: two plans with one are never taken for the same, and the shuffle would not be shared
    labels = F.when(F.col(day).isNull(), F.array(each[-1])).otherwise(F.array(*each))
    return daily.select("measure_name", group, F.inline(labels), "value", "n")


def values_at_ranks(ranged: DataFrame, keys: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column per rank) from (_range, keys, value, n): the least value whose cumulative count reaches the rank.

    ranks are expressions over the column total, the number of values of a
    group; _range never falls as the value grows. No task ever holds a whole
    group: running sums are taken within each range, the sizes of the ranges
    before it are added from one total per group and range. Rows of one value
    may come in parts: they are shuffled once, to their range, and summed there.
    """
    placed = ranged.select("_range", *keys, "value", "n").repartition("_range", *keys)
    summed = placed.groupBy("_range", *keys, "value").agg(F.sum("n").alias("n"))
    in_range = Window.partitionBy("_range", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = summed.withColumn("_run", F.sum("n").over(in_range))
    totals = summed.groupBy("_range", *keys).agg(F.sum("n").alias("_here"))  # over the sums, so that both read one shuffle
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        F.col("_range").alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_here").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_here").over(whole).alias("total"),
    )
    on = F.col("_range").eqNullSafe(F.col("_p"))  # plain equality would push a filter below one use of the shuffle and not the other
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    reached = running.join(offsets, on).withColumn("_cum", F.col("_run") + F.col("_before"))
    return reached.groupBy(*keys).agg(
        F.max("total").alias("n"),
        *[F.min(F.when(F.col("_cum") >= rank, F.col("value"))).alias(name) for name, rank in ranks.items()],
    )


def percentiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[tuple[str, float]], bits: int = BITS) -> DataFrame:
    """(measure_name, keys, n, one column per probability) from the counts of quantised values.

    A percentile q is the least value whose cumulative count reaches ceil(q*n).
    Ranges have fixed bounds in bins, so no sort by sampled bounds is needed, and
    counts not yet added up may be given. An empty input gives no rows; a
    group of nulls only is absent.
    """
    names = ["measure_name", *keys]
    fractional = _is_fractional(counts, "value")
    ranged = counts.withColumn("_range", value_range(F.col("value"), bits, fractional))
    return values_at_ranks(ranged, names, {name: F.ceil(F.lit(q) * F.col("total")) for name, q in probs})


def exact_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, median): the middle value, or the mean of the two middle ones. Null values do not count.

    The values are not quantised, so ranges come from a sort by sampled bounds;
    the table is written so that the bounds are drawn once.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stash(counts.repartitionByRange(*keys, "value").withColumn("_range", F.spark_partition_id()), "value-counts")
    half = (F.col("total") + 1) / 2
    return values_at_ranks(ranged, keys, {"_low": F.floor(half), "_high": F.ceil(half)}).select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"))
