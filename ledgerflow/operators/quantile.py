"""Exact quantiles of groups of any size in bounded memory: by a histogram, the bin of the middle rank, then that bin's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each factor of e that values grow by: a bin's values lie within a thousandth of each other.
FINE = 1024


def bin_of(v: Column) -> Column:
    """A number of the value's bin that never falls where the value rises."""
    far = 1000 * FINE  # beyond the logarithm of every double
    step = lambda x: far + F.floor(F.ln(x) * FINE)
    return F.when(v > 0, step(v)).when(v < 0, -step(-v)).otherwise(0)


def exact_quantile(df: DataFrame, by: tuple[str, ...], value: Column, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """by and the quantile of value as a double, as percentile gives it (linear between ranks); nulls are left out, NaN is largest.

    Equal values are counted together before anything meets in a task. Then a task holds one row at a time: of a group's bins
    (about 1.5 million at most, whatever its rows), and of the distinct values of the one or two bins around the rank.
    """
    v = value.cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_bin", F.when(F.isnan("_v"), F.lit(2**40)).otherwise(bin_of(F.col("_v"))))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    place = F.lit(q) * (F.col("_all") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    names = [f"_b{i}" for i in range(len(by))]
    picked = bins.where(holds(low) | holds(high)).select(*[F.col(c).alias(a) for c, a in zip(by, names, strict=True)], F.col("_bin").alias("_pick"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    same = F.col("_bin") == F.col("_pick")
    for c, a in zip(by, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(a))
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.join(picked, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    part = place - low
    at = lambda rank: F.max(F.when(holds(rank), F.col("_v")))
    d = d.groupBy(*by, "_all").agg(at(low).alias("_low"), at(high).alias("_high"))
    return d.select(*by, F.when(low == high, F.col("_low")).otherwise(F.col("_low") * (1 - part) + F.col("_high") * part).alias(name))
