"""Running sums, row numbers and lags of groups of any length: a prefix scan over range partitions.

Rows are cut into runs of (group, order). Each run is scanned by itself; of a group that a run's edge cuts, the runs before give a
count, sums and a last row, which are scanned in turn and added to the rows of the next run. One huge group so takes all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

_PART, _N = "_scan_part", "_scan_n"


def scan(
    df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None,
    number: str | None = None, parts: int | None = None, path: str | None = None,
) -> DataFrame:
    """df with columns added: running sums (the row included), values of the row before, and the row's number from 1.

    by and order name columns; a null is a value of its own in by and comes first in order. Rows that are equal in all of order stand
    in any order. As in SQL, nulls add nothing to a sum, and a sum of nothing is null; the first row of a group has no row before it.
    parts: how many runs, the session's shuffle partitions if not given. path: where the runs are stored, if the caller deletes them.
    """
    sums, lags = sums or {}, lags or {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.select("*", *[c.alias(f"_scan_s{i}") for i, c in enumerate(sums.values())], *[c.alias(f"_scan_l{i}") for i, c in enumerate(lags.values())])
    # Stored, so that both passes below see the same runs.
    held = stored(held.repartitionByRange(n, *by, *order).withColumn(_PART, F.spark_partition_id()), path)
    at, kinds = [F.col(c) for c in order], dict(held.dtypes)
    totals = [F.sum(f"_scan_s{i}").alias(f"_scan_t{i}") for i in range(len(sums))]
    if lags:
        totals.append(F.max_by(F.struct(*[f"_scan_l{i}" for i in range(len(lags))]), F.struct(*at)).alias("_scan_last"))
    before = Window.partitionBy(*by).orderBy(_PART)
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    group = held.groupBy(*by, _PART).agg(F.count("*").alias(_N), *totals)
    carried = [F.sum(_N).over(upto).alias("_scan_c"), *[F.sum(f"_scan_t{i}").over(upto).alias(f"_scan_c{i}") for i in range(len(sums))], *([F.lag("_scan_last").over(before).alias("_scan_before")] if lags else [])]
    names = [f"_scan_b{i}" for i in range(len(by))]
    # A run's first group is the only one that can have begun in the runs before: n rows at most.
    edges = group.select(*[F.col(c).alias(a) for c, a in zip(by, names, strict=True)], F.col(_PART).alias("_scan_p"), *carried).where(F.col("_scan_c").isNotNull())
    same = F.col(_PART) == F.col("_scan_p")
    for c, a in zip(by, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(a))
    d = held.join(F.broadcast(edges), same, "left")
    w = Window.partitionBy(*by, _PART).orderBy(*at)
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(_N, F.row_number().over(w))
    out = {}
    for i, name in enumerate(sums):
        own = F.sum(f"_scan_s{i}").over(inside)
        zero = F.lit(0).cast(kinds[f"_scan_s{i}"])
        out[name] = F.when(own.isNotNull() | F.col(f"_scan_c{i}").isNotNull(), F.coalesce(own, zero) + F.coalesce(f"_scan_c{i}", zero))
    for i, name in enumerate(lags):
        out[name] = F.when(F.col(_N) == 1, F.col(f"_scan_before._scan_l{i}")).otherwise(F.lag(f"_scan_l{i}").over(w))
    if number:
        out[number] = (F.col(_N) + F.coalesce("_scan_c", F.lit(0))).cast("long")
    return d.select(*df.columns, *[c.alias(k) for k, c in out.items()])
