"""Forensic rules, one shuffle by statement each; by= regroups them, e.g. by account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import amount, fixed, weekend
from .checks import anomaly, numbered
from .quantile import exact_quantile

# US bank holidays of 2024 and 2025.
HOLIDAYS = (
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-10-13", "2025-11-11", "2025-11-27", "2025-12-25",
)


def benford_table(t: DataFrame, by: str = "statement_id", min_n: int = 50) -> DataFrame:
    """by, n, digit, share, drift for the digits 1 to 9 of groups with min_n usable amounts."""
    digit = F.regexp_extract(amount().cast("decimal(24,6)").cast("string"), "[1-9]", 0)
    counts = [F.count_if(digit == str(d)).alias(f"d{d}") for d in range(1, 10)]
    g = t.groupBy(by).agg(*counts, F.count_if(digit != "").alias("n")).where(F.col("n") >= min_n)
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("digit"), (F.col(f"d{d}") / F.col("n")).alias("share")) for d in range(1, 10)]))
    g = g.select(by, "n", rows.alias("x")).select(by, "n", "x.digit", "x.share")
    return g.withColumn("drift", F.abs(F.col("share") - F.log10(1 + 1 / F.col("digit"))))


def benford_drift(t: DataFrame, min_n: int = 50, drift: float = 0.05, by: str = "statement_id") -> DataFrame:
    """by, n, worst digit (the lowest on a tie) and its drift, where that is beyond the limit."""
    worst = F.max_by("digit", F.struct("drift", -F.col("digit")))
    g = benford_table(t, by, min_n).groupBy(by, "n").agg(worst.alias("digit"), F.max("drift").alias("drift"))
    return g.where(F.col("drift") > drift)


def vendor_concentration(t: DataFrame, share: float = 0.35, floor: float = 10_000) -> DataFrame:
    """statement_id, vendor, vendor_total, total: the top vendor of vendor-tagged withdrawals where it has too large a share."""
    v = t.where(F.col("withdrawal").isNotNull() & (F.trim("vendor") != ""))
    v = v.groupBy("statement_id", "vendor").agg(F.sum("withdrawal").alias("vendor_total"), F.min("tx_index").alias("_first"))
    top = F.max_by(F.struct("vendor", "vendor_total"), F.struct("vendor_total", -F.col("_first")))
    v = v.groupBy("statement_id").agg(top.alias("m"), F.sum("vendor_total").alias("total")).select("statement_id", "m.vendor", "m.vendor_total", "total")
    return v.where((F.col("total") > floor) & (F.col("vendor_total") > F.lit(share) * F.col("total")))


def velocity_burst(t: DataFrame, factor: float = 3, floor: int = 10) -> DataFrame:
    """statement_id, tx_date, n, first_index of days with more rows than both limits allow."""
    d = t.where(F.col("tx_date").isNotNull()).groupBy("statement_id", "tx_date").agg(F.count("*").alias("n"), F.min("tx_index").alias("first_index"))
    m = exact_quantile(d, ("statement_id",), F.col("n"), name="_m")
    d = d.join(m, "statement_id").where(F.col("n") > F.greatest(F.floor(F.col("_m") * factor), F.lit(floor)))
    return d.drop("_m")


def weekend_postings(t: DataFrame) -> DataFrame:
    return anomaly(t.where(weekend("tx_date")), "weekend", "weekend_posting", "info", F.date_format("tx_date", "EEEE"), F.col("tx_index"))


def holiday_table(spark, days=HOLIDAYS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("holiday"))


def holiday_postings(t: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Rows on a holiday that is no weekend day. The list has some dates a year; Spark broadcasts it by its size."""
    h = holiday_table(t.sparkSession) if holidays is None else holidays
    d = t.where(~weekend("tx_date")).join(h, F.col("tx_date") == F.col("holiday"), "left_semi")
    return anomaly(d, "holiday", "holiday_posting", "info", F.col("tx_date").cast("string"), F.col("tx_index"))


def round_number_share(t: DataFrame, min_amount: float = 1000, min_n: int = 20, share: float = 0.20) -> DataFrame:
    """statement_id, n, n_round where too many large withdrawals are whole hundreds."""
    w = F.col("withdrawal")
    even = (F.abs(w - F.round(w, 0)) < 0.01) & (F.floor(w) % 100 == 0)
    g = t.where(w >= min_amount).groupBy("statement_id").agg(F.count("*").alias("n"), F.count_if(even).alias("n_round"))
    return g.where((F.col("n") >= min_n) & (F.col("n_round") / F.col("n") > share))


def detect_forensic(t: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """All six rules as anomalies, numbered per statement."""
    b = anomaly(benford_drift(t), "benford", "forensic", "warn", F.format_string("digit %d off by %.3f of %d", "digit", "drift", "n"))
    v = anomaly(vendor_concentration(t), "vendor_concentration", "forensic", "warn", F.concat("vendor", F.lit(": "), fixed(F.col("vendor_total")), F.lit(" of "), fixed(F.col("total"))))
    d = anomaly(velocity_burst(t), "velocity", "forensic", "warn", F.format_string("%d rows on one day", "n"), F.col("first_index"))
    r = anomaly(round_number_share(t), "round_numbers", "forensic", "warn", F.format_string("%d of %d withdrawals are whole hundreds", "n_round", "n"))
    return numbered((b, v, d, weekend_postings(t), holiday_postings(t, holidays), r))


def recurring_groups(t: DataFrame, min_occurrences: int = 3, tolerance: float = 1.0, share: float = 0.05, by: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """Vendors that are paid, or pay, about the same amount at even gaps.

    by, vendor_key, side, n, avg_amount, cadence_days, cadence_label, occurrences (row numbers in order), next_predicted_date and place,
    the group's rank among those of by: more rows first, then the larger mean, then the one that is seen first. The cluster holds
    amounts within the larger of tolerance and share of the group's mean.
    """
    from ..functions.columns import cadence_label, side, vendor_key

    key = [*by, "vendor_key", "side"]
    d = t.where(F.col("deposit").isNotNull() | F.col("withdrawal").isNotNull())
    d = d.select(*by, vendor_key("description", "vendor").alias("vendor_key"), side().alias("side"), "tx_index", "tx_date", amount().alias("a")).where("vendor_key <> ''")
    g = Window.partitionBy(*key)
    d = d.withColumns({"_n": F.count("*").over(g), "_mean": F.avg("a").over(g), "_seen": F.min("tx_index").over(g)}).where(F.col("_n") >= min_occurrences)
    d = d.where(F.abs(F.col("a") - F.col("_mean")) <= F.greatest(F.lit(tolerance).cast("decimal(18,6)"), F.abs(F.col("_mean")) * F.lit(share).cast("decimal(6,4)")))
    d = d.withColumn("gap", F.datediff("tx_date", F.lag("tx_date").over(g.orderBy(F.col("tx_date").asc_nulls_first(), "tx_index"))))
    r = d.groupBy(*key).agg(
        F.count("*").alias("n"), F.count("tx_date").alias("dated"), F.avg("a").alias("_avg"), F.min("_seen").alias("_seen"),
        F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("tx_date").alias("last"), F.sort_array(F.collect_list("tx_index")).alias("occurrences"),
    )
    middle = exact_quantile(d, tuple(key), F.col("gap"), name="cadence_days").select(*[F.col(c).alias(f"_{c}") for c in key], "cadence_days")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    r = r.where((F.col("n") >= min_occurrences) & (F.col("dated") >= min_occurrences)).join(middle, same).where(F.col("cadence_days") >= 2)
    r = r.where((F.col("low") <= 0) | (F.col("high") / F.col("low") <= 4))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("_avg"), "_seen", "vendor_key", "side")
    return r.select(*key, "n", F.round("_avg", 2).alias("avg_amount"), "cadence_days", cadence_label("cadence_days").alias("cadence_label"), "occurrences",
                    F.date_add("last", F.bround("cadence_days").cast("int")).alias("next_predicted_date"), F.row_number().over(rank).alias("place"))
