"""Set comparison of two extractions, dashboards, review queue and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, amount, collapse, fixed, money, side, signed
from .scan import scan

FIELDS = ("description", "category", "vendor", "confidence")


def _keyed(t: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The last row of each comparison key: date, side, cents, and the description collapsed and cut to 60 characters."""
    key = [*[F.col(c) for c in by], F.col("tx_date").alias("k_date"), side().alias("k_side"), money(amount()).alias("k_amount"), F.substring(F.trim(collapse("description")), 1, 60).alias("k_desc")]
    names = [*by, "k_date", "k_side", "k_amount", "k_desc"]
    rows = t.select(*key, F.struct("tx_index", *FIELDS).alias("row"))
    return rows.groupBy(*names).agg(F.max_by("row", F.col("row.tx_index")).alias("row"))


def diff_rows(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """One row per key: status only_a, only_b, common or changed, and the changed fields as a map of field to (a, b)."""
    names = [*by, "k_date", "k_side", "k_amount", "k_desc"]
    x, y = _keyed(a, by).alias("x"), _keyed(b, by).alias("y")
    same = all_of([F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in names])
    j = x.join(y, same, "full_outer")
    both = F.col("x.row").isNotNull() & F.col("y.row").isNotNull()
    fields = [
        F.when(~F.col(f"x.row.{f}").eqNullSafe(F.col(f"y.row.{f}")), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"x.row.{f}").cast("string").alias("a"), F.col(f"y.row.{f}").cast("string").alias("b")).alias("value")))
        for f in FIELDS
    ]
    changed = F.when(both, F.map_from_entries(F.array_compact(F.array(*fields))))
    j = j.select(*[F.coalesce(f"x.{n}", f"y.{n}").alias(n) for n in names], F.col("x.row").isNotNull().alias("in_a"), F.col("y.row").isNotNull().alias("in_b"), changed.alias("fields"))
    status = F.when(~F.col("in_b"), "only_a").when(~F.col("in_a"), "only_b").when(F.size("fields") > 0, "changed").otherwise("common")
    return j.withColumn("status", status).drop("in_a", "in_b")


#: Buckets of rows whose digests are compared; their numbers are broadcast.
DIGESTS = 65_536


def _bucket(by: tuple[str, ...], buckets: int) -> Column:
    key = [*[F.col(c) for c in by], F.col("tx_date"), side(), money(amount()), F.substring(F.trim(collapse("description")), 1, 60)]
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _digests(t: DataFrame, by: tuple[str, ...], buckets: int) -> DataFrame:
    """bucket and what its rows add up to in any order: their number, a sum and an exclusive or of two hashes of a row."""
    row = [*by, "tx_date", "deposit", "withdrawal", "tx_index", *FIELDS]
    d = t.select(_bucket(by, buckets).alias("bucket"), F.xxhash64(*row).alias("_x"), F.xxhash64(F.lit(1), *row).alias("_y"))
    return d.groupBy("bucket").agg(F.struct(F.count("*"), F.sum(F.col("_x").cast("decimal(20,0)")), F.bit_xor("_y")).alias("digest"))


def diff_changes(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("statement_id",), buckets: int = DIGESTS) -> DataFrame:
    """The rows of diff_rows that are not common, for two large extractions that differ in little.

    Both sides are read once for digests of key buckets, which is a row a bucket and task to send; then only rows of buckets whose
    digests differ are sent and joined. A row whose place (tx_index) has moved counts as different in the digest, so its bucket is
    compared row by row.
    """
    x, y = _digests(a, by, buckets), _digests(b, by, buckets).withColumnRenamed("digest", "other")
    differ = x.join(y, "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select(F.col("bucket").alias("_bucket"))
    # buckets numbers at most
    part = lambda t: t.join(F.broadcast(differ), _bucket(by, buckets) == F.col("_bucket"), "left_semi")
    return diff_rows(part(a), part(b), by).where("status <> 'common'")


def diff_counts(d: DataFrame) -> DataFrame:
    """only_a, only_b, common (changed rows included) and changed."""
    return d.agg(
        F.count_if(F.col("status") == "only_a").alias("only_a"), F.count_if(F.col("status") == "only_b").alias("only_b"),
        F.count_if(F.col("status").isin("common", "changed")).alias("common"), F.count_if(F.col("status") == "changed").alias("changed"),
    )


def diff_samples(d: DataFrame, k: int = 50) -> DataFrame:
    """At most k rows of each status, by key."""
    w = Window.partitionBy("status").orderBy(*[c for c in d.columns if c not in ("status", "fields")])
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


SUMMARY = ("beginning_balance", "ending_balance", "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count")


def diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """statement_id, field, a, b, delta of the summary fields that differ; delta is null where a is."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("decimal(18,2)").alias("a"), F.col(f"y.{f}").cast("decimal(18,2)").alias("b")) for f in SUMMARY])
    j = a.alias("x").join(b.alias("y"), F.col("x.statement_id") == F.col("y.statement_id")).select(F.col("x.statement_id").alias("statement_id"), F.explode(pairs).alias("p"))
    j = j.select("statement_id", "p.field", "p.a", "p.b").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.withColumn("delta", F.when(F.col("a").isNotNull(), F.coalesce("b", F.lit(0)) - F.col("a")))


def cash_flow_by_period(s: DataFrame, t: DataFrame) -> DataFrame:
    """statement_id, label (yyyy-mm), inflow, outflow, net; empty unless there are two statements or more."""
    zero = F.lit(0).cast("decimal(18,2)")
    g = t.groupBy("statement_id").agg(F.sum("deposit").alias("i"), F.sum("withdrawal").alias("o"))
    d = s.join(g, "statement_id", "left").select("statement_id", F.date_format("period_start", "yyyy-MM").alias("label"), F.coalesce("i", zero).alias("inflow"), F.coalesce("o", zero).alias("outflow"))
    enough = s.limit(2).agg((F.count("*") >= 2).alias("_enough"))  # one row
    return d.withColumn("net", F.col("inflow") - F.col("outflow")).join(F.broadcast(enough), F.col("_enough")).drop("_enough")


def top_vendors(t: DataFrame, k: int = 5, vendor: Column | None = None) -> DataFrame:
    v = F.trim(F.col("vendor") if vendor is None else vendor)
    d = t.where(F.col("withdrawal").isNotNull()).select(v.alias("vendor"), "withdrawal").where("vendor <> ''")
    return d.groupBy("vendor").agg(F.sum("withdrawal").alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "vendor").limit(k)


def category_totals(t: DataFrame, k: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Top k categories by amount, overall or per group, with their percentage of what is kept."""
    c = t.groupBy(*by, F.coalesce("category", F.lit("OTHER")).alias("category")).agg(F.sum(amount()).alias("total"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    c = c.withColumn("_n", F.row_number().over(w.orderBy(F.desc("total"), "category"))).where(F.col("_n") <= k).drop("_n")
    return c.withColumn("percent", F.when(F.sum("total").over(w) != 0, 100 * F.col("total") / F.sum("total").over(w)))


def biggest_transactions(t: DataFrame, k: int = 8) -> DataFrame:
    d = t.select("statement_id", "tx_index", "tx_date", F.substring("description", 1, 60).alias("description"), side().alias("side"), amount().alias("amount"))
    return d.orderBy(F.desc("amount"), "statement_id", "tx_index").limit(k)


def running_balance(s: DataFrame, t: DataFrame) -> DataFrame:
    """statement_id, point (0: opening), at, tx_index, balance, in date order. A statement of any length takes all tasks."""
    zero = F.lit(0).cast("decimal(18,2)")
    move = F.coalesce("deposit", zero) - F.coalesce("withdrawal", zero)
    d = scan(t.select("statement_id", "tx_date", "tx_index", move.alias("_move")), ("statement_id",), ("tx_date", "tx_index"), {"_sum": F.col("_move")}, number="point")
    d = d.join(s.select("statement_id", "beginning_balance"), "statement_id")
    d = d.select("statement_id", "point", F.col("tx_date").alias("at"), "tx_index", (F.col("beginning_balance") + F.col("_sum")).cast("decimal(18,2)").alias("balance"))
    first = s.select("statement_id", F.lit(0).cast("long").alias("point"), F.col("period_start").alias("at"), F.lit(None).cast("int").alias("tx_index"), F.col("beginning_balance").cast("decimal(18,2)").alias("balance"))
    return first.unionByName(d)


def balance_markers(series: DataFrame, anomalies: DataFrame, t: DataFrame) -> DataFrame:
    """Anomalies with a row, on the first point of the row's date; messages cut to 200 characters."""
    day = series.where("point > 0").groupBy("statement_id", F.col("at").alias("tx_date")).agg(F.min("point").alias("point"))
    a = anomalies.where(F.col("transaction_index").isNotNull()).select("statement_id", F.col("transaction_index").alias("tx_index"), "kind", "severity", F.substring("message", 1, 200).alias("message"))
    return a.join(t.select("statement_id", "tx_index", "tx_date"), ["statement_id", "tx_index"]).join(day, ["statement_id", "tx_date"])


def filter_view(t: DataFrame, side_is: str | None = None, category: str | None = None, min_confidence: float | None = None, search: str | None = None, null_confidence: float = 1.0) -> DataFrame:
    tests = []
    if side_is:
        tests.append(side() == side_is)
    if category:
        tests.append(F.col("category") == category)
    if min_confidence is not None:
        tests.append(F.coalesce("confidence", F.lit(null_confidence)) >= min_confidence)
    if search:
        tests.append(F.lower("description").contains(search.lower()))
    return t.where(all_of(tests)) if tests else t


def distinct_categories(t: DataFrame) -> DataFrame:
    return t.where(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


def statement_key() -> Column:
    return F.concat_ws("_", F.col("period_start").cast("string"), F.coalesce("account_last4", F.lit("none")))


def review_queue(s: DataFrame, t: DataFrame, anomalies: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows to look at: low confidence, and warnings or errors that point at a row. One row may be listed more than once."""
    rows = t.join(s.select("statement_id", statement_key().alias("statement_key")), "statement_id").select("statement_id", "statement_key", "tx_index", "tx_date", "description", amount().alias("amount"), side().alias("side"), "confidence")
    low = rows.where(F.col("confidence") < threshold).withColumn("reason", F.concat(F.lit("confidence "), fixed(F.col("confidence"))))
    a = anomalies.where(F.col("severity").isin("warn", "error")).select("statement_id", F.col("transaction_index").alias("tx_index"), F.concat_ws(": ", "kind", "message").alias("reason"))
    return low.unionByName(rows.join(a, ["statement_id", "tx_index"]))


def anomalies_by_kind(a: DataFrame) -> DataFrame:
    return a.groupBy("statement_id", "kind").agg(F.count("*").alias("n"), F.min_by("severity", "ordinal").alias("severity"))


def anomaly_context(a: DataFrame, t: DataFrame, before: int = 3, after: int = 3, most: int = 10) -> DataFrame:
    """The rows around each anomaly's row (its first row where it has none): an equi join on statement and row, not a range scan."""
    near = F.coalesce("transaction_index", F.lit(0))
    start = F.greatest(near - before, F.lit(0))  # rows count from 0, and so does the cap
    at = a.select("statement_id", "ordinal", near.alias("center"), F.posexplode(F.sequence(start, near + after)).alias("place", "tx_index")).where(F.col("place") < most)
    return at.drop("place").join(t, ["statement_id", "tx_index"])


def report_cover(s: DataFrame, r: DataFrame, t: DataFrame, a: DataFrame) -> DataFrame:
    n_t = t.groupBy("statement_id").agg(F.count("*").alias("transactions"))
    n_a = a.groupBy("statement_id").agg(F.count("*").alias("anomalies"))
    d = s.join(r.select("statement_id", "ok"), "statement_id", "left").join(n_t, "statement_id", "left").join(n_a, "statement_id", "left")
    zero = F.lit(0).cast("long")
    return d.select("statement_id", "account_last4", "period_start", "period_end", F.coalesce("currency", F.lit("USD")).alias("currency"), "ok", F.coalesce("transactions", zero).alias("transactions"), F.coalesce("anomalies", zero).alias("anomalies"))


def cover_totals(cover: DataFrame) -> DataFrame:
    return cover.agg(F.count("*").alias("statements"), F.count_if("ok").alias("reconciled"), F.sum("transactions").alias("transactions"), F.sum("anomalies").alias("anomalies"))


def cover_continuity(s: DataFrame, report: str = "report_id") -> DataFrame:
    """Each statement against the one before it in its report, whatever its account; a report of any length takes all tasks."""
    s = scan(s.select(report, "statement_id", "doc_pos", "beginning_balance", "ending_balance"), (report,), ("doc_pos",), lags={"_before": F.col("ending_balance")})
    gap = money(F.col("beginning_balance") - F.col("_before"))
    return s.select(report, "statement_id", gap.alias("gap")).withColumn("status", F.when(F.col("gap") == 0, "OK").when(F.col("gap").isNotNull(), F.concat(F.lit("DRIFT $"), fixed(F.col("gap")))))


def report_summary(s: DataFrame, r: DataFrame) -> DataFrame:
    """A row per statement and a TOTAL row."""
    zero = F.lit(0)
    d = s.join(r.select("statement_id", "ok", "issues", "deposits_count_actual", "withdrawals_count_actual"), "statement_id").select(
        "statement_id", "account_last4", "period_start", "period_end", "beginning_balance", "ending_balance", "deposits_total", "withdrawals_total",
        F.coalesce("deposits_count", zero).alias("deposits_count"), F.coalesce("withdrawals_count", zero).alias("withdrawals_count"),
        F.when(F.col("ok"), "OK").otherwise("MISMATCH").alias("status"), F.substring(F.array_join("issues", "; "), 1, 200).alias("issues"),
    )
    total = d.agg(*[F.sum(c).alias(c) for c in ("deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count")]).withColumn("statement_id", F.lit("TOTAL"))
    return d.unionByName(total, allowMissingColumns=True)


def report_transactions(s: DataFrame, t: DataFrame) -> DataFrame:
    return t.join(s.select("statement_id", "account_last4"), "statement_id").select("statement_id", "account_last4", "tx_index", "tx_date", "description", "deposit", "withdrawal", signed().alias("amount"), "category", "vendor", "confidence")


def report_categories(t: DataFrame) -> DataFrame:
    """Count and signed sum per category, by name; a table without categories has one row (none)."""
    c = t.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"), F.sum(signed()).alias("total"))
    none = t.agg(F.count("category").alias("k")).where("k = 0").select(F.lit("(none)").alias("category"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(c.schema["total"].dataType).alias("total"))
    return c.unionByName(none).orderBy("category")


def report_anomalies(s: DataFrame, a: DataFrame) -> DataFrame:
    return a.join(s.select("statement_id", "account_last4"), "statement_id").select("statement_id", "account_last4", "kind", "severity", "transaction_index", "message")


def report_reconciliation(s: DataFrame, r: DataFrame) -> DataFrame:
    return s.select("statement_id", "account_last4", "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count").join(r, "statement_id").withColumn("status", F.when(F.col("ok"), "OK").otherwise("MISMATCH")).drop("issues", "ok")


def extraction_totals(s: DataFrame, r: DataFrame, t: DataFrame) -> DataFrame:
    n = t.groupBy("statement_id").agg(F.count("*").alias("_n"))
    d = s.join(r.select("statement_id", "ok"), "statement_id", "left").join(n, "statement_id", "left")
    return d.agg(F.count("*").alias("statements"), F.count_if("ok").alias("reconciled"), F.coalesce(F.sum("_n"), F.lit(0)).alias("transactions"))


def event_counts(a: DataFrame) -> DataFrame:
    """Number of anomalies per statement, and by kind as a map."""
    k = a.groupBy("statement_id", "kind").agg(F.count("*").alias("n"))
    return k.groupBy("statement_id").agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
