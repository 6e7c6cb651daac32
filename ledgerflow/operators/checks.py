"""Ledger checks over statements (S) and transactions (T), grouped by statement_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, amount, fixed, money, side
from .quantile import exact_quantile

ANOMALY = ("statement_id", "rule", "kind", "severity", "message", "transaction_index", "related_index")


def anomaly(df: DataFrame, rule: str, kind: str, severity: str, message: Column, index: Column | None = None, related: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select(
        "statement_id",
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        (none if index is None else index.cast("int")).alias("transaction_index"),
        (none if related is None else related.cast("int")).alias("related_index"),
    )


def reconcile(s: DataFrame, t: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Declared against observed sums and counts, one row per statement of s; statements without rows count as zero.

    An issue needs a difference beyond the tolerance after rounding to cents; a missing declared count is no difference.
    """
    return reconcile_totals(s, statement_totals(t), tolerance)


def statement_totals(t: DataFrame, sign: Column | None = None) -> DataFrame:
    """statement_id, dep, wd, n_dep, n_wd: sums and counts; with a sign, a row of -1 takes back an equal row of 1."""
    value = lambda c: F.col(c) if sign is None else (F.col(c) * sign).cast(MONEY)
    count = lambda c: F.count(c) if sign is None else F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0).cast("long"))
    total = lambda c, n: (F.sum(value(c)).alias(n), count(c).alias("n_" + n))
    return t.groupBy("statement_id").agg(*total("deposit", "dep"), *total("withdrawal", "wd"))


def reconcile_totals(s: DataFrame, seen: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """reconcile over the sums and counts of each statement, as statement_totals gives them."""
    zero = F.lit(0).cast(MONEY)
    r = s.join(seen, "statement_id", "left").select(
        "statement_id",
        F.coalesce("dep", zero).alias("deposits_sum"),
        F.coalesce("wd", zero).alias("withdrawals_sum"),
        F.coalesce("n_dep", F.lit(0)).alias("deposits_count_actual"),
        F.coalesce("n_wd", F.lit(0)).alias("withdrawals_count_actual"),
        "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count", "beginning_balance", "ending_balance",
    )
    r = r.withColumns(
        {
            "deposits_total_delta": money(F.col("deposits_total") - F.col("deposits_sum")),
            "withdrawals_total_delta": money(F.col("withdrawals_total") - F.col("withdrawals_sum")),
            "deposits_count_delta": F.coalesce(F.col("deposits_count") - F.col("deposits_count_actual"), F.lit(0)),
            "withdrawals_count_delta": F.coalesce(F.col("withdrawals_count") - F.col("withdrawals_count_actual"), F.lit(0)),
            "balance_equation_delta": money(F.col("ending_balance") - (F.col("beginning_balance") + F.col("deposits_total") - F.col("withdrawals_total"))),
        }
    )
    far = lambda c: F.abs(F.col(c)) > F.lit(tolerance).cast("decimal(18,4)")
    say = lambda ok, text, c: F.when(ok, F.concat(F.lit(text), fixed(F.col(c), "%+.2f")))
    count = lambda c, text: F.when(F.col(c) != 0, F.format_string(text + "%+d", F.col(c)))
    issues = F.array_compact(
        F.array(
            say(far("deposits_total_delta"), "deposits differ from the declared total by ", "deposits_total_delta"),
            say(far("withdrawals_total_delta"), "withdrawals differ from the declared total by ", "withdrawals_total_delta"),
            count("deposits_count_delta", "number of deposits differs by "),
            count("withdrawals_count_delta", "number of withdrawals differs by "),
            say(far("balance_equation_delta"), "balances do not add up: ", "balance_equation_delta"),
        )
    )
    r = r.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)
    return r.select("statement_id", "ok", "deposits_sum", "withdrawals_sum", "deposits_count_actual", "withdrawals_count_actual",
                    "deposits_total_delta", "withdrawals_total_delta", "deposits_count_delta", "withdrawals_count_delta", "balance_equation_delta", "issues")


def continuity_audit(s: DataFrame, tolerance: float = 0.01, max_gap_days: int = 5) -> DataFrame:
    """Neighbouring statements of an account whose balances do not meet; pairs further apart than max_gap_days are passed over."""
    w = Window.partitionBy("account_last4").orderBy("period_start", "doc_pos")
    before = F.lag(F.struct("statement_id", "period_end", "ending_balance")).over(w)
    d = s.select("statement_id", "account_last4", "period_start", "beginning_balance", before.alias("p")).where(F.col("p").isNotNull())
    d = d.where(F.datediff("period_start", "p.period_end") <= max_gap_days)
    d = d.withColumn("delta", money(F.col("beginning_balance") - F.col("p.ending_balance"))).where(F.abs("delta") > F.lit(tolerance).cast("decimal(18,4)"))
    return d.select("account_last4", F.col("p.statement_id").alias("prev_statement_id"), F.col("statement_id").alias("next_statement_id"),
                    F.col("p.ending_balance").alias("expected_beginning"), F.col("beginning_balance").alias("actual_beginning"), "delta")


def attach_continuity(s: DataFrame, issues: DataFrame) -> DataFrame:
    """An error for every statement of an account with an issue; a null account is an account of its own."""
    i = issues.withColumnRenamed("account_last4", "i_account")
    d = s.join(i, F.col("account_last4").eqNullSafe(F.col("i_account")))
    text = F.concat(F.lit("balance drift of "), fixed(F.col("delta"), "%+.2f"), F.lit(" between "), F.col("prev_statement_id"), F.lit(" and "), F.col("next_statement_id"))
    return anomaly(d, "continuity", "running_balance_drift", "error", text)


def date_out_of_period(s: DataFrame, t: DataFrame) -> DataFrame:
    d = t.join(s.select("statement_id", "period_start", "period_end"), "statement_id")
    d = d.where((F.col("tx_date") < F.col("period_start")) | (F.col("tx_date") > F.col("period_end")))
    return anomaly(d, "date_out_of_period", "date_out_of_period", "warn", F.concat(F.lit("dated "), F.col("tx_date").cast("string")), F.col("tx_index"))


def duplicate_pairs(t: DataFrame, scale: int = 2) -> DataFrame:
    """All but the first of rows with one date, side and amount; rows without an amount are left out."""
    d = t.where(F.col("deposit").isNotNull() | F.col("withdrawal").isNotNull())
    w = Window.partitionBy("statement_id", "tx_date", side(), F.round(amount(), scale)).orderBy("tx_index")
    d = d.withColumns({"_n": F.row_number().over(w), "_first": F.first("tx_index").over(w)}).where("_n > 1")
    return anomaly(d, "duplicate", "duplicate", "warn", F.concat(F.lit("same as row "), F.col("_first").cast("string")), F.col("tx_index"), F.col("_first"))


def size_outliers(t: DataFrame, factor: float = 20, floor: float = 50_000) -> DataFrame:
    """Amounts above factor times the statement's median of positive amounts and above the floor."""
    d = t.withColumn("_a", amount())
    m = exact_quantile(d.where("_a > 0"), ("statement_id",), F.col("_a"), name="_m")
    d = d.join(m, "statement_id").where((F.col("_a").cast("double") > factor * F.col("_m")) & (F.col("_a") > floor))
    return anomaly(d, "size_outlier", "size_outlier", "warn", F.concat(fixed(F.col("_a")), F.lit(" against a median of "), fixed(F.col("_m"))), F.col("tx_index"))


def low_confidence(t: DataFrame, threshold: float = 0.5) -> DataFrame:
    return anomaly(t.where(F.col("confidence") < threshold), "low_confidence", "low_confidence", "warn", fixed(F.col("confidence")), F.col("tx_index"))


def detect_anomalies(s: DataFrame, t: DataFrame) -> DataFrame:
    """The four row rules in order, numbered per statement."""
    parts = (date_out_of_period(s, t), duplicate_pairs(t), size_outliers(t), low_confidence(t))
    return numbered(parts)


def numbered(parts) -> DataFrame:
    """Union of anomaly tables with ordinal, the place in the statement's list."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("statement_id").orderBy("_part", "transaction_index", "related_index", "message")
    return out.withColumn("ordinal", F.row_number().over(w) - 1).drop("_part")


def repair_score() -> Column:
    total = F.abs("deposits_total_delta") + F.abs("withdrawals_total_delta") + F.abs("balance_equation_delta")
    return total + 100 * F.abs("deposits_count_delta") + 100 * F.abs("withdrawals_count_delta")


def select_best_attempt(attempts: DataFrame, max_attempts: int = 2, eps: float = 0.001) -> DataFrame:
    """The attempt that a repair loop ends with: attempts (statement_id, attempt from 0, ok, score), 0 being the first extraction.

    The loop stops after an ok attempt, one that is not better by eps, or one that leaves over half of the error before it.
    """
    w = Window.partitionBy("statement_id").orderBy("attempt")
    before = F.min("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = attempts.where(F.col("attempt") <= max_attempts).withColumn("_best", before)
    stop = F.col("ok") | F.coalesce((F.col("score") >= F.col("_best") - eps) | (F.col("score") > 0.5 * F.col("_best")), F.lit(False))
    a = a.withColumn("_stops", F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    a = a.where(F.coalesce(F.col("_stops"), F.lit(0)) == 0)
    best = F.min_by(F.struct("attempt", "ok", "score"), F.struct("score", "attempt"))
    return a.groupBy("statement_id").agg(best.alias("b"), F.count("*").alias("tried")).select("statement_id", "b.attempt", "b.ok", "b.score", "tried")


def delta_candidates(r: DataFrame, t: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows that explain a failing statement: missing raw rows or spurious rows of the delta's amount, rows of half of it on the wrong side."""
    gaps = r.where(~F.col("ok")).select(
        "statement_id", F.explode(F.array(F.struct(F.lit("D").alias("side"), F.col("deposits_total_delta").alias("delta")), F.struct(F.lit("W").alias("side"), F.col("withdrawals_total_delta").alias("delta")))).alias("g")
    )
    gaps = gaps.select("statement_id", "g.side", "g.delta").where("delta <> 0")
    rows = t.select("statement_id", "tx_index", side().alias("tx_side"), money(amount()).alias("value"))
    lost = raw.select("statement_id", F.col("row_pos").alias("tx_index"), money("value").alias("value"))
    missing = gaps.where("delta > 0").join(lost, "statement_id").where("value = delta").select("statement_id", F.lit("missing").alias("why"), "side", "tx_index", "value")
    extra = gaps.where("delta < 0").join(rows, "statement_id").where("tx_side = side AND value = -delta").select("statement_id", F.lit("spurious").alias("why"), "side", "tx_index", "value")
    wrong = gaps.where("delta > 0").join(rows, "statement_id").where("tx_side <> side AND 2 * value = delta").select("statement_id", F.lit("wrong_side").alias("why"), "side", "tx_index", "value")
    return missing.unionByName(extra).unionByName(wrong)


# Names of what a repair can teach; their hash identifies a lesson.
LESSONS = (
    ("side_flip_dep_vs_with", "Rows on the wrong side: check deposits against withdrawals by column."),
    ("missed_checks_paid", "A row of the paid checks was missed: each is a withdrawal."),
    ("missed_remote_deposit", "Remote deposits that look alike are separate rows."),
    ("hallucinated_balance_marker", "A balance marker was taken for a transaction."),
)


def diagnose_repair(before: DataFrame, after: DataFrame, t0: DataFrame, t1: DataFrame) -> DataFrame:
    """statement_id, pattern_hash (first 12 hex digits of the name's SHA-256), pattern, hint for statements that a repair has made ok."""
    names = lambda t, c: t.groupBy("statement_id").agg(F.collect_set("description").alias(c))
    b = before.where(~F.col("ok")).select("statement_id", F.col("deposits_total_delta").alias("d"), F.col("withdrawals_total_delta").alias("w"))
    d = b.join(after.where("ok").select("statement_id"), "statement_id").join(names(t0, "n0"), "statement_id", "left").join(names(t1, "n1"), "statement_id", "left")
    none = F.array().cast("array<string>")
    new, gone = F.array_except(F.coalesce("n1", none), F.coalesce("n0", none)), F.array_except(F.coalesce("n0", none), F.coalesce("n1", none))
    has = lambda a, *words: F.exists(a, lambda x: F.lit(False) if not words else any_word(x, words))
    tests = ((F.abs(F.col("d") + F.col("w")) < 0.02) & (F.abs("d") > 1), has(new, "CHECK #"), has(new, "REMOTE DEPOSIT"), has(gone, "BEGINNING BALANCE", "ENDING BALANCE"))
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(p).alias("pattern"), F.lit(h).alias("hint"))) for t, (p, h) in zip(tests, LESSONS, strict=True)]))
    d = d.select("statement_id", F.explode(found).alias("l"))
    return d.select("statement_id", F.substring(F.sha2("l.pattern", 256), 1, 12).alias("pattern_hash"), "l.pattern", "l.hint")


def any_word(x: Column, words) -> Column:
    out = x.contains(words[0])
    for w in words[1:]:
        out = out | x.contains(w)
    return out


def golden_check(s: DataFrame, t: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected row (label 'Mon yyyy', account_last4, n_deposits, deposits_total, n_withdrawals) with its mismatches; a row without a statement has ['missing']."""
    seen = t.groupBy("statement_id").agg(F.count("deposit").alias("nd"), F.sum("deposit").alias("sd"), F.count("withdrawal").alias("nw"))
    have = s.join(seen, "statement_id", "left").select(F.date_format("period_start", "MMM yyyy").alias("label"), "account_last4", "statement_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nd", "sd", "nw")])
    d = expected.join(have, ["label", "account_last4"], "left")
    differs = F.array_compact(
        F.array(
            F.when(F.col("n_deposits") != F.col("nd"), "n_deposits"),
            F.when(F.abs(F.col("deposits_total") - F.col("sd")) > 0.01, "deposits_total"),
            F.when(F.col("n_withdrawals") != F.col("nw"), "n_withdrawals"),
        )
    )
    return d.withColumn("mismatches", F.when(F.col("statement_id").isNull(), F.array(F.lit("missing"))).otherwise(differs)).drop("nd", "sd", "nw")


