"""Operational tables: cache, audit log, reviews, lessons, call telemetry. All are set operations over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from .scan import scan

CACHE_DAYS, AUDIT_LIMIT = 30, 50


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key; of rows that tie, the one with the largest hash (maps left out), so that it is the same in each run."""
    row = F.struct(*df.columns)
    order = (*order, F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def content_hash_dedup(docs: DataFrame, known: DataFrame | None = None, content: str = "content", method: str = "method", order: str = "seq") -> DataFrame:
    """The last row of each (SHA-256 of the content, method); hashes in known are left out."""
    d = keep_last(docs.withColumn("sha256", F.sha2(content, 256)), ["sha256", method], F.col(order))
    return d if known is None else d.join(known.select("sha256", method), ["sha256", method], "left_anti")


def incremental_segments(segments: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments to work on, cached rows of the others) by cache key."""
    return segments.join(cache.select("key"), "key", "left_anti"), cache.join(segments.select("key").distinct(), "key", "left_semi")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by key: a new row takes the place of the old one, whatever their times; of several new ones the last.

    Only reconciled rows are stored.
    """
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.where("reconciled").withColumn("_new", F.lit(1)))
    return keep_last(both, ["key"], F.col("_new"), F.col("created_at"), F.col("payload")).drop("_new")


def cache_keys(cache: DataFrame, limit: int = 200) -> DataFrame:
    return cache.select("key", "created_at").orderBy(F.desc("created_at"), "key").limit(limit)


def cache_delete(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(~F.col("key").eqNullSafe(F.lit(key)))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if("reconciled").alias("reconciled"))


def cache_expire(cache: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    return cache.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


class StatementCache:
    """The cache as a stored table (see KeyedTable): key, created_at, reconciled, payload. A change rewrites the buckets of its keys."""

    def __init__(self, spark, path: str, buckets: int = 1024):
        self.table = KeyedTable(spark, path, "key", buckets)

    def put(self, rows: DataFrame) -> int:
        """Store the reconciled rows, in place of older ones of their keys; of several new ones of a key the last."""
        return self.table.upsert(rows.where("reconciled"), ("created_at",))

    def get(self, keys: DataFrame) -> DataFrame:
        """The stored rows of keys (column key)."""
        return self.table.read().join(keys.select("key").distinct(), "key", "left_semi")

    def keys(self, limit: int = 200) -> DataFrame:
        return cache_keys(self.table.read(), limit)

    def stats(self) -> DataFrame:
        return cache_stats(self.table.read())

    def delete(self, key: str) -> int:
        return self.table.delete(self.table.spark.createDataFrame([(key,)], "key string"))

    def clear(self) -> int:
        return self.table.clear()

    def expire(self, now, days: int = CACHE_DAYS) -> int:
        """Take out rows that are older than days; rows without a time stay."""
        return self.table.delete_where(F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def audit_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_recent(df: DataFrame, limit: int = AUDIT_LIMIT) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    return df.orderBy(F.desc("id")).limit(limit)


def reviews_latest(reviews: DataFrame) -> DataFrame:
    return keep_last(reviews, ["statement_key", "tx_index"], F.col("id"))


def reviews_history(reviews: DataFrame, key: str, tx_index: int) -> DataFrame:
    return reviews.where((F.col("statement_key") == key) & (F.col("tx_index") == tx_index)).orderBy("id")


def lessons_record(lessons: DataFrame, new: DataFrame) -> DataFrame:
    """Insert the (pattern_hash, hint) pairs that are not there yet; of equal new ones the first."""
    first = new.groupBy("pattern_hash", "hint").agg(F.min_by(F.struct(*[c for c in new.columns if c not in ("pattern_hash", "hint")]), "created_at").alias("r")).select("pattern_hash", "hint", "r.*")
    return lessons.unionByName(first.join(lessons.select("pattern_hash", "hint"), ["pattern_hash", "hint"], "left_anti").select(*lessons.columns))


def lessons_top(lessons: DataFrame, k: int = 5) -> DataFrame:
    return lessons.orderBy(F.desc(F.col("helpful_count") - F.col("unhelpful_count")), F.desc("created_at"), "pattern_hash", "hint").limit(k)


def lessons_feedback(lessons: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add (hint, helpful) votes to the counters."""
    n = feedback.groupBy("hint").agg(F.count_if("helpful").alias("_up"), F.count_if(~F.col("helpful")).alias("_down"))
    d = lessons.join(n, "hint", "left")
    plus = lambda c, v: (F.col(c) + F.coalesce(v, F.lit(0))).alias(c)
    return d.select(*[plus(c, {"helpful_count": "_up", "unhelpful_count": "_down"}[c]) if c.endswith("_count") else F.col(c) for c in lessons.columns])


def lessons_stats(lessons: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return lessons.agg(F.count("*").alias("total"), F.coalesce(F.sum("helpful_count"), zero).alias("helpful"), F.coalesce(F.sum("unhelpful_count"), zero).alias("unhelpful"))


def call_cost(calls: DataFrame, prices: DataFrame, default_input: float = 3.0, default_output: float = 15.0, read_share: float = 0.10, write_share: float = 1.25) -> DataFrame:
    """cost_usd per call from prices (model, input_per_m, output_per_m); cached tokens are priced as shares of the input rate."""
    d = calls.join(prices, "model", "left")
    i, o = F.coalesce("input_per_m", F.lit(default_input)), F.coalesce("output_per_m", F.lit(default_output))
    tokens = F.col("input_tokens") * i + F.col("output_tokens") * o + F.col("cache_read_tokens") * i * read_share + F.col("cache_write_tokens") * i * write_share
    return d.withColumn("cost_usd", tokens / 1_000_000).drop("input_per_m", "output_per_m")


def telemetry_summary(calls: DataFrame) -> DataFrame:
    """Totals, per role and per backend in one pass by grouping sets: level says which of them a row is."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens") if c in calls.columns]
    g = calls.groupingSets([[], ["role"], ["backend"]], "role", "backend").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("calls"), *sums, F.round(F.sum("elapsed_s"), 2).alias("elapsed_s"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.count("error").alias("errors")
    )
    return g.withColumn("level", F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "role").otherwise("backend")).drop("_g")


def telemetry_errors(calls: DataFrame) -> DataFrame:
    """The calls that failed, with what they reported: the error list as rows, in the order of ts and call_id."""
    return calls.where(F.col("error").isNotNull() & (F.col("error") != "")).select("ts", "call_id", "role", "backend", "error")


def spend_guard(calls: DataFrame, cap: float | None, warn: float = 0.8, by: tuple[str, ...] = ("budget",), order: tuple[str, ...] = ("ts", "call_id")) -> DataFrame:
    """Running spend per budget: warns is true once, at the first call past the share; breach where the cap is exceeded; no cap, no limit.

    A budget of any number of calls takes all tasks. A null cost is none; nulls of order come first.
    """
    kind = calls.select(F.sum("cost_usd")).schema[0].dataType
    cost = F.col("cost_usd").cast(kind)
    known = F.col("cost_usd").isNotNull().cast("int")
    d = scan(calls, by, order, {"spent": cost, "_known": known})
    limit = F.lit(cap).cast("double")
    past = lambda c: F.coalesce(c >= limit * warn, F.lit(False))
    was = F.when(F.col("_known") > known, F.col("spent") - F.coalesce(cost, F.lit(0).cast(kind)))  # nothing before the first cost
    d = d.withColumn("warns", past(F.col("spent")) & ~past(was)).drop("_known")
    return d.withColumns({"breach": F.coalesce(F.col("spent") > limit, F.lit(False)), "remaining": F.greatest(F.lit(0.0), limit - F.col("spent"))})
