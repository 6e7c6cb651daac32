"""URL filters by a temporal list join: dated list entries become validity intervals, captures meet the entries active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: Kinds of list entries, the most telling first: an exact URL, a host, a domain with all hosts below it.
KINDS = ("url", "host", "domain")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
REST = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where the URL has none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.+$", "")
    return F.when(host != "", host)


def key_of(url: Column) -> Column:
    """Host and path with query, without scheme, user, port and fragment; null where the URL has no host."""
    rest = F.regexp_extract(F.trim(url), "(?i)" + REST, 1)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Dated entries (kind, key, day, action) from CSV files with a header; lines that do not parse have nulls and are no entries."""
    return spark.read.schema("kind string, key string, day date, action string").option("header", True).option("enforceSchema", False).csv(path)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, action, valid_from, valid_to from dated entries (kind, key, day, action); action is block, allow or remove.

    The last word of a day counts: of several, remove before allow before block. An entry holds until the next one of its key
    (valid_to is exclusive, null: open). One row per key and day is left before the window, so a key's window is as long as its days.
    Rows with a null kind, key, day or action are no entries.
    """
    rank = F.when(F.col("action") == "remove", 3).when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1)
    e = entries.where(F.col("kind").isin(*KINDS) & F.col("key").isNotNull() & F.col("day").isNotNull() & rank.isNotNull())
    e = e.groupBy("kind", "key", "day").agg(F.max(F.struct(rank.alias("r"), "action")).alias("a"))
    w = Window.partitionBy("kind", "key").orderBy("day")
    e = e.select("kind", "key", "day", "a.action", F.lag("a.action").over(w).alias("before"))
    e = e.where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    e = e.select("kind", "key", "action", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))
    return e.where(F.col("action") != "remove")


def _candidates(captures: DataFrame) -> DataFrame:
    """kind, key and depth (labels of the domain) that an entry may have for a capture's url and host."""
    n = F.size("labels")
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", i, n), ".").alias("key"), (n - i + 1).alias("depth")))
    own = F.array(F.struct(F.lit("url").alias("kind"), F.col("url_key").alias("key"), F.lit(0).alias("depth")), F.struct(F.lit("host").alias("kind"), F.col("host").alias("key"), F.lit(0).alias("depth")))
    c = captures.where(F.col("host").isNotNull()).withColumn("labels", F.split("host", r"\."))
    return c.select("host", "url_key", "day", F.explode(F.concat(own, suffixes)).alias("c")).select("host", "url_key", "day", "c.kind", "c.key", "c.depth")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with host, verdict, action_kind, action_key, active_since and n_active added.

    All entries active on the capture's day are weighed: url before host before domain, a longer domain first; verdict is "block" or
    "allow" by the first (allow where there is none). Null or hostless URLs and null days are allowed with nulls. The as-of join
    runs over the distinct (url, day) of the captures and, per entry key, over its distinct days, never over all captures of a host.
    Repeated captures get equal verdicts. Columns of captures named like added ones are replaced. An empty list allows all, an
    empty table of captures gives an empty result.
    """
    added = ("host", "verdict", "action_kind", "action_key", "active_since", "n_active")
    plain, names = numbered(captures)
    u, d = (F.col(f"c{names.index(c)}") for c in (url, day))
    rows = plain.withColumns({"host": host_of(u), "url_key": key_of(u), "day": d})
    asked = rows.where(F.col("day").isNotNull()).select("host", "url_key", "day").distinct()
    listed = stored(intervals(entries))
    # Only keys that are listed: else a suffix such as "com" would gather all hosts.
    wanted = _candidates(asked).join(listed.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    points = wanted.select("kind", "key", "day").distinct()
    # As-of: per key, its interval starts and the asked days in one order; the last start before or on a day is the one in force.
    line = listed.select("kind", "key", F.col("valid_from").alias("day"), F.lit(0).alias("ask"), F.struct("action", "valid_from", "valid_to").alias("e"))
    line = line.unionByName(points.select("kind", "key", "day", F.lit(1).alias("ask"), F.lit(None).cast(line.schema["e"].dataType).alias("e")))
    last = F.last("e", ignorenulls=True).over(Window.partitionBy("kind", "key").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0))
    state = line.withColumn("e", last).where((F.col("ask") == 1) & F.col("e").isNotNull())
    state = state.where(F.col("e.valid_to").isNull() | (F.col("e.valid_to") > F.col("day"))).select("kind", "key", "day", "e")
    order = F.when(F.col("kind") == "url", 0).when(F.col("kind") == "host", 1).otherwise(1000 - F.col("depth"))
    hit = wanted.join(state, ["kind", "key", "day"]).groupBy("host", "url_key", "day")
    hit = hit.agg(F.min(F.struct(order.alias("o"), "kind", "key", "e")).alias("m"), F.count("*").alias("n_active"))
    hit = hit.select("url_key", "day", F.col("m.e.action").alias("verdict"), F.col("m.kind").alias("action_kind"), F.col("m.key").alias("action_key"), F.col("m.e.valid_from").alias("active_since"), "n_active")
    out = rows.join(hit, ["url_key", "day"], "left")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in added]
    return out.select(*own, "host", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "action_kind", "action_key", "active_since", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
