"""Benchmark decontamination by spaced seeds: fixed masks ignore chosen word positions, so a substituted word there does no harm.

Each mask gives a hash at each position of a text. Equal hashes of a document and a benchmark item are hits; around a hit the two
are laid side by side, and the overlap counts if enough words of some stretch of the item agree. All steps are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, settled, stored

#: Fixed masks: 1 is looked at, 0 is ignored. Together they meet every overlap that is accepted: whichever 2 of 11 to 14 words or 3 of
#: 15 are substituted, one of them fits between (a test goes through all cases).
MASKS = ("10001111", "111011", "101100101")
_LOOKED_AT = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
#: A stretch of STRETCH words of the item (all of a shorter one) must agree in MIN_AGREE of its words.
STRETCH, MIN_AGREE = 15, 0.8
#: Items of MIN_ITEM to SHORT words must stand in a text word for word; shorter ones, which cannot be told from ordinary phrases
#: elsewhere, must be a whole line of it.
MIN_ITEM, SHORT = 5, 10
#: Seeds of the benchmark up to this number are broadcast (16 bytes each), and hits (24 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_HITS = 1_000_000, 1_000_000


def tokens(text: Column) -> Column:
    """Words of letters and digits, lower case; an empty array where there is none."""
    line = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _looks(lengths: list[int]) -> list[tuple[int, list[int]]]:
    """(number, positions looked at) of each mask, and of whole items of the given lengths."""
    return [*enumerate(_LOOKED_AT), *[(100 + n, list(range(n))) for n in lengths]]


def _seeds(df: DataFrame, words: str, keep: list[str], pos: str, lengths: list[int]) -> DataFrame:
    """keep, pos and seed: one row for each look at each position of the words where it fits."""
    df = settled(df.withColumn("_w", F.col(words)), F.col("_w").alias("_words")).drop("_w")
    parts = []
    for m, at in _looks(lengths):
        chosen = ", ".join(f"_words[i + {j}]" for j in at)
        hashes = F.expr(f"transform(sequence(0, size(_words) - {at[-1] + 1}), i -> struct(i AS p, xxhash64({m}, {chosen}) AS h))")
        parts.append(F.when(F.size("_words") > at[-1], hashes).otherwise(F.array().cast("array<struct<p:int,h:bigint>>")))
    found = df.select(*keep, F.explode(F.concat(*parts)).alias("_s"))
    return found.select(*keep, F.col("_s.p").alias(pos), F.col("_s.h").alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: doc_id, th (hash of the text), item_id, words (most agreeing words of a stretch). One row a document and item."""
    given = stored(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("iw")).where(F.size("iw") > 0))
    items, brief = given.where(F.size("iw") >= MIN_ITEM), given.where(F.size("iw") < MIN_ITEM).distinct()
    lengths = sorted(r["n"] for r in items.select(F.size("iw").alias("n")).where(F.col("n") <= SHORT).distinct().collect())  # SHORT numbers at most
    tests = _seeds(items.where(F.size("iw") > SHORT), "iw", ["item_id"], "ipos", [])
    for m, at in _looks(lengths)[len(MASKS) :]:
        whole = items.where(F.size("iw") == len(at)).select("item_id", F.lit(0).alias("ipos"), F.expr(f"xxhash64({m}, {', '.join(f'iw[{j}]' for j in at)})").alias("seed"))
        tests = tests.unionByName(whole)
    tests = stored(tests.distinct())
    if tests.count() <= BROADCAST_SEEDS:
        tests = F.broadcast(tests)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("x"))
    hits = _seeds(base.withColumn("dw", tokens(F.col("x"))).drop("x"), "dw", ["doc_id", "th"], "pos", lengths).join(tests, "seed")
    hits = stored(hits.select("doc_id", "th", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).distinct())
    # Only texts with a hit are split into words again; the few hits go to the texts, not all texts to them.
    some = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    texts = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text).alias("d_th"), F.col(text).alias("d_text"))
    both = texts.join(some, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")))
    # A text with several hits is split once.
    both = both.groupBy("doc_id", "th", "d_text").agg(F.collect_set(F.struct("item_id", "shift")).alias("h"))
    both = settled(both.withColumn("_dw", tokens(F.col("d_text"))).drop("d_text"), F.col("_dw").alias("dw")).drop("_dw")
    both = both.select("doc_id", "th", "dw", F.explode("h").alias("h")).select("doc_id", "th", "h.item_id", "h.shift", "dw").join(items, "item_id")
    # The item's words beside those of the text.
    same = F.expr(
        "zip_with(slice(concat(array_repeat('', greatest(-shift, 0)), dw), greatest(shift, 0) + 1, size(iw)), iw, "
        "(a, b) -> CASE WHEN a = b THEN 1 ELSE 0 END)"
    )
    both = settled(both.select("doc_id", "th", "item_id", F.least(F.lit(STRETCH), F.size("iw")).alias("stretch"), same.alias("_same")), F.col("_same").alias("same"))
    best = F.expr("array_max(transform(sequence(1, size(same) - stretch + 1), s -> aggregate(slice(same, s, stretch), 0, (a, x) -> a + x)))")
    best = both.withColumn("words", best).groupBy("doc_id", "th", "item_id").agg(F.max("words").alias("words"), F.max("stretch").alias("stretch"))
    needed = F.when(F.col("stretch") <= SHORT, F.col("stretch")).otherwise(F.ceil(F.lit(MIN_AGREE) * F.col("stretch")))
    best = best.where(F.col("words") >= needed).drop("stretch")
    return best if brief.isEmpty() else best.unionByName(_whole_lines(base, brief))


def _whole_lines(base: DataFrame, brief: DataFrame) -> DataFrame:
    """doc_id, th, item_id, words: lines of texts (x) whose words are those of an item, no more and no fewer."""
    lines = base.select("doc_id", "th", F.explode(F.split("x", "\n")).alias("line")).withColumn("_iw", tokens(F.col("line"))).drop("line")
    lines = settled(lines, F.col("_iw").alias("iw")).drop("_iw").where(F.size("iw").between(1, MIN_ITEM - 1)).distinct()
    return lines.join(brief, "iw").select("doc_id", "th", "item_id", F.size("iw").alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """doc_id, th, contaminated, n_items, first_item, words for every row of docs.

    Null and empty texts are clean. Items of SHORT words or less match word for word, those below MIN_ITEM words whole lines only;
    null items and those without a word match nothing. Repeated rows, of docs or of the benchmark, get equal answers; a null id is an id of its own. Only the id and text
    columns are read. An empty table of documents gives an empty result, an empty benchmark contaminates nothing.
    """
    found = overlaps(docs, benchmark, id_col, text, **names).groupBy("doc_id", "th")
    found = found.agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("words").cast("long").alias("words"))
    found = stored(found).withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "th", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), "first_item", F.coalesce("words", zero).alias("words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns, whatever their names."""
    plain, columns = numbered(docs)
    key, x = (f"c{columns.index(c)}" for c in (id_col, text))
    bad = stored(overlaps(plain, benchmark, key, x, **names).select("doc_id", "th").distinct())
    kept = plain.join(bad, F.col(key).eqNullSafe(F.col("doc_id")) & (F.xxhash64(x) == F.col("th")), "left_anti")
    return kept.toDF(*columns)
