"""Statement text to rows: segmenting, row parsing, verdicts, chunking, enrichment. Text arrives as a table (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, account_hint, amount, categorise, collapse, flag_checks, flag_markers, infer_iso_date, injection_spans, money, side, strip, vendor_key
from ..sources.scratch import stored

# How statements write their balances, dates and amounts.
BEGIN = r"(?i)Beginning Balance as of\s+(\d{2}/\d{2}/\d{4})"
END = r"(?i)Ending Balance as of\s+(\d{2}/\d{2}/\d{4})"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAY = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}\b"
AMOUNT = r"-?\$?\d{1,3}(?:,\d{3})*\.\d{2}\b"


def _pieces(text, pattern: str):
    """The text cut before each match; the first piece is what stands before the first match."""
    # Behind a blank, so that a match at the very beginning is cut off too.
    parts = F.split(F.concat(F.lit(" "), text), f"(?={pattern})")
    return F.transform(parts, lambda x, i: F.when(i == 0, F.substr(x, F.lit(2))).otherwise(x))


def _or_null(c):
    return F.when(c != "", c)


def segment_statements(docs: DataFrame, lookback: int = 800) -> DataFrame:
    """doc_id, segment_no, text, lookback_chars, period_start_raw, period_end_raw, account_hint of each opening balance.

    The text begins lookback characters before the opening balance (lookback_chars of them are there) and ends at the next one.

    The end date is the first in the segment, the look-back included. A text without an opening balance gives no segment.
    """
    d = docs.select("doc_id", F.posexplode(_pieces(F.col("text"), BEGIN)).alias("pos", "piece"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # The characters before a piece are the tail of the pieces before it. But for the first, a piece has 34 characters at least.
    before = w.rowsBetween(-(-(-lookback // 34) + 1), -1)
    tail = F.right(F.array_join(F.collect_list(F.right("piece", F.lit(lookback))).over(before), ""), F.lit(lookback)) if lookback > 0 else F.lit("")
    d = d.withColumn("tail", tail).where("pos > 0").withColumn("text", F.concat("tail", "piece"))
    d = d.select("doc_id", (F.col("pos") - 1).alias("segment_no"), "text", F.length("tail").alias("lookback_chars"), F.regexp_extract("piece", BEGIN, 1).alias("period_start_raw"), _or_null(F.regexp_extract("text", END, 1)).alias("period_end_raw"))
    return d.withColumn("account_hint", account_hint("text"))


def dedupe_segments(segments: DataFrame) -> DataFrame:
    """Per document and period start: with accounts known, segments without one go; per account the longest stays, the first of equals."""
    p = Window.partitionBy("doc_id", "period_start_raw")
    d = segments.withColumn("_some", F.max(F.col("account_hint").isNotNull()).over(p)).where(~F.col("_some") | F.col("account_hint").isNotNull())
    a = Window.partitionBy("doc_id", "period_start_raw", "account_hint").orderBy(F.desc(F.length("text")), "segment_no")
    return d.withColumn("_n", F.row_number().over(a)).where("_n = 1").drop("_n", "_some")


def looks_like_statement(segments: DataFrame, min_rows: int = 5) -> DataFrame:
    # Fixed value: a dated row with an amount.
    row = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}\b[^\n]{{0,200}}\d{{1,3}}(?:,\d{{3}})*\.\d{{2}}"
    return segments.where(F.regexp_count("text", F.lit(row)) >= min_rows)


def parse_rows(segments: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """raw rows of segments (keys, text, period_start): one per 'Mon dd' with an amount after it.

    Of two numbers or more the last is the running balance. confidence: 1, less 0.5 without a date, less 0.2 with over three numbers.
    """
    d = segments.select(*keys, "period_start", F.posexplode(_pieces(F.col("text"), DAY)).alias("row_pos", "raw")).where("row_pos > 0")
    d = d.withColumns(
        {
            "month": F.regexp_extract("raw", rf"(?i)^({MONTHS})\s+(\d{{1,2}})", 1),
            "day": F.regexp_extract("raw", rf"(?i)^({MONTHS})\s+(\d{{1,2}})", 2),
            "body": F.regexp_replace("raw", rf"(?i)^(?:{MONTHS})\s+\d{{1,2}}", ""),
        }
    )
    numbers = F.transform(F.regexp_extract_all("body", F.lit(AMOUNT), 0), lambda x: F.regexp_replace(x, "[$,]", "").cast(MONEY))
    d = d.withColumn("numbers", numbers).where(F.size("numbers") > 0)
    head = F.regexp_extract("body", rf"(?s)^(.*?){AMOUNT}", 1)
    many = F.size("numbers") >= 2
    d = d.withColumns(
        {
            "tx_date": infer_iso_date(F.col("month"), F.col("day"), F.col("period_start")),
            "description": F.btrim(collapse(head), F.lit(" \t,;|")),
            "amounts": F.when(many, F.slice("numbers", 1, F.size("numbers") - 1)).otherwise(F.col("numbers")),
            "balance": F.when(many, F.element_at("numbers", -1)),
        }
    )
    doubt = F.when(F.col("tx_date").isNull(), 0.5).otherwise(0.0) + F.when(F.size("numbers") > 3, 0.2).otherwise(0.0)
    d = d.withColumns({"confidence": F.greatest(F.lit(0.0), 1.0 - doubt), "is_check": flag_checks("description"), "likely_marker": flag_markers("description")})
    return d.select(*keys, "row_pos", "tx_date", "description", "amounts", "balance", strip(F.col("raw")).alias("raw"), "confidence", "is_check", "likely_marker")


def filter_transactions(raw: DataFrame) -> DataFrame:
    return raw.where(~F.col("likely_marker") & (F.size("amounts") > 0) & (F.length("description") >= 2) & F.col("tx_date").isNotNull())


def rows_to_candidates(raw: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("row_pos")
    return raw.select(*keys, (F.row_number().over(w) - 1).alias("tx_index"), "tx_date", F.substring("description", 1, 120).alias("description"), F.col("amounts")[0].alias("amount"), "amounts", "balance", "is_check")


def infer_sides(candidates: DataFrame, keys: tuple[str, ...] = ("statement_id",), opening: DataFrame | None = None) -> DataFrame:
    """side D or W from the change of the running balance, W for checks, null where neither tells.

    opening (keys, beginning_balance; a row a statement) is what the first row's balance is held against.
    """
    w = Window.partitionBy(*keys).orderBy("tx_index")
    before = F.lag("balance").over(w)
    if opening is not None:
        candidates = candidates.join(opening.select(*keys, F.col("beginning_balance").alias("_open")), list(keys), "left")
        before = F.when(F.row_number().over(w) == 1, F.col("_open")).otherwise(before)
    move = F.col("balance") - before
    told = F.when(F.col("is_check"), "W").when(F.abs(move) == F.abs("amount"), F.when(move >= 0, "D").otherwise("W"))
    return candidates.withColumn("side", told).drop("_open")


def apply_row_verdicts(candidates: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> tuple[DataFrame, DataFrame]:
    """(transactions, skipped) from verdicts (keys, tx_index, keep, side, reason); candidates without one are in neither."""
    d = candidates.drop("side").join(verdicts, [*keys, "tx_index"])
    a = money(F.abs("amount"))
    kept = d.where("keep").select(*keys, "tx_index", "tx_date", "description", F.when(F.col("side") == "D", a).alias("deposit"), F.when(F.col("side") == "W", a).alias("withdrawal"))
    return kept, d.where(~F.col("keep")).select(*keys, "tx_index", F.col("description").alias("raw"), "reason")


def extract_summary(segments: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """Declared figures in the first 6000 characters: dates, balances, totals, counts, account and currency."""
    head = F.substring("text", 1, 6000)
    number = r"\$?(-?\d{1,3}(?:,\d{3})*\.\d{2})"
    pick = lambda p, i=1: _or_null(F.regexp_extract(head, p, i))
    value = lambda p: F.regexp_replace(pick(p), ",", "").cast(MONEY)
    date = lambda p: F.try_to_date(pick(p), "MM/dd/yyyy")
    start, end = date(BEGIN), date(END)
    code = pick(r"\b(USD|EUR|GBP|CAD)\b")
    return segments.select(
        *keys,
        account_hint("text").alias("account_last4"), F.coalesce(start, end).alias("period_start"), F.coalesce(end, start).alias("period_end"),
        value(r"(?i)Beginning Balance as of\s+\d{2}/\d{2}/\d{4}\s+" + number).alias("beginning_balance"),
        value(r"(?i)Ending Balance as of\s+\d{2}/\d{2}/\d{4}\s+" + number).alias("ending_balance"),
        value(r"(?i)Total Deposits[^\n$\d-]{0,40}(?:\(\d+\)\s*)?" + number).alias("deposits_total"),
        value(r"(?i)Total Withdrawals[^\n$\d-]{0,40}(?:\(\d+\)\s*)?" + number).alias("withdrawals_total"),
        pick(r"(?i)Total Deposits\s*\((\d+)\)").cast("int").alias("deposits_count"), pick(r"(?i)Total Withdrawals\s*\((\d+)\)").cast("int").alias("withdrawals_count"),
        F.coalesce(code, F.when(head.contains("$"), "USD").when(head.contains("€"), "EUR").when(head.contains("£"), "GBP")).alias("currency"),
    )


def chunk_by_dates(rows: DataFrame, n: int = 4, min_rows: int = 80, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """rows (keys, tx_date, period_start) with chunk_index: the statement's distinct dates in n runs, one chunk below min_rows.

    A date before the period's start belongs to the next year here, whatever the distance.
    """
    k = Window.partitionBy(*keys)
    rolled = F.when(F.col("tx_date") < F.col("period_start"), F.add_months("tx_date", 12)).otherwise(F.col("tx_date"))
    d = rows.withColumn("chunk_date", rolled)
    d = d.withColumns({"_rows": F.count("chunk_date").over(k), "_rank": F.dense_rank().over(k.orderBy("chunk_date")) - 1})
    d = d.withColumn("_dates", F.max("_rank").over(k) + 1)
    chunks = F.least(F.lit(n), F.col("_dates"))
    # Chunk i begins at rank i * dates div chunks: the last i at or before a rank is found among at most n.
    index = F.array_max(F.filter(F.sequence(F.lit(0), chunks - 1), lambda i: F.floor(i * F.col("_dates") / chunks) <= F.col("_rank")))
    return d.withColumn("chunk_index", F.when(F.col("_rows") < min_rows, 0).otherwise(index).cast("int")).drop("_rows", "_rank", "_dates")


def merge_chunks(rows: DataFrame, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """Rows (keys, chunk_index, pos, ...) of all chunks; of repeats by date, side, cents and description (80 characters) the first."""
    w = Window.partitionBy(*keys, "tx_date", side(), money(amount()), F.substring(F.trim(collapse("description")), 1, 80)).orderBy("chunk_index", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_enrichment(t: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("statement_id", "tx_index")) -> DataFrame:
    """Category, vendor and confidence (cut to 0..1) from items where a row has one, nulls included; other rows stay."""
    i = items.select(*keys, F.struct("category", "vendor", "confidence").alias("_i"))
    d = t.join(i, list(keys), "left")
    hit = F.col("_i").isNotNull()
    new = {c: F.when(hit, F.col(f"_i.{c}")).otherwise(F.col(c)) for c in ("category", "vendor")}
    new["confidence"] = F.when(hit, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_i.confidence")))).otherwise(F.col("confidence"))
    return d.withColumns(new).select(*t.columns)


def vendor_lookup(t: DataFrame, seed: DataFrame, vendor: str = "vendor") -> DataFrame:
    """canonical_name from seed (key, canonical_name): the vendor itself, or the longest seed key that it begins with (of equal keys, the last name).

    Each distinct vendor is looked up once. Its prefixes are matched by equality, so there is no cross join.
    """
    clean = lambda c: F.lower(strip(collapse(c)))
    names = t.where(F.col(vendor).isNotNull()).select(F.col(vendor).alias("_v")).distinct()
    names = names.select("_v", F.explode(F.transform(F.sequence(F.lit(1), F.length(clean("_v"))), lambda n: F.substr(clean("_v"), F.lit(1), n))).alias("key"))
    s = seed.select(clean("key").alias("key"), "canonical_name")
    best = names.join(s, "key").groupBy("_v").agg(F.max_by("canonical_name", F.struct(F.length("key"), "canonical_name")).alias("canonical_name"))
    return t.join(best, F.col(vendor) == F.col("_v"), "left").drop("_v")


def _page_keys(probe: Column) -> Column:
    """Keys that each page with the probe has too: its inner words, else the cut between its two words, else one of its 4-grams.

    On a page the first word may go on to the left and the last one to the right, so only words between two blanks are whole.
    """
    w = F.split(probe, " ")
    inner = F.transform(F.array_distinct(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))), lambda x: F.concat(F.lit("w"), x))
    cut = F.concat(F.lit("c"), F.right(F.get(w, F.lit(0)), F.lit(3)), F.lit(" "), F.left(F.get(w, F.lit(1)), F.lit(3)))
    grams = F.transform(F.sequence(F.lit(1), F.length(probe) - 3), lambda i: F.concat(F.lit("g"), F.substr(probe, i, F.lit(4))))
    two = (F.size(w) == 2) & (F.length(F.get(w, F.lit(0))) >= 3) & (F.length(F.get(w, F.lit(1))) >= 3)
    return F.when(F.size(w) > 2, inner).when(two, F.array(cut)).otherwise(F.array(F.array_min(grams)))


def _page_index(p: DataFrame, kinds: DataFrame) -> DataFrame:
    """doc_id, page, key of pages (page_text), with the kinds of keys that the document's probes have."""
    words = F.transform(F.array_distinct(F.split("page_text", " ")), lambda x: F.concat(F.lit("w"), x))
    # Arrays that a lambda looks into are bound by one around it, so that they are made once a row.
    cuts = F.expr("transform(array(split(page_text, ' ')), w -> array_distinct(transform(sequence(1, size(w)), i -> concat('c', right(w[i - 1], 3), ' ', left(get(w, i), 3)))))[0]")
    grams = F.expr("transform(array(split(page_text, '')), c -> array_distinct(transform(sequence(0, greatest(size(c) - 4, 0)), i -> concat('g', c[i], get(c, i + 1), get(c, i + 2), get(c, i + 3)))))[0]")
    none = F.array().cast("array<string>")
    keys = F.concat(*[F.when(F.col(k), x).otherwise(none) for k, x in (("_w", words), ("_c", cuts), ("_g", grams))])
    asked = p.where(F.length("page_text") >= 4).join(kinds, "doc_id")
    return asked.select("doc_id", "page", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def match_description_to_page(t: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, tx_index, page, matched: the page of the row's document that holds its first 60, 30 or 20 characters; the longest, then the lowest page.

    Pages are met through an index of words (of cuts between words and of 4-grams for beginnings without a whole word); of a
    beginning's keys the one on the fewest pages is followed, and pages are read only where it stands. Each distinct beginning is
    looked up once. Descriptions of under 4 characters, and nulls, match nothing; a null page comes last.
    """
    flat = lambda c: F.trim(collapse(F.upper(c)))
    rows = t.select("doc_id", "tx_index", F.substring(flat("description"), 1, 60).alias("head")).where(F.length("head") >= 4)
    p = pages.select("doc_id", "page", flat("text").alias("page_text"))
    heads = rows.select("doc_id", "head").distinct().withColumn("keys", _page_keys(F.trim(F.substring("head", 1, 20))))
    heads = heads.select("doc_id", "head", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    kinds = heads.groupBy("doc_id").agg(*[F.max(F.col("key").startswith(k)).alias(f"_{k}") for k in "wcg"])
    index = stored(_page_index(p, kinds))
    sizes = index.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    rare = heads.join(sizes, ["doc_id", "key"]).groupBy("doc_id", "head", "n_keys").agg(F.count("*").alias("found"), F.min(F.struct("n", "key")).alias("k"))
    rare = rare.where("found = n_keys").select("doc_id", "head", F.col("k.key").alias("key"))  # a page needs all of them
    met = rare.join(index, ["doc_id", "key"]).select(F.col("doc_id").alias("_d"), "head", F.col("page").alias("_p")).distinct()
    met = met.join(p, (F.col("_d") == F.col("doc_id")) & F.col("_p").eqNullSafe(F.col("page")))
    probes = [F.trim(F.substring("head", 1, n)) for n in (60, 30, 20)]
    matched = F.coalesce(*[F.when(F.col("page_text").contains(x), F.length(x)) for x in probes])
    order = F.struct(-F.col("matched"), F.col("page").isNull(), F.col("page"))
    met = met.select("doc_id", "head", "page", matched.alias("matched")).where("matched IS NOT NULL")
    best = met.groupBy("doc_id", "head").agg(F.min_by(F.struct("page", "matched"), order).alias("b")).select("doc_id", "head", "b.*")
    found = rows.join(best, ["doc_id", "head"]).groupBy("doc_id", "tx_index").agg(F.min_by(F.struct("page", "matched"), order).alias("b"))
    return found.select("doc_id", "tx_index", "b.page", "b.matched")


def find_injections(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end, kind of each planted instruction found; places count from 0, end is exclusive."""
    return df.select(key, F.explode(injection_spans(text)).alias("x")).select(key, "x.start", "x.end", "x.kind")


def with_vendor_key(t: DataFrame) -> DataFrame:
    return t.withColumn("vendor_key", vendor_key("description", "vendor"))


def bulk_extract(docs: DataFrame, lookback: int = 800, min_rows: int = 5, strict_period: bool = True) -> dict[str, DataFrame]:
    """statements, transactions and skipped_rows of all documents (doc_id, text); statement_id is doc_id#segment_no.

    strict_period reads rows and figures from the opening balance on only; otherwise the look-back may repeat rows of the statement
    before. The first row's side is told by the opening balance. Rows whose side nothing tells are skipped rows.
    """
    seg = looks_like_statement(dedupe_segments(segment_statements(docs, lookback)), min_rows)
    if strict_period:
        seg = seg.withColumn("text", F.substr("text", F.col("lookback_chars") + 1))
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("segment_no").cast("string"))
    seg = seg.withColumns({"statement_id": key, "period_start": F.try_to_date("period_start_raw", "MM/dd/yyyy")})
    s = extract_summary(seg, ("statement_id", "doc_id", "segment_no", "account_hint"))
    s = s.withColumn("account_last4", F.coalesce("account_last4", "account_hint")).drop("account_hint")
    c = infer_sides(rows_to_candidates(filter_transactions(parse_rows(seg))), opening=s)
    told = F.col("side").isNotNull()
    a = money(F.abs("amount"))
    t = c.where(told).select("statement_id", "tx_index", "tx_date", "description", F.when(F.col("side") == "D", a).alias("deposit"), F.when(F.col("side") == "W", a).alias("withdrawal"))
    skipped = c.where(~told).select("statement_id", "tx_index", F.col("description").alias("raw"), F.lit("side unknown").alias("reason"))
    return {"statements": s, "transactions": t.withColumn("category", categorise("description")), "skipped_rows": skipped}
