"""Column expressions shared by the ledger operators. All are built-in functions, so plans stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact cents: decimals instead of binary floats, so sums do not drift."""
    return F.round(col(c).cast("decimal(24,6)"), 2).cast(MONEY)


def amount(deposit: str = "deposit", withdrawal: str = "withdrawal") -> Column:
    return F.coalesce(F.col(deposit), F.col(withdrawal), F.lit(0).cast(MONEY))


def signed(deposit: str = "deposit", withdrawal: str = "withdrawal") -> Column:
    return F.coalesce(F.col(deposit), -F.col(withdrawal), F.lit(0).cast(MONEY))


def side(deposit: str = "deposit") -> Column:
    """D or W by which column is set, not by its value: a deposit of 0.00 is a deposit."""
    return F.when(F.col(deposit).isNotNull(), "D").otherwise("W")


def iso_date(c: Column | str) -> Column:
    """A date only from strict yyyy-mm-dd; anything else, or a day that does not exist, is null."""
    c = col(c).cast("string")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


#: White space of any script, line breaks and separators included.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", " ")


def fixed(c: Column, pattern: str = "%.2f") -> Column:
    """Text of a decimal; format_string takes no decimals, so the rounded value goes in as a double."""
    return F.format_string(pattern, c.cast("double"))


def weekend(c: Column | str) -> Column:
    return F.weekday(col(c)) >= 5


def vendor_key(description: Column | str, vendor: Column | str) -> Column:
    """The vendor in lower case, or the description without long digit runs and punctuation; at most 40 characters."""
    v = F.lower(strip(vendor))
    d = F.regexp_replace(F.lower(col(description)), r"\d{4,}", "")
    d = F.trim(collapse(F.regexp_replace(d, "[^a-z0-9 ]", " ")))
    return F.substring(F.when(v != "", v).otherwise(d), 1, 40)


def cadence_label(days: Column | str) -> Column:
    """Inclusive day ranges of the named cadences."""
    d = col(days)
    return F.when(d.between(5, 9), "weekly").when(d.between(12, 16), "fortnightly").when(d.between(27, 33), "monthly").when(d.between(86, 95), "quarterly").otherwise("irregular")


# Words that mark a balance row instead of a transaction.
BALANCE_MARKERS = ("BEGINNING BALANCE", "ENDING BALANCE", "OPENING BALANCE", "CLOSING BALANCE", "TOTAL DEPOSITS", "TOTAL WITHDRAWALS", "PRIOR BALANCE")
CHECK_ROW = r"(?i)\bCHECK\s*#?\s*\*?\d{3,6}\b"


def flag_markers(description: Column | str) -> Column:
    return F.upper(col(description)).rlike("|".join(BALANCE_MARKERS))


def flag_checks(description: Column | str) -> Column:
    return col(description).rlike(CHECK_ROW)


# What a text export leaves on each page.
EXPORT_STAMP = r"\d{2}\.\d{2}\.\d{4},\s*\d{2}:\d{2}\s*"
HOSTING_URL = r"(?i)https?://file\.notion\.so/[^\s]+|file\.notion\.so/[^\s]+"
PAGE_COUNTER = r"(?m)^\s*\d+/\d+\s*$"
SELECTION_MARK = r":(?:unselected|selected):"


def clean_text(c: Column | str) -> Column:
    out = col(c)
    for pattern in (EXPORT_STAMP, HOSTING_URL, PAGE_COUNTER, SELECTION_MARK):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_text(c: Column | str) -> Column:
    out = F.regexp_replace(col(c), "<[^>]+>", " ")
    return clean_text(F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def printable_share(c: Column | str) -> Column:
    """Share of characters that print, of the text without white space at its ends: neither control, format, private or unassigned
    characters nor separators; the plain space, line feeds and tabs count as printing. Null for a blank text."""
    c = strip(c)
    odd = F.length(F.regexp_replace(c, r"[^\p{C}\p{Z}]|[ \n\t]", ""))
    return F.when(F.length(c) > 0, 1 - odd / F.length(c))


# Patterns of instructions planted in a text, by kind.
INJECTIONS = (
    ("ignore-previous", r"(?i)ignore (?:(?:all|the|any) )?(?:previous|prior|above) (?:instructions?|prompts?|rules?)"),
    ("disregard-previous", r"(?i)disregard (?:the |all |any )?(?:previous|prior|above)"),
    ("role-override", r"(?i)you are (?:now|actually) (?:a|an) [a-z ]+ (?:assistant|model|agent)"),
    ("forget-instructions", r"(?i)forget (?:everything|all (?:your )?(?:previous |prior )?instructions?)"),
    ("new-message-claim", r"(?i)new (?:system|user|assistant) (?:prompt|message|instruction)"),
    ("role-token", r"(?i)<\|(?:system|user|assistant|im_start|im_end)\|>"),
    ("template-injection", r"(?i)\{\{[^}]*system[^}]*\}\}"),
    ("fake-system-tag", r"(?is)<system>.*?</system>"),
    ("tool-id-leak", r'(?i)"tool_use_id"\s*:\s*"'),
    ("tool-fence", r"(?i)```\s*(?:json|tool_use|function)"),
)
# Personal numbers and what stands for them.
PII = (
    ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[CARD]", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("[ROUTING]", r"(?i)\b(?:ABA|Routing)[: #]+\d{9}\b"),
)


def redact_pii(c: Column | str) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, rule[1], rule[0]), PII, col(c))


def injection_spans(c: Column | str) -> Column:
    """Array of (start, end, kind, nr) of all planted instructions, kind by kind; places count from 0, end is exclusive."""
    plain = F.translate(col(c), "\x01\x02", "\x03\x03")  # the marks below, of the same length

    def of(number: int, kind: str, pattern: str) -> Column:
        parts = F.split(F.regexp_replace(plain, f"({pattern})", "\x01$1\x02"), "\x01")
        spans = F.array().cast("array<struct<start:int,end:int,kind:string,nr:int>>")
        start = F.struct(F.lit(0).alias("at"), spans.alias("found"))

        def add(s: Column, part: Column) -> Column:
            # A part is a match up to its mark, and the text behind it; the first part has no mark.
            n = F.instr(part, "\x02") - 1
            span = F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"), F.lit(kind).alias("kind"), F.lit(number).alias("nr"))
            return F.struct((s["at"] + F.length(part) - F.when(n >= 0, 1).otherwise(0)).alias("at"), F.when(n >= 0, F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"))

        return F.aggregate(parts, start, add, lambda s: s["found"])

    return F.concat(*[of(i, kind, pattern) for i, (kind, pattern) in enumerate(INJECTIONS)])


def strip_injections(c: Column | str) -> Column:
    """Spans cut from the right, by their places in the given text; of spans that begin at one place the first kind is cut first."""
    order = F.array_sort(F.transform(injection_spans(c), lambda s: F.struct((-s["start"]).alias("o"), s["nr"].alias("nr"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = lambda t, s: F.concat(F.substr(t, F.lit(1), -s["o"]), F.lit("[REDACTED-INJECTION:"), s["kind"], F.lit("]"), F.substr(t, s["end"] + 1))
    return F.aggregate(order, col(c), cut)


def injection_kinds(c: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(col(c).rlike(p), F.lit(kind)) for kind, p in INJECTIONS]))


def infer_iso_date(month: Column, day: Column, period_start: Column) -> Column:
    """Month name and day in the period's year, or in the next one if that lies over 31 days before its start."""
    at = lambda year: F.try_to_date(F.concat_ws(" ", year.cast("string"), F.initcap(month), F.lpad(day, 2, "0")), "yyyy MMM dd")
    here = at(F.year(period_start))
    return F.when(F.datediff(period_start, here) > 31, F.coalesce(at(F.year(period_start) + 1), here)).otherwise(here)


def account_hint(c: Column | str) -> Column:
    """The most frequent last four digits of account numbers in the first 3000 characters; the first seen on a tie."""
    found = F.transform(
        F.regexp_extract_all(F.substring(col(c), 1, 3000), F.lit(r"(?i)Account Number[:\s]+X*\s*([0-9]{4,16})"), 1), lambda x: F.right(x, F.lit(4))
    )
    ranked = F.transform(
        F.array_distinct(found), lambda v: F.struct((-F.size(F.filter(found, lambda x: x == v))).alias("n"), F.array_position(found, v).alias("p"), v.alias("v"))
    )
    return F.array_min(ranked)["v"]


def trim_tail(c: Column | str) -> Column:
    """Struct of body and tail, cut at the last daily balance summary that does not open the text."""
    c = col(c)
    body = F.regexp_extract(c, r"(?is)^(.+)DAILY BALANCE SUMMARY", 1)
    cut = F.when(body == "", F.length(c)).otherwise(F.length(body))
    return F.struct(F.substr(c, F.lit(1), cut).alias("body"), F.substr(c, cut + 1).alias("tail"))


# Category names. The rules are ordered; the first that matches a description names it.
CATEGORY_RULES = (
    ("TRANSFER_INTERNAL", r"(?i)\bTRNSFR\b|\bTRANSFER (?:TO|FROM)\b"),
    ("CHECK", CHECK_ROW),
    ("DEPOSIT_REMOTE", r"(?i)\b(?:REMOTE|MOBILE) DEPOSIT\b"),
    ("DEPOSIT_CASH", r"(?i)\b(?:CASH|ATM|BRANCH) DEPOSIT\b"),
    ("PAYROLL", r"(?i)\bPAYROLL\b"),
    ("WIRE", r"(?i)\bWIRE\b"),
    ("CARD_PAYMENT", r"(?i)\b(?:AMEX|VISA|MASTERCARD)\b"),
    ("LOAN_PAYMENT", r"(?i)\b(?:LOAN|MORTGAGE|SBA|EIDL)\b"),
    ("INTEREST", r"(?i)\bINTEREST\b"),
    ("FEE", r"(?i)\bFEE\b|\bSERVICE CHARGE\b|\bNSF\b"),
    ("TAX", r"(?i)\bIRS\b|\bTAX\b"),
    ("ACH_PAYABLE", r"(?i)\bPAYABLES?\b"),
    ("VENDOR_PAYMENT", r"(?i)\b(?:VENDOR|ACH)\b"),
)
CATEGORIES = ("ACH_PAYABLE", "WIRE", "CHECK", "DEPOSIT_REMOTE", "DEPOSIT_CASH", "TRANSFER_INTERNAL", "PAYROLL", "VENDOR_PAYMENT", "CARD_PAYMENT", "LOAN_PAYMENT", "INTEREST", "FEE", "TAX", "OTHER")


def categorise(description: Column | str, rules=CATEGORY_RULES) -> Column:
    pairs = [F.when(col(description).rlike(p), F.lit(name)) for name, p in rules]
    return F.coalesce(*pairs, F.lit("OTHER"))


def tenant_norm(c: Column | str) -> Column:
    t = strip(c)
    return F.when(t.rlike("^[A-Za-z0-9._-]{1,64}$"), t).otherwise("_default")


def statement_cache_key(tenant: Column, start: Column, account: Column, backend: Column, text: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", backend, text), 256), 1, 16)
    return F.concat(tenant_norm(tenant), F.lit("::"), F.concat_ws("_", F.replace(start, F.lit("/"), F.lit("-")), F.coalesce(account, F.lit("none")), backend, digest))


def all_of(predicates: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, predicates) if predicates else None


def negate(predicate: Column) -> Column:
    """True where the predicate is false or null."""
    return ~F.coalesce(predicate, F.lit(False))


def any_of(predicates: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, predicates) if predicates else None
