"""Quality rules: Jensen-Shannon distance of character-class and common-word histograms to language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, numbered, settled, stored, words_of

# Frequent function words of the four languages of the corpus.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with",
    "der", "die", "und", "das", "den", "von", "ein", "ist", "mit",
    "le", "la", "les", "des", "et", "un", "une", "est", "que",
    "el", "los", "del", "y", "se", "con", "por", "para", "en", "de",
)
#: Character classes, removed from the text one after the other; what is left is the class "other".
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", SPACE + "+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("punct", r"[!-/:-@\[-`{-~]+"),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 200, 100
#: The class distance is judged as it is; the word distance as a share of what a text without any common word has to the same reference.
MAX_CLASS_DISTANCE, MAX_WORD_SHARE = 0.30, 0.8
_WORK = "_quality_"


def _histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Add words, the character-class and the common-word counts. Every step is a built-in function."""
    p = _WORK
    df = docs.withColumn(p + "lang", F.coalesce(F.col(lang).cast("string"), F.lit(""))).withColumn(p + "r0", F.coalesce(F.col(text), F.lit("")))
    counts = []
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"{p}r{i + 1}", F.regexp_replace(f"{p}r{i}", pattern, ""))
        counts.append(F.length(f"{p}r{i}") - F.length(f"{p}r{i + 1}"))
    counts.append(F.length(f"{p}r{len(CLASSES)}"))
    df = df.withColumn(p + "chars", F.array(*[c.cast("long") for c in counts])).withColumn(p + "n_chars", F.length(p + "r0").cast("long"))
    df = df.drop(*[f"{p}r{i + 1}" for i in range(len(CLASSES))])
    df = df.withColumn(p + "words", words_of(F.col(p + "r0"))).withColumn(p + "hits", F.filter(p + "words", lambda w: w.isin(*COMMON_WORDS)))
    # Each common word of the text between two spaces of its own: what replace() takes away of them counts one word.
    df = df.withColumn(p + "line", F.concat(F.lit(" "), F.array_join(p + "hits", "  "), F.lit(" ")))
    bins = [F.expr(f"(octet_length({p}line) - octet_length(replace({p}line, ' {w} ', ''))) div {len(w) + 2}") for w in COMMON_WORDS]
    bins.append(F.size(p + "words") - F.size(p + "hits"))
    return df.withColumn(p + "common", F.array(*[b.cast("long") for b in bins])).withColumn(p + "n_words", F.size(p + "words").cast("long")).drop(p + "hits", p + "line")


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language (null counts as ''): the summed histograms of all its documents that pass the length guards.

    ref_far is the distance to ref_common of a text without any common word, the largest that such a text can have.
    """
    p = _WORK
    df = _histograms(docs, text, lang)
    k, m = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    chars_ok, words_ok = F.col(p + "n_chars") >= MIN_CHARS_FOR_CLASSES, F.col(p + "n_words") >= MIN_WORDS_FOR_COMMON
    sums = [F.sum(F.when(chars_ok, F.col(p + "chars")[i])).alias(f"c{i}") for i in range(k)]
    sums += [F.sum(F.when(words_ok, F.col(p + "common")[i])).alias(f"w{i}") for i in range(m)]
    total = df.groupBy(F.col(p + "lang").alias("ref_lang")).agg(*sums)
    zero = F.lit(0).cast("long")
    refs = total.select(
        "ref_lang",
        F.array(*[F.coalesce(f"c{i}", zero) for i in range(k)]).alias("ref_chars"),
        F.array(*[F.coalesce(f"w{i}", zero) for i in range(m)]).alias("ref_common"),
    )
    none = F.array(*[zero] * (m - 1), F.lit(1).cast("long"))
    return refs.withColumn("ref_far", js_distance(none, F.col("ref_common")))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two count arrays; null where a total is 0.

    With totals A and B and m = (a/A + b/B) / 2 the terms are a/A * log2(a/A / m) and b/B * log2(b/B / m), halved and summed.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    both = F.struct(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("xy"), total(a).alias("a"), total(b).alias("b"))

    def add(s: Column, v: Column) -> Column:
        p, q = v["x"] / s["a"], v["y"] / s["b"]
        part = lambda z: F.when(z > 0, z * F.log2(2 * z / (p + q))).otherwise(F.lit(0.0))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), (s["d"] + (part(p) + part(q)) / 2).alias("d"))

    # The struct stands in an array of one so that both totals are found once a row, not once an element.
    found = F.transform(F.array(both), lambda z: F.aggregate(z["xy"], F.struct(z["a"].alias("a"), z["b"].alias("b"), F.lit(0.0).alias("d")), add, lambda s: s["d"]))
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(found[0], F.lit(0.0))))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_classes", "js_common", "kept")


def _judged(plain: DataFrame, text: str, lang: str, references: DataFrame | None, max_class_distance: float, max_word_share: float) -> DataFrame:
    """plain, whose columns are numbered, with ADDED."""
    p = _WORK
    refs = stored(language_references(plain, text, lang)) if references is None else references
    own = plain.columns
    df = _histograms(plain, text, lang)
    df = df.join(refs, F.col(p + "lang") == F.col("ref_lang"), "left")  # a table of a row a language: Spark broadcasts it by its size
    n = F.col(p + "n_words")
    df = df.withColumns(
        {
            "js_classes": F.when(F.col(p + "n_chars") >= MIN_CHARS_FOR_CLASSES, js_distance(F.col(p + "chars"), F.col("ref_chars"))),
            "js_common": F.when(n >= MIN_WORDS_FOR_COMMON, js_distance(F.col(p + "common"), F.col("ref_common"))),
            "word_chars": F.col(p + "n_chars") - F.col(p + "chars")[1],
            "n_symbols": F.col(p + "chars")[4],
            p + "lines": F.filter(F.split(p + "r0", "\n"), lambda x: x.rlike(WORD)),
        }
    )
    df = df.withColumn("n_dup_lines", (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"))
    # Windows of three words that occur again in the text: sort (hash, position) and look at the neighbours.
    df = df.withColumn(
        p + "tri",
        F.expr(
            f"CASE WHEN {p}n_words >= 3 THEN sort_array(transform(sequence(0, cast({p}n_words AS INT) - 3), "
            f"i -> struct(xxhash64({p}words[i], {p}words[i + 1], {p}words[i + 2]) AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        p + "again",
        F.expr(
            f"CASE WHEN {p}n_words >= 3 THEN sort_array(transform(filter(sequence(0, cast({p}n_words AS INT) - 3), "
            f"j -> get({p}tri, j - 1).h <=> {p}tri[j].h OR get({p}tri, j + 1).h <=> {p}tri[j].h), k -> {p}tri[k].i)) END"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr(f"coalesce(aggregate({p}again, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n), 0L)"),
    )
    df = df.withColumn("n_words", n).withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    far = F.coalesce(F.col("js_classes") > max_class_distance, F.lit(False)) | F.coalesce(F.col("js_common") > max_word_share * F.col("ref_far"), F.lit(False))
    df = df.withColumn("kept", ~F.col("base_failed") & ~far)
    return settled(df.select(*own, *[F.col(c).alias("_" + c) for c in ADDED]), *[F.col("_" + c).alias(c) for c in ADDED]).select(*own, *ADDED)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    references: DataFrame | None = None,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_share: float = MAX_WORD_SHARE,
) -> DataFrame:
    """Add the base counts, both distances and the verdict to every row of docs; no row is dropped.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_common, kept.
    references is a table as language_references makes it; without one it is made of docs, so that it follows the corpus. A text
    below MIN_CHARS_FOR_CLASSES characters or MIN_WORDS_FOR_COMMON words is not judged by that histogram (distance null), nor is
    one whose language has no reference or no common word at all.
    A null text counts as empty and fails the base rules; a null language is a language of its own. Repeated rows are
    judged one by one. An empty table gives an empty result. Columns of docs with the names of added ones are replaced.
    What is added may be filtered and selected freely: it is computed once a row.
    """
    plain, names = numbered(docs)
    at = lambda c: f"c{names.index(c)}"
    df = _judged(plain, at(text), at(lang), references, max_class_distance, max_word_share)
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ADDED], *ADDED)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", references: DataFrame | None = None, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_share: float = MAX_WORD_SHARE) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns unchanged, whatever their names."""
    plain, names = numbered(docs)
    df = _judged(plain, f"c{names.index(text)}", f"c{names.index(lang)}", references, max_class_distance, max_word_share)
    return df.where("kept").select(*plain.columns).toDF(*names)
