"""Quality rules: distribution divergence from language references.

Two histograms of each whole text are compared with its language's reference by Jensen-Shannon distance (the square root
of the divergence in bits, 0 to 1): the shares of character classes, and the shares of words that are each of the
language's common words or none of them. References are the sums over all documents of the language that pass the base
rules; documents of a null or unlisted language are compared with the sums over all languages, and by characters only.
A histogram of too few characters says little, so that comparison has a minimum length below which it passes. The
words' one covers all texts that pass the base rules; below `least_words` its limit widens as the square root of the
length falls, to `short_limit` at most.

All of it is DataFrame and SQL functions; nothing but the small table of references is joined, and texts never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, durable, words

# Common function words by language.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his at are this or had from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}
MARKS = "ABCDEFGHIJKLMNOPQRSTUVWX"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Order of the character histogram.
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "blank")


def repeated_words(columns: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a table with `_words`: words inside 3-word windows that the text has twice or more.

    Each window's hash and position share a long, hash bits above position bits; sorting brings equal windows together,
    and neighbours are compared word by word. The positions found are then counted as a union of intervals."""
    size = F.col("_n")
    span = F.expr("cast(shiftleft(1L, length(bin(_n))) as bigint)")
    df = columns.withColumn("_n", F.size("_words")).withColumn("_span", span)
    windows = F.transform(F.slice("_words", 1, F.greatest(size - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_windows", windows).withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    packed = F.transform("_windows", lambda h, i: h.bitwiseAND(-F.col("_span")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))

    def same(a: Column, b: Column) -> Column:
        at = [(x.bitwiseAND(F.col("_span") - 1)).cast("int") for x in (a, b)]
        words_ = reduce(lambda p, q: p & q, [F.get("_words", at[0] + k) == F.get("_words", at[1] + k) for k in range(3)])
        return F.when(a.bitwiseAND(-F.col("_span")) == b.bitwiseAND(-F.col("_span")), words_).otherwise(False)

    found = F.filter("_sorted", lambda x, k: ((k > 0) & same(x, F.get("_sorted", k - 1))) | F.coalesce(same(x, F.get("_sorted", k + 1)), F.lit(False)))
    df = df.withColumn("_found", found)
    df = df.withColumn("_at", F.sort_array(F.transform("_found", lambda x: x.bitwiseAND(F.col("_span") - 1))))
    covered = F.transform("_at", lambda p, k: F.coalesce(F.least(F.lit(3).cast("long"), F.get("_at", k + 1) - p), F.lit(3).cast("long")))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_windows", "_repeats", "_sorted", "_found", "_at", "_span")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", common: dict[str, list[str]] | None = None) -> DataFrame:
    """key, lang and the counts of each text; one narrow pass."""
    common = common or COMMON_WORDS
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), t.alias("_text"))
    lists = None
    for name, listed in common.items():
        case = F.when(F.col("_lang") == name, F.array(*map(F.lit, listed)))
        lists = case if lists is None else F.coalesce(lists, case)
    df = df.withColumn("_words", words(F.col("_text"))).withColumn("_common", lists)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # all but small ASCII letters: a fraction of the text, from which every class is counted
    df = repeated_words(df.withColumn("_lines", lines).withColumn("_rest", F.regexp_replace("_text", "[a-z]+", "")))
    marks = F.when(F.col("_common").isNotNull(), F.array_join(F.transform("_words", lambda w: F.substring(F.lit(" " + MARKS), F.array_position("_common", F.lower(w)).cast("int") + 1, F.lit(1))), ""))
    n, rest = F.length("_text"), F.length("_rest")
    count = lambda chars: rest - F.length(F.translate("_rest", chars, ""))
    df = df.select(
        "_key", "_lang", F.size("_words").cast("long").alias("n_words"), count(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        n.alias("_chars"), (n - rest).alias("_small"), F.length(F.regexp_replace("_rest", r"[^\p{L}]+", "")).alias("_letters"), F.length(F.regexp_replace("_rest", r"[^\p{Lu}]+", "")).alias("_upper"),
        count("0123456789").alias("_digits"), count(PUNCTUATION).alias("_punct"), count(BLANKS).alias("_blanks"), F.translate(marks, " ", "").alias("_marks"),
    )
    lower = F.col("_small") + F.col("_letters") - F.col("_upper")
    symbols = F.col("_chars") - F.col("_small") - F.col("_letters") - F.col("_digits") - F.col("_punct") - F.col("_blanks")
    chars = F.array(lower, F.col("_upper"), F.col("_digits"), F.col("_punct"), symbols, F.col("_blanks"))
    df = df.withColumn("word_chars", (F.col("_chars") - F.col("_blanks")).cast("long"))
    each = [F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit(m), F.lit(""))) for m in MARKS]
    common_hist = F.when(F.col("_marks").isNotNull(), F.array(*each, F.col("n_words") - F.length("_marks")))
    return df.select("_key", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.cast("array<bigint>").alias("chars"), common_hist.cast("array<bigint>").alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either has no mass."""

    def shares(x: Column) -> Column:
        return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))

    def gain(v: Column, w: Column) -> Column:
        return F.when(v > 0, v * F.log2(v / ((v + w) / 2))).otherwise(0.0)

    halves = F.zip_with(shares(p), shares(q), lambda a, b: (gain(a, b) + gain(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(halves, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", char_limit: float = 0.26, common_limit: float = 0.24, least_chars: int = 200, least_words: int = 150, least_base_words: int = 50, common: dict[str, list[str]] | None = None, short_limit: float = 0.32) -> DataFrame:
    """Per row: key, the base counts, base_failed, char_distance, common_distance, kept.

    Null and blank texts have no words and fail the base rules. Rows are judged one by one, repeated keys too. With no
    document that passes the base rules there are no references, and distances are null, which passes."""
    seen = durable(features(docs, key, text, lang, common))
    n = F.col("n_words")
    base_failed = (n < least_base_words) | (100 * F.col("n_repeat_words") > 50 * n)
    good = seen.where(~base_failed)

    def sums(column: str, size: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)).cast("double") for i in range(size)])

    marks = len(MARKS) + 1
    # languages that have lists of common words; a fixed number of rows
    listed = good.where(F.col("common").isNotNull()).groupBy("_lang").agg(sums("chars", len(CLASSES)).alias("_rc"), sums("common", marks).alias("_rw"))
    pooled = good.agg(sums("chars", len(CLASSES)).alias("_pc"))
    df = seen.join(F.broadcast(listed.withColumnRenamed("_lang", "_l")), F.col("_lang") == F.col("_l"), "left").join(F.broadcast(pooled))
    as_double = lambda c: F.col(c).cast("array<double>")
    df = df.withColumn("_ref", F.coalesce("_rc", "_pc"))
    df = df.withColumn("char_distance", F.when(F.col("word_chars") >= least_chars, distance(as_double("chars"), F.col("_ref"))))
    df = df.withColumn("common_distance", F.when((n >= least_base_words) & F.col("_rw").isNotNull(), distance(as_double("common"), F.col("_rw"))))
    widened = F.lit(common_limit) * F.sqrt(F.lit(float(least_words)) / F.greatest(n, F.lit(1)))
    words_limit = F.when(n >= least_words, common_limit).otherwise(F.greatest(F.lit(common_limit), F.least(F.lit(short_limit), widened)))
    fine = F.coalesce(F.col("char_distance") <= char_limit, F.lit(True)) & F.coalesce(F.col("common_distance") <= words_limit, F.lit(True))
    return df.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "char_distance", "common_distance", (~base_failed & fine).alias("kept"))
