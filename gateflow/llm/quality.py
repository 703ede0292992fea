"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on are as was "
    "der die das und ist nicht von zu mit den ein sich auf für "
    "le la les de des et en un une du que est pour dans qui par "
    "el los las y una por con para como del se lo su"
).split()

#: (name, measure, lowest, highest); a document fails a rule if its measure is outside. Null: no bound. Set on the labelled documents,
#: with room beyond the good ones, which have 4.5 to 6.0 characters a word, no symbols, 6 % stop words at least and a third of
#: repeated lines at most; the bad ones are caught by symbols and stop words, the other two keep to what real pages show.
RULES = (
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.08),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.50),
)


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the text.

    Window hashes are sorted with their places; equal neighbours are repeated windows; the union of
    their three words each is summed over the places in order."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("p")),
    )

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i).h == F.get(s, j).h, F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x.p))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), lambda a, x: F.struct(x.alias("last"), (a.sum + F.least(F.lit(3), x - a.last)).alias("sum")), lambda a: a.sum)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.array_sort(windows), lambda s: covered(repeated(s)))).cast("long")


def quality_rules(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """Measures of every whole text, the base verdict and that of the rule table, in one projection.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
    ``failed`` (names of the rules failed) and ``kept``. Nothing is shuffled.

    Defined edge cases: a null text has no words and fails the base; ratios of an empty text are 0;
    repeated rows are judged each; an empty table gives an empty result; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_word = lambda t: F.length(F.translate(t, SPACES, "")) > 0
    lines = F.filter(F.split(text, "\n", -1), has_word)
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("__text"), F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "").alias("__words"), lines.alias("__lines"))
    base = base.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    measures = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }

    def fails(measure: Column, low, high) -> Column:
        tests = ([measure < low] if low is not None else []) + ([measure > high] if high is not None else [])
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    failed = F.filter(F.array(*(F.when(fails(measures[m], low, high), name) for name, m, low, high in rules)), lambda x: x.isNotNull())
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", base_failed).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
