"""Quality rules: a threshold table compiled into one projection.

Each :class:`Rule` bounds a ratio of two counts of a text. :func:`quality` computes every count
natively, once per row, and compiles the table into the boolean columns beside them: no shuffle,
no user function, no second pass over the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, words_of

SYMBOLS = "[#*$%&|<>]"
#: Words per window when repeated passages are counted.
REPEAT_WINDOW = 8

#: Very frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by this are at from or an "
    "le la les de des du et en un une que qui dans pour par sur est au avec "
    "der die das und ist nicht von mit den dem ein eine im zu auf für sich als "
    "el los las del y no con su por se lo al una o"
).split()


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * count / per <= ``most``, in whole per cent; None is no bound."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None


#: A document has to satisfy all of these.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", most=10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=40),
    Rule("stop_words", "n_stop_words", "n_words", least=1),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window of REPEAT_WINDOW words that the text holds twice or more.

    Windows are told apart by a 64-bit hash of their words. Texts whose windows all differ, the
    usual case, need one distinct count; the rest sort (hash, place) and add up what the repeated
    windows cover.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(2), F.size(places)),
            lambda k: F.least(F.lit(REPEAT_WINDOW), F.element_at(places, k) - F.element_at(places, k - 1)),
        )
        more = F.when(F.size(places) > 1, F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0)
        return more + REPEAT_WINDOW

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs)
        hash_at = lambda k: F.element_at(pairs, k)["h"]
        places = F.filter(
            F.transform(
                F.sequence(F.lit(1), last),
                lambda k: F.when(
                    F.when(k > 1, hash_at(k) == hash_at(k - 1)).otherwise(False)
                    | F.when(k < last, hash_at(k) == hash_at(k + 1)).otherwise(False),
                    F.element_at(pairs, k)["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return once(F.array_sort(places), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(once(pairs, repeated))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (REPEAT_WINDOW - 1)),
        lambda k: F.xxhash64(F.slice(words, k, REPEAT_WINDOW)),
    )
    return F.when(F.size(words) > REPEAT_WINDOW, once(windows, count)).otherwise(0)


def _counts(text: Column) -> Column:
    """A struct of COUNTS."""
    stop = [w for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize()))]
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        ]

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    return once(
        once(lines, of_lines),
        lambda of: once(
            words_of(text),
            lambda words: F.struct(
                *of_words(words),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                of["n_lines"].alias("n_lines"),
                of["n_dup_lines"].alias("n_dup_lines"),
            ),
        ),
    )


def _broken(rule: Rule) -> Column:
    ratio, per = 100 * F.col(rule.count), F.col(rule.per)
    low = ratio < rule.least * per if rule.least is not None else F.lit(False)
    high = ratio > rule.most * per if rule.most is not None else F.lit(False)
    return low | high


def quality(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_columns: list[str] | None = None
) -> DataFrame:
    """``keep_columns`` of ``docs`` (all, if None) with COUNTS, ``base_failed``, ``failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows.
    ``failed``: the names of the broken rules of the table, in its order. ``kept``: neither.

    A null text counts as one without words, which fails the base; so does an empty one. Repeated
    rows and ties are judged row by row, very long texts whole, and an empty table gives an empty one.
    An input column that is named like a result is replaced by it; :func:`keep` returns it as it is.
    """
    results = {c.lower() for c in (*COUNTS, "base_failed", "failed", "kept")}
    names = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in results]
    held = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in names)).alias("own"), _counts(F.coalesce(F.col(text_col), F.lit(""))).alias("counts"))
    counted = held.select("own", *(F.col(f"counts.{c}").alias(c) for c in COUNTS))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(_broken(r), F.lit(r.name)) for r in rules)), lambda r: r.isNotNull()) if rules else F.array().cast("array<string>")
    passed = ~reduce(lambda a, b: a | b, [base, *map(_broken, rules)])
    return counted.select(*(F.col(f"own.`{c}`") for c in names), *COUNTS, base.alias("base_failed"), failed.alias("failed"), passed.alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their columns as they are, whatever their names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return quality(whole, rules=rules, keep_columns=["row"]).where("kept").select("row.*")
