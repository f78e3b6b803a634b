"""Quality rules: a table of thresholds compiled into Spark expressions over length, symbol, stop-word and line
ratios. No user function runs.

A null text has no words and fails, as an empty one does. Very long texts are measured whole; the work per
document is a few passes and one sort of numbers. Repeated rows get equal verdicts, an empty table an empty
result. Columns of the input keep their values; measures with their names replace them only where a caller
adds them (``with_measures``); ``passing`` returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stored import stored

#: Classes of ASCII white space, symbols and capitals.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
CAPITAL = "[A-Z]"

#: Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the be to of and that have with in is it for on as are was this by from at or an not "
    "der die das und ist nicht von mit ein eine zu den des im sich auf für dem "
    "le la les de et est un une des que pour dans qui du en au par sur "
    "el los las y es una por con para del se su lo como más al"
).split()

#: A text fails the base with fewer words, or with more than this percentage of words in repeated windows.
BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50

#: measure, divided by, least, most
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("word_chars", "n_words", 2.0, 14.0),
    ("n_symbols", "n_words", None, 0.25),
    ("n_capitals", "word_chars", None, 0.4),
    ("n_stop_words", "n_words", 0.02, None),
    ("n_dup_lines", "n_lines", None, 0.5),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stop_words"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(keys: Column, marks: Column, low: Column) -> Column:
    """Words inside three-word windows that stand more than once.

    ``keys``: 64-bit hashes of the windows, by position. ``marks``: the same with the bits of ``low`` replaced
    by the position, sorted, so that equal windows are neighbours; a pair counts if its full hashes agree.
    """

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(
            F.get(keys, a.bitwiseAND(low).cast("int")) == F.get(keys, b.bitwiseAND(low).cast("int")), F.lit(False)
        )

    twice = F.filter(marks, lambda m, j: same(m, F.get(marks, j - 1)) | same(m, F.get(marks, j + 1)))
    places = F.sort_array(F.transform(twice, lambda m: m.bitwiseAND(low)))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``MEASURES``, ``base_failed`` and ``kept``, all from one pass over the rows."""
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, keys, marks, lines, low = (F.col(f"_quality_{x}") for x in ("words", "keys", "marks", "lines", "low"))
    last = F.size(words) - 3
    window = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    out = docs.withColumns(
        {
            "_quality_words": F.array_remove(F.split(given, SPACE + "+"), ""),
            "_quality_lines": F.filter(F.split(given, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "word_chars": F.length(given) - _count(given, SPACE),
            "n_capitals": _count(given, CAPITAL),
            "n_symbols": _count(given, SYMBOL),
        }
    )
    position_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1
    out = out.withColumns(
        {
            "_quality_keys": F.transform(
                window, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            ),
            "_quality_low": position_bits,
            "_quality_high": F.bitwise_not(position_bits),
        }
    )
    out = out.withColumn(
        "_quality_marks",
        # most texts repeat no window; only the others are sorted
        F.when(
            F.size(F.array_distinct(keys)) < F.size(keys),
            F.sort_array(
                F.transform(keys, lambda k, i: k.bitwiseAND(F.col("_quality_high")).bitwiseOR(i.cast("long")))
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    stops = [f(w) for w in dict.fromkeys(STOP_WORDS) for f in (str.lower, str.capitalize, str.upper)]
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(keys, marks, low),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(stops)))).cast("long"),
        }
    ).drop(*[f"_quality_{x}" for x in ("words", "keys", "marks", "lines", "low", "high")])
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(RULES))


def verdict(rules: list[tuple[str, str, float | None, float | None]]) -> Column:
    """The threshold table as one condition. A ratio over nothing counts as 0."""
    good = F.lit(True)
    for measure, per, least, most in rules:
        ratio = F.col(measure) / F.greatest(F.col(per), F.lit(1))
        if least is not None:
            good = good & (ratio >= least)
        if most is not None:
            good = good & (ratio <= most)
    return good


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents the rules keep, with the columns they came with.

    The verdicts are stored with the rows before they filter: a condition on ``kept`` would be moved below the
    measures and repeat each of them wherever the next one uses it.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    judged = stored(with_measures(held, "_text").select("_row", "kept"), "quality")
    return judged.where("kept").select("_row.*")
