"""Line-first cleaning: judge every line, drop the failing ones, reject texts that lose too much.

Native: DataFrame functions only, one pass, no shuffle. Work per text is linear in its length, but for
one in-row sort of the three-word windows of texts that repeat one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import WORD_SPACE

SYMBOLS = "#*$%&|<>"
# What a line of prose ends with, words of menus, phrases of boilerplate.
TERMINAL = r"""[.!?…。:;"'”’»)\]][\x20\x09-\x0D]*$"""
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|prev|back|login|log in|sign in|sign up|register|search|site ?map|contact|about us|skip to content|read more|share|top)\b"
SEPARATED = r"([|»›>•·][^|»›>•·]*){3}"
BOILERPLATE = r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookies?\b.{0,40}\b(accept|use|consent)|(accept|use|consent).{0,40}\bcookies?\b|subscribe to|newsletter|click here|enable javascript|javascript is (required|disabled)|lorem ipsum|powered by|copyright|©)"


def _windows_twice(words: Column) -> Column:
    """Hashes of the three-word windows, in order. A wrong match needs a 64-bit collision in one text."""
    return F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )


def _covered(positions: Column) -> Column:
    """Words inside windows of three that start at the sorted positions."""
    steps = F.zip_with(
        positions,
        F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))),
        lambda a, b: F.least(F.lit(3), b - a),  # the last one has no successor and counts three
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def line_verdicts(docs: DataFrame, min_words: int = 50, max_loss: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with the measures, ``base_failed``, ``kept`` and ``clean_text``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines,
    lost_chars (bigint), base_failed, kept (boolean), clean_text (the lines that pass, joined by \\n).
    Lines without a word neither pass nor fail; they stay only as written between kept lines.
    A null text has no words: all measures are 0, ``base_failed`` is true, ``clean_text`` is empty.
    Repeated rows are judged each; columns of ``docs`` with names of added ones are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    added = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_bad_lines lost_chars"
        " base_failed kept clean_text"
    ).split()
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.array_remove(F.split(text, WORD_SPACE), "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(_no_space(line)) > 0).alias("__lines"),
    )
    rows = rows.withColumn("__grams", _windows_twice(F.col("__words")))
    grams = F.col("__grams")
    rows = rows.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col("__sorted")
    twice = F.transform(
        ordered,
        lambda x, i: F.when(
            F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
            x["i"],
        ),
    )
    rows = rows.withColumn("__at", F.sort_array(F.array_compact(twice)))
    rows = rows.withColumn("__good", F.filter(F.col("__lines"), lambda line: ~_fails(line)))
    lines, good = F.col("__lines"), F.col("__good")
    chars = lambda part: F.aggregate(
        part, F.lit(0).cast("bigint"), lambda total, line: total + F.length(_no_space(line))
    )
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("__")],
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(_no_space(text)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("__at")), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(good)).cast("bigint").alias("n_bad_lines"),
        (chars(lines) - chars(good)).alias("lost_chars"),
        F.array_join(good, "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("lost_chars") <= max_loss * F.col("word_chars"))
    )


def _no_space(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\f\r", "")


def _fails(line: Column) -> Column:
    """True when a punctuation, navigation or boilerplate rule rejects the line."""
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    short = F.length(line) <= 80
    return (
        ~line.rlike(TERMINAL)
        | line.rlike(SEPARATED)
        | (short & line.rlike(NAVIGATION))
        | (F.length(line) <= 200) & line.rlike(BOILERPLATE)
        | (10 * symbols > F.length(line))
    )


def clean_documents(docs: DataFrame, min_words: int = 50, max_loss: float = 0.5) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``; ``n_chars`` is counted
    anew, others pass through whatever their names."""
    given = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"given_{c}") for c in docs.columns])
    # The row number holds the filter above the measures; pushed below them it would measure again, and
    # split the text once more for every word.
    verdicts = line_verdicts(given, min_words, max_loss).withColumn("__row", F.monotonically_increasing_id())
    kept = verdicts.filter(F.col("kept") & (F.col("__row") >= 0))
    return kept.select(
        *[
            F.col("clean_text").alias(c)
            if c == "text"
            else F.length("clean_text").cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars"
            else F.col(f"`given_{c}`").alias(c)
            for c in docs.columns
        ]
    )
