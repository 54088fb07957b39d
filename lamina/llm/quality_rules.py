"""Line-first cleaning: rules per line, removal of failing lines, rejection of documents that lose too much.

Everything here is a Column expression: no Python runs on the executors and no
row leaves its partition, so the plan is one scan with projections.

Defined cases: a null text counts as empty; an empty text has no words, so it
fails the base rules; very long texts are judged whole; rows are judged one by
one, so ties and repeated rows give equal results.  Other columns pass through
untouched, but those named like a result (``COUNTS``, ``clean_text``,
``lost_chars``, ``kept_by_lines``) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACE, free_name, words

#: Phrases of legal and site boilerplate, matched in lower case.
BOILERPLATE = (
    "licensed under|released under the|license, version|all rights reserved|copyright (c)|terms of use|terms of service|"
    "privacy policy|cookie policy|accept cookies|use of cookies|enable javascript|lorem ipsum|subscribe to our|click here|"
    "powered by|skip to content|"
    "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|cookies akzeptieren|javascript aktivieren|"
    "tous droits réservés|conditions d'utilisation|politique de confidentialité|accepter les cookies|"
    "todos los derechos reservados|términos de uso|política de privacidad|aceptar cookies"
)
_BOILER_RE = r"\b(?:" + BOILERPLATE.replace("(", "[(]").replace(")", "[)]") + ")"


def _stripped(line: Column, pattern: str) -> Column:
    """Characters of ``line`` that ``pattern`` takes away."""
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def line_facts(text: Column) -> Column:
    """For each line with a word: the line, its characters in words, and its symbols and separators."""
    facts = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda s: F.struct(
            s.alias("line"),
            F.length(F.regexp_replace(s, f"[{SPACE}]+", "")).alias("chars"),
            _stripped(s, r"[#*$%&<>|]+").alias("marks"),
        ),
    )
    return F.filter(facts, lambda f: f["chars"] > 0)


def line_fails(f: Column) -> Column:
    """True where a line, as ``line_facts`` tells of it, breaks a rule.

    punctuation: a symbol ``#*$%&<>`` for each 10 characters, runs of ``!`` and
    ``?`` for a fifth of them, or no sentence mark in 40 characters or more;
    navigation: two separators ``|`` or more, at most 20 characters to each;
    boilerplate: a phrase of ``BOILERPLATE``.
    """
    line, chars, marks = f["line"], f["chars"], f["marks"]
    symbols = F.when(marks > 0, _stripped(line, r"[#*$%&<>]+")).otherwise(0)
    bars = F.when(marks > 1, _stripped(line, r"[|]+")).otherwise(0)
    shouts = F.when(line.contains("!!") | line.contains("??"), _stripped(line, r"[!?]{2,}")).otherwise(0)
    punctuation = (10 * symbols > chars) | (5 * shouts > chars) | ((chars >= 40) & ~line.rlike(r"[.!?:;]"))
    navigation = (bars >= 2) & (chars <= 20 * bars)
    return punctuation | navigation | F.lower(line).rlike(_BOILER_RE)


def with_line_verdict(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Adds ``clean_text`` (failing lines removed), ``lost_chars`` and ``kept_by_lines``.

    A document is kept by its lines if the removed lines hold at most
    ``max_lost`` of its characters in words.
    """
    total = lambda facts: F.aggregate(facts, F.lit(0).cast("long"), lambda s, f: s + f["chars"])
    facts, clean = free_name(df, "_facts"), free_name(df, "_clean")
    df = df.withColumn(facts, line_facts(F.col(text)))
    df = df.withColumn(clean, F.filter(facts, lambda f: ~line_fails(f)))
    df = df.withColumn("clean_text", F.array_join(F.col(f"{clean}.line"), "\n"))
    df = df.withColumn("word_chars", total(F.col(facts))).withColumn("lost_chars", F.col("word_chars") - total(F.col(clean)))
    df = df.withColumn("n_dup_lines", (F.size(facts) - F.size(F.array_distinct(F.col(f"{facts}.line")))).cast("long"))
    return df.withColumn("kept_by_lines", F.col("lost_chars") <= max_lost * F.col("word_chars")).drop(facts, clean)


def window_hashes(tokens: Column) -> Column:
    """64-bit hashes of the 3-word windows of ``tokens``, in order."""
    at = lambda i: F.get(tokens, i)
    windows = F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    return F.when(F.size(tokens) >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def rule_columns(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Base counts, base verdict and the line-first verdict for each row of ``df``.

    Repeated words lie in a 3-word window found twice or more.  Where the
    distinct hashes are as many as the windows nothing repeats; other texts
    sort (hash, position) pairs and add up the widths of the covered runs.
    """
    words_, windows_, repeats_, pairs_, hits_ = (free_name(df, c) for c in ("_words", "_windows", "_repeats", "_pairs", "_hits"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words_, words(F.col(text)))
    df = df.withColumn(windows_, window_hashes(F.col(words_)))
    df = df.withColumn(repeats_, F.size(windows_) > F.size(F.array_distinct(windows_)))
    # (hash, position) pairs in order; a window repeats if a neighbour has its hash
    pairs = F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(pairs_, F.when(F.col(repeats_), pairs))
    m = F.size(pairs_)
    shifted = F.arrays_zip(
        F.col(pairs_).alias("p"),
        F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.col(f"{pairs_}.h"), F.lit(1), m - 1)).alias("before"),
        F.slice(F.col(f"{pairs_}.h"), F.lit(2), m - 1).alias("after"),
    )
    hits = F.sort_array(
        F.transform(
            F.filter(shifted, lambda s: F.coalesce(s["p"]["h"] == s["before"], F.lit(False)) | F.coalesce(s["p"]["h"] == s["after"], F.lit(False))),
            lambda s: s["p"]["i"],
        )
    )
    df = df.withColumn(hits_, F.when(F.col(repeats_), hits))
    k = F.size(hits_)
    covered = F.aggregate(
        F.zip_with(F.slice(hits_, F.lit(1), k - 1), F.slice(hits_, F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(3))),
        F.lit(3).cast("bigint"),
        lambda s, x: s + x,
    )
    df = (
        df.withColumn("n_words", F.size(words_).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col(repeats_), covered).otherwise(F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )
    df = with_line_verdict(df, text, max_lost)
    df = df.withColumn("kept", ~F.col("base_failed") & F.col("kept_by_lines"))
    return df.drop(words_, windows_, repeats_, pairs_, hits_)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
