"""Threshold rules on text statistics, compiled into one Spark projection.

Every statistic is a built-in expression over the text of a single row, so the
operator never shuffles and a hot source or a group of copies costs no more
than its rows.  A rule is a row of :data:`RULES`: a statistic, and the lowest
and highest value that a kept text may have.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; repeated rows give repeated results; other columns are ignored unless
``carry`` names them; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "was", "be", "by", "this", "are", "or", "at", "from", "a", "an",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "en", "au", "avec",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es",
    "el", "los", "las", "y", "se", "del", "una", "con", "no", "su", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o", "este",
]


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= statistic <= high; None leaves a side open."""

    statistic: str
    low: float | None = None
    high: float | None = None


# The production thresholds.  Ratios are per word or per line.
RULES = [
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.40),
    Rule("repeat_ratio", None, 0.50),
    Rule("upper_ratio", None, 0.30),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def compile_rules(rules: list[Rule]) -> Column:
    """One boolean expression that is true where every rule holds."""
    held = F.lit(True)
    for r in rules:
        x = F.col(f"`{r.statistic}`")
        if r.low is not None:
            held = held & (x >= F.lit(r.low))
        if r.high is not None:
            held = held & (x <= F.lit(r.high))
    return held


def _per(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0D END"


def text_statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (``doc_id`` by default) and a column for each statistic.

    ``n_repeat_words`` counts the words in three-word windows that the text has
    twice or more; windows are compared by a 64-bit hash of their words.
    """
    carry = ["doc_id"] if carry is None else carry
    stops = ", ".join("'" + w + "'" for w in dict.fromkeys([*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]))
    keep = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    held = [f"_c{i}" for i in range(len(carry))]
    x = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    x = x.selectExpr(
        *held, "_t",
        rf"array_remove(split(_t, '{SPACES}'), '') AS _w".replace("\\", "\\\\"),
        r"filter(split(_t, '\n'), l -> l rlike '[^\x20\x09-\x0D]') AS _l".replace("\\x", "\\\\x"),
    )
    x = x.selectExpr(*held, "_t", "_w", "_l", "size(_w) AS _n", "CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END AS _h")
    x = x.selectExpr(*held, "_t", "_w", "_l", "_n", "CASE WHEN size(array_distinct(_h)) = size(_h) THEN NULL ELSE sort_array(transform(_h, (h, i) -> struct(h, i))) END AS _s")
    x = x.selectExpr(*held, "_t", "_w", "_l", "_n", "filter(_s, (x, k) -> get(_s, k - 1).h <=> x.h OR get(_s, k + 1).h <=> x.h) AS _d")
    statistics = {
        "n_words": "CAST(_n AS BIGINT)",
        "word_chars": "CAST(length(array_join(_w, '')) AS BIGINT)",
        "n_symbols": f"CAST(length(_t) - length(regexp_replace(_t, '{SYMBOLS}', '')) AS BIGINT)",
        "n_lines": "CAST(size(_l) AS BIGINT)",
        "n_dup_lines": "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)",
        "n_repeat_words": "CAST(coalesce(size(array_distinct(flatten(transform(_d, x -> array(x.i, x.i + 1, x.i + 2))))), 0) AS BIGINT)",
        "n_stop_words": f"CAST(size(filter(_w, w -> w IN ({stops}))) AS BIGINT)",
        "n_upper": "CAST(length(_t) - length(regexp_replace(_t, '[A-Z]+', '')) AS BIGINT)",
        "n_bullet_lines": "CAST(size(filter(_l, l -> l rlike '^ *[-*•]')) AS BIGINT)",
        "n_ellipsis_lines": "CAST(size(filter(_l, l -> l rlike '(\\\\.\\\\.\\\\.|…)$')) AS BIGINT)",
    }
    # One row a text: a filter on a statistic stays above the generator, as in the projections below each use would split the text again; one on a carried column passes it.
    x = x.selectExpr(*held, f"inline(array(named_struct({', '.join(f"'{n}', {e}" for n, e in statistics.items())})))")
    ratios = {
        "mean_word_chars": _per("word_chars", "n_words"), "symbol_ratio": _per("n_symbols", "n_words"), "stop_ratio": _per("n_stop_words", "n_words"),
        "dup_line_ratio": _per("n_dup_lines", "n_lines"), "repeat_ratio": _per("n_repeat_words", "n_words"),
        "upper_ratio": _per("n_upper", "word_chars"), "bullet_line_ratio": _per("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": _per("n_ellipsis_lines", "n_lines"),
    }
    x = x.selectExpr("*", *(f"{e} AS {n}" for n, e in ratios.items()))
    return x.select(*(F.col(h).alias(c) for h, c in zip(held, carry)), *(c for c in x.columns if c not in held))


def quality_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """:func:`text_statistics` with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated three-word windows.  ``kept`` is false for these, and else true if
    the text is within every threshold of ``rules``.
    """
    x = text_statistics(docs, text, carry).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return x.withColumn("kept", ~F.col("base_failed") & compile_rules(RULES if rules is None else rules))
