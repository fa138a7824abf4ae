"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule names a measure and the range it must lie in. All measures are built-in expressions over one
split of the text, so a rule set of any size is one narrow stage: no shuffle, no state, and a lost
task is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import SPACES, SPACE_CLASS, ascii_lower, bind, trimmed, words_of

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in the window that the repetition measure compares.
WINDOW = 8
#: Function words of the languages served. A parameter.
STOP_WORDS = (
    "the be to of and that have with it is in for on as at by this was "
    "le la les de des du et un une est que dans pour pas sur au en il "
    "der die das und ist ein eine zu den von mit im dem nicht sich auf "
    "el los las y del se una por con no su al es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a side of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (
    Rule("short", "n_words", low=20),
    Rule("repeated_words", "repeat_word_pct", high=30),
)
METHOD_RULES = (
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("duplicate_lines", "dup_line_share", high=0.5),
    Rule("bullet_lines", "bullet_line_share", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_share", high=0.3),
)


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more.

    Windows are compared by 64-bit hashes within one text. Places of repeated windows, in order,
    cover ``least(8, distance to the next)`` words each. Sorting makes it n log n for any text.
    """
    size = F.size(words)

    def hashed(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]),
        )

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        steps = F.transform(
            places,
            lambda p, k: F.when(k < last, F.least(F.lit(WINDOW), places[k + 1] - p)).otherwise(F.lit(WINDOW)),
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def doubles(p: Column) -> Column:
            top = F.size(p) - 1
            return F.filter(
                p,
                lambda x, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["g"] == x["g"]))
                | ((k < top) & (p[F.least(k + 1, top)]["g"] == x["g"])),
            )

        places = bind(pairs, lambda p: F.array_sort(F.transform(doubles(p), lambda x: x["i"])))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, bind(places, covered)).otherwise(F.lit(0))

    windows = bind(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(size >= WINDOW, bind(windows, repeated)).otherwise(F.lit(0))


def _measures(stop_words: Sequence[str]) -> list[dict[str, Column]]:
    """Layers of measures; a layer uses those before it."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    stops = F.array(*[F.lit(w) for w in stop_words])
    squeezed = F.translate(text, SPACES, "")
    per_line = F.greatest(F.size(lines), F.lit(1))
    return [
        {"_words": words_of(text), "_lines": F.filter(F.split(text, "\n", -1), lambda x: trimmed(x) != "")},
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(squeezed).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(words).cast("long"),
            # Distinct ones, so that this is a set operation whatever the length.
            "n_stop_words": F.size(F.array_intersect(stops, F.transform(words, ascii_lower))).cast("long"),
            "_bullets": F.size(F.filter(lines, lambda x: F.substring(trimmed(x), 1, 1).isin("-", "*", "•"))),
            "_ellipses": F.size(F.filter(lines, lambda x: trimmed(x).endswith("...") | trimmed(x).endswith("…"))),
        },
        {
            "repeat_word_pct": 100 * F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
            "mean_word_chars": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
            "symbols_per_word": F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / per_line,
            "bullet_line_share": F.col("_bullets") / per_line,
            "ellipsis_line_share": F.col("_ellipses") / per_line,
        },
    ]


def _broken(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a row breaks."""
    checks = []
    for rule in rules:
        value = F.col(rule.measure)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality_rules(
    docs: DataFrame,
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = METHOD_RULES,
    stop_words: Sequence[str] = STOP_WORDS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (``text`` and the columns of ``keep``).

    base_failed: a base rule is broken. kept: no rule at all is. broken: names of broken rules.
    A null text has no words, as an empty or blank one, and so breaks the length rule. Repeated
    rows and null ids get a row each; an empty table gives none. Columns that are neither ``text``
    nor in ``keep`` are not read, so their names do not matter.
    """
    kept_names = list(keep)
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept_names]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")
    )
    for layer in _measures(stop_words):
        df = df.withColumns(layer)
    names = [m for layer in _measures(stop_words) for m in layer if not m.startswith("_")]
    df = df.withColumn("_base", _broken(base)).withColumn("_more", _broken(rules))
    return df.select(
        *[F.col("_row")[c].alias(c) for c in kept_names],
        *names,
        (F.size("_base") > 0).alias("base_failed"),
        ((F.size("_base") == 0) & (F.size("_more") == 0)).alias("kept"),
        F.concat("_base", "_more").alias("broken"),
    )


def passing(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that keep all rules, with all their columns."""
    columns = docs.columns
    judged = quality_rules(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text"),
                           keep=("row",), **settings)
    return judged.where("kept").select("row.*")


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT row_number() OVER () AS r, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM base
), grams AS (
  SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM parts WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), steps AS (
  SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS s FROM twice
), repeats AS (
  SELECT r, sum(s) AS n FROM steps GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_intersect(list_distinct(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))),
      [{', '.join(repr(w) for w in dict.fromkeys(STOP_WORDS))}])) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS ellipses
  FROM parts LEFT JOIN repeats USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR n_symbols / greatest(n_words, 1) > 0.3 OR n_stop_words < 1
    OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR bullets / greatest(n_lines, 1) > 0.9
    OR ellipses / greatest(n_lines, 1) > 0.3) AS kept
FROM measured
"""
