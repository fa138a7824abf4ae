"""Quality scores learnt from preferences (Bradley-Terry) and cut at a quantile.

A document's score is linear in measures of its text. A labelled good document is preferred to a
labelled bad one, and the chance of that preference is the logistic function of the difference of
their scores; weights are fitted by the logistic loss on feature differences of such pairs. The
threshold is the quantile of the scores of all documents that leaves the labelled share of bad ones
below it, and scores are shifted so that the threshold is 0.7.

Measures are built-in expressions, computed once per document and stored: a few numbers a row. The
fit sees a bounded sample of labelled rows (``SAMPLE``, by hash of the id); the share of bad labels
counts all labels, and the quantile and the scores cover all documents. The quantile is exact up to
``RANKS`` / 2 documents, and a ``RANKS``-th of all ranks off at most beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import stored, words_of

#: Labelled documents that the fit sees at most. A parameter, and the bound of what is broadcast and collected.
SAMPLE = 20_000
#: Good documents that each bad one is compared with.
RIVALS = 16
PASS_AT = 0.7
#: Accuracy of the quantile over all documents.
RANKS = 100_000
_RIDGE = 1e-3
_STEPS = 60
_BUCKETS = 1 << 20


def _per(count: Column, of: str) -> Column:
    return count / F.greatest(F.col(of), F.lit(1))


def measures(text: Column) -> dict[str, Column]:
    """Measures of a text. They use _words, _chars and _n, its number of words."""
    return {
        "_words": words_of(text),
        "_chars": F.char_length(text),
        "log_chars": F.log1p(F.col("_chars")),
        "log_words": F.log1p(F.size("_words")),
        "word_chars": F.least(_per(F.col("_chars"), "_n"), F.lit(40)),
        "distinct_words": _per(F.size(F.array_distinct("_words")), "_n"),
        "symbols": _per(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "_n"),
        "exclamations": _per(F.regexp_count(text, F.lit("!")), "_n"),
        "capitals": _per(F.regexp_count(text, F.lit(r"\p{Lu}")), "_chars"),
        "digits": _per(F.regexp_count(text, F.lit(r"\d")), "_chars"),
        "lines": _per(F.regexp_count(text, F.lit("\n")), "_n"),
        "short_words": _per(F.size(F.filter("_words", lambda w: F.char_length(w) <= 3)), "_n"),
    }


NAMES = [
    "log_chars", "log_words", "word_chars", "distinct_words", "symbols", "exclamations", "capitals", "digits", "lines",
    "short_words",
]


def with_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row of ``docs`` (doc_id, text)."""
    text = F.col("_text")
    made = measures(text)
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    base = base.withColumns({"_words": made["_words"], "_chars": made["_chars"]}).withColumn("_n", F.size("_words"))
    return base.select("doc_id", *[made[n].cast("double").alias(n) for n in NAMES])


@dataclass(frozen=True)
class Ranking:
    """score = logistic(bias + weights . measures)."""

    weights: tuple[float, ...]
    bias: float

    def raw(self) -> Column:
        """Weights times measures, before the shift."""
        total = F.lit(0.0)
        for name, weight in zip(NAMES, self.weights):
            total = total + F.col(name) * F.lit(weight)
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.bias) + self.raw())))


def fit_preferences(good: np.ndarray, bad: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of feature differences."""
    both = np.concatenate((good, bad))
    centre, spread = both.mean(0), both.std(0)
    spread[spread < 1e-9] = 1.0
    g, b = (good - centre) / spread, (bad - centre) / spread
    rng = np.random.default_rng(seed)
    left = rng.integers(0, len(g), size=len(b) * RIVALS)
    better = g[left] - np.repeat(b, RIVALS, axis=0)
    w = np.zeros(both.shape[1])
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(np.clip(better @ w, -40, 40)))  # chance that the pair is the wrong way round
        gradient = better.T @ p / len(better) - _RIDGE * w
        curvature = (better * (p * (1 - p))[:, None]).T @ better / len(better) + _RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w / spread


def score_quantile(measured: DataFrame, raw: Column, share: float) -> float:
    """A threshold with ``share`` of all rows below it: midway from the quantile to the next greater score."""
    scores = measured.select(raw.alias("raw"))
    last = scores.agg(F.percentile_approx("raw", F.lit(share), F.lit(RANKS))).first()[0]
    following = scores.where(F.col("raw") > last).agg(F.min("raw")).first()[0]
    return last if following is None else (last + following) / 2


def fit_ranking(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Fits on labels (doc_id, label 0 or 1); other values and null ids are left out, repeated ids count once.

    Without both labels all weights are zero, and every score lies at the threshold's lower side.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").alias("label"))
    )
    known, poor = clean.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    share = min(1.0, 0.95 * sample / max(1, known))
    chosen = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < int(share * _BUCKETS)).limit(sample)
    rows = (
        measured.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` pairs of numbers
        .select("label", F.array(*NAMES).alias("x")).limit(2 * sample).collect()
    )
    good = np.array([r.x for r in rows if r.label == 1], dtype=float)
    bad = np.array([r.x for r in rows if r.label == 0], dtype=float)
    if not len(good) or not len(bad):
        return Ranking((0.0,) * len(NAMES), 0.0)
    found = Ranking(tuple(float(v) for v in fit_preferences(good, bad)), 0.0)
    threshold = score_quantile(measured, found.raw(), poor / known)
    return Ranking(found.weights, float(np.log(PASS_AT / (1 - PASS_AT)) - threshold))


def rank_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs`` (doc_id, text), fitted on ``labels`` (doc_id, label).

    Null texts count as empty; empty ones have a score as all others. Repeated rows and null ids get a
    row each; equal scores fall on one side of the threshold together. Very long texts are measured whole.
    An empty table gives no rows. Only doc_id and text are read.
    """
    measured = stored(with_measures(docs))
    score = fit_ranking(measured, labels, sample).score()
    return measured.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= PASS_AT).cast("int"))
